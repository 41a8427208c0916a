"""Settings as nested dictionaries: defaults, files over them, never changed in place."""

from __future__ import annotations

import copy
import json
from pathlib import Path

import yaml

# Default settings.
_DEFAULTS = {
    "cleaning": {
        "missing_strategy": "auto",
        "numeric_strategy": "median",
        "categorical_strategy": "mode",
        "outlier_method": "iforest",
        "outlier_contamination": 0.05,
        "remove_outliers": False,
        "scale_method": "standard",
        "encode_method": "label",
        "balance_method": "oversample",
    },
    "detection": {"outlier_method": "iforest", "contamination": 0.05, "zscore_threshold": 3.0, "imbalance_threshold": 0.3},
    "reporting": {"format": "html", "include_plots": True, "plot_style": "seaborn", "output_dir": "./reports"},
    "logging": {"enabled": True, "level": "INFO", "file": "millrace.log"},
}


def default_config() -> dict:
    return copy.deepcopy(_DEFAULTS)


def merged(over: dict | None) -> dict:
    """The defaults with given settings over them, section by section."""
    out = default_config()
    for section, settings in (over or {}).items():
        if isinstance(settings, dict) and isinstance(out.get(section), dict):
            out[section] = {**out[section], **copy.deepcopy(settings)}
        else:
            out[section] = copy.deepcopy(settings)
    return out


def load_config(path: str | None = None) -> dict:
    if path is None:
        return default_config()
    file = Path(path)
    if not file.exists():
        raise FileNotFoundError(f"Config file not found: {path}")
    text = file.read_text(encoding="utf-8")
    if file.suffix in (".yaml", ".yml"):
        return merged(yaml.safe_load(text) or {})
    if file.suffix == ".json":
        return merged(json.loads(text))
    raise ValueError(f"Unsupported config format: {file.suffix}")


def save_config(config: dict, path: str) -> None:
    file = Path(path)
    if file.suffix in (".yaml", ".yml"):
        file.write_text(yaml.safe_dump(config, sort_keys=False), encoding="utf-8")
    elif file.suffix == ".json":
        file.write_text(json.dumps(config, indent=2), encoding="utf-8")
    else:
        raise ValueError(f"Unsupported config format: {file.suffix}")
