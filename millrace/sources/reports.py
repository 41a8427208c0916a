"""Reports as JSON and HTML."""

from __future__ import annotations

import json
from datetime import datetime
from html import escape


def json_report(report: dict) -> str:
    """The report as JSON; charts are only named."""
    shown = {k: ({n: "<chart>" for n in v} if k == "plots" and isinstance(v, dict) else v) for k, v in report.items()}
    return json.dumps(shown, default=str, indent=2)


def _table(rows: list[tuple]) -> str:
    return "<table>" + "".join("<tr>" + "".join(f"<td>{escape(str(x))}</td>" for x in r) + "</tr>" for r in rows) + "</table>"


def _section(title: str, body: str) -> str:
    return f"<h2>{escape(title)}</h2>{body}"


def _nested(value: object) -> str:
    if isinstance(value, dict):
        return "<table>" + "".join(f"<tr><th>{escape(str(k))}</th><td>{_nested(v)}</td></tr>" for k, v in value.items()) + "</table>"
    if isinstance(value, (list, tuple)):
        return "<ul>" + "".join(f"<li>{_nested(v)}</li>" for v in value) + "</ul>"
    return escape(str(value))


def _page(title: str, body: str) -> str:
    style = "body{font-family:sans-serif;margin:2em}td,th{border:1px solid #ccc;padding:.2em .6em;text-align:left}table{border-collapse:collapse}"
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{escape(title)}</title><style>{style}</style></head><body><h1>{escape(title)}</h1>{body}</body></html>"


def html_report(report: dict, title: str = "Data preparation report") -> str:
    """Detailed for tables (detection results, charts), plain for other reports."""
    shown = {"timestamp": datetime.now().isoformat(timespec="seconds")} | report
    parts = [f"<p>{escape(str(shown.pop('timestamp')))}</p>"]
    plots = shown.pop("plots", {}) or {}
    logs = shown.pop("logs", []) or []
    for key, value in shown.items():
        parts.append(_section(key.replace("_", " ").capitalize(), _nested(value)))
    for name, data in plots.items():
        parts.append(_section(f"Chart: {name}", f'<img alt="{escape(name)}" src="data:image/svg+xml;base64,{data}">'))
    if logs:
        parts.append(_section("Steps", _table([(i + 1, x.get("action", x.get("step", "")), {k: v for k, v in x.items() if k not in ("action", "step")}) for i, x in enumerate(logs)])))
    return _page(title, "".join(parts))


def profile_html(results: dict, insights: list[str], title: str) -> str:
    body = _section("Insights", "<ul>" + "".join(f"<li>{escape(x)}</li>" for x in insights) + "</ul>")
    for key in ("basic_stats", "missing_values", "outliers", "correlations", "categorical", "distributions", "data_info"):
        if results.get(key):
            body += _section(key.replace("_", " ").capitalize(), _nested(results[key]))
    return _page(title, body)


def save_report(report: dict, path: str, title: str = "Data preparation report") -> None:
    if path.endswith(".json"):
        text = json_report(report)
    elif path.endswith(".html"):
        text = html_report(report, title)
    else:
        raise ValueError("Report path must end in .json or .html")
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
