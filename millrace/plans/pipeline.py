"""The tabular pipeline: detect, then impute, drop outliers, encode, scale and balance as one lazy plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.config import load_config, merged
from millrace.operators.balance import balance_classes, smote
from millrace.operators.clean import Encoder, Imputer, Scaler
from millrace.operators.detect import detect_all, detect_imbalance, detect_missing, flag_outliers, remove_outliers
from millrace.operators.impute import impute_iterative, impute_knn
from millrace.plans.stats import fuse
from millrace.schema import categorical_columns, nan_to_null, numeric_columns, require
from millrace.sources.reports import save_report


@dataclass
class FittedPrep:
    """What was learned from one frame, to be applied to that or any other, streams included."""

    imputer: Imputer | None = None
    encoder: Encoder | None = None
    scaler: Scaler | None = None

    def apply(self, df: DataFrame) -> DataFrame:
        for step in (self.imputer, self.encoder, self.scaler):
            if step is not None:
                df = step.apply(df)
        return df


@dataclass
class Prep:
    """A frame with its settings, what was detected, what was done and the cleaned plan."""

    df: DataFrame
    config: dict | None = None
    config_path: str | None = None
    advisor: object | None = None
    log: list[dict] = field(default_factory=list)
    detection_results: dict = field(default_factory=dict)
    cleaned: DataFrame | None = None
    fitted: FittedPrep = field(default_factory=FittedPrep)

    def __post_init__(self) -> None:
        self.original = self.df
        self.df = nan_to_null(self.df)
        self.config = load_config(self.config_path) if self.config_path else merged(self.config)

    def _note(self, action: str, **details: object) -> None:
        self.log.append({"action": action, "details": details, "timestamp": datetime.now().isoformat(timespec="seconds")})

    def detect(self, target: str | None = None) -> dict:
        s = self.config["detection"]
        self.detection_results = detect_all(self.df, target, s["outlier_method"], s["contamination"], s["zscore_threshold"], s["imbalance_threshold"])
        self._note("detect", target=target)
        return self.detection_results

    def clean(self, task: str | None = None, target: str | None = None, use_advanced: bool = False, imputation_method: str | None = None, balance_method: str | None = None) -> tuple[DataFrame, dict]:
        """The cleaned plan and the report. imputation_method: simple, knn or iterative; balance_method: oversample, undersample or smote."""
        if target:
            require(self.df, target)
        s, d = self.config["cleaning"], self.config["detection"]
        if not self.detection_results:
            self.detect(target)
        df, keep = self.df, [target] if target else []
        self.fitted = FittedPrep()
        if s["remove_outliers"]:
            df = remove_outliers(flag_outliers(df, s["outlier_method"], s["outlier_contamination"], d["zscore_threshold"]))
            self._note("remove_outliers", method=s["outlier_method"])
        if self.detection_results["missing_values"]:
            method = imputation_method or ("knn" if use_advanced else "simple")
            if method in ("knn", "iterative"):
                df = (impute_knn if method == "knn" else impute_iterative)(df, exclude=keep)
            elif method != "simple":
                raise ValueError(f"Unknown imputation method: {method}")
            self.fitted.imputer = Imputer(s["missing_strategy"], s["numeric_strategy"], s["categorical_strategy"]).fit(df)
            df = self.fitted.imputer.apply(df)
            self._note("impute_missing", method=method, columns=list(self.detection_results["missing_values"]))
        if names := categorical_columns(df, keep):
            self.fitted.encoder = Encoder(s["encode_method"]).fit(df, keep)
            df = self.fitted.encoder.apply(df)
            self._note("encode_categorical", method=s["encode_method"], columns=names)
        if names := numeric_columns(df, keep):
            self.fitted.scaler = Scaler(s["scale_method"]).fit(df, keep)
            df = self.fitted.scaler.apply(df)
            self._note("scale_features", method=s["scale_method"], columns=names)
        if task == "classification" and target:
            found = self.detection_results.get("class_imbalance") or detect_imbalance(self.df, target, d["imbalance_threshold"])
            if found.get("is_imbalanced"):
                method = balance_method or s["balance_method"]
                df = smote(df, target) if method == "smote" else balance_classes(df, target, method)
                self._note("balance_classes", method=method)
        self.cleaned = df
        return df, self.report(include_plots=False)

    def summary(self) -> dict:
        return {
            "shape": [fuse(self.df, {"n": F.count(F.lit(1))})["n"], len(self.df.columns)],
            "columns": self.df.columns,
            "dtypes": dict(self.df.dtypes),
            "missing_values": detect_missing(self.df),
            "numeric_columns": numeric_columns(self.df),
            "categorical_columns": categorical_columns(self.df),
        }

    def report(self, include_plots: bool = True) -> dict:
        from millrace.sources.charts import all_charts

        rows = fuse(self.df, {"n": F.count(F.lit(1))})["n"]
        after = None if self.cleaned is None else [fuse(self.cleaned, {"n": F.count(F.lit(1))})["n"], len(self.cleaned.columns)]
        out = {"timestamp": datetime.now().isoformat(timespec="seconds"), "original_shape": [rows, len(self.df.columns)], "cleaned_shape": after, "detection_results": self.detection_results, "logs": self.log}
        return out | ({"plots": all_charts(self.df)} if include_plots else {})

    def save_report(self, path: str, include_plots: bool | None = None) -> None:
        save_report(self.report(self.config["reporting"]["include_plots"] if include_plots is None else include_plots), path)

    # advice, if an advisor was given

    def _ask(self, how: Callable) -> object:
        return how(self.advisor) if self.advisor is not None else "No advisor is set."

    def get_suggestions(self, column: str | None = None, issue: str = "missing") -> object:
        return self._ask(lambda a: a.suggest_fix(self.df, column, issue))

    def analyze_with_advisor(self, task: str = "classification", target: str | None = None) -> object:
        return self._ask(lambda a: a.analyze_dataframe(self.df, task, target))

    def get_feature_suggestions(self, task: str = "classification", target: str | None = None) -> object:
        return self._ask(lambda a: a.suggest_features(self.df, task, target))

    def explain_step(self, step: str, details: dict | None = None) -> object:
        return self._ask(lambda a: a.explain_cleaning_step(step, details or {}))
