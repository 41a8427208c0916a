"""Detection: missing values, outliers, class imbalance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.forest import IsolationForest
from millrace.plans.scratch import Scratch
from millrace.plans.stats import fuse, missing_table, null_count, quantiles
from millrace.schema import number, numeric_columns, q, require, value


def detect_missing(df: DataFrame) -> dict[str, dict]:
    """{column: {count, percent, dtype}} of the columns that miss values."""
    types = dict(df.dtypes)
    found = fuse(df, {"": F.count(F.lit(1))} | {c: null_count(df, c) for c in df.columns})
    total = found.pop("")
    return {c: {"count": n, "percent": round(n * 100 / total, 2), "dtype": types[c]} for c, n in found.items() if n}


def summarize_missing(df: DataFrame) -> dict[str, dict]:
    return {c: {"count": x["count"], "percent": x["percent"]} for c, x in detect_missing(df).items()}


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in conditions], F.lit(False))


def zscore_flag(df: DataFrame, columns: list[str], threshold: float, rows: DataFrame | None = None) -> Column:
    """Whether any column lies beyond threshold sample deviations; constant columns flag nothing."""
    wanted = {}
    for c in columns:
        wanted |= {f"m {c}": F.avg(number(df, c)), f"s {c}": F.stddev_samp(number(df, c))}
    s = fuse(df if rows is None else rows, wanted)
    return _any([F.abs((number(df, c) - s[f"m {c}"]) / s[f"s {c}"]) > threshold for c in columns if s[f"s {c}"]])


def iqr_flag(df: DataFrame, columns: list[str], factor: float, rows: DataFrame | None = None, approx: bool = False) -> Column:
    """Whether any column lies beyond factor times the inter-quartile range outside its quartiles."""
    s = quantiles(df if rows is None else rows, {c: number(df, c) for c in columns}, [0.25, 0.75], approx)
    flags = []
    for c in columns:
        if s[c]:
            low, high = s[c]
            reach = factor * (high - low)
            flags.append((number(df, c) < low - reach) | (number(df, c) > high + reach))
    return _any(flags)


def flag_outliers(df: DataFrame, method: str = "iforest", contamination: float = 0.05, threshold: float = 3.0, flag: str = "is_outlier") -> DataFrame:
    """df with a boolean column; rows with a missing number take no part and are not flagged."""
    columns = numeric_columns(df)
    if not columns:
        return df.withColumn(flag, F.lit(False))
    whole = reduce(lambda a, b: a & b, [value(df, c).isNotNull() for c in columns])
    rows = df.where(whole)
    if method == "zscore":
        return df.withColumn(flag, whole & zscore_flag(df, columns, threshold, rows))
    if method == "iqr":
        return df.withColumn(flag, whole & iqr_flag(df, columns, threshold, rows))
    if method != "iforest":
        raise ValueError(f"Unknown method: {method}")
    # scored once: the level and the flags read the saved scores
    scored = Scratch(df.sparkSession, "iforest").save(IsolationForest(columns).fit(rows).score(df, "__score"))
    cut = quantiles(scored, {"cut": F.col("__score")}, [1 - contamination])["cut"]
    return scored.withColumn(flag, F.coalesce(F.col("__score") > F.lit(cut[0] if cut else None), F.lit(False))).drop("__score")


def detect_outliers(df: DataFrame, method: str = "iforest", contamination: float = 0.05, threshold: float = 3.0) -> dict:
    """Counts of outlying rows; an error text where nothing can be said."""
    columns = numeric_columns(df)
    if not columns:
        return {"outlier_count": 0, "error": "No numeric columns found"}
    if method not in ("iforest", "zscore", "iqr"):
        return {"outlier_count": 0, "error": f"Unknown method: {method}"}
    whole = reduce(lambda a, b: a & b, [value(df, c).isNotNull() for c in columns])
    if df.where(whole).isEmpty():
        return {"outlier_count": 0, "error": "No valid data after removing missing values"}
    found = fuse(flag_outliers(df, method, contamination, threshold), {"n": F.count_if("is_outlier"), "rows": F.count_if(whole)})
    return {"method": method, "outlier_count": found["n"], "rows": found["rows"], "percent": round(found["n"] * 100 / found["rows"], 2), "columns": columns}


def class_shares(df: DataFrame, target: str) -> DataFrame:
    """(class, n, share): counts of the target's classes over all rows, nulls in the denominator only."""
    require(df, target)
    counts = df.groupBy(value(df, target).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).where(F.col("class").isNotNull()).select("class", "n", F.bround(F.col("n") / F.col("total"), 4).alias("share"))


def detect_imbalance(df: DataFrame, target: str, threshold: float = 0.3) -> dict:
    """Whether the rarest class falls short of the threshold."""
    if target not in df.columns:
        return {"error": f"Column '{target}' not found"}
    shares = {r["class"]: r["share"] for r in class_shares(df, target).collect()}
    if not shares:
        return {"error": f"Column '{target}' has no values"}
    rare, common = min(shares, key=lambda k: (shares[k], str(k))), max(shares, key=lambda k: (shares[k], str(k)))
    return {
        "is_imbalanced": shares[rare] < threshold,
        "class_distribution": shares,
        "minority_class": rare,
        "majority_class": common,
        "imbalance_ratio": round(shares[rare] / shares[common], 4) if shares[common] else 0.0,
    }


def detect_all(df: DataFrame, target: str | None = None, outlier_method: str = "iforest", contamination: float = 0.05, zscore_threshold: float = 3.0, imbalance_threshold: float = 0.3) -> dict:
    found = {"missing_values": detect_missing(df), "outliers": detect_outliers(df, outlier_method, contamination, zscore_threshold)}
    if target:
        found["class_imbalance"] = detect_imbalance(df, target, imbalance_threshold)
    return found


def remove_outliers(df: DataFrame, flag: str = "is_outlier") -> DataFrame:
    """Rows whose flag is not set, without the flag."""
    return df.where(~F.coalesce(q(flag), F.lit(False))).drop(flag)


def remove_rows(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among keys."""
    return df.join(keys.select(key).distinct(), key, "left_anti")


__all__ = ["class_shares", "detect_all", "detect_imbalance", "detect_missing", "detect_outliers", "flag_outliers", "iqr_flag", "missing_table", "remove_outliers", "remove_rows", "summarize_missing", "zscore_flag"]
