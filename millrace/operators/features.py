"""Feature engineering: products, ratios, bins, row statistics, calendar parts; and the choice of features."""

from __future__ import annotations

import math
from collections.abc import Iterable
from itertools import combinations, combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.timeseries import time_parts
from millrace.plans.stats import fuse, quantiles
from millrace.schema import datetime_columns, number, numeric_columns, q, require, value


def polynomial(df: DataFrame, columns: list[str], degree: int = 2, interaction_only: bool = False, include_bias: bool = False) -> dict[str, Column]:
    """Products of up to `degree` factors, named like 'a^2' and 'a b', lower degrees first."""
    made = {"1": F.lit(1.0)} if include_bias else {}
    choose = combinations if interaction_only else combinations_with_replacement
    for d in range(2, degree + 1):
        for factors in choose(columns, d):
            names = [f"{c}^{factors.count(c)}" if factors.count(c) > 1 else c for c in dict.fromkeys(factors)]
            product = number(df, factors[0])
            for c in factors[1:]:
                product = product * number(df, c)
            made[" ".join(names)] = product
    return made


def row_statistics(df: DataFrame, columns: list[str], operations: Iterable[str]) -> dict[str, Column]:
    """Statistics across columns; missing values are skipped, a sum of none is 0, a deviation needs two values."""
    values = F.filter(F.array(*[number(df, c) for c in columns]), lambda x: x.isNotNull())
    n = F.size(values).cast("double")
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    mean = total / F.nullif(n, F.lit(0.0))
    squares = F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    ordered = F.array_sort(values)
    half = F.floor((F.size(values) - 1) / 2).cast("int")
    known = {
        "sum": total,
        "mean": mean,
        "std": F.sqrt(squares / F.when(n > 1, n - 1)),
        "min": F.array_min(values),
        "max": F.array_max(values),
        "median": (F.get(ordered, half) + F.get(ordered, F.floor(F.size(values) / 2).cast("int"))) / 2,
    }
    unknown = [o for o in operations if o not in known]
    if unknown:
        raise ValueError(f"Unknown operations: {unknown}")
    return {o: known[o] for o in operations}


def bin_edges(df: DataFrame, columns: list[str], n_bins: int, strategy: str) -> dict[str, list[float]]:
    """Inner and outer edges of each column's bins, equal edges once."""
    if strategy not in ("uniform", "quantile", "kmeans"):
        raise ValueError(f"Unknown binning strategy: {strategy}")
    if strategy == "quantile":
        shares = [i / n_bins for i in range(n_bins + 1)]
        found = quantiles(df, {c: number(df, c) for c in columns}, shares)
    else:
        ends = fuse(df, {c: F.array(F.min(number(df, c)), F.max(number(df, c))) for c in columns})
        found = {c: list(np.linspace(*e, n_bins + 1)) if e and e[0] is not None else None for c, e in ends.items()}
        if strategy == "kmeans":
            found = {c: _kmeans_edges(df, c, e) if e else None for c, e in found.items()}
    return {c: [x for i, x in enumerate(e) if i == 0 or x > e[i - 1] + 1e-8] if e else [] for c, e in found.items()}


def _kmeans_edges(df: DataFrame, column: str, edges: list[float], rounds: int = 100) -> list[float]:
    """One-dimensional k-means from evenly spread centres; each round is one aggregation by centre."""
    centres = [(a + b) / 2 for a, b in zip(edges, edges[1:], strict=False)]
    x = number(df, column)
    for _ in range(rounds):
        cuts = [(a + b) / 2 for a, b in zip(centres, centres[1:], strict=False)]
        means = {r["k"]: r["m"] for r in df.where(x.isNotNull()).groupBy(bin_code(x, [-math.inf, *cuts, math.inf]).alias("k")).agg(F.avg(x).alias("m")).collect()}
        new = sorted(means.get(float(i), c) for i, c in enumerate(centres))
        if max(abs(a - b) for a, b in zip(new, centres, strict=True)) <= 1e-9 * max(1.0, abs(edges[-1])):
            break
        centres = new
    return [edges[0], *[(a + b) / 2 for a, b in zip(centres, centres[1:], strict=False)], edges[-1]]


def bin_code(x: Column, edges: list[float]) -> Column:
    """How many inner edges a value has reached, as a double; null stays."""
    code = F.lit(0.0)
    for e in edges[1:-1]:
        code = code + F.when(x >= F.lit(e), 1.0).otherwise(0.0)
    return F.when(x.isNotNull(), code)


def f_scores(df: DataFrame, columns: list[str], target: str, task: str = "classification") -> dict[str, float]:
    """F statistics of one-way analysis of variance, or of the correlation with a numeric target."""
    if task != "classification":
        y = number(df, target)
        s = {}
        for c in columns:
            x = F.when(y.isNotNull(), number(df, c))
            yy = F.when(x.isNotNull(), y)
            s |= {f"n {c}": F.count(yy), f"c {c}": F.covar_samp(x, yy), f"x {c}": F.stddev_samp(x), f"y {c}": F.stddev_samp(yy)}
        s = fuse(df, s)
        out = {}
        for c in columns:
            spread = (s[f"x {c}"] or 0) * (s[f"y {c}"] or 0)
            r = s[f"c {c}"] / spread if spread else math.nan
            out[c] = math.inf if r * r == 1 else r * r / (1 - r * r) * (s[f"n {c}"] - 2)
        return out
    cells = {}
    for c in columns:
        x = number(df, c)
        cells |= {f"n {c}": F.count(x), f"s {c}": F.sum(x), f"q {c}": F.sum(x * x)}
    groups = df.where(value(df, target).isNotNull()).groupBy(q(target)).agg(*[e.alias(f"a{i}") for i, e in enumerate(cells.values())])
    sums = [f"a{i}" for i in range(len(cells))]
    between = [F.sum(F.col(f"a{3 * k + 1}") * F.col(f"a{3 * k + 1}") / F.nullif(F.col(f"a{3 * k}").cast("double"), F.lit(0.0))).alias(f"b{k}") for k in range(len(columns))]
    row = groups.agg(F.count(F.lit(1)).alias("g"), *[F.sum(a).alias(a) for a in sums], *between).first()
    out = {}
    for k, c in enumerate(columns):
        n, s, sq, b, g = row[f"a{3 * k}"], row[f"a{3 * k + 1}"], row[f"a{3 * k + 2}"], row[f"b{k}"], row["g"]
        if not n or n <= g or g < 2:
            out[c] = math.nan
            continue
        among, within = b - s * s / n, sq - b
        out[c] = (among / (g - 1)) / (within / (n - g)) if within > 0 else math.inf if among > 0 else math.nan
    return out


def mutual_information(df: DataFrame, columns: list[str], target: str, task: str = "classification", n_bins: int = 10) -> dict[str, float]:
    """Plug-in mutual information (nats) of quantile-binned features and the target; one shuffle for all features."""
    wanted = [*columns, target] if task != "classification" else columns
    edges = bin_edges(df, wanted, n_bins, "quantile")
    y = bin_code(number(df, target), edges[target]).cast("string") if task != "classification" else value(df, target).cast("string")
    cells = F.array(*[F.struct(F.lit(i).alias("c"), bin_code(number(df, c), edges[c] or [0, 0]).alias("x")) for i, c in enumerate(columns)])
    counts = df.select(y.alias("y"), F.explode(cells).alias("f")).where("y IS NOT NULL AND f.x IS NOT NULL").groupBy("f.c", "f.x", "y").agg(F.count(F.lit(1)).alias("n"))
    by_x = counts.groupBy("c", "x").agg(F.sum("n").alias("nx"))
    by_y = counts.groupBy("c", "y").agg(F.sum("n").alias("ny"))
    total = counts.groupBy("c").agg(F.sum("n").alias("nn"))
    joined = counts.join(by_x, ["c", "x"]).join(by_y, ["c", "y"]).join(total, "c")
    share = F.col("n") / F.col("nn")
    rows = joined.groupBy("c").agg(F.sum(share * F.log(F.col("n") * F.col("nn") / (F.col("nx") * F.col("ny")))).alias("mi")).collect()
    found = {columns[r["c"]]: max(0.0, r["mi"]) for r in rows}
    return {c: found.get(c, 0.0) for c in columns}


def variances(df: DataFrame, columns: list[str]) -> dict[str, float]:
    return {c: v if v is not None else math.nan for c, v in fuse(df, {c: F.var_samp(number(df, c)) for c in columns}).items()}


class FeatureEngine:
    """Chained feature making; the log says which columns each step made."""

    def __init__(self, df: DataFrame, target_column: str | None = None) -> None:
        if not isinstance(df, DataFrame):
            raise TypeError("df must be a Spark DataFrame")
        if df.isEmpty():
            raise ValueError("DataFrame is empty")
        if target_column:
            require(df, target_column)
        self.original = self.df = df
        self.target = target_column
        self.log: list[dict] = []

    def _numeric(self, columns: list[str] | None) -> list[str]:
        if columns is not None:
            require(self.df, *columns)
            return list(columns)
        return numeric_columns(self.df, [self.target] if self.target else [])

    def _add(self, step: str, made: dict[str, Column]) -> DataFrame:
        self.df = self.df.withColumns(made) if made else self.df
        self.log.append({"step": step, "columns": list(made), "n_features": len(made)})
        return self.df

    def create_polynomial_features(self, columns: list[str] | None = None, degree: int = 2, interaction_only: bool = False, include_bias: bool = False) -> DataFrame:
        return self._add("polynomial", polynomial(self.df, self._numeric(columns), degree, interaction_only, include_bias))

    def create_interactions(self, columns: list[str] | None = None, max_interactions: int = 10) -> DataFrame:
        pairs = list(combinations(self._numeric(columns), 2))[:max_interactions]
        return self._add("interactions", {f"{a}_x_{b}": number(self.df, a) * number(self.df, b) for a, b in pairs})

    def create_ratio_features(self, columns: list[str] | None = None, max_ratios: int = 10) -> DataFrame:
        """a / b for ordered pairs whose b is never zero."""
        names = self._numeric(columns)
        zeros = fuse(self.df, {c: F.count_if(number(self.df, c) == 0) for c in names}) if names else {}
        pairs = [(a, b) for a in names for b in names if a != b and not zeros[b]][:max_ratios]
        return self._add("ratios", {f"{a}_div_{b}": number(self.df, a) / number(self.df, b) for a, b in pairs})

    def create_binned_features(self, columns: list[str] | None = None, n_bins: int = 5, strategy: str = "quantile", encode: str = "ordinal") -> DataFrame:
        names = self._numeric(columns)
        if encode not in ("ordinal", "onehot", "onehot-dense"):
            raise ValueError(f"Unknown encoding: {encode}")
        edges = bin_edges(self.df, names, n_bins, strategy)
        made = {}
        for c in names:
            code = bin_code(number(self.df, c), edges[c] or [0.0, 0.0])
            if encode == "ordinal":
                made[f"{c}_binned"] = code
            else:
                made |= {f"{c}_bin_{i}": F.coalesce((code == float(i)).cast("double"), F.lit(0.0)) for i in range(max(1, len(edges[c]) - 1))}
        return self._add("binned", made)

    def create_aggregation_features(self, columns: list[str] | None = None, operations: Iterable[str] = ("sum", "mean", "std")) -> DataFrame:
        return self._add("aggregations", {f"agg_{o}": x for o, x in row_statistics(self.df, self._numeric(columns), list(operations)).items()})

    def create_datetime_features(self, columns: list[str] | None = None, features: Iterable[str] = ("year", "month", "day", "dayofweek", "hour")) -> DataFrame:
        made = {}
        for c in columns if columns is not None else datetime_columns(self.df):
            require(self.df, c)
            kind = self.df.schema[c].dataType
            if not isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType, T.StringType)):
                raise ValueError(f"Column '{c}' is not a date")
            ts = F.try_to_timestamp(q(c)) if isinstance(kind, T.StringType) else q(c).cast("timestamp_ntz")
            made |= {f"{c}_{k}": v.cast("int") for k, v in time_parts(ts, features).items()}
        return self._add("datetime", made)

    def scores(self, method: str = "mutual_info", task: str = "classification") -> dict[str, float]:
        if not self.target:
            raise ValueError("target_column is needed")
        names = numeric_columns(self.df, [self.target])
        if method == "f_test":
            return f_scores(self.df, names, self.target, task)
        if method == "mutual_info":
            return mutual_information(self.df, names, self.target, task)
        return variances(self.df, names)

    def select_features(self, method: str = "mutual_info", k: int = 10, task: str = "classification") -> DataFrame:
        """The k best numeric features with all others and the target; unchanged without a target. NaN ranks last."""
        if not self.target:
            return self.df
        found = self.scores(method, task)
        best = sorted(found, key=lambda c: (math.isnan(found[c]), -found[c] if not math.isnan(found[c]) else 0, c))[:k]
        gone = set(found) - set(best)
        self.df = self.df.select(*[q(c) for c in self.df.columns if c not in gone])
        self.log.append({"step": "selection", "method": method, "columns": best})
        return self.df

    def get_feature_importance(self, task: str = "classification") -> dict[str, float]:
        found = self.scores("mutual_info", task)
        return dict(sorted(found.items(), key=lambda x: (-x[1], x[0])))

    def get_features(self) -> DataFrame:
        return self.df

    def get_feature_log(self) -> list[dict]:
        return self.log

    def get_summary(self) -> dict:
        return {"original_features": len(self.original.columns), "current_features": len(self.df.columns), "new_features": len(self.df.columns) - len(self.original.columns), "steps": len(self.log), "log": self.log}

    def reset(self) -> DataFrame:
        self.df, self.log = self.original, []
        return self.df


def auto_features(df: DataFrame, target_column: str | None = None, max_features: int = 50, include_polynomials: bool = True, include_interactions: bool = True, include_ratios: bool = False, include_aggregations: bool = True, task: str = "classification") -> DataFrame:
    """Interactions, row statistics, ratios and products in turn, then the best max_features if there are more."""
    e = FeatureEngine(df, target_column)
    if include_interactions:
        e.create_interactions()
    if include_aggregations:
        e.create_aggregation_features()
    if include_ratios:
        e.create_ratio_features()
    if include_polynomials:
        e.create_polynomial_features(columns=e._numeric(None)[:max_features], interaction_only=True)
    if target_column and len(e.df.columns) > max_features:
        e.select_features("mutual_info", max_features, task)
    return e.df
