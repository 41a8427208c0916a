"""Cleaning: imputation, scaling, encoding. Each is fitted in few aggregations and applied as expressions."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.plans.scratch import Scratch
from millrace.plans.stats import fuse, modes, null_count, quantiles
from millrace.schema import categorical_columns, number, numeric_columns, q, require, value

#: Dictionaries up to this size become part of the expression; larger ones are joined.
INLINE = 256


def replace(df: DataFrame, changed: dict[str, Column]) -> DataFrame:
    """One projection in which some columns are replaced in place."""
    return df.select(*[changed[c].alias(c) if c in changed else q(c) for c in df.columns])


@dataclass
class Imputer:
    """Fill values for the columns that missed any when fitted."""

    strategy: str = "auto"
    numeric_strategy: str = "median"
    categorical_strategy: str = "mode"
    approx: bool = False
    fills: dict[str, object] = field(default_factory=dict)
    drops: list[str] = field(default_factory=list)

    def _kind(self, df: DataFrame, name: str) -> str:
        numeric = isinstance(df.schema[name].dataType, (T.NumericType, T.BooleanType))
        wanted = self.strategy
        if wanted == "auto":
            wanted = self.numeric_strategy if numeric else self.categorical_strategy
        if wanted in ("drop", "mode") or (numeric and wanted in ("median", "mean")):
            return wanted
        return "zero" if numeric else "empty"

    def fit(self, df: DataFrame, columns: Iterable[str] | None = None) -> Imputer:
        names = list(columns or df.columns)
        require(df, *names)
        missing = fuse(df, {c: null_count(df, c) for c in names})
        kinds = {c: self._kind(df, c) for c in names if missing[c]}
        self.drops = [c for c, k in kinds.items() if k == "drop"]
        rows = df.na.drop(subset=[f"`{c}`" for c in self.drops]) if self.drops else df
        wanted = {c: F.avg(number(rows, c)) for c, k in kinds.items() if k == "mean"}
        middle = quantiles(rows, {c: number(rows, c) for c, k in kinds.items() if k == "median"}, [0.5], self.approx)
        self.fills = (fuse(rows, wanted) if wanted else {}) | {c: v[0] if v else None for c, v in middle.items()}
        most = modes(rows, [c for c, k in kinds.items() if k == "mode"])
        for c, k in kinds.items():
            if k == "mode":
                numeric = isinstance(df.schema[c].dataType, T.NumericType)
                self.fills[c] = most.get(c) if c in most or numeric else ""
            elif k in ("zero", "empty"):
                self.fills[c] = 0 if k == "zero" else ""
        return self

    def apply(self, df: DataFrame) -> DataFrame:
        if self.drops:
            gone = value(df, self.drops[0]).isNull()
            for c in self.drops[1:]:
                gone = gone | value(df, c).isNull()
            df = df.where(~gone)
        changed = {}
        for c, fill in self.fills.items():
            kind = df.schema[c].dataType
            if fill is None:
                continue
            whole = isinstance(kind, T.IntegralType) and isinstance(fill, float) and fill != int(fill)
            target = T.DoubleType() if whole else kind  # a median or mean between two integers makes the column double
            changed[c] = F.coalesce(value(df, c).cast(target), F.lit(fill).try_cast(target))
        return replace(df, changed) if changed else df


def impute_missing(df: DataFrame, strategy: str = "auto", numeric_strategy: str = "median", categorical_strategy: str = "mode") -> DataFrame:
    return Imputer(strategy, numeric_strategy, categorical_strategy).fit(df).apply(df)


@dataclass
class Scaler:
    """z-scores by population deviation, or min-max; constant columns become 0."""

    method: str = "standard"
    stats: dict[str, tuple[float, float]] = field(default_factory=dict)

    def fit(self, df: DataFrame, exclude: Iterable[str] = ()) -> Scaler:
        if self.method not in ("standard", "minmax"):
            raise ValueError(f"Unknown scaling method: {self.method}")
        wanted = {}
        for c in numeric_columns(df, exclude):
            x = number(df, c)
            pair = (F.avg(x), F.stddev_pop(x)) if self.method == "standard" else (F.min(x), F.max(x) - F.min(x))
            wanted |= {f"a {c}": pair[0], f"b {c}": pair[1]}
        s = fuse(df, wanted) if wanted else {}
        self.stats = {k[2:]: (s[k], s[f"b {k[2:]}"] or 1.0) for k in s if k[0] == "a" and s[k] is not None}
        return self

    def apply(self, df: DataFrame) -> DataFrame:
        return replace(df, {c: (number(df, c) - a) / b for c, (a, b) in self.stats.items()}) if self.stats else df


def scale_features(df: DataFrame, method: str = "standard", exclude: Iterable[str] = ()) -> DataFrame:
    return Scaler(method).fit(df, exclude).apply(df)


@dataclass
class Encoder:
    """Label codes in the values' order as text (null is the value 'nan'), or one-hot columns without the first."""

    method: str = "label"
    values: dict[str, list[str]] = field(default_factory=dict)
    large: dict[str, DataFrame] = field(default_factory=dict)

    def fit(self, df: DataFrame, exclude: Iterable[str] = ()) -> Encoder:
        if self.method not in ("label", "onehot"):
            raise ValueError(f"Unknown encoding method: {self.method}")
        for c in categorical_columns(df, exclude):
            known = q(c) if self.method == "onehot" else F.coalesce(q(c), F.lit("nan"))
            distinct = df.select(known.alias("v")).where("v IS NOT NULL").distinct()
            # each value of a one-hot column becomes a column of the plan, however many there are
            some = [r["v"] for r in (distinct if self.method == "onehot" else distinct.limit(INLINE + 1)).collect()]
            if self.method == "onehot" or len(some) <= INLINE:
                self.values[c] = sorted(some, key=lambda s: s.encode("utf-8"))
            else:
                self.large[c] = self._dictionary(distinct)
        return self

    @staticmethod
    def _dictionary(distinct: DataFrame) -> DataFrame:
        """(v, code): numbers in the values' order, by a range sort and the sizes of its parts."""
        from millrace.operators.timeseries import numbered

        return numbered(distinct, [F.col("v")], Scratch(distinct.sparkSession, "codes"), "code").withColumn("code", F.col("code").cast("int"))

    def apply(self, df: DataFrame) -> DataFrame:
        if self.method == "onehot":
            kept = [q(c) for c in df.columns if c not in self.values]
            made = [F.coalesce(q(c) == F.lit(v), F.lit(False)).alias(f"{c}_{v}") for c, vs in self.values.items() for v in vs[1:]]
            return df.select(*kept, *made)
        changed = {}
        for c, vs in self.values.items():
            if vs:
                codes = F.map_from_arrays(F.array(*[F.lit(v) for v in vs]), F.array(*[F.lit(i) for i in range(len(vs))]))
                changed[c] = F.try_element_at(codes, F.coalesce(q(c), F.lit("nan")))
        out = replace(df, changed) if changed else df
        for c, codes in self.large.items():
            names = out.columns
            out = out.withColumn("__v", F.coalesce(q(c), F.lit("nan"))).join(codes.withColumnRenamed("v", "__v"), "__v", "left").select(*[F.col("code").alias(c) if n == c else q(n) for n in names])
        return out


def encode_categorical(df: DataFrame, method: str = "label", exclude: Iterable[str] = ()) -> DataFrame:
    return Encoder(method).fit(df, exclude).apply(df)


def drop_missing(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Rows without null or NaN in the columns (all by default)."""
    return df.na.drop(subset=[f"`{c}`" for c in columns] if columns else None)
