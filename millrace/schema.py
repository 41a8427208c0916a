"""Column classes, missing values and keys: what all operators share."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def q(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    out = set(exclude)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in out]


def categorical_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    out = set(exclude)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in out]


def datetime_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))]


def fractional(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType))


def value(df: DataFrame, name: str) -> Column:
    """The column with NaN as null."""
    return F.nullif(q(name), F.lit(float("nan")).cast(df.schema[name].dataType)) if fractional(df, name) else q(name)


def number(df: DataFrame, name: str) -> Column:
    """The column as double with NaN as null."""
    return value(df, name).cast("double")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Every NaN of the frame as null, in one projection."""
    return df.select(*[value(df, c).alias(c) if fractional(df, c) else q(c) for c in df.columns])


def require(df: DataFrame, *names: str) -> None:
    for name in names:
        if name not in df.columns:
            raise ValueError(f"Column '{name}' not found in DataFrame")


def row_hash(df: DataFrame, seed: int, exclude: Iterable[str] = ()) -> Column:
    """A number that depends on a row's content and the seed alone, not on its partition."""
    out = set(exclude)
    return F.xxhash64(F.lit(seed), *[F.to_json(F.struct(q(f.name))) if isinstance(f.dataType, (T.MapType, T.VariantType)) else q(f.name) for f in df.schema.fields if f.name not in out])
