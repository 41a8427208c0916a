"""Fused statistics: whatever a pipeline wants to know of a frame, in as few jobs as can be.

Every statistic is a named aggregate expression. fuse() runs all of them as one
aggregation, so the frame is scanned once; frames of thousands of columns are
cut into a few scans, to keep generated code in its limits.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.schema import number, q, value

AT_ONCE = 400
#: Quantiles: relative rank error of a sketch is 1 / ACCURACY; a bracket reaches so far to both sides; so many rows are listed by value.
ACCURACY = 10_000
MARGIN = 2 / ACCURACY
FEW = 20_000


def fuse(df: DataFrame, wanted: dict) -> dict:
    """name -> value of each aggregate expression."""
    found: dict = {}
    names = list(wanted)
    for at in range(0, len(names), AT_ONCE):
        part = names[at : at + AT_ONCE]
        row = df.agg(*[wanted[n].alias(f"s{i}") for i, n in enumerate(part)]).first()
        found.update(zip(part, row, strict=True))
    return found


def quantiles(df: DataFrame, columns: dict[str, Column], shares: list[float], approx: bool = False) -> dict[str, list[float] | None]:
    """name -> linear-interpolation quantiles of each column of numbers; None for a column without values.

    Exact, with bounded memory at any number of distinct values: a sketch brackets each
    wanted rank, one scan counts the values at and between the brackets' ends, and what
    lies between is bracketed anew until few enough values are left to be listed by
    value. Two to four scans as a rule, no shuffle of the column. approx: the sketch alone.
    """
    if not columns:
        return {}
    if approx:
        return {c: list(v) if v else None for c, v in fuse(df, {c: F.percentile_approx(x, shares, 100_000) for c, x in columns.items()}).items()}
    probes = sorted({min(1.0, max(0.0, p + d)) for p in shares for d in (-MARGIN, MARGIN)})
    found = fuse(df, {f"n{c}": F.count(x) for c, x in columns.items()} | {f"p{c}": F.percentile_approx(x, probes, ACCURACY) for c, x in columns.items()})
    known: dict[tuple[str, int], float] = {}
    open_ranks: dict[tuple[str, int], tuple[float | None, float | None, int, int]] = {}  # between (exclusive), rank there, rows there
    brackets: dict[tuple[str, int], tuple[float, float]] = {}
    for c in columns:
        n = found[f"n{c}"]
        for p in shares if n else []:
            for k in (math.floor(p * (n - 1)), math.ceil(p * (n - 1))):
                open_ranks[c, k] = (None, None, k, n)
                near = dict(zip(probes, found[f"p{c}"], strict=True))
                brackets[c, k] = (near[min(1.0, max(0.0, p - MARGIN))], near[min(1.0, max(0.0, p + MARGIN))])
    while open_ranks:
        few = {r: t for r, t in open_ranks.items() if t[3] <= FEW}
        known |= _listed(df, columns, few)
        open_ranks = {r: t for r, t in open_ranks.items() if r not in few}
        if not open_ranks:
            break
        if not brackets:
            ask = {r: [min(1.0, max(0.0, k / t + d)) for d in (-MARGIN, MARGIN)] for r, (_, _, k, t) in open_ranks.items()}
            brackets = {r: tuple(v) for r, v in fuse(df, {r: F.percentile_approx(_between(columns[r[0]], *open_ranks[r][:2]), ask[r], ACCURACY) for r in open_ranks}).items()}
        wanted = {}
        for r, (a, b, _, _) in open_ranks.items():
            x, (low, high) = _between(columns[r[0]], a, b), brackets[r]
            wanted |= {("<", r): F.count_if(x < low), ("=", r): F.count_if(x == low), ("in", r): F.count_if((x > low) & (x < high)), (">", r): F.count_if(x == high) if high > low else F.lit(0)}
        counts, left = fuse(df, wanted), {}
        for r, (a, b, k, n) in open_ranks.items():
            low, high = brackets[r]
            below, at, inside, over = (counts[s, r] for s in ("<", "=", "in", ">"))
            if k < below:
                left[r] = (a, low, k, below)
            elif k < below + at:
                known[r] = low
            elif k < below + at + inside:
                left[r] = (low, high, k - below - at, inside)
            elif k < below + at + inside + over:
                known[r] = high
            else:
                left[r] = (high, b, k - below - at - inside - over, n - below - at - inside - over)
        open_ranks, brackets = left, {}

    def share(c: str, p: float) -> float:
        at = p * (found[f"n{c}"] - 1)
        low, high = known[c, math.floor(at)], known[c, math.ceil(at)]
        return low + (high - low) * (at - math.floor(at)) if high > low else low

    return {c: [share(c, p) for p in shares] if found[f"n{c}"] else None for c in columns}


def _between(x: Column, low: float | None, high: float | None) -> Column:
    if low is not None:
        x = F.when(x > F.lit(low), x)
    return F.when(x < F.lit(high), x) if high is not None else x


def _listed(df: DataFrame, columns: dict[str, Column], ranks: dict[tuple[str, int], tuple]) -> dict[tuple[str, int], float]:
    """The value at each rank of an interval that holds at most FEW rows."""
    spans = sorted({(c, a, b) for (c, _), (a, b, _, _) in ranks.items()}, key=str)
    if not spans:
        return {}
    cells = F.filter(F.array(*[F.struct(F.lit(i).alias("i"), _between(columns[c], a, b).cast("double").alias("v")) for i, (c, a, b) in enumerate(spans)]), lambda s: s["v"].isNotNull())
    rows = df.select(F.explode(cells).alias("s")).groupBy("s.i", "s.v").agg(F.count(F.lit(1)).alias("n")).collect()
    out = {}
    lists: list[list[tuple[float, int]]] = [[] for _ in spans]
    for r in rows:
        lists[r["i"]].append((r["v"], r["n"]))
    for x in lists:
        x.sort()
    for (c, rank), (a, b, k, _) in ranks.items():
        for v, n in lists[spans.index((c, a, b))]:
            if k < n:
                out[c, rank] = v
                break
            k -= n
    return out


def null_count(df: DataFrame, name: str) -> Column:
    return F.count_if(value(df, name).isNull())


def moments(df: DataFrame, name: str) -> dict[str, Column]:
    x = number(df, name)
    return {"count": F.count(x), "mean": F.avg(x), "std": F.stddev_samp(x), "min": F.min(x), "max": F.max(x)}


def skewness(x: Column) -> Column:
    """Bias-corrected skewness; null for fewer than three values, 0 for constant ones."""
    n, g = F.count(x).cast("double"), F.coalesce(F.skewness(x), F.lit(float("nan")))
    constant = F.min(x) == F.max(x)
    return F.when(n < 3, F.lit(None)).when(constant, F.lit(0.0)).otherwise(g * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))


def kurtosis(x: Column) -> Column:
    """Bias-corrected excess kurtosis; null for fewer than four values, 0 for constant ones."""
    n, g = F.count(x).cast("double"), F.coalesce(F.kurtosis(x), F.lit(float("nan")))
    constant = F.min(x) == F.max(x)
    scale = (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0))
    return F.when(n < 4, F.lit(None)).when(constant, F.lit(0.0)).otherwise(scale * ((n + 1) * g + 6))


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation over rows where both are there; null where one is constant."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    return F.covar_samp(x, y) / F.nullif(F.stddev_samp(x) * F.stddev_samp(y), F.lit(0.0))


def value_counts(df: DataFrame, names: list[str]) -> DataFrame:
    """(column, value, n): counts of all non-null values of the columns, as text, in one shuffle."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), value(df, c).cast("string").alias("value")) for c in names])
    long = df.select(F.explode(cells).alias("cell")).select("cell.column", "cell.value")
    return long.where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def modes(df: DataFrame, names: list[str]) -> dict[str, str]:
    """The most frequent value of each column, as text; the smallest of equals. Columns without values are left out.

    Values are compared in their own order: ties of numbers go by number.
    """
    if not names:
        return {}
    numeric = {f.name for f in df.schema.fields if f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double", "decimal")}
    order = F.when(F.col("column").isin(*sorted(numeric & set(names)) or [""]), F.expr("try_cast(value AS double)"))
    best = value_counts(df, names).groupBy("column").agg(F.min_by("value", F.struct(-F.col("n"), order, F.col("value"))).alias("value"))
    return {r["column"]: r["value"] for r in best.collect()}


def missing_table(df: DataFrame) -> DataFrame:
    """(column, count, percent, dtype) of the columns with missing values; one row for each column, in one scan."""
    total = F.count(F.lit(1))
    row = df.agg(F.array(*[F.struct(F.lit(c).alias("column"), null_count(df, c).alias("count"), F.lit(t).alias("dtype")) for c, t in df.dtypes]).alias("cells"), total.alias("total"))
    cells = row.select(F.explode("cells").alias("cell"), "total").select("cell.*", "total").where(F.col("count") > 0)
    return cells.select("column", F.col("count"), F.bround(F.col("count") * 100 / F.col("total"), 2).alias("percent"), "dtype")


__all__ = ["correlation", "fuse", "kurtosis", "missing_table", "modes", "moments", "null_count", "q", "quantiles", "skewness", "value_counts"]
