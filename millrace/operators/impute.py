"""Imputation from other columns: nearest neighbours and chained equations."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.clean import replace
from millrace.operators.neighbours import fill
from millrace.plans.scratch import Scratch
from millrace.plans.stats import fuse, null_count
from millrace.schema import number, numeric_columns, q

def impute_knn(df: DataFrame, n_neighbors: int = 5, exclude: Iterable[str] = ()) -> DataFrame:
    """Missing numbers become the mean of the nearest rows that have them.

    Distance is Euclidean over the columns that both rows have, scaled up for those
    they lack. Every row is a donor, and the nearest are found exactly (`neighbours`);
    rows alike in all numbers are sought once, and as donors kept n_neighbors times.
    Runs jobs and writes intermediate tables. Of donors equally near, the first by their
    numbers, column by column, count.
    """
    columns = numeric_columns(df, exclude)
    gaps = fuse(df, {c: null_count(df, c) for c in columns}) if columns else {}
    holes = [c for c in columns if gaps[c]]
    if not holes:
        return df
    scratch = Scratch(df.sparkSession, "knn")
    base = scratch.save(df)
    hole_at = [columns.index(c) for c in holes]
    x = F.array(*[number(base, c) + F.lit(0.0) for c in columns])  # -0.0 as 0.0
    lacks = F.exists(x, lambda v: v.isNull())
    gives = F.array(*[number(base, c).isNotNull() for c in holes])
    donors = base.where(F.array_contains(gives, True)).groupBy(x.alias("x")).agg(F.least(F.count(F.lit(1)), F.lit(n_neighbors)).alias("n"))
    donors = scratch.save(donors.select("x", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy")).select("x"))
    asked = scratch.save(base.where(lacks).select(x.alias("x")).distinct())
    means = fill(asked, donors, len(columns), hole_at, n_neighbors, scratch)
    wide = means.groupBy(F.col("x").alias("__x")).agg(*[F.max(F.when(F.col("h") == h, F.col("v"))).alias(f"__v{h}") for h in hole_at])
    average = fuse(base, {c: F.avg(number(base, c)) for c in holes})
    names = base.columns
    whole = base.where(~lacks).select(*[number(base, c).alias(c) if c in holes else q(c) for c in names])
    filled = [F.coalesce(number(base, c), F.col(f"__v{columns.index(c)}"), F.lit(average[c])).alias(c) if c in holes else q(c) for c in names]
    return whole.union(base.where(lacks).withColumn("__x", x).join(wide, "__x", "left").select(*filled))


def impute_iterative(df: DataFrame, max_iter: int = 10, seed: int = 42, exclude: Iterable[str] = (), tolerance: float = 1e-3, ridge: float = 1e-6) -> DataFrame:
    """Missing numbers become ridge regressions on the other numbers, round after round.

    A round is one aggregation: the matrix of cross products of all columns, from
    which the small systems of all regressions are solved on the driver. All columns
    of a round are estimated from the previous one. No random numbers are drawn; the
    seed is taken for symmetry with other imputers.
    """
    columns = numeric_columns(df, exclude)
    gaps = fuse(df, {c: null_count(df, c) for c in columns} | {f"m {c}": F.avg(number(df, c)) for c in columns} | {f"s {c}": F.stddev_pop(number(df, c)) for c in columns}) if columns else {}
    holes = [c for c in columns if gaps[c] and gaps[f"m {c}"] is not None]
    if not holes:
        return df
    usable = [c for c in columns if gaps[f"m {c}"] is not None]
    scratch = Scratch(df.sparkSession, "mice")
    base = scratch.save(df)
    place = {c: i for i, c in enumerate(usable)}
    mean, spread = {c: gaps[f"m {c}"] for c in usable}, {c: gaps[f"s {c}"] or 1.0 for c in usable}
    scaled = {c: (number(base, c) - mean[c]) / spread[c] for c in usable}
    # the state: scaled columns (missing as null) and the present estimates of the missing
    state = base.select(*[q(c) for c in df.columns], F.array(*[scaled[c] for c in usable]).alias("__x"), F.array(*[F.coalesce(scaled[c], F.lit(0.0)) for c in usable]).alias("__z"))
    last = None
    for _ in range(max_iter):
        state = scratch.save(state)
        z = [F.col("__z")[i] for i in range(len(usable))]
        wanted = {"n": F.count(F.lit(1))} | {f"{i}": F.sum(z[i]) for i in range(len(usable))} | {f"{i} {j}": F.sum(z[i] * z[j]) for i in range(len(usable)) for j in range(i + 1)}
        s = fuse(state, wanted)
        p = len(usable)
        gram = np.zeros((p + 1, p + 1))
        gram[p, p] = s["n"]
        for i in range(p):
            gram[i, p] = gram[p, i] = s[f"{i}"]
            for j in range(i + 1):
                gram[i, j] = gram[j, i] = s[f"{i} {j}"]
        weights = {}
        for c in holes:
            keep = [i for i in range(p + 1) if i != place[c]]
            a = gram[np.ix_(keep, keep)] + ridge * s["n"] * np.eye(p)
            weights[c] = dict(zip(keep, np.linalg.solve(a, gram[keep, place[c]]).tolist(), strict=True))
        now = np.array([w for c in holes for w in weights[c].values()])
        estimates = []
        for i, c in enumerate(usable):
            if c in weights:
                guess = F.lit(weights[c].get(p, 0.0))
                for j, w in weights[c].items():
                    if j < p:
                        guess = guess + F.lit(w) * z[j]
                estimates.append(F.coalesce(F.col("__x")[i], guess))
            else:
                estimates.append(z[i])
        state = state.select(*[q(c) for c in df.columns], "__x", F.array(*estimates).alias("__z"))
        if last is not None and np.abs(now - last).max() < tolerance:
            break
        last = now
    filled = {c: F.coalesce(number(df, c), F.col("__z")[place[c]] * spread[c] + mean[c]) for c in holes}
    return replace(state, filled).select(*[q(c) for c in df.columns])
