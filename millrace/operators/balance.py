"""Class balancing: over- and undersampling with exact class counts, and synthetic minority rows.

Rows are picked by the order of a hash of their content, so a result depends on
rows and seed only. An exact number of each class is found without sorting a
class: counts of hash buckets say which buckets are in wholly, and only the one
bucket of a class that is in partly is ranked.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.plans.scratch import Scratch
from millrace.schema import number, numeric_columns, q, require, row_hash, value

BUCKETS = 1024
#: Rows of a chunk in the search for neighbours, and bases of a chunk; rows are sent once for each of the latter.
CHUNK = 8192
BASES = 65_536


def class_counts(df: DataFrame, target: str) -> dict[object, int]:
    require(df, target)
    return {r["c"]: r["n"] for r in df.where(value(df, target).isNotNull()).groupBy(q(target).alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()}


def pick(df: DataFrame, target: str, wanted: dict[object, int], seed: int) -> DataFrame:
    """df with a boolean column __picked: exactly wanted[c] rows of each class c (all, if it has fewer)."""
    hashed = df.withColumn("__h", row_hash(df, seed)).withColumn("__b", F.pmod(F.shiftrightunsigned("__h", 17), F.lit(BUCKETS)))
    sizes: dict[object, dict[int, int]] = {}
    for r in hashed.groupBy(q(target).alias("c"), "__b").agg(F.count(F.lit(1)).alias("n")).collect():
        sizes.setdefault(r["c"], {})[r["__b"]] = r["n"]
    whole: Column = F.lit(False)  # buckets that are in wholly
    edge: Column = F.lit(False)
    room: Column = F.lit(0)
    for c, n in wanted.items():
        left, cut = n, BUCKETS
        for b in range(BUCKETS):
            here = sizes.get(c, {}).get(b, 0)
            if here > left:
                cut = b
                break
            left -= here
        mine = q(target) == F.lit(c)
        whole = whole | (mine & (F.col("__b") < cut))
        edge = edge | (mine & (F.col("__b") == cut))
        room = F.when(mine, F.lit(left)).otherwise(room)
    edge = F.coalesce(edge, F.lit(False))
    names = [q(c) for c in df.columns]
    plain = hashed.where(~edge).select(*names, F.coalesce(whole, F.lit(False)).alias("__picked"))
    rank = F.row_number().over(Window.partitionBy(q(target), "__b").orderBy("__h"))
    ranked = hashed.where(edge).withColumn("__r", rank).select(*names, (F.col("__r") <= room).alias("__picked"))
    return plain.unionByName(ranked)


def balance_classes(df: DataFrame, target: str, method: str = "oversample", seed: int = 42) -> DataFrame:
    """Every class as frequent as the most (oversample) or least frequent one; rows without class go."""
    counts = class_counts(df, target)
    rows = df.where(value(df, target).isNotNull())
    if method == "undersample":
        least = min(counts.values(), default=0)
        return pick(rows, target, {c: least for c in counts}, seed).where("__picked").drop("__picked")
    if method != "oversample":
        raise ValueError(f"Unknown balancing method: {method}")
    most = max(counts.values(), default=0)
    times: Column = F.lit(1)
    for c, n in counts.items():
        times = F.when(q(target) == F.lit(c), F.lit(most // n)).otherwise(times)
    picked = pick(rows, target, {c: most % n for c, n in counts.items()}, seed)
    copies = F.sequence(F.lit(1), times + F.col("__picked").cast("int"))
    return picked.withColumn("__copy", F.explode(copies)).drop("__copy", "__picked")


def nearest_rows(rows: DataFrame, bases: DataFrame, n_rows: int, n_bases: int, width: int, k: int) -> DataFrame:
    """(id, near): the x of the k other rows nearest to each base, for rows (id, x, h, ...); bases are some of the rows.

    Rows and bases meet chunk by chunk, and the best of all chunk pairs are merged, so
    no task holds more than two chunks. Ties are broken by h, then by x.
    """
    down, across = max(1, -(-n_rows // CHUNK)), max(1, -(-n_bases // BASES))
    given = rows.select(F.pmod(F.xxhash64("id"), F.lit(down)).alias("d"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(across - 1).cast("long"))).alias("r"), "id", "x", "h")
    asked = bases.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(down - 1).cast("long"))).alias("d"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(across)).alias("r"), "id", "x")

    def compare(asked: pa.Table, given: pa.Table) -> pa.Table:
        table = lambda t: np.array(t.column("x").to_pylist(), dtype=np.float64).reshape(t.num_rows, width)
        found: list[list] = [[], [], [], []]
        if asked.num_rows and given.num_rows:
            pool, ids, h = table(given), given.column("id").to_numpy(), given.column("h").to_numpy()
            for base, x in zip(asked.column("id").to_pylist(), table(asked), strict=True):
                apart = ((pool - x) ** 2).sum(axis=1)
                apart[np.isnan(apart)] = np.inf
                apart[ids == base] = np.nan  # sorts last; never its own neighbour
                able = np.flatnonzero(apart <= np.partition(apart, k - 1)[k - 1]) if len(apart) > k else np.flatnonzero(~np.isnan(apart))
                for i in able[np.lexsort((*pool[able].T[::-1], h[able], apart[able]))[:k]]:
                    for column, v in zip(found, (base, float(apart[i]), int(h[i]), pool[i].tolist()), strict=True):
                        column.append(v)
        kinds = (pa.int64(), pa.float64(), pa.int64(), pa.list_(pa.float64()))
        return pa.table({name: pa.array(v, t) for name, v, t in zip(("id", "apart", "h", "x"), found, kinds, strict=True)})

    found = asked.groupBy("d", "r").cogroup(given.groupBy("d", "r")).applyInArrow(compare, "id long, apart double, h long, x array<double>")
    best = F.slice(F.sort_array(F.collect_list(F.struct("apart", "h", "x"))), 1, k)  # k rows for each chunk pair
    return found.groupBy("id").agg(F.transform(best, lambda b: b["x"]).alias("near"))


def smote(df: DataFrame, target: str, sampling_strategy: str | float = "auto", k_neighbors: int = 5, seed: int = 42) -> DataFrame:
    """Synthetic rows between minority rows and their nearest neighbours of the same class.

    auto: all classes but the largest reach its size; 'minority': only the rarest; a
    number: two classes, minority/majority. Every row of a class may be a base, and
    neighbours are sought among all its other rows.
    """
    require(df, target)
    columns = numeric_columns(df, [target])
    others = [c for c in df.columns if c not in columns and c != target]
    if others:
        raise ValueError(f"SMOTE balancing failed: non-numeric features {others}")
    rows = df.where(value(df, target).isNotNull())
    counts = class_counts(df, target)
    most = max(counts.values(), default=0)
    rare = min(counts, key=lambda c: (counts[c], str(c)), default=None)
    if sampling_strategy == "auto":
        goal = {c: most for c in counts if counts[c] < most}
    elif sampling_strategy == "minority":
        goal = {rare: most} if counts.get(rare, 0) < most else {}
    elif isinstance(sampling_strategy, (int, float)):
        if len(counts) != 2:
            raise ValueError("SMOTE balancing failed: a ratio needs two classes")
        goal = {rare: max(counts[rare], int(sampling_strategy * most))}
    else:
        raise ValueError(f"SMOTE balancing failed: unknown strategy {sampling_strategy!r}")
    made, scratch = [rows], Scratch(df.sparkSession, "smote")
    for c, size in goal.items():
        n = counts[c]
        if n <= k_neighbors:
            raise ValueError(f"SMOTE balancing failed: class {c!r} has {n} rows, more than {k_neighbors} are needed")
        own = rows.where(q(target) == F.lit(c))
        times = (size - n) // n
        picked = pick(own, target, {c: (size - n) % n}, seed)
        keyed = scratch.save(picked.select(F.monotonically_increasing_id().alias("id"), F.array(*[number(own, x) for x in columns]).alias("x"), row_hash(own, seed).alias("h"), (F.lit(times) + F.col("__picked").cast("int")).alias("copies")))
        bases = keyed.where("copies > 0")
        near = nearest_rows(keyed, bases, n, n if times else (size - n) % n, len(columns), k_neighbors)
        based = bases.join(near, "id").select("x", "h", "copies", "near")

        def run(batches):
            for batch in batches:
                out = []
                for x, h, copies, pool in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                    x, pool = np.array(x, dtype=np.float64), np.array(pool, dtype=np.float64)
                    for copy in range(1, copies + 1):
                        rng = np.random.default_rng([abs(h), copy, seed])
                        out.append(x + rng.random() * (pool[rng.choice(len(pool))] - x))
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.float64()))], names=["x"])

        fresh = based.mapInArrow(run, "x array<double>")
        cells = [F.lit(c).cast(df.schema[target].dataType).alias(target) if name == target else F.col("x")[columns.index(name)].cast(df.schema[name].dataType if not str(df.schema[name].dataType).startswith(("Int", "Long", "Short", "Byte")) else "double").alias(name) for name in df.columns]
        made.append(fresh.select(*cells))
    out = made[0].select(*[q(c).cast("double").alias(c) if c in columns else q(c) for c in df.columns])
    for more in made[1:]:
        out = out.unionByName(more.select(*[q(c).cast("double").alias(c) if c in columns else q(c) for c in df.columns]))
    return out


def shuffle_rows(df: DataFrame, seed: int = 42) -> DataFrame:
    """All rows in an order that depends on their content and the seed alone: a range sort by hash."""
    return df.withColumn("__h", row_hash(df, seed)).orderBy("__h").drop("__h")


def share_of(total: int, share: float) -> int:
    """total * share rounded down, with the share as it is written: 0.7 of 90,000 is 63,000, which doubles miss by a hair."""
    simple = Fraction(share).limit_denominator(10**6)  # also 1/3
    return int(total * (simple if float(simple) == float(share) else Fraction(repr(float(share)))))


def split_rows(df: DataFrame, shares: tuple[float, ...] = (0.7, 0.15, 0.15), seed: int = 42) -> list[DataFrame]:
    """Disjoint parts of exact sizes (rounded down; the rest goes to the last), by hash order. Writes intermediate tables."""
    if abs(sum(shares) - 1) > 1e-6:
        raise ValueError("shares must sum to 1")
    scratch = Scratch(df.sparkSession, "split")
    marked = scratch.save(df.withColumn("__all", F.lit(0)))
    total = marked.count()
    parts, rest = [], marked
    for k, share in enumerate(shares[:-1]):
        chosen = scratch.save(pick(rest, "__all", {0: share_of(total, share)}, seed + k))
        parts.append(chosen.where("__picked").drop("__picked", "__all"))
        rest = chosen.where("NOT __picked").drop("__picked")
    return [*parts, rest.drop("__all")]
