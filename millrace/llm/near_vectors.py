"""Operator 5: near-duplicates among embeddings by sorted projection passes.

Equal vectors form a class, and the rest works on classes. They are centred on
their mean for hashing only, as embeddings share a direction that would make all
signs alike. A pass hashes each vector by a few cross-polytope hashes (which of
some random orthogonal directions it lies nearest to, and on which side) and then
signs of random projections, all in one number; in the order of these numbers
each vector is compared with a window of neighbours, and pairs of the wanted
cosine are linked. Passes are independent, so one range shuffle by (pass, hash)
sorts all of them; the last and first rows of neighbouring partitions meet in a
second step, so a window does not end at a border. Links of all passes are united
into components. Passes run in rounds of a bounded number of rows (ROUND_ROWS, two
passes at least), so that shuffle files take a few times the table's size however
many passes are planned. Direct links are then counted exactly: linked vectors are in one
component by definition, so the members of each component are compared in blocks
of bounded size.

Passes and window are planned for each table (see plan()): they grow with the
number of classes and with the share of the common mean, so that a pair of just
the wanted cosine that nothing else holds together is found with probability
RECALL. A table that fits one window is compared wholly. Pairs are found with a
probability, not for certain, in all larger tables. The block comparison is
quadratic in the size of one component (not of the table) and never leaves its
blocks.

Vectors that are null, empty, zero or hold null or non-finite components link
with nothing and are kept. Vectors of different length are compared as if
padded with zeros. Repeated rows count as vectors. Extra columns are ignored;
an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.components import components, local_forest

from .common import Scratch, small_batches
from .vectors import finite, matrix

#: Probability to find an isolated pair of just the wanted cosine.
RECALL = 0.999
#: Windows are powers of two up to this.
WIDEST = 16_384
#: What hashing, moving and sorting a vector once costs, in comparisons.
PASS_COST = 1000
#: Directions of a cross-polytope hash, at most.
DIRECTIONS = 64
SIGNS = 20
#: Members of a component that one side of a comparison holds, and rows of it that are multiplied at once.
BLOCK = 4096
SLICE = 512
#: Rows of all passes that are shuffled together.
ROUND_ROWS = 20_000_000


def _normal(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(axis=1, keepdims=True)
    x = x / np.where(scale > 0, scale, 1)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _turn(rng: np.random.Generator, dims: int) -> np.ndarray:
    """Some random orthogonal directions."""
    return np.linalg.qr(rng.normal(size=(dims, min(dims, DIRECTIONS))))[0]


def _nearest(y: np.ndarray) -> np.ndarray:
    """Which direction is nearest, counting both sides."""
    at = np.abs(y).argmax(axis=1)
    return 2 * at + (y[np.arange(len(y)), at] > 0)


def centre(vectors: DataFrame, dims: int) -> tuple[int, np.ndarray]:
    """How many vectors there are, and the mean of their directions (rounded, so the order of sums doesn't show)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dims)
        for batch in batches:
            if batch.num_rows:
                n, total = n + batch.num_rows, total + _normal(matrix(batch.column(0), dims)).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tolist()], pa.list_(pa.float64()))], names=["n", "total"])

    n, total = 0, np.zeros(dims)
    for r in vectors.select("v").mapInArrow(run, "n long, total array<double>").toLocalIterator():
        n, total = n + r["n"], total + np.array(r["total"])
    return n, np.round(total / max(n, 1), 6)


def plan(n: int, dims: int, cosine: float, mean: np.ndarray, recall: float = RECALL) -> tuple[int, int]:
    """(passes, window) of least cost that find an isolated pair of this cosine with this probability.

    A pair is found by a pass if it agrees in so many cross-polytope hashes that what
    shares them fits the window twice over. How often it agrees in one is sampled, at
    the cosine that is left of it once the mean is taken out.
    """
    if n <= 4096:
        return 1, max(n, 1)
    left = 1 - (1 - cosine) / max(1 - float(mean @ mean), 1e-9)
    left = min(max(left, 0.1), 1.0)
    rng, agree = np.random.default_rng(5), []
    for _ in range(20):
        a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in rng.normal(size=(2, 500, dims)))
        b = b - (a * b).sum(axis=1, keepdims=True) * a
        b = left * a + math.sqrt(1 - left * left) * b / np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-12)
        turn = _turn(rng, dims)
        agree.append((_nearest(a @ turn) == _nearest(b @ turn)).mean())
    each, sides = min(max(float(np.mean(agree)), 1e-3), 1 - 1e-9), 2 * min(dims, DIRECTIONS)
    best = None
    window = 32
    while window <= WIDEST:
        hashes = max(0, math.ceil(math.log(max(2 * n / window, 1), max(sides, 2))))
        found = min(each**hashes, 1 - 1e-9)
        passes = max(1, math.ceil(math.log(1 - recall) / math.log1p(-found)))
        cost = passes * (PASS_COST + window)
        if best is None or cost < best[0]:
            best = (cost, passes, window)
        window *= 2
    return best[1], best[2]


def directions(dims: int, passes: range, seed: int) -> list[tuple[list[np.ndarray], np.ndarray]]:
    """The random directions of each pass: those of its cross-polytope hashes, and those of its signs."""
    out = []
    for p in passes:
        rng = np.random.default_rng([seed, p])
        hashes = max(1, int(28 / math.log2(2 * min(dims, DIRECTIONS))))
        out.append(([_turn(rng, dims) for _ in range(hashes)], rng.normal(size=(dims, SIGNS))))
    return out


def keys(x: np.ndarray, turns: list[np.ndarray], planes: np.ndarray) -> np.ndarray:
    """The number that a pass sorts by, of centred vectors."""
    key = np.zeros(len(x), dtype=np.int64)
    for turn in turns:
        key = key * (2 * turn.shape[1]) + _nearest(x @ turn)
    return (key << SIGNS) + ((x @ planes > 0) * (1 << np.arange(SIGNS - 1, -1, -1, dtype=np.int64))).sum(axis=1)


def pass_hashes(vectors: DataFrame, dims: int, passes: range, seed: int, mean: np.ndarray) -> DataFrame:
    """(pass, hash, id, v) for every vector and each of these passes."""
    names = ["pass", "hash", "id", "v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn = directions(dims, passes, seed)
        for batch in batches:
            if batch.num_rows:
                x = _normal(matrix(batch.column(1), dims)) - mean
                for p, (turns, planes) in zip(passes, drawn, strict=True):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), p, dtype=np.int32)), pa.array(keys(x, turns, planes)), batch.column(0), batch.column(1)], names=names)

    return vectors.select("id", "v").mapInArrow(run, f"pass int, hash long, id long, v {vectors.schema['v'].dataType.simpleString()}")


def _within(p: np.ndarray, ids: np.ndarray, x: np.ndarray, fresh: int, window: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of the last `fresh` rows with the `window` rows before each, in the same pass."""
    u, v = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    n = len(ids)
    for a in range(n - fresh, n, 256):
        b, low = min(n, a + 256), max(0, a - window)
        i, j = np.nonzero(x[a:b] @ x[low:b].T >= cosine)
        i, j = i + a, j + low
        hit = (j < i) & (i - j <= window) & (p[i] == p[j])
        u.append(ids[i[hit]])
        v.append(ids[j[hit]])
    return np.concatenate(u), np.concatenate(v)


def window_links(hashed: DataFrame, dims: int, window: int, cosine: float, scratch: Scratch, parts: int) -> DataFrame:
    """Links within the window of each vector in the order of its pass; per batch a spanning forest."""
    kind = hashed.schema["v"].dataType.simpleString()
    arrow = pa.list_(pa.float32() if "float" in kind else pa.float64())
    names = ["u", "v", "border", "place", "pass", "id", "x"]

    def edge(border: int, first: int, p: np.ndarray, ids: np.ndarray, x: pa.Array) -> pa.RecordBatch:
        n = len(ids)
        none = pa.nulls(n, pa.int64())
        return pa.RecordBatch.from_arrays([none, none, pa.array(np.full(n, border)), pa.array(np.arange(first, first + n)), pa.array(p.astype(np.int32)), pa.array(ids), x], names=names)

    def forest(u: np.ndarray, v: np.ndarray) -> Iterator[pa.RecordBatch]:
        for b in local_forest([pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])]) if len(u) else ():
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, arrow)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, seen, before = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            p, ids, raw = batch.column(0).to_numpy(), batch.column(2).to_numpy(), batch.column(3).cast(arrow)
            x, fresh = _normal(matrix(raw, dims)), len(ids)
            if seen < window and here:
                k = min(fresh, window - seen)
                yield edge(here, seen, p[:k], ids[:k], raw.slice(0, k))
            seen += fresh
            raws = [raw]
            if before is not None:
                p, ids, x = np.concatenate([before[0], p]), np.concatenate([before[1], ids]), np.concatenate([before[2], x])
                raws = [before[3], raw]
            yield from forest(*_within(p, ids, x, fresh, window, cosine))
            raw = pa.concat_arrays(raws)
            before = (p[-window:], ids[-window:], x[-window:], raw.slice(max(0, len(raw) - window)))
        if before is not None:
            yield edge(here + 1, -len(before[1]), before[0], before[1], before[3])

    def meet(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        p, ids, x = table.column("pass").to_numpy(), table.column("id").to_numpy(), _normal(matrix(table.column("x"), dims))
        u, v = _within(p, ids, x, int((table.column("place").to_numpy() >= 0).sum()), window, cosine)
        return pa.Table.from_batches(local_forest([pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])]))

    ordered = hashed.repartitionByRange(parts, "pass", "hash").sortWithinPartitions("pass", "hash", "id")
    found = scratch.save(ordered.mapInArrow(run, f"u long, v long, border long, place long, pass int, id long, x {kind}"), "windows")
    borders = found.where("border IS NOT NULL").select("border", "place", "pass", "id", "x")
    return found.where("border IS NULL").select("u", "v").unionByName(borders.groupBy("border").applyInArrow(meet, "u long, v long"))


def count_links(members: DataFrame, dims: int, cosine: float) -> DataFrame:
    """(id, links): copies of all vectors linked with each member, for rows (component, id, copies, v)."""
    sizes = members.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    rows = members.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "copies", "v")

    def compare(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        i, j = key[1].as_py(), key[2].as_py()
        block, ids, copies = (table.column(c).to_numpy() for c in ("block", "id", "copies"))
        x = _normal(matrix(table.column("v"), dims))
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        of_left, of_right = np.zeros(len(left), dtype=np.int64), np.zeros(len(right), dtype=np.int64)
        for a in range(0, len(left), SLICE):
            part = left[a : a + SLICE]
            near = x[part] @ x[right].T >= cosine
            if i == j:
                near[np.arange(len(part)), np.arange(a, a + len(part))] = False
            of_left[a : a + SLICE] = near @ copies[right]
            of_right += copies[part] @ near
        if i == j:
            return pa.table({"id": ids[left], "links": of_left})
        return pa.table({"id": np.concatenate([ids[left], ids[right]]), "links": np.concatenate([of_left, of_right])})

    counted = rows.groupBy("component", "i", "j").applyInArrow(compare, "id long, links long")
    return counted.groupBy("id").agg(F.sum("links").alias("links"))


def near_duplicates(df: DataFrame, cosine: float = 0.9, passes: int | None = None, window: int | None = None, seed: int = 11, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """One row for each vector: its id, n_links, component_id, kept. Passes and window are planned if not given."""
    spark = df.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "near-vectors")
    all_rows = df.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{vector_column}`").alias("v"))
    good = all_rows.where(F.col("id").isNotNull() & finite("v") & F.exists("v", lambda x: x != 0))
    dims = good.agg(F.max(F.size("v"))).first()[0] or 1
    classes = scratch.save(good.groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")).select("id", "v", "copies"), "classes")
    n, mean = centre(classes, dims)
    planned = plan(n, dims, cosine, mean)
    passes, window = passes or planned[0], window or planned[1]
    at_once, links = max(2, ROUND_ROWS // max(n, 1)), []
    for first in range(0, passes, at_once):
        some = range(first, min(passes, first + at_once))
        rows = n * len(some)
        # partitions hold several windows, so that a window meets no more than one border
        parts = max(1, min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // 100_000), rows // (4 * window)))
        links.append(window_links(pass_hashes(classes, dims, some, seed, mean), dims, window, cosine, scratch, parts))
        scratch.drop()
    labels = scratch.save(components(reduce(DataFrame.unionByName, links), scratch).withColumnRenamed("node", "id"), "labels")
    members = scratch.save(labels.join(classes, "id"), "members")
    counts = count_links(members, dims, cosine)
    of_class = classes.join(labels, "id", "left").join(counts, "id", "left")
    found = scratch.save(of_class.select("v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "id").alias("c")), "found")
    scratch.drop(classes, labels, members)
    usable = F.when(F.col("id").isNotNull() & finite("v"), F.col("v"))
    return (
        all_rows.withColumn("v", usable)
        .join(found, "v", "left")
        .select(F.col("id").alias(id_column), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col(id_column) == F.col("component_id"), F.lit(True)))
    )
