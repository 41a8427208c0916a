"""Operator 9: exact top-k search by block-at-a-time pruning.

Vectors are quantized to integers, floor(256 x), and scored by their integer
inner product. Queries and candidates are dealt out in chunks, and each pair of
chunks is one task's work: it orders its candidates so that similar ones stand
together, cuts them into blocks (document ranges) with a forward index and the
largest and smallest value of each term, and for each query sums the best that
a block could score over its terms. A query takes its blocks in falling order
of that bound, scores them through their forward index, and stops when the next
bound is below its k-th score; a bound equal to it still counts, for ties go to
the smaller id. Every chunk gives its k best, which are merged by one window
over k rows for each query and chunk. Chunks of queries are large, as every
candidate is sent once for each of them.

Vectors that are null, empty or hold null or non-finite components take no
part; those of different length are compared as if padded with zeros. A vector
is known by its id: rows of the query's id are not its candidates, and repeated
rows of one id count once. Extra columns are ignored; an empty table gives an
empty table; a query without candidates has no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .vectors import finite, matrix

BLOCK = 64
#: Blocks that a query scores between two looks at its bound.
STRIDE = 4
QUERY_CHUNK = 65_536
#: Queries whose bounds are held at once.
SLICE = 1024
CANDIDATE_CHUNK = 32768


def quantized(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    return np.floor(matrix(column, dims) * 256.0)


def search(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, candidate id, score) of each query's k best rows; all values are integers in doubles."""
    _, once = np.unique(ids, return_index=True)
    rows, ids = rows[once], ids[once]
    most = max(np.abs(rows).max(initial=0), np.abs(queries).max(initial=0))
    exact = np.float64 if most * most * rows.shape[1] < 2**52 else object
    planes = np.random.default_rng(5).normal(size=(rows.shape[1], 16))
    order = np.argsort((rows @ planes > 0) @ (1 << np.arange(15, -1, -1)), kind="stable")
    rows, ids = rows[order], ids[order]
    start = np.arange(0, len(ids), BLOCK)
    high, low = np.maximum.reduceat(rows, start), np.minimum.reduceat(rows, start)
    forward = rows.astype(exact) if exact is np.float64 else np.array([[int(x) for x in r] for r in rows], dtype=object)
    asked = queries.astype(exact) if exact is np.float64 else np.array([[int(x) for x in r] for r in queries], dtype=object)
    out: list[list] = [[], [], []]
    for q in range(len(query_ids)):
        if q % SLICE == 0:
            part = queries[q : q + SLICE]
            # rounding of these sums is covered by the slack; inner products themselves are exact
            bounds = np.maximum(part, 0) @ high.T + np.minimum(part, 0) @ low.T
            bounds += np.abs(bounds) * 1e-9
        bound = bounds[q % SLICE]
        turn = np.argsort(-bound, kind="stable")
        best_score, best_id = np.zeros(0, dtype=exact), np.zeros(0, dtype=np.int64)
        for at in range(0, len(turn), STRIDE):
            if len(best_id) == k and bound[turn[at]] < best_score[-1]:
                break
            taken = (start[turn[at : at + STRIDE], None] + np.arange(BLOCK)).ravel()
            taken = taken[taken < len(ids)]
            score = forward[taken] @ asked[q]
            seen = ids[taken]
            fit = seen != query_ids[q]
            if len(best_id) == k:
                fit &= score >= best_score[-1]
            if fit.any():
                score, seen = np.concatenate([best_score, score[fit]]), np.concatenate([best_id, seen[fit]])
                front = np.lexsort((seen, -score))[:k]
                best_score, best_id = score[front], seen[front]
        out[0].extend([query_ids[q]] * len(best_id))
        out[1].extend(best_id.tolist())
        out[2].extend(int(s) for s in best_score)
    return tuple(np.array(x, dtype=np.int64) for x in out)


def top_k(df: DataFrame, is_query: Column, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k best of all other vectors for every query."""
    marked = df.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{vector_column}`").alias("v"), is_query.alias("asks"))
    rows = marked.where(F.col("id").isNotNull() & finite("v")).select("id", "v", F.coalesce("asks", F.lit(False)).alias("asks"))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("q"), F.max(F.size("v")).alias("d")).first()
    dims = size["d"] or 1
    cores = df.sparkSession.sparkContext.defaultParallelism
    across = max(1, -(-size["q"] // QUERY_CHUNK))
    down = max(1, -(-size["n"] // CANDIDATE_CHUNK), min(-(-size["n"] // 1024), 2 * cores))
    candidates = rows.select(F.pmod(F.xxhash64("id"), F.lit(down)).cast("int").alias("c"), F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("r"), "id", "v")
    queries = rows.where("asks").dropDuplicates(["id"]).select(F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("c"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(across)).cast("int").alias("r"), "id", "v")

    def work(asked: pa.Table, offered: pa.Table) -> pa.Table:
        found = ([], [], [])
        if asked.num_rows and offered.num_rows:
            found = search(quantized(asked.column("v"), dims), asked.column("id").to_numpy(), quantized(offered.column("v"), dims), offered.column("id").to_numpy(), k)
        return pa.table({n: pa.array(x, pa.int64()) for n, x in zip(("query_id", "vec_id", "score"), found, strict=True)})

    partial = queries.groupBy("c", "r").cogroup(candidates.groupBy("c", "r")).applyInArrow(work, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return partial.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
