"""Pieces that the operators of this subpackage share.

Everything here is either a thin layer over Spark or numpy code that works on a
whole Arrow batch at once. Intermediate tables are written by Scratch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from millrace.plans.scratch import Scratch

#: Characters that one numpy step handles; a longer text is a step of its own.
STEP_CHARS = 250_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession, rows: int = 2000, size: str = "8m") -> None:
    """Keep Arrow batches small, in rows and bytes, on both sides of the pipe; a longer text is a batch of its own."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def steps(sizes: list[int], limit: int = STEP_CHARS) -> Iterator[tuple[int, int]]:
    """Split positions 0..n into runs whose sizes sum to at most limit (one position at least)."""
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if len(sizes) > start:
        yield start, len(sizes)


def strings(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """Texts of an Arrow column; null is the empty text."""
    return [x or "" for x in column.to_pylist()]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without copying, and offsets (one more than rows); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if large else np.int32, count=len(column) + 1, offset=column.offset * (8 if large else 4)).astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def free_name(name: str, taken: list[str]) -> str:
    """The name, with underscores after it if a column is called so already."""
    while name in taken:
        name += "_"
    return name


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (multiply and xor-shift)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[int, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """base**0 .. base**n modulo 2**64, or those of its inverse; kept between calls."""
    have = _POWERS.get(inverse)
    if have is None or len(have) <= n:
        base = pow(_BASE, -1, 1 << 64) if inverse else _BASE
        size = max(n + 1, 1 << 16)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 1 << 20:
            _POWERS[inverse] = have
    return have[: n + 1]


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of values[start:end] for all spans at once, by prefix sums of a polynomial."""
    n = len(values)
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values * powers(n)[:n], out=prefix[1:])
    return mix64((prefix[end] - prefix[start]) * powers(n, True)[start] + (end - start).astype(np.uint64))


def expand(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices start[0]..start[0]+length[0]-1, start[1].., one after the other."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    first = np.cumsum(length) - length
    return np.repeat(start - first, length) + np.arange(total)


__all__ = ["STEP_CHARS", "Scratch", "expand", "free_name", "mix64", "powers", "read", "small_batches", "span_hashes", "steps", "strings", "utf8"]
