"""Operator 4: substring dedup by content-defined chunking.

A gear hash rolls over the bytes of each text (32 bits, a window of 16 bytes,
computed for a whole batch by doubling), and a text is cut after white space
where the hash says so, on average after every fourth word. Within words longer
than 64 bytes (text without ASCII white space, such as Chinese, or base64) it is
also cut between characters where the hash says so. Where neither cuts for 512
bytes (repeated characters or lines), it is cut by length. Cuts by hash depend on nearby content alone, so
an insertion shifts no later chunk. Chunks are known by a 64-bit digest.

A stretch is the shortest run of chunks from a chunk on, or up to a chunk, that is
worth cutting (20 words, or 240 bytes); its digest is made of those of its chunks.
Only whole stretches repeat, so chance repeats of a few words, short common lines, and words
that each stand somewhere else stay. Of all documents that hold a stretch, the one
with the smallest id keeps it, and there its first place stays; everywhere else it
is cut out. Whatever is cut thus stands in a document of a smaller id, or before.
Tasks first settle what they see themselves: of a digest they pass on only their
smallest document, and the others are already known to be repeats. What they pass
on is shuffled once by digest and sorted; repeats stream out and return to their
documents. No group of copies is ever held together.

Null texts stay null, empty ones empty. Rows of one id count as one document, so
repeated rows are all kept (keep_one() leaves none of them); rows without id come
after all others, and those of equal text count as one document. Texts of any
length are cut whole. Extra columns of the input pass through; an empty table gives
an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, free_name, mix64, small_batches, span_hashes, steps, utf8

STEP_BYTES = 200_000
WINDOW = 16
#: One in so many gaps between words is a cut.
WORDS_PER_CHUNK = 4
#: Words of more bytes are cut inside: after one in so many bytes where a character ends, not twice within so many.
LONGEST_WORD = 64
BYTES_PER_CUT = 16
CLOSEST_CUTS = 16
LONGEST_CHUNK = 512
SHORTEST_RUN_WORDS = 20
SHORTEST_RUN_BYTES = 240
#: (digest, document) pairs that a task settles at once.
SETTLE = 500_000
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_GEAR = (mix64(np.arange(1000, 1256, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
_VALUES = mix64(np.arange(1, 257, dtype=np.uint64))


def chunks(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, text, digest and number of words of every chunk; the chunks of a text cover it."""
    n, texts = len(raw), len(offsets) - 1
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none, none
    sizes = np.diff(offsets)
    owner = np.repeat(np.arange(texts), sizes)
    padded = np.zeros(n + WINDOW * texts, dtype=np.uint32)  # a text's hash starts anew
    place = np.arange(n) + WINDOW * (owner + 1)
    padded[place] = _GEAR[raw]
    rolled, width = padded, 1
    while width < WINDOW:
        earlier = np.zeros_like(rolled)
        earlier[width:] = rolled[:-width] << np.uint32(width)
        rolled, width = rolled + earlier, 2 * width
    white = _WHITE[raw]
    word = ~white
    word_begin = word.copy()
    word_begin[1:] &= white[:-1] | (owner[1:] != owner[:-1])
    gap = white.copy()
    gap[:-1] &= ~white[1:]
    cut = gap & ((rolled[place] >> np.uint32(14)) % np.uint32(WORDS_PER_CHUNK) == 0)
    word_end = word.copy()
    word_end[:-1] &= white[1:] | (owner[1:] != owner[:-1])
    first, last = np.flatnonzero(word_begin), np.flatnonzero(word_end)
    large = last - first >= LONGEST_WORD
    if large.any():
        long_at = np.concatenate([np.arange(x, y) for x, y in zip(first[large].tolist(), last[large].tolist(), strict=True)])  # a cut after the last byte is the gap's
        long_at = long_at[raw[long_at + 1] & 0xC0 != 0x80]
        hit = long_at[(rolled[place[long_at]] >> np.uint32(8)) % np.uint32(BYTES_PER_CUT) == 0]
        cut[hit[np.diff(hit, prepend=-CLOSEST_CUTS - 1) > CLOSEST_CUTS]] = True
    stop = offsets[1:][sizes > 0]
    cut[stop - 1] = True
    end = np.flatnonzero(cut) + 1
    start = np.concatenate([[0], end[:-1]])
    long = np.flatnonzero(end - start > LONGEST_CHUNK)
    if len(long):
        extra, gaps = [], np.flatnonzero(gap) + 1
        for i in long.tolist():
            for at in range(int(start[i]) + LONGEST_CHUNK, int(end[i]), LONGEST_CHUNK):
                near = int(np.searchsorted(gaps, at))
                if near < len(gaps) and gaps[near] - at < 64:
                    at = int(gaps[near])
                while at < end[i] and raw[at] & 0xC0 == 0x80:
                    at += 1
                if at < end[i]:
                    extra.append(at)
        end = np.unique(np.concatenate([end, np.array(extra, dtype=np.int64)]))
        start = np.concatenate([[0], end[:-1]])
    before = np.concatenate([[0], np.cumsum(word_begin)])
    digest = span_hashes(_VALUES[raw], start, end).view(np.int64)
    return start, end, owner[start], digest, before[end] - before[start]


def stretches(start: np.ndarray, end: np.ndarray, owner: np.ndarray, digest: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First chunk, end (the chunk after the last) and digest of the stretches of all texts in order, given their chunks."""
    n, at = len(start), np.arange(len(start))
    before = np.concatenate([[0], np.cumsum(words)])
    # the shortest run from each chunk on, and the shortest up to each chunk: together they reach to both ends of a passage
    stop = np.minimum(np.searchsorted(before, before[:-1] + SHORTEST_RUN_WORDS), np.searchsorted(end, start + SHORTEST_RUN_BYTES) + 1)
    first = np.maximum(np.searchsorted(before, before[1:] - SHORTEST_RUN_WORDS, side="right"), np.searchsorted(start, end - SHORTEST_RUN_BYTES, side="right")) - 1
    on, up = stop <= np.searchsorted(owner, owner, side="right"), first >= np.searchsorted(owner, owner)
    runs = np.unique(np.concatenate([at[on] * (n + 1) + stop[on], first[up] * (n + 1) + at[up] + 1]))
    first, stop = runs // (n + 1), runs % (n + 1)
    return first, stop, span_hashes(digest.view(np.uint64), first, stop).view(np.int64)


def document_key(id_column: str, text_column: str) -> Column:
    """The id as a long; without one, a number above all ids that equal texts share."""
    return F.coalesce(F.col(f"`{id_column}`").cast("long"), F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64(F.col(f"`{text_column}`")), 2))


def _settled(df: DataFrame, known: bool) -> DataFrame:
    """(digest, id): what a task passes on (its smallest id of each digest), or what it knows to be repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        count = 0

        def settle() -> Iterator[pa.RecordBatch]:
            digest, ids = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            order = np.lexsort((ids, digest))
            digest, ids = digest[order], ids[order]
            fresh = np.ones(len(digest), dtype=bool)
            fresh[1:] = (digest[1:] != digest[:-1]) | (ids[1:] != ids[:-1])
            digest, ids = digest[fresh], ids[fresh]
            first = np.ones(len(digest), dtype=bool)
            first[1:] = digest[1:] != digest[:-1]
            pick = ~first if known else first
            for a in range(0, int(pick.sum()), 100_000):
                at = np.flatnonzero(pick)[a : a + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(digest[at]), pa.array(ids[at])], names=["digest", "id"])

        for batch in batches:
            names = batch.column(0).to_numpy()
            _, offsets = utf8(batch.column(1))
            for a, b in steps(np.diff(offsets).tolist(), STEP_BYTES):
                raw, at = utf8(batch.column(1).slice(a, b - a))
                start, end, owner, digest, words = chunks(raw, at)
                first, _, digest = stretches(start, end, owner, digest, words)
                held.append((digest, names[a:b][owner[first]]))
                count += len(digest)
                if count >= SETTLE:
                    yield from settle()
                    held, count = [], 0
        if held:
            yield from settle()

    return df.mapInArrow(run, "digest long, id long")


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (digest, id), all whose digest has a smaller id."""
    last: tuple[int, int] | None = None  # digest, its smallest id
    for batch in batches:
        digest, ids = (batch.column(k).to_numpy() for k in (0, 1))
        if not len(digest):
            continue
        start = np.flatnonzero(np.concatenate([[True], digest[1:] != digest[:-1]]))
        smallest = ids[start]
        if last and digest[0] == last[0]:
            smallest[0] = last[1]
        later = ids != np.repeat(smallest, np.diff(np.append(start, len(digest))))
        last = (int(digest[-1]), int(smallest[-1]))
        if later.any():
            yield pa.RecordBatch.from_arrays([pa.array(digest[later]), pa.array(ids[later])], names=["digest", "id"])


def spans_to_cut(start: np.ndarray, end: np.ndarray, digest: np.ndarray, repeats: np.ndarray) -> list[tuple[int, int]]:
    """Byte spans to cut from one text, given its stretches in order and the digests that an earlier document keeps."""
    _, once = np.unique(digest, return_index=True)
    goes = np.ones(len(digest), dtype=bool)
    goes[once] = False
    if len(repeats):
        goes |= np.isin(digest, repeats)
    low, high = start[goes], end[goes]
    if not len(low):
        return []
    new = np.flatnonzero(np.concatenate([[True], low[1:] > high[:-1]]))
    return list(zip(low[new].tolist(), high[np.append(new[1:], len(high)) - 1].tolist(), strict=True))


def dedup_substrings(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", spans_column: str = "removed") -> DataFrame:
    """All rows and columns of df, with repeats cut out of the text, and the spans cut, in code points of the old text.

    The column of spans gets underscores after its name if df has one of that name.
    """
    spark = df.sparkSession
    spans_column = free_name(spans_column, df.columns)
    small_batches(spark)
    scratch = Scratch(spark, "substring")
    texts = df.select(document_key(id_column, text_column).alias("id"), F.col(f"`{text_column}`").alias("text"))
    passed_on = _settled(texts, known=False)
    repeats = passed_on.repartition("digest").sortWithinPartitions("digest", "id").mapInArrow(_later, "digest long, id long")
    repeats = scratch.save(repeats.unionByName(_settled(texts, known=True)), "repeats")
    by_document = scratch.save(repeats.groupBy("id").agg(F.collect_set("digest").alias("repeats")), "documents")
    scratch.drop(repeats)

    names = df.columns
    keyed = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), document_key(id_column, text_column).alias("id"))
    joined = keyed.join(by_document, "id", "left").select("row.*", "repeats").toDF(*names, "__repeats")
    where = names.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(where)
            found: list[str | None] = []
            removed: list[list[dict[str, int]]] = []
            _, offsets = utf8(column)
            known = batch.column(len(names))
            for a, b in steps(np.diff(offsets).tolist(), STEP_BYTES):
                part = column.slice(a, b - a)
                raw, at = utf8(part)
                start, end, owner, digest, words = chunks(raw, at)
                first, stop, digest = stretches(start, end, owner, digest, words)
                owner, start, end = owner[first], start[first], end[stop - 1]
                bound = np.searchsorted(owner, np.arange(b - a + 1))
                for i, text in enumerate(part.to_pylist()):
                    lo, hi = bound[i], bound[i + 1]
                    own = known[a + i].values
                    spans = spans_to_cut(start[lo:hi], end[lo:hi], digest[lo:hi], own.to_numpy() if own is not None else np.zeros(0, np.int64)) if text else []
                    if not spans:
                        found.append(text)
                        removed.append([])
                        continue
                    base, whole = int(at[i]), raw[at[i] : at[i + 1]]
                    points = np.concatenate([[0], np.cumsum((whole & 0xC0) != 0x80)])
                    stay = np.ones(len(whole), dtype=bool)
                    for x, y in spans:
                        stay[x - base : y - base] = False
                    found.append(whole[stay].tobytes().decode("utf-8").rstrip())
                    removed.append([{"start": int(points[x - base]), "end": int(points[y - base])} for x, y in spans])
            columns = [*batch.columns[:where], pa.array(found, pa.string()), *batch.columns[where + 1 : len(names)]]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(removed, kind)], names=[*names, spans_column])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return joined.mapInArrow(run, f"{kinds}, `{spans_column}` array<struct<start: bigint, end: bigint>>")


def keep_new(df: DataFrame) -> DataFrame:
    """Documents without their repeats, n_chars (if there) set anew; those of which nothing is left go."""
    found = dedup_substrings(df)
    cut = F.size(F.col(f"`{found.columns[-1]}`")) > 0
    left = found.where(~cut | (F.length("text") > 0))
    counted = F.when(cut, F.length("text").cast(dict(df.dtypes).get("n_chars", "long"))).otherwise(F.col("n_chars")) if "n_chars" in df.columns else None
    return left.select(*[counted.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in df.columns])
