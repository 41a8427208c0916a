"""Operator 10: best-fit packing of documents into sequences of fixed length.

A document is its token ids and an end id. One narrow pass tokenizes whole
texts and writes a row for each piece: a document longer than a sequence is cut
into full pieces after a first piece of the remainder. Packing reads only that
small table. It is bounded-space online best-fit: a fixed number of open bins,
found through a bitset keyed by free space; a piece goes to the fullest bin
that holds it, else to a new one, and when too many are open the fullest
closes. A task looks at a bounded number of pieces at a time, the longest first,
and holds no more than these and its open bins. Tasks pack their rows independently, and a sequence number
is the task's number and a counter.

Pieces of equal length go in the order of their rows, into the bin of equal free
space that was filled last. Null and empty texts are the end id alone. Repeated rows are packed each. Extra
columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Tokenizer, tokenizer
from .common import STEP_CHARS, Scratch, small_batches, steps, strings

#: Sequences that a task keeps open; the bound of the packing's space.
OPEN_BINS = 1024
#: Pieces that a task looks at together, longest first: large pieces open bins, small ones fill them.
LOOK_AHEAD = 2000
_FAST: dict[str, Callable[[str], list[int]]] = {}


def fast_merge(path: str) -> Callable[[str], list[int]]:
    """Ids of one piece by a compiled BPE, where the vocabulary's ids are in order of its merges."""
    if path not in _FAST:
        tok = tokenizer(path)
        _FAST[path] = tok.merge
        if tok.merged == sorted(set(tok.merged)) and tok.merged and tok.merged[0] > max(tok.byte_ids):
            import tiktoken

            ranks = {tok.token_bytes[i]: i for i in tok.vocab.values() if i not in set(tok.special.values())}
            _FAST[path] = tiktoken.Encoding("pieces", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return _FAST[path]


def cut(length: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only the first is shorter than most."""
    head = length % most or min(length, most)
    return [(0, head), *((s, most) for s in range(head, length, most))]


def token_pieces(df: DataFrame, vocabulary: str, most: int = 2048, end_id: int = 0, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32. No shuffle."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok: Tokenizer = tokenizer(vocabulary)
        miss = fast_merge(vocabulary)
        tail = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            texts = strings(batch.column(1))
            rows: list[list[int]] = [[], [], [], [], []]
            for a, b in steps([len(t) for t in texts], STEP_CHARS):
                ids, counts = tok.encode(texts[a:b], miss)
                raw = memoryview(ids.astype("<u4").tobytes())
                at = 0
                for i, n in enumerate(counts.tolist(), a):
                    own = bytes(raw[4 * at : 4 * (at + n)]) + tail
                    at += n
                    for k, (start, length) in enumerate(cut(n + 1, most)):
                        for column, x in zip(rows, (i, k, start, length, zlib.crc32(own[4 * start : 4 * (start + length)])), strict=True):
                            column.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32()), *(pa.array(r, pa.int64()) for r in rows[2:])], names=[id_column, "piece", "start", "length", "ids_crc32"])

    kind = df.schema[id_column].dataType.simpleString()
    return df.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, piece int, start long, length long, ids_crc32 long")


class OpenBins:
    """Bounded-space best-fit: put() gives a piece's bin and its offset there."""

    def __init__(self, capacity: int, most_open: int) -> None:
        self.capacity, self.most_open = capacity, most_open
        self.bits = 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.opened = self.open = 0

    def put(self, length: int) -> tuple[int, int]:
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            stack = self.by_free[free]
            number = stack.pop()
            if not stack:
                self.bits ^= 1 << free
        else:
            free, number = self.capacity, self.opened
            self.opened += 1
            self.open += 1
        rest = free - length
        if rest:
            self.by_free[rest].append(number)
            self.bits |= 1 << rest
        else:
            self.open -= 1
        if self.open > self.most_open:
            fullest = (self.bits & -self.bits).bit_length() - 1
            stack = self.by_free[fullest]
            stack.pop()
            self.open -= 1
            if not stack:
                self.bits ^= 1 << fullest
        return number, self.capacity - free


def pack(pieces: DataFrame, most: int = 2048, open_bins: int = OPEN_BINS) -> DataFrame:
    """Add sequence_id and offset to a table of pieces with a column length (1 to most)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, first = OpenBins(most, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            lengths = batch.column(batch.schema.get_field_index("length")).to_numpy()
            sequence, offset = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
            for start in range(0, len(lengths), LOOK_AHEAD):
                seen = lengths[start : start + LOOK_AHEAD]
                for i in (np.argsort(-seen, kind="stable") + start).tolist():
                    sequence[i], offset[i] = bins.put(int(lengths[i]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequence + first), pa.array(offset)], names=[*batch.schema.names, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return pieces.mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def best_fit_pack(df: DataFrame, vocabulary: str, most: int = 2048, end_id: int = 0, open_bins: int = OPEN_BINS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Pack whole documents: a row for each piece with its sequence_id and offset.

    The table of pieces is written before packing, so the costly pass over the
    texts runs once, and a lost executor repeats only its own share of packing.
    """
    saved = Scratch(df.sparkSession, "packing").save(token_pieces(df, vocabulary, most, end_id, id_column, text_column), "pieces")
    return pack(saved.select(*[F.col(f"`{c}`") for c in saved.columns]), most, open_bins)
