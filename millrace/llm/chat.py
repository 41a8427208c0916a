"""Operator 7: chat formatting by columnar byte assembly, with a loss mask.

A conversation becomes one string: for each turn `<s>`, the role, a line feed,
the text and `</s>`. Control strings inside roles and texts get a backslash
after their first character, and a backslash is doubled, so that a text can
never open or close a turn and reading gives back exactly what was written.

Rows are dealt by conversation and sorted by turn; each Arrow batch is then
assembled as a whole: numpy computes the lengths of all segments, their
cumulative offsets and the scatter indices, and headers and contents are copied
into one preallocated buffer that becomes the Arrow column. The loss mask is a
list of spans of code points: the assistant's texts.

Null roles and texts are empty; a null conversation id is a conversation of its
own; null turns come first, and rows of equal turn are ordered by role and
text. Repeated rows are repeated turns. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import expand, small_batches, steps, utf8

#: Bytes of formatted conversations in one batch; a longer one is a batch of its own.
MOST_BYTES = 1 << 28
OPEN, AFTER_ROLE, CLOSE = "<s>", "\n", "</s>"
#: Strings that mark turns in common chat templates.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile(r"\\|" + "|".join(re.escape(c) for c in CONTROL))
_TURN = re.compile(r"<s>((?:[^\\\n]|\\.)*?)\n((?:[^\\<]|\\.|<(?!/s>))*)</s>", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)
SUSPECT = r"[\\<\[]"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\\n")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def _escaped(column: pa.Array, how) -> pa.Array:
    """The column with escapes; only the few texts that could need any are touched one by one."""
    column = column.fill_null("") if column.null_count else column
    hits = np.flatnonzero(pc.match_substring_regex(column, SUSPECT if how is escape else SUSPECT[:-1] + r"\n]").to_numpy(zero_copy_only=False))
    if not len(hits):
        return column
    texts = column.to_pylist()
    for i in hits.tolist():
        texts[i] = how(texts[i])
    return pa.array(texts, pa.large_string())


def _characters(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Code points of each span of UTF-8 bytes."""
    before = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return before[end] - before[start]


def assemble(roles: pa.Array, texts: pa.Array, first: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Format turns (in order; first: where conversations begin) into a column of strings.

    Also gives where each turn's text starts in its conversation, in code points, and its length.
    """
    role_raw, role_at = utf8(_escaped(roles, escape_role))
    text_raw, text_at = utf8(_escaped(texts, escape))
    n = len(roles)
    heads = [np.frombuffer(x.encode(), dtype=np.uint8) for x in (OPEN, AFTER_ROLE, CLOSE)]
    sizes = np.empty((n, 5), dtype=np.int64)
    sizes[:, 0], sizes[:, 2], sizes[:, 4] = (len(h) for h in heads)
    sizes[:, 1], sizes[:, 3] = np.diff(role_at), np.diff(text_at)
    ends = np.cumsum(sizes.ravel()).reshape(n, 5)
    starts = ends - sizes
    total = int(ends[-1, -1]) if n else 0
    buffer = pa.allocate_buffer(total)
    out = np.frombuffer(buffer, dtype=np.uint8)
    for k, head in ((0, heads[0]), (2, heads[1]), (4, heads[2])):
        for j, byte in enumerate(head.tolist()):
            out[starts[:, k] + j] = byte
    out[expand(starts[:, 1], sizes[:, 1])] = role_raw
    out[expand(starts[:, 3], sizes[:, 3])] = text_raw
    offsets = np.append(starts[first, 0], total)
    column = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets.astype(np.int64).tobytes()), buffer)
    begin = np.repeat(offsets[:-1], np.diff(np.append(first, n)))
    return column, _characters(out, begin, starts[:, 3]), _characters(out, starts[:, 3], ends[:, 3])


def format_chats(df: DataFrame, conv_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text", loss_role: str = "assistant") -> DataFrame:
    """One row for each conversation: conv_id, formatted, loss_start and loss_length (lists of code points)."""
    small_batches(df.sparkSession)
    rows = df.select(F.col(f"`{conv_column}`").alias("conv_id"), F.col(f"`{turn_column}`").alias("turn"), F.col(f"`{role_column}`").alias("role"), F.col(f"`{text_column}`").alias("text"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def emit(table: pa.Table) -> Iterator[pa.RecordBatch]:
        ids = table.column("conv_id").combine_chunks()
        names = ids.to_pylist()
        first = np.array([i for i, x in enumerate(names) if i == 0 or x != names[i - 1]], dtype=np.int64)
        roles = table.column("role").combine_chunks()
        column, start, length = assemble(roles, table.column("text").combine_chunks(), first)
        loss = np.flatnonzero(pc.equal(roles, loss_role).fill_null(False).to_numpy(zero_copy_only=False))
        bounds = np.searchsorted(loss, np.append(first, len(names))).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(bounds), pa.array(x[loss])) for x in (start, length)]
        ids = ids.take(pa.array(first))
        sizes = pc.binary_length(column).to_numpy(zero_copy_only=False)
        for a, b in steps(sizes.tolist(), MOST_BYTES):  # a column of strings has 32-bit offsets
            yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), column.slice(a, b - a).cast(pa.string()), *(x.slice(a, b - a) for x in lists)], names=["conv_id", "formatted", "loss_start", "loss_length"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []  # the last conversation so far may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_pylist()
            last = len(ids) - 1
            while last > 0 and ids[last - 1] == ids[-1]:
                last -= 1
            if waiting and last == 0 and waiting[-1].column(0)[-1].as_py() == ids[0]:
                waiting.append(batch)
                continue
            done = [*waiting, batch.slice(0, last)]
            if sum(b.num_rows for b in done):
                yield from emit(pa.Table.from_batches(done))
            waiting = [batch.slice(last)]
        if waiting:
            yield from emit(pa.Table.from_batches(waiting))

    kind = rows.schema["conv_id"].dataType.simpleString()
    return dealt.mapInArrow(run, f"conv_id {kind}, formatted string, loss_start array<long>, loss_length array<long>")


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation: (role, text)."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def read_back(chats: DataFrame) -> DataFrame:
    """Digests of what the formatted conversations and their loss masks say."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for text, starts, lengths in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                turns = read_turns(text)
                loss = "".join(unescape(text[s : s + n]) for s, n in zip(starts, lengths, strict=True))
                whole = "".join(f"{role}\n{said}\n" for role, said in turns)
                for column, x in zip(out, (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)), strict=True):
                    column.append(x)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = chats.schema["conv_id"].dataType.simpleString()
    return chats.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
