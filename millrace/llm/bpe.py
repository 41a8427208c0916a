"""Operator 1: byte-level BPE encoding and decoding.

Texts are cut into pieces by the pattern of byte-level BPE tokenizers, a whole
batch at a time: the pattern is a rule on neighbouring character classes, so a
few numpy comparisons find all piece borders. Each distinct piece is then
merged once: a priority queue of merge ranks over a doubly linked symbol list,
in which entries that a later merge has made stale are skipped. Decoding
concatenates the vocabulary's byte strings.

Null texts count as empty, empty texts have no ids. Equal texts get equal ids.
Extra columns of the input are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import STEP_CHARS, expand, mix64, small_batches, span_hashes, steps, strings

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
#: The contractions of the byte-level pattern.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Code points with the property White_Space.
WHITE_SPACE = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: Distinct pieces and their ids that a worker keeps; beyond, it starts anew.
CACHE_PIECES = 500_000
#: Longer pieces are not looked up by hash.
LONG_PIECE = 64


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def character_classes() -> np.ndarray:
    table = np.full(sys.maxunicode + 1, OTHER, dtype=np.uint8)
    kind = {"L": LETTER, "N": NUMBER}
    for c in range(sys.maxunicode + 1):
        if (k := kind.get(unicodedata.category(chr(c))[0])) is not None:
            table[c] = k
    table[list(WHITE_SPACE)] = SPACE
    return table


class Tokenizer:
    """A byte-level BPE vocabulary with its merges, loaded from a tokenizer.json."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model, letters = whole["model"], byte_letters()
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in whole.get("added_tokens", [])}
        size = 1 + max([*self.vocab.values(), *self.special.values()])
        self.token_bytes = [b""] * size
        for token, i in self.vocab.items():
            self.token_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.byte_ids = [0] * 256
        for letter, b in letters.items():
            self.byte_ids[b] = self.vocab[letter]
        self.rank: dict[int, int] = {}
        self.left: list[int] = []
        self.right: list[int] = []
        self.merged: list[int] = []
        for pair in model["merges"]:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank.setdefault(self.vocab[a] << 32 | self.vocab[b], len(self.merged))
            self.left.append(self.vocab[a])
            self.right.append(self.vocab[b])
            self.merged.append(self.vocab[a + b])
        self.classes = character_classes()
        self.values = None
        self.special_pattern = re.compile("|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        lengths = np.array([len(b) for b in self.token_bytes], dtype=np.int64)
        self.byte_length, self.byte_start = lengths, np.cumsum(lengths) - lengths
        self.byte_pool = np.frombuffer(b"".join(self.token_bytes), dtype=np.uint8)
        self._forget()

    def _forget(self) -> None:
        self.slots: dict[int, int] = {}
        self.starts = np.zeros(1 << 16, dtype=np.int64)
        self.lengths = np.zeros(1 << 16, dtype=np.int64)
        self.pool = np.zeros(1 << 18, dtype=np.uint32)
        self.used = 0
        self.filled = 0

    def _remember(self, ids: list[int]) -> int:
        slot, n = self.used, len(ids)
        if slot >= len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.lengths = np.concatenate([self.lengths, np.zeros_like(self.lengths)])
        while self.filled + n > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.filled : self.filled + n] = ids
        self.starts[slot], self.lengths[slot] = self.filled, n
        self.used, self.filled = slot + 1, self.filled + n
        return slot

    def merge(self, piece: str) -> list[int]:
        """Ids of one piece: the pair of lowest rank merges first, the leftmost of equals."""
        byte_ids = self.byte_ids
        symbols = [byte_ids[b] for b in piece.encode("utf-8")]
        n = len(symbols)
        if n < 2:
            return symbols
        rank, left, right, merged = self.rank, self.left, self.right, self.merged
        queue = [r << 32 | i for i in range(n - 1) if (r := rank.get(symbols[i] << 32 | symbols[i + 1])) is not None]
        heapq.heapify(queue)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pop, push = heapq.heappop, heapq.heappush
        while queue:
            entry = pop(queue)
            r, i = entry >> 32, entry & 0xFFFFFFFF
            if symbols[i] != left[r] or (j := after[i]) >= n or symbols[j] != right[r]:
                continue  # stale: a neighbour has merged since this entry was made
            symbols[i] = new = merged[r]
            symbols[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get(new << 32 | symbols[k])) is not None:
                    push(queue, r << 32 | i)
            if (h := before[i]) >= 0 and (r := rank.get(symbols[h] << 32 | new)) is not None:
                push(queue, r << 32 | h)
        return [s for s in symbols if s >= 0]

    def pieces(self, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Starts of all pieces of the joined segments; first: where segments (none of them empty) begin."""
        n = len(codes)
        kind = self.classes[codes]
        begins = np.zeros(n + 1, dtype=bool)
        begins[first] = True
        begins[n] = True
        change = np.ones(n, dtype=bool)
        change[1:] = kind[1:] != kind[:-1]
        blank = codes == 32
        attached = np.zeros(n, dtype=bool)  # a single blank goes with what follows it
        attached[1:] = blank[:-1] & (kind[1:] != SPACE)
        border = change & ~attached
        white = kind == SPACE
        border[:-1] |= white[:-1] & ~white[1:] & ~begins[1:n]  # the last of a run of white space stands alone or goes along
        border |= begins[:n]
        marks = np.flatnonzero((codes[:-1] == 39) & border[:-1] & (kind[1:] == LETTER) & ~begins[1:n])
        if len(marks):
            padded = np.concatenate([codes, np.zeros(2, codes.dtype)])
            for tail in CONTRACTIONS:
                hit = marks
                for k, c in enumerate(tail, 1):
                    hit = hit[(padded[hit + k] == ord(c)) & ~begins[np.minimum(hit + k, n)]]
                border[hit + 1] = False
                stop = hit + 1 + len(tail)
                border[stop[stop < n]] = True
        return np.flatnonzero(border)

    def encode(self, texts: list[str], miss: Callable[[str], list[int]] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other (uint32), and the number of ids of each text."""
        miss = miss or self.merge
        if self.used > CACHE_PIECES or self.filled > 8 * CACHE_PIECES:
            self._forget()
        segments: list[str] = []
        owner: list[int] = []
        marks: list[tuple[int, int]] = []  # (position among segments, id) of special strings
        for t, text in enumerate(texts):
            if self.special_pattern is None or not any(s in text for s in self.special):
                if text:
                    segments.append(text)
                    owner.append(t)
                continue
            at = 0
            for m in self.special_pattern.finditer(text):
                if m.start() > at:
                    segments.append(text[at : m.start()])
                    owner.append(t)
                marks.append((len(segments), self.special[m[0]]))
                segments.append("\0")
                owner.append(t)
                at = m.end()
            if at < len(text):
                segments.append(text[at:])
                owner.append(t)
        if not segments:
            return np.zeros(0, dtype=np.uint32), np.zeros(len(texts), dtype=np.int64)
        joined = "".join(segments)
        codes = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        sizes = np.fromiter(map(len, segments), dtype=np.int64, count=len(segments))
        first = np.cumsum(sizes) - sizes
        start = self.pieces(codes, first)
        end = np.append(start[1:], len(codes))
        if self.values is None:
            self.values = mix64(np.arange(1, sys.maxunicode + 2, dtype=np.uint64))
        hashes = span_hashes(self.values[codes], start, end)
        group, distinct = pd.factorize(hashes)
        # one example of each distinct piece
        example = np.empty(len(distinct), dtype=np.int64)
        example[group[::-1]] = np.arange(len(group))[::-1]
        slot_of = np.empty(len(distinct), dtype=np.int64)
        slots, low, high = self.slots, start[example].tolist(), end[example].tolist()
        for i, h in enumerate(distinct.tolist()):
            slot = slots.get(h)
            if slot is None:
                a, b = low[i], high[i]
                slot = self._remember(miss(joined[a:b]))
                if b - a <= LONG_PIECE:
                    slots[h] = slot
            slot_of[i] = slot
        slot = slot_of[group]
        long = np.flatnonzero(end - start > LONG_PIECE)
        for i in long.tolist():  # exact even where long pieces share a hash
            slot[i] = self._remember(miss(joined[start[i] : end[i]]))
        piece_owner = np.searchsorted(first, start, side="right") - 1
        if marks:
            position = np.searchsorted(start, first[[m for m, _ in marks]])
            for p, (_, i) in zip(position.tolist(), marks, strict=True):
                slot[p] = self._remember([i])
        length = self.lengths[slot]
        ids = self.pool[expand(self.starts[slot], length)]
        counts = np.bincount(np.asarray(owner, dtype=np.int64)[piece_owner], weights=length, minlength=len(texts)).astype(np.int64)
        return ids, counts

    def decode_bytes(self, ids: np.ndarray) -> np.ndarray:
        """UTF-8 of the vocabulary strings of all ids, one after the other."""
        ids = ids.astype(np.int64)
        return self.byte_pool[expand(self.byte_start[ids], self.byte_length[ids])]

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(np.asarray(ids, dtype=np.int64)).tobytes().decode("utf-8", errors="replace")


_LOADED: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    """The tokenizer of this process, loaded once."""
    if path not in _LOADED:
        _LOADED[path] = Tokenizer(path)
    return _LOADED[path]


def decimal_table(size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each id its decimal digits and a comma, as rows of bytes, and their lengths."""
    width = len(str(size)) + 1
    rows = np.zeros((size, width), dtype=np.uint8)
    lengths = np.zeros(size, dtype=np.int64)
    for i in range(size):
        b = f"{i},".encode()
        rows[i, : len(b)] = np.frombuffer(b, dtype=np.uint8)
        lengths[i] = len(b)
    return rows, lengths


def encode_decode(df: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Encode each text, decode its ids again and return digests of both.

    Columns: the id column, n_tokens, ids_sha256, decoded_sha256, round_trip
    (whether decoding gave the text back). A narrow plan: no shuffle.
    """
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(vocabulary)
        digits, digit_length = decimal_table(len(tok.token_bytes))
        flat, width = digits.ravel(), digits.shape[1]
        for batch in batches:
            texts = strings(batch.column(1))
            out = {"n": [], "ids": [], "text": [], "same": []}
            for a, b in steps([len(t) for t in texts], STEP_CHARS):
                ids, counts = tok.encode(texts[a:b])
                wide = ids.astype(np.int64)
                lengths = digit_length[wide]
                written = flat[expand(wide * width, lengths)]
                decoded = tok.decode_bytes(wide)
                ends = np.cumsum(counts)
                id_at = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], ends])]
                byte_at = np.concatenate([[0], np.cumsum(tok.byte_length[wide])])[np.concatenate([[0], ends])]
                for i, text in enumerate(texts[a:b]):
                    raw = decoded[byte_at[i] : byte_at[i + 1]].tobytes()
                    back = raw.decode("utf-8", errors="replace")
                    out["ids"].append(hashlib.sha256(written[id_at[i] : max(id_at[i], id_at[i + 1] - 1)].tobytes()).hexdigest())
                    out["text"].append(hashlib.sha256(back.encode("utf-8")).hexdigest())
                    out["same"].append(back == text)
                out["n"].extend(counts.tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out["n"], pa.int64()), pa.array(out["ids"], pa.string()), pa.array(out["text"], pa.string()), pa.array(out["same"], pa.bool_())], names=[id_column, "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"])

    kind = df.schema[id_column].dataType.simpleString()
    return df.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean")
