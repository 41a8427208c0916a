"""Words and word shingles of whole texts as 64-bit hashes, a batch of UTF-8 at a time."""

from __future__ import annotations

import numpy as np

from .common import mix64, span_hashes

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: Random-looking values of the bytes.
_VALUES = mix64(np.arange(1, 257, dtype=np.uint64))


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, byte starts and ends of all words [^ \\t-\\r]+ (A-Z lower-cased), and the first word of each text (one more than texts)."""
    n = len(raw)
    inner = np.zeros(n + 1, dtype=bool)
    inner[:n] = ~_WHITE[raw]
    begin = inner[:-1].copy()
    begin[1:] &= ~inner[: n - 1]
    stop = inner[:-1] & ~inner[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    begin[edges] = inner[edges]
    stop[edges - 1] = inner[edges - 1]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    hashes = span_hashes(_VALUES[_LOWER[raw]], start, end)
    return hashes, start, end, np.searchsorted(start, offsets)


def shingles(raw: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the k-word shingles of each text, their text, and how many each text has.

    A text of fewer words has its whole sequence as one shingle; a text without words has none.
    """
    hashes, _, _, first = words(raw, offsets)
    count = np.diff(first)
    texts = len(count)
    total = len(hashes)
    chained = np.zeros(total, dtype=np.uint64)
    padded = np.concatenate([hashes, np.zeros(k, dtype=np.uint64)])
    room = np.repeat(first[1:], count) - np.arange(total)  # words left in the text, this one included
    for j in range(k):
        chained = mix64(chained * np.uint64(0x9E3779B97F4A7C15) + np.where(room > j, padded[j : j + total], np.uint64(j + 1)) + np.uint64(j))
    keep = room >= k
    short = first[:-1][(count > 0) & (count < k)]
    keep[short] = True
    owner = np.repeat(np.arange(texts), count)[keep]
    values = chained[keep]
    order = np.lexsort((values, owner))
    owner, values = owner[order], values[order]
    fresh = np.ones(len(values), dtype=bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (values[1:] != values[:-1])
    owner, values = owner[fresh], values[fresh]
    return values, owner, np.bincount(owner, minlength=texts)
