"""Operator 2: license scans by MinHash bands over overlapping windows of text.

Words are lower-cased runs of ASCII letters, digits and non-ASCII characters; a
template and a text are sequences of 3-word shingles. A template belongs to the
smallest window (a power of two) of which it fills at most three quarters, so it
fills more than 0.375 of it; windows of a text start at its first word, overlap by
three quarters and end with the text at the latest, so a copy lies wholly in one of
them, where its similarity to the template is then at least 0.375 (0.279 if a fifth
of its shingles is changed). With 32 bands of one row, such a window shares a band
with probability 1 - (1 - 0.279)^32 > 0.9999. Minima of all windows are running
minima by doubling, in numpy.

A template retrieved for a text is verified exactly: the most of its distinct
shingles that any stretch of the window's length holds. 80 % make a match; the
first best stretch is reported. Templates share passages, so of matches whose
stretches overlap the best stays: the one with most shingles found less those
missing, then the one listed first. A text can match several templates apart.

Null and empty texts and texts of fewer than three words match nothing. Whole
texts are scanned; repeated rows match alike; extra columns are ignored; an
empty table gives an empty table. The plan is narrow: no shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import mix64, small_batches, span_hashes, steps, utf8

STEP_BYTES = 500_000
BANDS = 32
SHINGLE = 3
SMALLEST_WINDOW = 2
CONTAINMENT = 0.8

# Public license notices and the short statements that name a license.
TEMPLATES: dict[str, str] = {
    "mit-statement": "Released under the MIT License.",
    "apache-2.0-statement": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-statement": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-statement": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-statement": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-statement": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "lgpl-3.0-statement": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "agpl-3.0-statement": "This work is licensed under the GNU Affero General Public License, version 3.",
    "bsd-statement": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "cc0-1.0-statement": """To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to
        this software to the public domain worldwide. This software is distributed without any warranty.""",
    "all-rights-reserved": "All rights reserved.",
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
        this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED
        "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS
        BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
        OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
        applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
        governing permissions and limitations under the License.""",
    "bsd-2-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
        the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this
        list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
        WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
        ARE DISCLAIMED.""",
    "bsd-3-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
        the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this
        list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
        promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE
        COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
        IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""",
    "gpl-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
    "lgpl-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
    "agpl-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
    "mpl-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS"
        AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
        AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY
        DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER
        TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
        use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
        commercial or non-commercial, and by any means.""",
}

_WORD = np.ones(256, dtype=bool)
_WORD[:128] = [chr(c).isalnum() for c in range(128)]
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_VALUES = mix64(np.arange(7000, 7256, dtype=np.uint64))
_MULTIPLIERS = mix64(np.arange(1, BANDS + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_rows(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, byte start and byte end of the shingle at every word, and the first word of each text; the last words of a text have hash 0."""
    n = len(raw)
    inner = np.zeros(n + 1, dtype=bool)
    inner[:n] = _WORD[raw]
    begin, stop = inner[:-1].copy(), inner[:-1] & ~inner[1:]
    begin[1:] &= ~inner[: n - 1]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    begin[edges] = inner[edges]
    stop[edges - 1] = inner[edges - 1]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    words = span_hashes(_VALUES[_FOLD[raw]], start, end)
    first = np.searchsorted(start, offsets)
    total = len(words)
    room = np.repeat(first[1:], np.diff(first)) - np.arange(total)
    padded, last = np.concatenate([words, np.zeros(SHINGLE, np.uint64)]), np.concatenate([end, np.zeros(SHINGLE, end.dtype)])
    chained = np.zeros(total, dtype=np.uint64)
    for j in range(SHINGLE):
        chained = mix64(chained * np.uint64(0x9E3779B97F4A7C15) + padded[j : j + total] + np.uint64(j))
    whole = room >= SHINGLE
    return np.where(whole, chained | np.uint64(1), np.uint64(0)), start, np.where(whole, last[SHINGLE - 1 : SHINGLE - 1 + total], end), first


class Scanner:
    """Templates with the band tables of their windows."""

    def __init__(self, templates: dict[str, str]) -> None:
        self.names = list(templates)
        self.sets: list[np.ndarray] = []
        self.windows: list[int] = []
        for text in templates.values():
            raw = text.encode()
            hashes = shingle_rows(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]
            hashes = hashes[hashes > 0]
            self.sets.append(np.unique(hashes))
            window = SMALLEST_WINDOW
            while window * 3 < len(hashes) * 4:
                window *= 2
            self.windows.append(window)
        # band tables: for each window and band, the minima of its templates, and a quick filter on their low bits
        self.tables: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for window in sorted(set(self.windows)):
            of = [t for t, w in enumerate(self.windows) if w == window and len(self.sets[t])]
            rows = []
            for m in _MULTIPLIERS:
                least = np.array([self._rank(self.sets[t], m).min() for t in of], dtype=np.uint32)
                quick = np.zeros(1 << 16, dtype=bool)
                quick[least & 0xFFFF] = True
                rows.append((quick, least, np.array(of)))
            self.tables[window] = rows

    @staticmethod
    def _rank(hashes: np.ndarray, multiplier: np.uint64) -> np.ndarray:
        return ((hashes * multiplier) >> np.uint64(32)).astype(np.uint32)

    def candidates(self, hashes: np.ndarray, first: np.ndarray) -> set[tuple[int, int]]:
        """(text, template) that share a band in some window."""
        found: set[tuple[int, int]] = set()
        total = len(hashes)
        if not total:
            return found
        sizes = np.diff(first)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(total) - first[:-1][owner]
        left = sizes[owner] - place  # words from here to the end of the text
        blank = np.where(hashes == 0, np.uint32(0xFFFFFFFF), np.uint32(0))
        starts = {w: np.flatnonzero(place % max(1, w // 4) == 0) for w in self.tables}
        # what lies beyond the text counts as largest
        beyond = {1 << i: np.where(left[: total - (1 << i)] > 1 << i, np.uint32(0), np.uint32(0xFFFFFFFF)) for i in range(max(self.tables).bit_length() - 1) if 1 << i < total}
        for band, m in enumerate(_MULTIPLIERS):
            ranks = self._rank(hashes, m) | blank
            width = 1
            while width <= max(self.tables):
                if width in self.tables:
                    quick, least, of = self.tables[width][band]
                    seen = ranks[starts[width]]
                    hits = np.flatnonzero(quick[seen & 0xFFFF])
                    for k, t in zip(*np.nonzero(seen[hits][:, None] == least[None, :]), strict=True):
                        found.add((int(owner[starts[width][hits[k]]]), int(of[t])))
                if width in beyond:
                    ranks[:-width] = np.minimum(ranks[:-width], ranks[width:] | beyond[width])
                width *= 2
        return found

    def matches(self, hashes: np.ndarray, templates: list[int]) -> list[tuple[int, float, int, int]]:
        """(template, containment, first and last word) of a text's matches that stay, in order of templates."""
        found = [(t, *match) for t in templates if (match := self.verify(hashes, t))]
        kept: list[tuple[int, float, int, int]] = []
        for x in sorted(found, key=lambda x: (-(2 * x[1] - 1) * len(self.sets[x[0]]), x[0])):
            if not any(x[2] <= y[3] and y[2] <= x[3] for y in kept):
                kept.append(x)
        return sorted(kept)

    def verify(self, hashes: np.ndarray, template: int) -> tuple[float, int, int] | None:
        """Containment and word positions of the best stretch of a text, if it is a match."""
        wanted, window = self.sets[template], self.windows[template]
        places = np.flatnonzero(np.isin(hashes, wanted)).tolist()
        inside: Counter[int] = Counter()
        best, low = (0, 0, 0), 0
        for at, place in enumerate(places):
            inside[int(hashes[place])] += 1
            while places[low] <= place - window:
                h = int(hashes[places[low]])
                inside[h] -= 1
                if not inside[h]:
                    del inside[h]
                low += 1
            if len(inside) > best[0]:
                best = (len(inside), places[low], places[at])
        share = best[0] / len(wanted)
        return (share, best[1], best[2]) if share >= CONTAINMENT else None


def scan(df: DataFrame, templates: dict[str, str] | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row for each match: the id, license, containment, and start and end of the stretch in code points."""
    small_batches(df.sparkSession)
    chosen = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(chosen)
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            _, offsets = utf8(batch.column(1))
            for a, b in steps(np.diff(offsets).tolist(), STEP_BYTES):
                raw, at = utf8(batch.column(1).slice(a, b - a))
                hashes, start, end, first = shingle_rows(raw, at)
                near: dict[int, list[int]] = {}
                for i, t in sorted(scanner.candidates(hashes, first)):
                    near.setdefault(i, []).append(t)
                for i, templates in near.items():
                    text = raw[at[i] : at[i + 1]]
                    for t, share, low, high in scanner.matches(hashes[first[i] : first[i + 1]], templates):
                        x, y = int(start[first[i] + low] - at[i]), int(end[first[i] + high] - at[i])
                        points = [int(((text[:z] & 0xC0) != 0x80).sum()) for z in (x, y)]
                        for column, value in zip(rows, (a + i, scanner.names[t], share, *points), strict=True):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.float64()), pa.array(rows[3], pa.int64()), pa.array(rows[4], pa.int64())], names=[id_column, "license", "containment", "start", "end"])

    kind = df.schema[id_column].dataType.simpleString()
    return df.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, license string, containment double, start long, `end` long")
