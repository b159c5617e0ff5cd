"""License scans: winnowed fingerprints of templates in an inverted index pick candidates, banded alignment reports what matches where.

Words are runs of letters, digits and non-ASCII characters, A-Z lowered. A template may stand at each place of a text, and is aligned
with the words there, with at most BAND words inserted or left out. Coverage is the share of the template's words that match, and the
span is in words of the text.

Of an alignment that reaches the asked coverage, the matched words fall into a bounded number of runs, so one run has at least so many
words: that is the winnowing window of the template, of the hashes of single words. Template and text keep the word of least hash of
each such window, hence a run of that length has a kept word in common, which the inverted index turns into places of the template in
the text. Of these, places with fewer words of the template around than the coverage asks for can't reach it; the others are aligned,
equal windows once. So no alignment is lost, whatever the coverage. Matches of at least `least` coverage are reported; of overlapping
ones that with more matched words, and of those the shorter, the earlier, and the template of the first name.

Null, empty and word-less texts match nothing; each row gives one row. Texts are scanned whole. Copies are scanned each for itself.
An empty table gives no rows. Extra columns aren't read.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, NOT_ALNUM, frugal, slices, table, text_bytes, word_hashes, word_spans

#: Words inserted or left out.
BAND = 4
#: Notices by which licenses are named in documents, and whole licenses: fixed texts.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
    + (_BSD := 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
    + _BSD,
    "bsl-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "isc": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "mit": "Released under the MIT License.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mit-license": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
}


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = text_bytes(texts)
    data = LOWER[data]
    starts, ends, words = word_spans(data, offsets, NOT_ALNUM)
    return word_hashes(data, starts, ends), words


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """The places that hold the least hash, the last of equal ones, of some `window` places one after the other; all, if there are
    fewer. Equal stretches of at least `window` hashes keep the same of their places somewhere."""
    if window == 1 or len(hashes) < window:
        return np.arange(len(hashes))
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)
    return np.unique(np.arange(len(views)) + window - 1 - views[:, ::-1].argmin(axis=1))


def shortest_run(words: int, least: float) -> int:
    """Matched words in a row, without a gap in template or text, that any alignment of the coverage has at least: gaps are words left
    out, and words inserted, at most as many and those of a shift from one edge of the band to the other."""
    need = max(1, math.ceil(least * words))
    return -(-need // (2 * (words - need) + 2 * BAND + 1))


class Templates:
    def __init__(self, templates: dict[str, str] = TEMPLATES, least: float = 0.75) -> None:
        self.least = least
        self.names = sorted(templates)
        hashes, edges = words_of(pa.array([templates[n] for n in self.names], pa.string()))
        self.words = [hashes[a:b] for a, b in zip(edges, edges[1:])]
        self.vocabulary = np.unique(hashes)
        #: Of each template and word of the vocabulary, from 1 on: a number from 1 on, or 0 for a word that it hasn't.
        self.codes = []
        for w in self.words:
            code = np.zeros(len(self.vocabulary) + 1, np.int32)
            own = np.unique(w)
            code[np.searchsorted(self.vocabulary, own) + 1] = np.arange(1, len(own) + 1)
            self.codes.append(code)
        self.own = [code[np.searchsorted(self.vocabulary, w) + 1] for code, w in zip(self.codes, self.words)]
        self.gap = max(map(len, self.words), default=0) + 2 * BAND
        #: The inverted index, by winnowing window: the starts of each vocabulary word's entries, from 1 on, and (template, place).
        self.index: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        kept: dict[int, list[tuple[int, int, int]]] = {}
        for t, w in enumerate(self.words):
            window = shortest_run(len(w), least)
            for p in winnow(w, window).tolist():
                kept.setdefault(window, []).append((int(np.searchsorted(self.vocabulary, w[p])) + 1, t, p))
        for window, entries in kept.items():
            word, template, place = (np.array(x, np.int64) for x in zip(*sorted(entries)))
            self.index[window] = np.searchsorted(word, np.arange(len(self.vocabulary) + 2)), template, place

    def candidates(self, words: np.ndarray, ids: np.ndarray, at: np.ndarray) -> dict[int, np.ndarray]:
        """By template, for each place of ids whether a window from there holds a fingerprint where an alignment can have it."""
        edges: dict[int, np.ndarray] = {}
        for window, (starts, template, place) in self.index.items():
            x = at[winnow(words, window)]
            x = x[ids[x] > 0]
            n = starts[ids[x] + 1] - starts[ids[x]]
            entry = np.repeat(starts[ids[x]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            x, t, p = np.repeat(x, n), template[entry], place[entry]
            for k in np.unique(t).tolist():
                low = x[t == k] - p[t == k] - 2 * BAND
                change = edges.setdefault(k, np.zeros(len(ids) + 1, np.int32))
                change += np.bincount(np.maximum(low, 0), minlength=len(change)).astype(np.int32)
                change -= np.bincount(low + 2 * BAND + 1, minlength=len(change)).astype(np.int32)
        return {k: np.cumsum(change[:-1]) > 0 for k, change in edges.items()}

    def found(self, words: np.ndarray, edges: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(row, template, matched words, first word, word after the last) of the alignments at all places that reach the coverage."""
        if not len(words) or not len(self.vocabulary):
            return
        at = np.searchsorted(self.vocabulary, words)
        at[at == len(self.vocabulary)] = 0
        lengths = np.diff(edges)
        row = np.repeat(np.arange(len(lengths)), lengths)
        ids = np.zeros(len(words) + self.gap * (len(lengths) + 1), np.int32)  # rows stand apart, so that no window holds words of two
        places = np.arange(len(words)) + (row + 1) * self.gap
        ids[places] = np.where(self.vocabulary[at] == words, at + 1, 0)
        starts = np.asarray(edges[:-1]) + (np.arange(len(lengths)) + 1) * self.gap
        # between rows a hash of their own, so that they share no winnowing window but with that
        apart = np.full(len(ids), np.iinfo(np.uint64).max, np.uint64)
        apart[places] = words
        for t, near in sorted(self.candidates(apart, ids, np.arange(len(ids))).items()):
            code, own = self.codes[t], self.own[t]
            need, width = max(1, math.ceil(self.least * len(own))), len(own) + 2 * BAND
            count = np.concatenate([[0], np.cumsum(code[ids] > 0, dtype=np.int32)])
            lows = np.flatnonzero(near[: len(ids) - width + 1] & (count[width:] - count[:-width] >= need))
            for at in range(0, len(lows), BATCH):
                some = lows[at : at + BATCH]
                windows = code[ids[some[:, None] + np.arange(width)]]
                _, one, same = np.unique((windows.astype(np.uint64) * _MIX[:width]).sum(axis=1), return_index=True, return_inverse=True)
                n, a, b = (x[same] for x in align(own, windows[one]))  # equal windows once
                for i in np.flatnonzero(n >= need).tolist():
                    r = int(np.searchsorted(starts, some[i] + a[i], side="right")) - 1
                    yield r, t, int(n[i]), int(some[i] + a[i] - starts[r]), int(some[i] + b[i] - starts[r])


#: Windows that are aligned at once; random factors of a window's places, by which equal windows are told.
BATCH = 4_096
_MIX = np.random.default_rng(17).integers(1, 1 << 63, 1 << 14, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_N, _FIRST = np.int64(1 << 42), np.int64(1 << 21)  # of a packed (matches, place of the first + 1 or 0, place after the last)


def align(own: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each window the most template words matched in order within the band about its middle, and the span of the matched words."""
    width, size = 2 * BAND + 1, windows.shape[1]
    columns = np.ascontiguousarray(windows.T)
    best = np.zeros((width + 1, len(windows)), np.int64)  # [k]: before window place i + k
    for i, word in enumerate(own):
        new = np.empty_like(best)
        for k in range(width + 1):
            j = i + k  # window words before j are used
            option = best[k + 1] if k < width else best[k]  # this template word is left out
            if k:
                option = np.where(new[k - 1] >= option & ~(_N - 1), new[k - 1], option)  # of equal counts that which used no more words
            if j < size:
                hit = columns[j] == word
                if hit.any():
                    had = best[k]
                    taken = (had & ~(_FIRST - 1)) + _N + (j + 1) + np.where(had & (_N - _FIRST), 0, (j + 1) * _FIRST)
                    option = np.where(hit & (taken >> 42 > option >> 42), taken, option)
            new[k] = option
        best = new
    found = best[(best >> 42).argmax(axis=0), np.arange(len(windows))]
    n, a, b = found >> 42, ((found >> 21) & ((1 << 21) - 1)) - 1, found & ((1 << 21) - 1)
    exact = (windows[:, BAND : BAND + len(own)] == own).all(axis=1)
    return np.where(exact, len(own), n), np.where(exact, BAND, a), np.where(exact, BAND + len(own), b)


def scan(docs: DataFrame, *, least: float = 0.75, templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_matches, licenses, coverage, spans): the names found, the best coverage, and each match's name, first word, word
    after the last and coverage."""
    kind = dict(docs.select(F.col(id_col)).dtypes)[id_col]
    names = ["doc_id", "n_matches", "licenses", "coverage", "spans"]
    span = pa.list_(pa.struct([("name", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(templates, least)
        for batch in batches:
            for part in slices(batch, "text"):
                words, edges = words_of(part.column("text"))
                found: list[set[tuple[int, int, int, int]]] = [set() for _ in range(part.num_rows)]
                for r, t, n, a, b in known.found(words, edges):
                    found[r].add((t, n, a, b))
                spans = []
                for own in found:
                    kept: list[tuple[int, int, int, int]] = []  # by first word; they don't overlap
                    for t, n, a, b in sorted(own, key=lambda m: (-m[1], -m[1] / len(known.words[m[0]]), m[3] - m[2], m[2], m[0])):
                        at = bisect_left(kept, (b,))
                        if not at or kept[at - 1][1] <= a:
                            insort(kept, (a, b, t, n))
                    spans.append([{"name": known.names[t], "start": a, "end": b, "coverage": n / len(known.words[t])} for a, b, t, n in kept])
                yield pa.record_batch(
                    [part.column("doc_id"), pa.array([len(x) for x in spans], pa.int64()), pa.array([",".join(sorted({m["name"] for m in x})) for x in spans]), pa.array([max((m["coverage"] for m in x), default=0.0) for x in spans], pa.float64()), pa.array(spans, span)],
                    names=names,
                )

    schema = f"doc_id {kind}, n_matches long, licenses string, coverage double, spans array<struct<name:string,start:long,end:long,coverage:double>>"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(frugal(run), schema)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
