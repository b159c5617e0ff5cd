"""Packing token sequences into windows by non-negative least squares over length combinations.

A document's ids are cut into whole windows and a rest. The rests' histogram by length (at most window - 1 rows) goes to the driver,
which finds there how often each of a bounded list of patterns is used:
1. lengths are rounded up to a grid; all combinations of up to three grid lengths that fill a window are enumerated, and
   non-negative least squares solves for their repeat counts; these are rounded down and kept within what there is;
2. what a combination leaves free, because its lengths are below the grid, is filled with the largest rests that fit;
3. the remaining rests are packed greedily, the largest that fits first, many equal windows at a time.
Each rest gets its rank among those of its length (numbered in salted groups, so a length that a third of all documents share is
spread), and the rank decides pattern, repeat and place. So nothing larger than the histogram is ever gathered.

Null and empty texts have the end id alone. Repeated rows are packed as often as they come; of pieces of one length it makes no
difference which stands where, and ties go by id, start and content. An empty table gives no rows. Very long
texts are tokenized in whole, one at a time. Extra columns aren't read.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from .common import frugal, hashed_spans, materialise, mix, slices, table, text_bytes
from .token_counts import tokenizer_path

GRID = 128  # grid lengths in a window, for the least squares
DEEPEST = 3
#: Pieces, and chunks that go to the tokenizer whole, that a worker keeps; beyond that it starts afresh.
KEPT_WORDS = 400_000

# ---------------------------------------------------------------- tokens

#: Characters that the word tokenizer's pattern cuts plainly: each is one character in lower case, a letter, a digit or a mark.
_PLAIN = re.compile(r"[\x21-\x7e\xa1-\xac\xae-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ]")
_LETTER = re.compile(r"[^\W\d_]")
#: What the pattern cuts off after an apostrophe.
_SHORT, _LONG = "stmd", ("re", "ve", "ll")
_GAP, _LETTERS, _DIGIT, _MARK, _HARD = range(5)
_MEMO: dict[str, WordIds] = {}


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """By character below 592: its class, and its lower case. The last entry stands for all other characters."""
    kinds, low = np.full(593, _HARD, np.uint8), np.arange(593, dtype=np.int64)
    for c in range(592):
        lower = chr(c).lower()
        if c == 0x20 or 9 <= c <= 13:
            kinds[c] = _GAP
        elif _PLAIN.match(chr(c)) and len(lower) == 1 and _PLAIN.match(lower):
            kinds[c] = _LETTERS if _LETTER.match(lower) else _DIGIT if lower.isdigit() else _MARK
            low[c] = ord(lower)
    return kinds, low


class WordIds:
    """Ids of texts by a tokenizer whose white space only separates. The characters of many texts are cut at once into the pieces of
    the tokenizer's pattern, and each distinct piece is encoded once and found again by a 64-bit hash; chunks between white space
    with a character that isn't plain, or with the beginning of a special token, go to the tokenizer whole."""

    def __init__(self, name: str) -> None:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(tokenizer_path(name))
        self.bytes_to_chars = _byte_chars()
        self.kinds, self.low = _classes()
        self.values = mix(np.arange(1, 594, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
        self.clear()

    def clear(self) -> None:
        self.hashes, self.codes, self.chunks = np.zeros(0, np.uint64), np.zeros(0, np.int64), {}
        self.flat, self.starts, self.counts, self.used = np.zeros(1 << 16, np.uint32), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), 0
        self.n = 0

    def _keep(self, ids: list[int]) -> int:
        """The code of a new piece."""
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        if self.n == len(self.starts):
            self.starts, self.counts = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.counts))
        self.flat[self.used : self.used + len(ids)] = ids
        self.starts[self.n], self.counts[self.n] = self.used, len(ids)
        self.used += len(ids)
        self.n += 1
        return self.n - 1

    def _piece(self, piece: str) -> list[int]:
        return [t.id for t in self.tokenizer.model.tokenize(piece.encode().decode("latin-1").translate(self.bytes_to_chars))]

    def _cut(self, points: np.ndarray, kinds: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of every piece, and which pieces are chunks for the tokenizer."""
        gap = kinds == _GAP
        change = np.ones(len(points), bool)
        change[1:] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == _DIGIT)
        # the texts end with a gap, so what follows an apostrophe is there
        for i in np.flatnonzero((low == 0x27) & change & (kinds == _MARK)).tolist():
            after = low[i + 1 : i + 3].tolist()
            if len(after) == 2 and after[0] < 128 and chr(after[0]) in _SHORT:
                change[i + 1], change[i + 2] = False, True
            elif len(after) == 2 and after[1] < 128 and chr(after[0]) + chr(after[1]) in _LONG:
                change[i + 1], change[i + 3] = False, True
        hard = kinds == _HARD
        hard[:-1] |= (points[:-1] == 0x3C) & (points[1:] == 0x7C)
        if hard.any():
            chunk = np.cumsum(gap)
            inside = np.zeros(int(chunk[-1]) + 1, bool)
            inside[chunk[hard]] = True
            whole = inside[chunk] & ~gap
            change[1:][whole[1:] & ~gap[:-1]] = False
        else:
            whole = hard
        start = np.flatnonzero(change & ~gap)
        ends = np.flatnonzero(change | gap)
        end = ends[np.searchsorted(ends, start, side="right")] if len(start) else start
        return start, end, whole[start]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and the n+1 offsets of the texts in them."""
        data, lengths = text_bytes(pc.binary_join_element_wise(pc.fill_null(texts, ""), "", " "))
        if self.n > KEPT_WORDS:
            self.clear()
        points = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
        first = np.flatnonzero((data & 0xC0) != 0x80) if len(points) < len(data) else np.arange(len(points))  # each character's first byte
        known = np.minimum(points, 592)
        kinds, low = self.kinds[known], self.low[known]
        start, end, whole = self._cut(points, kinds, low)
        code = np.zeros(len(start), np.int64)

        own = np.flatnonzero(~whole)
        hashes = hashed_spans(self.values[low], start[own], end[own])
        code[own], lost = self._find(hashes)
        if len(lost):
            fresh, at = np.unique(hashes[lost], return_index=True)
            new = [self._keep(self._piece("".join(map(chr, low[start[own[i]] : end[own[i]]].tolist())))) for i in lost[at].tolist()]
            place = np.searchsorted(self.hashes, fresh)
            self.hashes, self.codes = np.insert(self.hashes, place, fresh), np.insert(self.codes, place, new)
            code[own[lost]] = self._find(hashes[lost])[0]
        for i in np.flatnonzero(whole).tolist():
            chunk = points[start[i] : end[i]].tobytes().decode("utf-32-le", "surrogatepass")
            if chunk not in self.chunks:
                self.chunks[chunk] = self._keep(self.tokenizer.encode(chunk, add_special_tokens=False).ids)
            code[i] = self.chunks[chunk]

        n = self.counts[code]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        where = np.arange(total) + np.repeat(self.starts[code] - (ends - n), n)
        rows = np.searchsorted(first[start], lengths) if len(start) else np.zeros(len(lengths), np.int64)
        return self.flat[where], np.concatenate([[0], ends])[rows]

    def _find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The codes of kept hashes, and the places of those that aren't kept."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64), np.arange(len(hashes))
        at = np.searchsorted(self.hashes, hashes)
        at[at == len(self.hashes)] = 0
        return self.codes[at], np.flatnonzero(self.hashes[at] != hashes)


def _byte_chars() -> dict[int, str]:
    """Byte-level tokenizers write each byte as a printable character: printable Latin-1 as itself, the others from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


def word_ids(name: str) -> WordIds:
    if name not in _MEMO:
        _MEMO[name] = WordIds(name)
    return _MEMO[name]


PIECES = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")])


def pieces(docs: DataFrame, *, tokenizer: str, window: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document cut into whole windows and a rest, with the CRC-32 of each piece's ids as little-endian unsigned 32-bit."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(tokenizer)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                ids, offsets = encode(part.column("text"))
                whole = np.insert(ids.astype("<u4"), offsets[1:], end_id)  # the end id after each text
                edges = offsets + np.arange(len(offsets))
                n = np.diff(edges)
                count = -(-n // window)
                doc = np.repeat(np.arange(len(n)), count)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * window
                length = np.minimum(window, n[doc] - start)
                raw = memoryview(whole.tobytes())
                base = (edges[doc] + start) * 4
                crc = np.fromiter((zlib.crc32(raw[a:b]) for a, b in zip(base.tolist(), (base + 4 * length).tolist())), np.int64, len(doc))
                yield pa.record_batch([part.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crc), pa.array(n[doc])], names=PIECES.names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(frugal(cut), PIECES)


# ---------------------------------------------------------------- patterns


def combinations(parts: int, deepest: int) -> np.ndarray:
    """All non-increasing rows of up to three positive numbers (0: none) with the sum `parts`."""
    out = [(parts, 0, 0)]
    if deepest >= 2:
        out += [(a, parts - a, 0) for a in range(parts - 1, (parts - 1) // 2, -1) if parts - a <= a]
    if deepest >= 3:
        out += [(a, b, parts - a - b) for a in range(1, parts) for b in range(1, a + 1) if 1 <= parts - a - b <= b]
    return np.array(out, np.int64)


def least_squares(matrix: np.ndarray, wanted: np.ndarray, steps: int = 3000) -> np.ndarray:
    """x >= 0 that minimises |matrix x - wanted|, by the active-set method of Lawson and Hanson."""
    m, n = matrix.shape
    x, free = np.zeros(n), np.zeros(n, bool)
    scale = max(1.0, float(np.abs(wanted).max(initial=0)))
    for _ in range(steps):
        pull = matrix.T @ (wanted - matrix @ x)
        pull[free] = -np.inf
        j = int(np.argmax(pull))
        if pull[j] <= 1e-9 * scale or free.sum() >= m:
            return x
        free[j] = True
        while True:
            own = np.flatnonzero(free)
            s = np.linalg.lstsq(matrix[:, own], wanted, rcond=None)[0]
            if (s > 1e-12 * scale).all():
                x[:] = 0
                x[own] = s
                break
            low = s <= 1e-12 * scale
            step = np.min(x[own][low] / np.maximum(x[own][low] - s[low], 1e-300))
            x[own] += step * (s - x[own])
            free[own[low & (x[own] <= 1e-10 * scale)]] = False
            x[~free] = 0
            if not free[j] and not free.any():
                return x
    return x


def plan_patterns(histogram: dict[int, int], window: int, grid: int = GRID, deepest: int = DEEPEST) -> list[tuple[list[int], int]]:
    """[(lengths, repeats)] that use up the histogram {length: count}; no pattern is longer than the window."""
    left = np.zeros(window + 1, np.int64)
    for length, count in histogram.items():
        left[length] = count
    unit = window // grid if window % grid == 0 else 1
    parts = window // unit
    coarse = np.zeros(parts + 1)
    np.add.at(coarse, -(-np.arange(1, window + 1) // unit), left[1:])
    rows = combinations(parts, deepest)
    have = np.append(coarse > 0, False)
    rows = rows[have[rows].all(axis=1, where=rows > 0)]  # of lengths that there are
    out: list[tuple[list[int], int]] = []
    if len(rows):
        matrix = np.zeros((parts, len(rows)))
        for k in range(rows.shape[1]):
            use = rows[:, k] > 0
            np.add.at(matrix, (rows[use, k] - 1, np.flatnonzero(use)), 1)
        for i, repeats in enumerate(np.floor(least_squares(matrix, coarse[1:]) + 1e-6).astype(np.int64).tolist()):
            want = [int(p) for p in rows[i] if p]
            while repeats > 0:  # as long as the longest lengths on the grid's steps last, the pattern stays the same
                lengths = _longest(left, want, unit)
                if lengths is None:
                    break
                _fill(left, lengths, window)
                out.append((lengths, n := min(repeats, _times(left, lengths))))
                repeats -= n
                np.subtract.at(left, lengths, n)
    while left.any():
        lengths: list[int] = []
        _fill(left, lengths, window)
        out.append((lengths, n := _times(left, lengths)))
        np.subtract.at(left, lengths, n)
    return out


def _longest(left: np.ndarray, want: list[int], unit: int) -> list[int] | None:
    spent: dict[int, int] = {}
    out = []
    for p in want:
        for length in range(p * unit, (p - 1) * unit, -1):
            if left[length] > spent.get(length, 0):
                spent[length] = spent.get(length, 0) + 1
                out.append(length)
                break
        else:
            return None
    return out


def _fill(left: np.ndarray, lengths: list[int], window: int) -> None:
    """Adds to lengths the longest rests that fit, again and again."""
    room = window - sum(lengths)
    spent = {x: lengths.count(x) for x in lengths}
    there = np.flatnonzero(left)
    at = room
    while room > 0:
        k = int(np.searchsorted(there, min(room, at), side="right")) - 1
        while k >= 0 and left[there[k]] <= spent.get(int(there[k]), 0):
            k -= 1
        if k < 0:
            return
        length = int(there[k])
        n = int(min(room // length, left[length] - spent.get(length, 0)))
        lengths += [length] * n
        spent[length] = spent.get(length, 0) + n
        room -= n * length
        at = length - 1 if left[length] <= spent[length] else length


def _times(left: np.ndarray, lengths: list[int]) -> int:
    own, n = np.unique(lengths, return_counts=True)
    return int((left[own] // n).min())


# ---------------------------------------------------------------- assignment


def pack(cut: DataFrame, *, window: int) -> DataFrame:
    """The pieces with sequence_id and offset: each sequence's pieces stand end to end from 0, in at most `window` tokens."""
    spark = cut.sparkSession
    cut = materialise(cut, "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `window` rows
    full = histogram.pop(window, 0)
    patterns = [([window], full)] * bool(full) + plan_patterns(histogram, window)
    # For each length, in the order of patterns: the first rank, and the pattern's place in the numbering of sequences.
    spans: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for lengths, repeats in patterns:
        offset = 0
        for length in lengths:
            spans.setdefault(length, []).append((ranks.get(length, 0), sequence, offset, repeats))
            ranks[length] = ranks.get(length, 0) + repeats
            offset += length
        sequence += repeats
    keys = np.array([(length << 48) + first for length in sorted(spans) for first, *_ in spans[length]], np.int64)
    first = np.array([x[0] for length in sorted(spans) for x in spans[length]], np.int64)
    base = np.array([x[1] for length in sorted(spans) for x in spans[length]], np.int64)
    offsets = np.array([x[2] for length in sorted(spans) for x in spans[length]], np.int64)
    lookup = spark.sparkContext.broadcast((keys, first, base, offsets))  # bounded by the patterns' lengths, and so by the window

    # a salt for each million rows of a length or less; 64 at least, so that one length of most rows is spread
    salts = max(64, (full + sum(histogram.values())) >> 20)
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)))
    groups = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    groups = groups.withColumn("before", F.sum("n").over(W.Window.partitionBy("length").orderBy("salt").rowsBetween(W.Window.unboundedPreceding, -1)))
    groups = groups.select(F.col("length").alias("__length"), F.col("salt").alias("__salt"), F.coalesce("before", F.lit(0)).alias("before"))
    within = F.row_number().over(W.Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32"))
    ranked = salted.withColumn("within", within - 1).join(groups, (F.col("length") == F.col("__length")) & (F.col("salt") == F.col("__salt")))
    ranked = ranked.select(*PIECES.names, (F.col("before") + F.col("within")).cast("long").alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, first, base, offsets = lookup.value
        for b in batches:
            rank, length = np.asarray(b.column("rank")), np.asarray(b.column("length"))
            i = np.searchsorted(keys, (length << 48) + rank, side="right") - 1
            yield pa.record_batch([*(b.column(k) for k in PIECES.names), pa.array(base[i] + rank - first[i]), pa.array(offsets[i])], names=[*PIECES.names, "sequence_id", "offset"])

    return ranked.mapInArrow(place, T.StructType([*PIECES.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))


def pack_documents(docs: DataFrame, *, tokenizer: str = "word_bpe_49k.json", window: int = 4096, end_id: int = 2) -> DataFrame:
    return pack(pieces(docs, tokenizer=tokenizer, window=window, end_id=end_id), window=window)


def op4_sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
