r"""Language identification by character models: one interpolated Kneser-Ney model a language, of ORDER characters.

Characters are lower-cased letters; every run of others is one boundary sign. A model's n-grams of all orders lie in one sorted
array of hashes with the logarithms of their probabilities beside it, one column a language; an n-gram that no language has takes
the next shorter one, plus each language's weight of that context. A text's cross-entropy in a language is the mean over its
characters; the lowest wins. It is rejected if its distance from the entropy that texts of this length have in that language, in
standard errors, is beyond what any text of the calibration part shows, with a margin.

A letter that no language's texts have counts 1 / 256 in all of them. Null texts and texts without a letter are `und` with score 0,
and rejected. Ties go to the language that comes first. Repeated rows are scored alike, each for itself. Whole texts are scored, very
long ones alone. Languages are learned from a bounded sample, SAMPLE texts of each and SAMPLE_TOTAL characters in all, taken by hash
and not by position. Without any labelled text all are `und`. Extra columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import frugal, mix, slices, table

ORDER = 4
#: Texts of each language that a model is learned from at most, and the characters that such a text has at most.
SAMPLE, SAMPLE_CHARS = 600, 200_000
#: Characters of all texts of all languages that models are learned from at most: what the driver holds.
SAMPLE_TOTAL = 24_000_000
BITS = 8  # of a character's code
MARGIN = 2.0

_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point: its lower-case code point if it is a letter, else 0."""
    if not _LETTER:
        out = np.zeros(0x110000, np.uint32)
        for c in range(0x30000):
            x = chr(c)
            if x.isalpha():
                low = x.lower()
                out[c] = ord(low) if len(low) == 1 else c
        _LETTER.append(out)
    return _LETTER[0]


def symbols(texts: list[str | None], alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all texts end to end, their n+1 offsets and the numbers of letters. Each text begins and ends with a boundary (0);
    letters outside the sorted alphabet have the last code."""
    points = np.frombuffer("".join(f"\0{t or ''}\0" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    offsets = np.concatenate([[0], np.cumsum([len(t or "") + 2 for t in texts])])
    low = _letters()[points]
    at = np.searchsorted(alphabet, low)
    at[at == len(alphabet)] = 0
    code = np.where(low == 0, 0, np.where(alphabet[at] == low, at + 1, len(alphabet) + 1)).astype(np.uint64)
    first = np.zeros(len(code), bool)
    first[offsets[:-1]] = True
    keep = (code > 0) | first
    keep[1:] |= code[:-1] > 0  # of a run of boundaries only the first
    upto = np.concatenate([[0], np.cumsum(keep)])
    letters = np.concatenate([[0], np.cumsum(code > 0)])
    return code[keep], upto[offsets], np.diff(letters[offsets])


def grams(codes: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """At each character, the n-gram that ends there, or as much of it as the text has."""
    out = codes + np.uint64(1)
    for k in range(1, n):
        moved = np.zeros_like(codes)
        moved[k:] = codes[:-k] + np.uint64(1)
        for j in range(k):  # nothing from the text before
            at = offsets[:-1] + j
            moved[at[at < len(moved)]] = 0
        out |= moved << np.uint64(BITS * k)
    return out


@dataclass
class Models:
    languages: list[str]
    alphabet: np.ndarray
    #: for each order 1..ORDER: sorted hashes, and log probabilities by row and language
    keys: list[np.ndarray]
    logs: list[np.ndarray]
    #: for each order 1..ORDER-1, of contexts: sorted hashes, and the log weights of the shorter n-grams
    contexts: list[np.ndarray]
    weights: list[np.ndarray]
    #: by language: mean entropy, its variance by character and by text, and the largest distance in standard errors
    calibration: np.ndarray

    def log_probability(self, codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(languages, characters)."""
        gram = grams(codes, offsets, ORDER)
        out = np.zeros((len(codes), len(self.languages)), np.float32)
        rest = np.arange(len(codes))
        for n in range(ORDER, 0, -1):
            mask = np.uint64((1 << (BITS * n)) - 1)
            key = mix(gram[rest] & mask)
            keys = self.keys[n - 1]
            at = np.searchsorted(keys, key)
            at[at == len(keys)] = 0
            hit = keys[at] == key
            out[rest[hit]] += self.logs[n - 1][at[hit]]
            rest = rest[~hit]
            if not len(rest):
                return out
            if n > 1:
                context = mix((gram[rest] & mask) >> np.uint64(BITS))
                have = self.contexts[n - 2]
                at = np.searchsorted(have, context)
                at[at == len(have)] = 0
                seen = have[at] == context
                out[rest[seen]] += self.weights[n - 2][at[seen]]
        out[rest] += np.float32(-math.log(1 << BITS))
        return out

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By text: cross-entropy by language, characters, letters."""
        codes, offsets, letters = symbols(texts, self.alphabet)
        logs = self.log_probability(codes, offsets)
        logs[offsets[:-1]] = 0  # the first boundary is given
        n = np.maximum(np.diff(offsets) - 1, 1)
        return -np.add.reduceat(logs.astype(np.float64), offsets[:-1], axis=0) / n[:, None], n, letters

    def distance(self, entropy: np.ndarray, best: np.ndarray, n: np.ndarray) -> np.ndarray:
        mean, by_char, by_text, _ = self.calibration[best].T
        return (entropy - mean) / np.sqrt(by_char / n + by_text)


def _discounts(counts: np.ndarray) -> float:
    ones, twos = int((counts == 1).sum()), int((counts == 2).sum())
    return ones / (ones + 2 * twos) if ones and twos else 0.5


def train(texts: dict[str, list[str]]) -> Models:
    """Models of the languages (in code-point order) from their texts; every fifth text calibrates the rejection."""
    languages = sorted(texts)
    learn = {x: [t for i, t in enumerate(texts[x]) if i % 5 or len(texts[x]) < 5] for x in languages}
    low = _letters()
    points = [low[np.frombuffer("".join(learn[x]).encode("utf-32-le", "surrogatepass"), np.uint32)] for x in languages]
    found, n = np.unique(np.concatenate([p[p > 0] for p in points]) if points else np.zeros(0, np.uint32), return_counts=True)
    alphabet = np.sort(found[np.argsort(-n, kind="stable")][: (1 << BITS) - 4])
    alphabet = alphabet if len(alphabet) else np.array([ord("a")], np.uint32)

    per: list[list[dict]] = []
    for x in languages:
        codes, offsets, _ = symbols(learn[x], alphabet)
        gram = grams(codes, offsets, ORDER)
        full = gram[np.setdiff1d(np.arange(len(codes)), offsets[:-1])]  # the first boundary is not predicted
        orders: list[dict] = [{}] * ORDER
        seen, counts = np.unique(full, return_counts=True)
        for n in range(ORDER, 0, -1):  # below the highest order: by how many characters an n-gram is preceded
            orders[n - 1] = {"gram": seen, "count": counts, "discount": _discounts(counts)}
            mask = np.uint64((1 << (BITS * (n - 1))) - 1)
            seen, counts = np.unique(seen & mask, return_counts=True)
        per.append(orders)

    keys, logs, contexts, weights = [], [], [], []
    shorter: tuple[np.ndarray, np.ndarray] | None = None
    size = len(alphabet) + 2
    for n in range(1, ORDER + 1):
        every = np.unique(np.concatenate([o[n - 1]["gram"] for o in per])) if per else np.zeros(0, np.uint64)
        heads = np.unique(every >> np.uint64(BITS))
        p, w = np.zeros((len(every), len(per))), np.ones((len(heads), len(per)))
        low_mask = np.uint64((1 << (BITS * (n - 1))) - 1)
        for k, orders in enumerate(per):
            own = orders[n - 1]
            head = np.searchsorted(heads, own["gram"] >> np.uint64(BITS))
            total = np.bincount(head, own["count"], len(heads))
            kinds = np.bincount(head, minlength=len(heads))
            known = total > 0
            w[known, k] = own["discount"] * kinds[known] / total[known]
            p[np.searchsorted(every, own["gram"]), k] = (own["count"] - own["discount"]) / total[head]
        head_of = np.searchsorted(heads, every >> np.uint64(BITS))
        if shorter is None:
            p += w[head_of] / size
        else:
            p += w[head_of] * shorter[1][np.searchsorted(shorter[0], every & low_mask)]
        shorter = (every, p)
        hashed = mix(every)
        order = np.argsort(hashed)
        keys.append(hashed[order])
        logs.append(np.log(np.maximum(p[order], 1e-12)).astype(np.float32))
        if n > 1:
            hashed = mix(heads)
            order = np.argsort(hashed)
            contexts.append(hashed[order])
            weights.append(np.log(np.maximum(w[order], 1e-12)).astype(np.float32))
    models = Models(languages, alphabet, keys, logs, contexts, weights, np.zeros((len(languages), 4)))
    for k, x in enumerate(languages):
        held = [t for i, t in enumerate(texts[x]) if i % 5 == 0]
        e, n, letters = models.entropies(held or [""])
        e, n = e[letters > 0, k], n[letters > 0]
        if not len(e):
            models.calibration[k] = [math.log(size), 1, 1, 10]
            continue
        mean = float(np.average(e, weights=n))
        spread = (e - mean) ** 2
        by_char = max(1.0, float(np.average(spread * n, weights=1 / n))) if len(e) > 1 else 1.0
        models.calibration[k] = [mean, by_char, max(float(np.median(spread)), 0.0025), 0]
        models.calibration[k, 3] = max(4.0, float(models.distance(e, np.full(len(e), k), n).max())) * MARGIN
    return models


def sample(docs: DataFrame, *, per_language: int = SAMPLE) -> dict[str, list[str]]:
    """About per_language texts of each label, those of the smallest hashes, for the driver: of all labels together at most
    SAMPLE_TOTAL characters, which the labels share equally. A label whose first text is beyond its share has none."""
    labelled = docs.where(f"lang IS NOT NULL AND length(text) <= {SAMPLE_CHARS}").select("lang", "text", F.xxhash64("doc_id", F.length("text")).alias("__h"))
    counts = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("__n"))
    # in expectation a little more than per_language, cut at per_language; all where there are fewer
    share = F.least(F.lit(1.0), F.lit(per_language * 1.3) / F.col("__n"))
    # one row a language, as in the models, so texts needn't move to be sampled
    near = labelled.join(F.broadcast(counts), "lang").where((F.shiftrightunsigned("__h", 11) / F.lit(float(1 << 53))) < share)
    rows = near.select("lang", "text", "__h").orderBy("__h").toLocalIterator()
    out: dict[str, list[str]] = {}
    room = dict.fromkeys((r["lang"] for r in counts.select("lang").toLocalIterator()), 0)
    room = dict.fromkeys(room, SAMPLE_TOTAL // max(1, len(room)))
    for r in rows:
        own = out.setdefault(r["lang"], [])
        if len(own) < per_language and len(r["text"]) <= room[r["lang"]]:
            room[r["lang"]] -= len(r["text"])
            own.append(r["text"])
    return {x: own for x, own in out.items() if own}


PREDICTED = [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("entropy", T.DoubleType()), ("rejected", T.BooleanType())]


def predict(docs: DataFrame, models: Models, *, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score (the winner's share of the likelihood of the mean character, to the power of at most 32
    characters), entropy and rejected. Of docs' columns those with these names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(models)  # bounded by the sample
    docs = docs.drop(*(n for n, _ in PREDICTED))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        names = np.array([*models.languages, "und"], object)
        for batch in batches:
            for part in slices(batch, text_col, 1 << 20):
                texts = part.column(text_col).to_pylist()
                if models.languages:
                    e, n, letters = models.entropies(texts)
                else:
                    e, n, letters = np.zeros((len(texts), 1)), np.ones(len(texts)), np.zeros(len(texts))
                best = e.argmin(axis=1)
                power = np.minimum(n, 32)[:, None]
                likely = np.exp(-(e - e.min(axis=1, keepdims=True)) * power)
                share = 1 / likely.sum(axis=1)
                none = letters == 0
                entropy = e[np.arange(len(e)), best]
                far = none | (models.distance(entropy, best, n) > models.calibration[best, 3]) if models.languages else none
                yield pa.record_batch(
                    [*part.columns, pa.array(names[np.where(none, len(names) - 1, best)], pa.string()), pa.array(np.where(none, 0.0, share)), pa.array(np.where(none, 0.0, entropy)), pa.array(far)],
                    names=[*part.schema.names, *(k for k, _ in PREDICTED)],
                )

    return docs.mapInArrow(frugal(score), T.StructType([*docs.schema.fields, *(T.StructField(*x) for x in PREDICTED)]))


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text, mod 5, is 0; a null id is as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    models = train(sample(docs.where(~held_out())))
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return predict(rows, models).select("doc_id", "held_out", "lang_pred", "score", "entropy", "rejected")
