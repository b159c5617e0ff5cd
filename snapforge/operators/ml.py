"""Features at a date, folds, baselines, boosted trees by tier, metrics and recommendation."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import date, timedelta
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import StopWordsRemover
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.expr import inverse_log_return, log_return, ordinal, ratio, reason, tier
from .gold import with_columns
from .windows import history, last


#: Columns that tell of the future and never are features.
LEAKAGE = ("price_ath", "price_atl", "days_with_price")
#: Features by their treatment: nulls become the median, zero, or stay apart.
MEDIAN = ["edhrec_rank", "edhrec_saltiness", "foil_premium"]
ZERO = ["top8_appearances_30d", "deck_pct"]
PLAIN = [
    "rarity_ord", "print_count", "mana_value", "format_count", "lag_1d", "lag_7d", "lag_14d", "lag_30d", "rolling_mean_7d", "rolling_std_14d", "rolling_min_30d", "rolling_max_30d", "momentum_7d", "log_eur",
    "is_reserved", "is_legendary", "is_commander_legal", "has_mtgjson_data",
]
#: What a missing plain feature is to the trees: below all values, so that a split can set it apart.
MISSING = -1e9


def lag_features(prices: DataFrame, day: str) -> DataFrame:
    """Windows over the whole history, then the rows of one day."""
    w = history()
    rows = with_columns(prices, {"edhrec_rank": "double", "foil_premium": "double"}).select("uuid", "snapshot_date", "eur", "edhrec_rank", "foil_premium")
    rows = rows.withColumns({f"lag_{n}d": F.lag("eur", n).over(w) for n in (1, 7, 14, 30)})
    rows = rows.withColumns({
        "rolling_mean_7d": F.avg("eur").over(last(7)), "rolling_std_14d": F.stddev_samp("eur").over(last(14)),
        "rolling_min_30d": F.min("eur").over(last(30)), "rolling_max_30d": F.max("eur").over(last(30)), "momentum_7d": ratio(F.col("eur") - F.col("lag_7d"), F.col("lag_7d")),
    })
    return rows.where(F.col("snapshot_date") == F.to_date(F.lit(day)))


def target(prices: DataFrame, day: str, ahead: int = 7) -> DataFrame:
    now = prices.where(F.col("snapshot_date") == F.to_date(F.lit(day))).select("uuid", F.col("eur").alias("p0"))
    later = prices.where(F.col("snapshot_date") == F.date_add(F.to_date(F.lit(day)), ahead)).select("uuid", F.col("eur").alias("p1"))
    return now.join(later, "uuid").select("uuid", log_return(F.col("p0"), F.col("p1")).alias(f"log_return_{ahead}d"))


def enrich_cards(cards: DataFrame, stubs: bool = True) -> DataFrame:
    """Card features with the rarity's ordinal; stubs: the columns of sources that aren't there yet, constant."""
    rows = with_columns(cards, {"rarity": "string"}).withColumn("rarity_ord", ordinal(F.col("rarity")).cast("double"))
    constant = {"has_mtgjson_data": 1.0, "top8_appearances_30d": 0.0, "deck_pct": 0.0} if stubs else {}
    rows = rows.withColumns({c: F.lit(v) for c, v in constant.items()})
    return rows.withColumns({c: F.col(c).cast("double") for c in ("is_reserved", "is_legendary", "is_commander_legal", "has_mtgjson_data") if c in rows.columns})


def enrich_lags(lags: DataFrame) -> DataFrame:
    """Lag features with the price's logarithm, the rolling mean as its logarithm, and the return since the row before."""
    return lags.withColumns({"log_eur": F.log1p("eur"), "rolling_mean_7d": F.log1p("rolling_mean_7d"), "lag_1d_return": ratio(F.col("eur") - F.col("lag_1d"), F.col("lag_1d"))})


def plain_types(rows: DataFrame) -> DataFrame:
    """No nulls where a number must be: booleans are false, whole numbers 0; doubles stay as they are."""
    zero = {"boolean": F.lit(False), "tinyint": F.lit(0), "smallint": F.lit(0), "int": F.lit(0), "bigint": F.lit(0)}
    return rows.select(*[F.coalesce(F.col(n), zero[t].cast(t)).alias(n) if t in zero else F.col(n) for n, t in rows.dtypes])


def without_leakage(rows: DataFrame) -> DataFrame:
    return rows.drop(*LEAKAGE)


def inference_features(prices: DataFrame, cards: DataFrame, day: str) -> DataFrame:
    """The matrix that models see, in training and in use: the day's lags beside the cards' attributes."""
    lags, own = enrich_lags(lag_features(prices, day)), enrich_cards(cards)
    return plain_types(lags.join(own.select("uuid", *[c for c in own.columns if c not in lags.columns]), "uuid"))


def training_frame(prices: DataFrame, cards: DataFrame, day: str) -> DataFrame:
    """inference_features of the rows that have a target, with it and without what leaks."""
    return without_leakage(inference_features(prices, cards, day).join(target(prices, day), "uuid"))


class Features:
    """The vector that models see. Nulls of the median columns become the fitted rows' median (MISSING where these have none), of the
    zero columns 0, of the plain ones MISSING."""

    def __init__(self, median: list[str] = MEDIAN, zero: list[str] = ZERO, plain: list[str] = PLAIN) -> None:
        self.median, self.zero, self.plain = median, zero, plain
        self.names = [*median, *zero, *plain]
        self.fill = dict.fromkeys(zero, 0.0) | dict.fromkeys([*plain, *median], MISSING)

    def fit(self, rows: DataFrame) -> Features:
        if self.median:
            found = rows.agg(*[F.percentile_approx(F.col(c).cast("double"), 0.5, 10_000).alias(c) for c in self.median]).first()
            self.fill |= {c: found[c] for c in self.median if found[c] is not None}
        return self

    def transform(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("features", array_to_vector(F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float(self.fill[c]))) for c in self.names])))


def folds(dates: list[date], train_days: int = 30, val_days: int = 7, step: int = 7, least: int = 3) -> list[tuple[date, date, date]]:
    """(first train day, first validation day, day after the last); an error if there are fewer than `least`. The train window starts
    with the first date and grows."""
    out, split = [], min(dates) + timedelta(train_days)
    while split + timedelta(val_days) <= max(dates) + timedelta(1):
        out.append((min(dates), split, split + timedelta(val_days)))
        split += timedelta(step)
    if len(out) < least:
        raise ValueError(f"{len(out)} folds; {least} are needed")
    return out


#: A model to cross-validate: from (train, validation), with features and log_return_7d, to validation with prediction.
Model = Callable[[DataFrame, DataFrame], DataFrame]


def naive(train: DataFrame, val: DataFrame) -> DataFrame:
    return val.withColumn("prediction", F.lit(0.0))


def mean_return(train: DataFrame, val: DataFrame) -> DataFrame:
    return val.crossJoin(F.broadcast(train.agg(F.avg("log_return_7d").alias("prediction"))))  # one row


def reversion(train: DataFrame, val: DataFrame) -> DataFrame:
    """Back to the rolling mean; both are logarithms."""
    return val.withColumn("prediction", F.col("rolling_mean_7d") - F.col("log_eur"))


def autoregression(train: DataFrame, val: DataFrame) -> DataFrame:
    """Least squares on the last day's return; a missing one counts as 0."""
    x = F.coalesce("lag_1d_return", F.lit(0.0))
    line = train.agg(F.regr_slope("log_return_7d", x).alias("__a"), F.regr_intercept("log_return_7d", x).alias("__b"), F.avg("log_return_7d").alias("__m"))
    fit = F.coalesce(F.col("__a") * x + F.col("__b"), F.col("__m"))  # without any spread of x the mean
    return val.crossJoin(F.broadcast(line)).withColumn("prediction", fit).drop("__a", "__b", "__m")  # one row


def walk_forward(prices: DataFrame, cards: DataFrame, models: dict[str, Model], windows: list[tuple[date, date, date]] | None = None) -> DataFrame:
    """(fold_idx, val_snapshot, model, tier, n_cards, mae, mape): each model fitted on the last snapshot of each fold's train window and
    evaluated on the last of its validation window, by price tier. Folds without rows on either side are left out."""
    days = sorted(r[0] for r in prices.select("snapshot_date").distinct().collect())  # one row a day of the history
    out = []
    for i, (_, split, end) in enumerate(windows or folds(days)):
        train_day, val_day = max((d for d in days if d < split), default=None), max((d for d in days if split <= d < end), default=None)
        if train_day is None or val_day is None:
            continue
        train, val = (training_frame(prices, cards, str(d)).where("log_return_7d IS NOT NULL") for d in (train_day, val_day))
        if train.isEmpty() or val.isEmpty():
            continue
        for name, model in models.items():
            scored = model(train, val).select(F.lit(name).alias("model"), tier(F.col("eur")).alias("tier"), F.col("log_return_7d").alias("y"), "prediction")
            out.append(per_tier(scored).select(F.lit(i).alias("fold_idx"), F.lit(val_day).alias("val_snapshot"), "model", "tier", "n_cards", "mae", "mape"))
    if not out:
        return prices.sparkSession.createDataFrame([], "fold_idx int, val_snapshot date, model string, tier int, n_cards long, mae double, mape double")
    return reduce(DataFrame.unionByName, out)


def boosted_model(rounds: int = 1000) -> Model:
    """The boosted trees by tier as a model to cross-validate."""

    def run(train: DataFrame, val: DataFrame) -> DataFrame:
        matrix = Features().fit(train)
        return predict_by_tier(matrix.transform(val), by_tier(matrix.transform(train), "log_return_7d", rounds=rounds))

    return run


def importances(model: GBTRegressionModel, names: list[str]) -> list[tuple[str, float]]:
    """Features by the share of the gain of all splits on them, the largest first; ties by name."""
    return sorted(zip(names, model.featureImportances.toArray().tolist()), key=lambda x: (-x[1], x[0]))


def best_round(errors: list[float], patience: int) -> tuple[int, bool]:
    """The round of least error before `patience` rounds without a lesser one, and whether those have been seen."""
    best = 0
    for i, e in enumerate(errors):
        if e < errors[best]:
            best = i
        elif i - best >= patience:
            return best + 1, True
    return best + 1, False


def boosted(rows: DataFrame, label: str, key: str = "uuid", rounds: int = 1000, patience: int = 50) -> GBTRegressionModel:
    """Absolute loss, up to the best round on the fifth of the keys that a hash picks; stops after `patience` rounds without gain.
    Spark can't go on with a model, so that the rounds are doubled until the stop is seen; a seed gives the same first trees."""
    tasks = rows.sparkSession.sparkContext.defaultParallelism
    marked = rows.withColumn("is_validation", F.pmod(F.xxhash64(key), F.lit(5)) == 0).repartition(tasks).persist()
    try:
        train, held = marked.where("NOT is_validation"), marked.where("is_validation")
        if train.isEmpty() or held.isEmpty():  # too few keys to hold some out
            train = held = marked
        grown = lambda n: GBTRegressor(labelCol=label, lossType="absolute", maxIter=n, maxDepth=3, seed=7).fit(train)
        n = min(rounds, patience + 14)
        while True:
            model = grown(n)
            best, seen = best_round(model.evaluateEachIteration(held, "absolute"), patience)
            if seen or n >= rounds:
                return model if best == n else grown(best)
            n = min(rounds, 2 * n)
    finally:
        marked.unpersist()


def by_tier(rows: DataFrame, label: str, price: str = "eur", least: int = 50, rounds: int = 1000) -> dict:
    """A model for tiers 1 and 2, the second only with enough rows; tier 3 has none."""
    marked = rows.withColumn("tier", tier(F.col(price)))
    counts = {r["tier"]: r["count"] for r in marked.groupBy("tier").count().collect()}
    return {t: boosted(marked.where(F.col("tier") == t), label, rounds=rounds) for t in (1, 2) if counts.get(t, 0) >= (least if t == 2 else 1)}


def predict_by_tier(rows: DataFrame, models: dict, price: str = "eur") -> DataFrame:
    marked = rows.withColumn("tier", tier(F.col(price)))
    parts = [m.transform(marked.where(F.col("tier") == t)) for t, m in models.items()]
    rest = marked.where(~F.col("tier").isin([0, *models])).withColumn("prediction", F.lit(None).cast("double"))
    out = rest.select(*marked.columns, "prediction")
    for p in parts:
        out = out.unionByName(p.select(*marked.columns, "prediction"))
    return out


def absolute_percentage(y: Column, p: Column, clip: float = 0.01) -> Column:
    return F.abs(y - p) / F.greatest(F.abs(y), F.lit(clip)) * 100


def per_tier(rows: DataFrame, y: str = "y", p: str = "prediction") -> DataFrame:
    """rows with model and tier: n_cards, mae, mape of each that has rows."""
    return rows.where(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy("model", "tier").agg(F.count(F.lit(1)).alias("n_cards"), F.avg(F.abs(F.col(y) - F.col(p))).alias("mae"), F.avg(absolute_percentage(F.col(y), F.col(p))).alias("mape"))


def worst(rows: DataFrame, y: str, p: str, n: int = 20) -> DataFrame:
    return rows.withColumn("pct_error", absolute_percentage(F.col(y), F.col(p))).orderBy(F.col("pct_error").desc_nulls_last(), "uuid").limit(n)


def error_by_group(rows: DataFrame, group: str, y: str, p: str) -> DataFrame:
    e = F.abs(F.col(y) - F.col(p))
    out = rows.groupBy(group).agg(F.avg(e).alias("mean"), F.count(e).alias("count"), F.stddev_samp(e).alias("std"), F.sum(e).alias("__sum"))
    return out.withColumn("share_of_total", ratio(F.col("__sum"), F.sum("__sum").over(W.Window.partitionBy()))).drop("__sum")  # one row a group


# ---------------------------------------------------------------- recommendation


#: Bytes of text whose words a task counts at once; a longer text goes alone.
TEXT_SLICE = 4 << 20
_WORD = np.zeros(256, bool)
_WORD[[*b"abcdefghijklmnopqrstuvwxyz0123456789_"]] = True


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of lower-case texts, runs of ASCII letters, digits and underscores, and of each the place of its text."""
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64, len(texts) + 1, 8 * texts.offset)
    z = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
    at, inside, edge = at - at[0], _WORD[z], np.zeros(len(z) + 1, bool)
    edge[at] = True
    out = np.concatenate([[True], ~inside, [True]])  # what lies outside words, from the byte before the first one
    begin, end = np.flatnonzero(inside & (out[:-2] | edge[:-1])), np.flatnonzero(inside & (out[2:] | edge[1:])) + 1
    place = np.concatenate([[0], np.cumsum(end - begin)])
    words = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(place), pa.py_buffer(z[inside]))
    return words, np.searchsorted(at, begin, side="right") - 1


def _text_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with a text in the last column, cut to about TEXT_SLICE bytes of it."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(batch.num_columns - 1)).to_numpy(zero_copy_only=False)) if batch.num_rows else []
        at = 0
        while at < batch.num_rows:
            n = max(1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TEXT_SLICE, side="right")) - at)
            yield batch.slice(at, n)
            at += n


class _Counter:
    """Counts the words of texts, each text a document: two characters at least, no stop words."""

    def __init__(self, stop: list[str]) -> None:
        self.stop = stop

    def _pairs(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """(dictionary, document, code, n): of each document its distinct words."""
        words, doc = _words(texts)
        coded = words.dictionary_encode()
        known, size = coded.dictionary, max(1, len(coded.dictionary))
        keep = pc.and_(pc.greater_equal(pc.binary_length(known), 2), pc.invert(pc.is_in(known, pa.array(self.stop, known.type)))).to_numpy(zero_copy_only=False)
        code = coded.indices.to_numpy()
        kept = keep[code] if len(code) else np.zeros(0, bool)
        pair, n = np.unique(doc[kept] * size + code[kept], return_counts=True)
        return known, pair // size, pair % size, n

    def totals(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _text_slices(batches):
            known, _, code, n = self._pairs(b.column(0))
            total, df = np.bincount(code, n, len(known)).astype(np.int64), np.bincount(code, minlength=len(known))
            got = np.flatnonzero(df)
            yield pa.record_batch([known.take(pa.array(got)).cast(pa.string()), pa.array(total[got]), pa.array(df[got])], names=["term", "total", "df"])

    def by_document(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _text_slices(batches):
            known, doc, code, n = self._pairs(b.column(1))
            yield pa.record_batch([b.column(0).take(pa.array(doc)), known.take(pa.array(code)).cast(pa.string()), pa.array(n)], names=["key", "term", "n"])


@dataclass
class Weights:
    """The weights of a table's most frequent terms, in their order."""

    terms: list[str]
    idf: list[float]

    def matrix(self, texts: pa.Array) -> np.ndarray:
        """Of each text its terms' weights: sublinear tf times idf, of length 1."""
        words, doc = _words(texts)
        code = pc.index_in(words, pa.array(self.terms, words.type)).fill_null(-1).to_numpy()
        n = np.bincount(doc[code >= 0] * len(self.terms) + code[code >= 0], minlength=len(texts) * len(self.terms)).reshape(len(texts), -1)
        w = np.where(n > 0, (1 + np.log(np.maximum(n, 1))) * self.idf, 0.0)
        norm = np.sqrt((w * w).sum(axis=1, keepdims=True))
        return w / np.where(norm > 0, norm, 1.0)

    def long(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = pa.array(self.terms, pa.string())
        for b in _text_slices(batches):
            w = self.matrix(b.column(1))
            doc, code = np.nonzero(w)
            yield pa.record_batch([b.column(0).take(pa.array(doc)), terms.take(pa.array(code)), pa.array(w[doc, code])], names=["key", "term", "weight"])

    def beside(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _text_slices(batches):
            w = self.matrix(b.column(2)) if self.terms else np.zeros((b.num_rows, 0))
            x = np.hstack([np.asarray(b.column(1).flatten(), np.float64).reshape(b.num_rows, -1), w])
            at = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * x.shape[1], pa.int32())
            yield pa.record_batch([b.column(0), pa.ListArray.from_arrays(at, pa.array(x.ravel()))], names=["key", "vector"])


class _Texts:
    """A table's documents, all rows of one key being one: rows whose key is theirs alone are counted where they lie, and only the rows
    of shared or null keys are brought together."""

    def __init__(self, rows: DataFrame, key: str, text: str) -> None:
        self.key, self.kind = key, rows.schema[key].dataType.simpleString()
        self.rows, self.text = rows, F.lower(F.coalesce(F.col(text), F.lit("")))
        shared = rows.groupBy(F.col(key).alias("__key")).count().where("count > 1 OR __key IS NULL").select("__key")
        self.alone, self.together = rows, None
        if not shared.isEmpty():
            on = F.col(key).eqNullSafe(F.col("__key"))
            self.alone, self.together = rows.join(shared, on, "left_anti"), rows.join(shared, on, "left_semi")

    def _together(self, counter: _Counter) -> DataFrame:
        """(key, term, n) of the shared keys."""
        counted = self.together.select(self.key, self.text.alias("__text")).mapInArrow(counter.by_document, f"key {self.kind}, term string, n long")
        return counted.groupBy("key", "term").agg(F.sum("n").alias("n"))

    def fit(self, terms: int, least: int) -> Weights:
        self.counter = _Counter(StopWordsRemover.loadDefaultStopWords("english"))
        counted = self.alone.select(self.text.alias("__text")).mapInArrow(self.counter.totals, "term string, total long, df long")
        if self.together is not None:
            counted = counted.unionByName(self._together(self.counter).groupBy("term").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("df")))
        summed = counted.groupBy("term").agg(F.sum("total").alias("total"), F.sum("df").alias("df")).where(F.col("df") >= least)
        top = sorted(summed.orderBy(F.desc("total"), "term").limit(terms).collect())  # `terms` rows
        docs = self.rows.count() if top else 0
        return Weights([r["term"] for r in top], [float(np.log((1 + docs) / (1 + r["df"])) + 1) for r in top])

    def shared_weights(self, fitted: Weights) -> DataFrame:
        """(key, term, weight) of the shared keys."""
        idf = F.element_at(F.create_map(*[F.lit(x) for pair in zip(fitted.terms, fitted.idf) for x in pair]), F.col("term"))
        weighed = self._together(self.counter).where(F.col("term").isin(fitted.terms)).withColumn("w", (1 + F.log("n")) * idf)
        norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.Window.partitionBy("key")))
        return weighed.select(F.col("key").alias(self.key), "term", (F.col("w") / norm).alias("weight"))


def tfidf(rows: DataFrame, key: str, text: str, terms: int = 500, least: int = 5) -> DataFrame:
    """(key, term, weight): sublinear tf times smoothed idf, each document's weights of length 1; the most frequent terms only."""
    texts = _Texts(rows, key, text)
    fitted = texts.fit(terms, least)
    if not fitted.terms:
        return rows.where("false").select(key, F.lit("").alias("term"), F.lit(0.0).alias("weight"))
    out = texts.alone.select(key, texts.text.alias("__text")).mapInArrow(fitted.long, f"key {texts.kind}, term string, weight double").withColumnRenamed("key", key)
    return out if texts.together is None else out.unionByName(texts.shared_weights(fitted))


def text_beside(rows: DataFrame, key: str, text: str, columns: list[str], terms: int = 500, least: int = 5) -> DataFrame:
    """(key, vector): stacked of the rows' own columns and their texts' weights, whose terms come in their order."""
    texts = _Texts(rows, key, text)
    fitted = texts.fit(terms, least)
    plain = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]).cast("array<double>")
    out = texts.alone.select(key, plain.alias("__plain"), texts.text.alias("__text")).mapInArrow(fitted.beside, f"key {texts.kind}, vector array<double>").withColumnRenamed("key", key)
    if texts.together is None:
        return out
    weights = texts.shared_weights(fitted) if fitted.terms else rows.where("false").select(key, F.lit("").alias("term"), F.lit(0.0).alias("weight"))
    return out.unionByName(stacked(texts.together, weights, key, columns, fitted.terms))


def stacked(static: DataFrame, weights: DataFrame, key: str, columns: list[str], terms: list[str]) -> DataFrame:
    """(key, vector): the static columns of each row, then its weights (key, term, weight) of the terms, 0 where it has none."""
    held = weights.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("term", "weight"))).alias("__w"))  # at most `terms` of a key
    of = F.array(*[F.coalesce(F.col("__w")[t], F.lit(0.0)) for t in terms]) if terms else F.array().cast("array<double>")
    plain = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns])
    return static.join(held, key, "left").select(key, F.concat(plain, of).alias("vector"))


#: Rows and queries of a block: a task holds the scores of one pair of blocks.
ROW_BLOCK, QUERY_BLOCK = 8192, 256


def _blocks(rows: DataFrame, key: str, size: int, names: tuple[str, str]) -> DataFrame:
    """Rows of (keys, vectors end to end): at most `size` rows of a partition each."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def packed() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            keys, z = t.column(0).combine_chunks(), t.column(1).combine_chunks().flatten()
            return pa.record_batch([pa.ListArray.from_arrays([0, len(keys)], keys), pa.ListArray.from_arrays([0, len(z)], z)], names=list(names))

        for batch in batches:
            while batch.num_rows:
                held.append(batch.slice(0, size - n))
                n += held[-1].num_rows
                batch = batch.slice(held[-1].num_rows)
                if n == size:
                    yield packed()
                    held, n = [], 0
        if n:
            yield packed()

    return rows.select(key, "z").mapInArrow(run, f"{names[0]} array<{kind}>, {names[1]} array<double>")


def _nearest(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each pair of blocks and each query the k vectors of highest score; of equal scores those of least key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                keys, z, asked, q = (c[i].values for c in batch.columns)
                order = pc.array_sort_indices(keys)
                keys = keys.take(order)
                z = z.to_numpy(zero_copy_only=False).reshape(len(keys), -1)[order.to_numpy()]
                q = q.to_numpy(zero_copy_only=False).reshape(len(asked), -1)
                score = np.zeros((len(asked), len(keys)))
                for c in range(z.shape[1]):  # summed in the columns' order, so that scores don't depend on the blocks
                    score += q[:, c, None] * z[None, :, c]
                least = np.partition(score, len(keys) - k, axis=1)[:, len(keys) - k, None] if len(keys) > k else np.full((len(asked), 1), -np.inf)
                a, b = np.nonzero(score >= least)
                by = np.lexsort((b, -score[a, b], a))
                a, b = a[by], b[by]
                top = np.arange(len(a)) - np.searchsorted(a, a) < k
                a, b = a[top], b[top]
                at = pa.array(np.arange(len(a) + 1, dtype=np.int32) * z.shape[1], pa.int32())
                yield pa.record_batch([pa.ListArray.from_arrays(at, pa.array(q[a].ravel())), pa.ListArray.from_arrays(at, pa.array(z[b].ravel())), keys.take(pa.array(b)), pa.array(score[a, b])], names=["q", "z", "key", "score"])

    return run


def similar(rows: DataFrame, key: str, columns: list[str], queries: DataFrame, k: int = 10) -> DataFrame:
    """The k most cosine-similar rows of each query row, by population z-scores; null counts as the mean. Exact: each block of different
    vectors is compared with each block of different query vectors, and only a block's best of each query are written. Rows of equal
    vectors have equal scores, so that the k + 1 least keys of a vector, one of which may be the query's, are all that can be found."""
    stats = rows.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns])
    z = F.array(*[F.coalesce((F.col(c) - F.col(f"m_{c}")) / F.nullif(F.col(f"s_{c}"), F.lit(0.0)), F.lit(0.0)) for c in columns])
    scaled = rows.where(F.col(key).isNotNull()).crossJoin(F.broadcast(stats)).select(F.col(key).alias("key"), z.alias("z"))  # one row of statistics
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    scaled = scaled.withColumn("z", F.transform("z", lambda x: x / F.coalesce(F.nullif(F.sqrt(dot(F.col("z"), F.col("z"))), F.lit(0.0)), F.lit(1.0))))
    asked = scaled.join(queries.select(F.col(key).alias("key")), "key", "left_semi")
    kind, tasks = rows.schema[key].dataType.simpleString(), rows.sparkSession.sparkContext.defaultParallelism
    # the least keys of each vector; rows that share one are counted, at most k of them
    place = F.dense_rank().over(W.Window.partitionBy("z").orderBy("key"))
    least = scaled.withColumn("place", place).where(F.col("place") <= k + 1).groupBy("z", "key").agg(F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("n"))
    vectors = least.groupBy("z").agg(F.sort_array(F.collect_list(F.struct("key", "n"))).alias("own"))  # k + 1 of a vector
    different = asked.groupBy("z").agg(F.min("key").alias("key"))
    first = vectors.select(F.col("own")[0]["key"].alias("key"), "z")
    pairs = _blocks(first.repartition(tasks), "key", ROW_BLOCK, ("k", "z")).crossJoin(_blocks(different.repartition(tasks), "key", QUERY_BLOCK, ("asked", "q")))
    near = pairs.mapInArrow(_nearest(k + 1), f"q array<double>, z array<double>, key {kind}, score double")
    nth = F.row_number().over(W.Window.partitionBy("q").orderBy(F.desc("score"), "key"))
    near = near.withColumn("place", nth).where(F.col("place") <= k + 1).select("q", "z", "score").join(vectors, "z").select("q", "score", F.inline("own"))
    near = near.withColumn("place", nth).where(F.col("place") <= k + 1)
    found = near.groupBy("q").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "key", "n"))).alias("found"))
    others = F.filter("found", lambda e: e["key"] != F.col("query"))  # a query isn't its own neighbour
    best = F.slice(F.flatten(F.transform(others, lambda e: F.array_repeat(e, e["n"]))), 1, k)
    each = asked.distinct().withColumnRenamed("key", "query").join(found, F.col("z") == F.col("q")).select("query", F.explode(best).alias("e"))
    out = each.select("query", F.col("e.key").alias(key), (-F.col("e.s")).alias("similarity_score"))
    return out.withColumn("rank", F.row_number().over(W.Window.partitionBy("query").orderBy(F.desc("similarity_score"), key))).where(F.col("rank") <= k)


def underpriced(rows: DataFrame, actual: str = "eur", predicted: str = "predicted_eur", factor: float = 1.3) -> DataFrame:
    confidence = F.when(F.col(actual).isNotNull(), F.col(predicted) / F.greatest(F.col(actual), F.lit(0.01)))
    rows = rows.withColumns({"tier": tier(F.col(actual)), "confidence": confidence})
    flagged = F.coalesce(F.col("tier").isin(1, 2) & (F.col("confidence") > factor), F.lit(False))
    rows = rows.withColumn("is_underpriced", flagged).withColumn("reason", F.when(F.col("is_underpriced"), reason(F.col("confidence"))))
    return rows


def underpriced_listing(rows: DataFrame, tiers: tuple[int, ...] = (1, 2), least: float = 1.3, actual: str = "eur") -> DataFrame:
    """The underpriced rows with a price, of the tiers and at least that confident, the most confident first."""
    found = underpriced(rows.where(F.col(actual).isNotNull())).where("is_underpriced").where(F.col("tier").isin(*tiers) & (F.col("confidence") >= least))
    return found.orderBy(F.desc("confidence"), "uuid")


def predictions(rows: DataFrame, actual: str = "eur", log_return: str = "prediction") -> DataFrame:
    """rows with tier and predicted_eur: null without a price, for tier 3, or without a prediction."""
    marked = rows.withColumn("tier", tier(F.col(actual)))
    return marked.withColumn("predicted_eur", F.when(F.col("tier") < 3, inverse_log_return(F.col(actual), F.col(log_return))))


def predict(rows: DataFrame, uuid: str) -> DataFrame:
    return predictions(rows.where(F.col("uuid") == uuid))


def predict_by_name(rows: DataFrame, name: str) -> DataFrame:
    """The first match by uuid."""
    return predictions(rows.where(F.col("name") == name).orderBy("uuid").limit(1))


def list_entities(cards: DataFrame) -> DataFrame:
    """One row a uuid with a name, by name and set."""
    return cards.where("name IS NOT NULL AND uuid IS NOT NULL").groupBy("uuid").agg(F.min_by(F.struct("name", "set_code"), F.struct("name", "set_code")).alias("x")).select("uuid", "x.name", "x.set_code").orderBy("name", "set_code", "uuid")


def backtest(prices: DataFrame, flagged: DataFrame, flag_day: str, check_day: str, rise: float = 0.1) -> DataFrame:
    on = lambda d, n: prices.where(F.col("snapshot_date") == F.to_date(F.lit(d))).select("uuid", F.col("eur").alias(n))
    rows = on(flag_day, "p0").join(on(check_day, "p1"), "uuid").join(flagged.select("uuid").distinct(), "uuid", "left_semi").withColumn("gain", ratio(F.col("p1"), F.col("p0")) - 1)
    return rows.agg(F.count("gain").alias("n"), F.count(F.when(F.col("gain") > rise, 1)).alias("hits"), F.avg((F.col("gain") > rise).cast("int")).alias("hit_rate"), F.avg("gain").alias("mean_appreciation"))
