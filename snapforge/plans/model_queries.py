"""Queries of models, evaluation, decisions, dates and series, with DuckDB SQL written for itself where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import gold, ml, monitor, stats
from ..sources import io
from ..sources.store import Store
from .dialect import run, to_duckdb
from .sql_queries import PREDICTED, SERIES
from .tier_queries import _MERGED_FEEDS, CARD_FEATURES, DAY, PRICE_FEATURES, duck, feed, merged, price_features

TIERED = "CASE WHEN eur >= 60 THEN 3 WHEN eur >= 30 THEN 2 ELSE 1 END"
SCORED = f"WITH {PREDICTED} SELECT uuid, snapshot_date, 'mean' AS model, {TIERED} AS tier, actual AS y, predicted_eur AS prediction FROM scored"
_SCORED = to_duckdb(f"WITH {PREDICTED}, s AS (SELECT uuid, snapshot_date, {TIERED} AS tier, actual AS y, predicted_eur AS p, ABS(actual - predicted_eur) AS e, ABS(actual - predicted_eur) / GREATEST(ABS(actual), 0.01) * 100 AS pct FROM scored)")


def scored(spark: SparkSession, d: str) -> DataFrame:
    return run(spark, d, SCORED)


def _rounded(rows: DataFrame, places: int, *names: str) -> DataFrame:
    return rows.withColumns({n: F.round(n, places) for n in names})


def per_tier(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(ml.per_tier(scored(spark, d)).orderBy("tier", "mape"), 6, "mae", "mape")


def worst(spark: SparkSession, d: str) -> DataFrame:
    rows = scored(spark, d).withColumn("uuid", F.concat_ws(" ", "uuid", F.col("snapshot_date").cast("string")))
    return _rounded(ml.worst(rows, "y", "prediction").select("uuid", "tier", "pct_error"), 6, "pct_error")


def error_by_group(spark: SparkSession, d: str) -> DataFrame:
    out = ml.error_by_group(scored(spark, d), "tier", "y", "prediction")
    return _rounded(out.select("tier", F.col("mean").alias("mean_error"), F.col("count").alias("n"), F.col("std").alias("std_error"), "share_of_total"), 6, "mean_error", "std_error", "share_of_total")


def residuals(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).select("uuid", "snapshot_date", F.col("prediction").alias("predicted"), (F.col("y") - F.col("prediction")).alias("residual"))


def lag_features(spark: SparkSession, d: str) -> DataFrame:
    out = ml.lag_features(feed(spark, d, "prices_in"), DAY)
    return _rounded(out.drop("edhrec_rank", "foil_premium"), 7, "rolling_mean_7d", "rolling_std_14d")


LAGS = f"""WITH p AS (SELECT *, row_number() OVER (PARTITION BY uuid ORDER BY snapshot_date) AS n FROM prices_in)
SELECT p.uuid, p.snapshot_date, p.eur, a.eur AS lag_1d, b.eur AS lag_7d, c.eur AS lag_14d, e.eur AS lag_30d, (SELECT ROUND(AVG(q.eur), 7) FROM p q WHERE q.uuid = p.uuid AND q.n BETWEEN p.n - 6 AND p.n) AS rolling_mean_7d,
  (SELECT ROUND(stddev_samp(q.eur), 7) FROM p q WHERE q.uuid = p.uuid AND q.n BETWEEN p.n - 13 AND p.n) AS rolling_std_14d, (SELECT MIN(q.eur) FROM p q WHERE q.uuid = p.uuid AND q.n BETWEEN p.n - 29 AND p.n) AS rolling_min_30d,
  (SELECT MAX(q.eur) FROM p q WHERE q.uuid = p.uuid AND q.n BETWEEN p.n - 29 AND p.n) AS rolling_max_30d, (p.eur - b.eur) / NULLIF(b.eur, 0) AS momentum_7d
FROM p LEFT JOIN p a ON a.uuid = p.uuid AND a.n = p.n - 1 LEFT JOIN p b ON b.uuid = p.uuid AND b.n = p.n - 7 LEFT JOIN p c ON c.uuid = p.uuid AND c.n = p.n - 14 LEFT JOIN p e ON e.uuid = p.uuid AND e.n = p.n - 30 WHERE p.snapshot_date = DATE '{DAY}'"""


def target(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(ml.target(feed(spark, d, "prices_in"), DAY), 7, "log_return_7d")


TARGET = f"SELECT a.uuid, ROUND(ln(1 + b.eur) - ln(1 + a.eur), 7) AS log_return_7d FROM prices_in a JOIN prices_in b ON b.uuid = a.uuid AND b.snapshot_date = DATE '{DAY}' + INTERVAL 7 DAY WHERE a.snapshot_date = DATE '{DAY}'"


def enriched_cards(spark: SparkSession, d: str) -> DataFrame:
    names = F.create_map(*map(F.lit, ("machinery", "common", "building", "Uncommon", "automobile", "rare", "furniture", "mythic")))
    cards = gold.card_features(merged(spark, d)).withColumn("rarity", F.coalesce(names[F.col("rarity")], "rarity"))
    return ml.enrich_cards(cards).select("uuid", "rarity_ord", "has_mtgjson_data", "top8_appearances_30d", "deck_pct", "is_legendary", "is_commander_legal")


ENRICHED = f"""WITH f AS ({CARD_FEATURES.replace('WITH ', 'WITH ', 1)})
SELECT uuid, CASE rarity WHEN 'machinery' THEN 0.0 WHEN 'building' THEN 1.0 WHEN 'automobile' THEN 2.0 WHEN 'furniture' THEN 3.0 END::DOUBLE AS rarity_ord, 1.0::DOUBLE AS has_mtgjson_data, 0.0::DOUBLE AS top8_appearances_30d, 0.0::DOUBLE AS deck_pct,
  is_legendary::INT::DOUBLE AS is_legendary, is_commander_legal::INT::DOUBLE AS is_commander_legal FROM f"""


def without_leakage(spark: SparkSession, d: str) -> DataFrame:
    return ml.without_leakage(price_features(spark, d))


def missing_lists(spark: SparkSession, d: str) -> DataFrame:
    """Cards whose catalogue lacks the lists: no items, no flags."""
    rows = run(spark, d, "SELECT CAST(p_partkey AS STRING) AS uuid, p_name AS name, split(p_name, ' ') AS colors FROM {part}")
    return gold.card_features(rows).select("uuid", "color_count", "finish_count", "variation_count", "has_etched_finish", "is_legendary", "format_count")


MISSING = "SELECT p_partkey::VARCHAR AS uuid, len(string_split(p_name, ' '))::INT AS color_count, 0 AS finish_count, 0 AS variation_count, false AS has_etched_finish, false AS is_legendary, NULL::INT AS format_count FROM part"


def folds(spark: SparkSession, d: str) -> DataFrame:
    days = [r[0] for r in run(spark, d, "SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM {orders}").collect()]  # one row a day
    return spark.createDataFrame([(i, *f) for i, f in enumerate(ml.folds(days, 365, 90, 90))], "fold int, train_start date, val_start date, val_end date")


FOLDS = """WITH b AS (SELECT MIN(o_orderdate::DATE) AS lo, MAX(o_orderdate::DATE) AS hi FROM orders), s AS (SELECT unnest(range(0, 100)) AS i)
SELECT i::INT AS fold, lo AS train_start, (lo + INTERVAL (365 + 90 * i) DAY)::DATE AS val_start, (lo + INTERVAL (455 + 90 * i) DAY)::DATE AS val_end FROM b CROSS JOIN s WHERE (lo + INTERVAL (455 + 90 * i) DAY)::DATE <= hi + INTERVAL 1 DAY"""


def decision(spark: SparkSession, d: str) -> DataFrame:
    """By day: whether to retrain, and why."""
    events, mapes = gold.events(feed(spark, d, "meta_in")), scored(spark, d).groupBy("snapshot_date").agg((F.avg(F.abs(F.col("prediction") - F.col("y")) / F.greatest("y", F.lit(0.01))) * 100).alias("mape"))
    days = ("2024-01-01", "2024-01-20", "2024-06-01")
    return spark.createDataFrame([(day, *monitor.should_retrain(events, mapes, day)) for day in days], "day string, retrain boolean, why string")


DECISION = f"""WITH {to_duckdb(PREDICTED)}, m AS (SELECT snapshot_date, AVG(ABS(predicted_eur - actual) / GREATEST(actual, 0.01)) * 100 AS mape FROM scored GROUP BY 1 ORDER BY 1 DESC LIMIT 3),
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY snapshot_date) AS n FROM meta_in),
e AS (SELECT DISTINCT c.snapshot_date FROM n c JOIN n b ON b.id = c.id AND b.n = c.n - 1 CROSS JOIN (SELECT unnest(['commander', 'standard', 'modern', 'legacy', 'vintage']) AS f)
  WHERE (json_extract_string(b.legalities, '$.' || f) = 'legal' AND json_extract_string(c.legalities, '$.' || f) = 'banned') OR (json_extract_string(b.legalities, '$.' || f) = 'banned' AND json_extract_string(c.legalities, '$.' || f) = 'legal')),
a AS (SELECT COUNT(mape) = 3 AND MIN(mape) > 30 AS alert FROM m), d AS (SELECT unnest(['2024-01-01', '2024-01-20', '2024-06-01']) AS day)
SELECT day, alert OR day::DATE IN (SELECT snapshot_date FROM e) AS retrain, CASE WHEN day::DATE IN (SELECT snapshot_date FROM e) THEN 'event' WHEN alert THEN 'mape' ELSE 'none' END AS why FROM d CROSS JOIN a"""


def _price_history(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return gold.price_features(feed(spark, d, "prices_in")), gold.card_features(merged(spark, d))


def promotion(spark: SparkSession, d: str) -> DataFrame:
    """The retraining of the simplest model: its error over the folds, and whether it replaces one with an error of 100 %."""
    prices, cards = _price_history(spark, d)
    days = [r[0] for r in prices.select("snapshot_date").distinct().collect()]
    done = monitor.retrain(prices, cards, DAY, candidate=ml.naive, name="naive", production_mape=100.0, windows=ml.folds(days, train_days=9, val_days=7, step=5))
    return spark.createDataFrame([(round(done["cv_mape_tier1"], 6), done["promote"])], "cv_mape_tier1 double, promote boolean")


def importances(spark: SparkSession, d: str) -> DataFrame:
    """Gain of the splits of 20 trees on the day's frame, the largest first."""
    prices, cards = _price_history(spark, d)
    frame = ml.training_frame(prices, cards, DAY).where("log_return_7d IS NOT NULL")
    matrix = ml.Features().fit(frame)
    model = ml.boosted(matrix.transform(frame), "log_return_7d", rounds=20)
    return spark.createDataFrame(ml.importances(model, matrix.names), "feature string, gain double")


def power_by_tier(spark: SparkSession, d: str) -> DataFrame:
    rows = run(spark, d, "SELECT CASE WHEN o_totalprice < 100000 THEN 1 WHEN o_totalprice < 300000 THEN 2 ELSE 3 END AS tier FROM {orders}")
    return spark.createDataFrame(stats.tier_power(rows, "tier"), "tier int, n long, power double")


def _series(spark: SparkSession, d: str) -> DataFrame:
    return run(spark, d, f"WITH {SERIES} SELECT * FROM series")


def seasonal(spark: SparkSession, d: str) -> DataFrame:
    """Trend, weekly season and rest of each event type's daily mean."""

    def split(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("snapshot_date")
        trend, season, rest = stats.seasonal(group["eur"].to_numpy(float))
        return pd.DataFrame({"uuid": group["uuid"], "snapshot_date": group["snapshot_date"], "trend": trend, "season": season, "rest": rest})

    return _series(spark, d).groupBy("uuid").applyInPandas(split, "uuid string, snapshot_date date, trend double, season double, rest double")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of event types, on the days that both have."""
    return run(spark, d, f"WITH {SERIES} SELECT a.uuid AS u, b.uuid AS v, a.snapshot_date, a.eur AS x, b.eur AS y FROM series a JOIN series b ON a.snapshot_date = b.snapshot_date AND a.uuid < b.uuid")


def cointegration(spark: SparkSession, d: str) -> DataFrame:
    def test(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values("snapshot_date")
        found = stats.engle_granger(g["x"].to_numpy(float), g["y"].to_numpy(float))
        return pd.DataFrame([(g["u"].iloc[0], g["v"].iloc[0], len(g), found["slope"], found["intercept"], found["statistic"], found["half_life"], bool(found["statistic"] < stats.COINTEGRATION_CRITICAL[1]))])

    return _pairs(spark, d).groupBy("u", "v").applyInPandas(test, "u string, v string, n long, slope double, intercept double, statistic double, half_life double, is_cointegrated boolean")


def causality(spark: SparkSession, d: str) -> DataFrame:
    """Whether one event type's days help to predict another's next ones, by lag."""

    def test(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values("snapshot_date")
        x, y = g["x"].to_numpy(float), g["y"].to_numpy(float)
        return pd.DataFrame([(g["u"].iloc[0], g["v"].iloc[0], lag, *stats.granger(x, y, lag)) for lag in range(1, min(4, len(g) // 5) + 1)], columns=["u", "v", "lag", "f", "p"])

    return _pairs(spark, d).groupBy("u", "v").applyInPandas(test, "u string, v string, lag int, f double, p double")


def positional(spark: SparkSession, d: str) -> DataFrame:
    path = f"{d}/orders.parquet"
    return spark.sql(f"SELECT o_orderkey, o_totalprice FROM parquet.`{path}` WHERE CAST(o_orderdate AS DATE) BETWEEN ? AND ? AND o_orderstatus = ?", args=[date(1996, 1, 1), date(1997, 6, 30), "F"])


def date_minus_date(spark: SparkSession, d: str) -> DataFrame:
    return run(spark, d, "SELECT l_orderkey, l_linenumber, CAST(extract(DAY FROM (DATE '2001-12-31' - CAST(l_shipdate AS DATE))) AS BIGINT) AS age FROM {lineitem}")


def whole_days(spark: SparkSession, d: str) -> DataFrame:
    return run(spark, d, "SELECT event_id, CAST(floor((unix_micros(CAST(ts AS TIMESTAMP)) - unix_micros(TIMESTAMP '2024-01-10 12:00:00')) / 86400000000) AS BIGINT) AS days FROM {events}")


def _tables(spark: SparkSession, d: str) -> Store:
    store = Store(spark, {"gold": f"{io.scratch(spark, 'store')}/gold"})
    for name in ("gold_prices", "gold_old", "gold_predictions", "notes"):
        io.overwrite(run(spark, d, "SELECT * FROM {region}"), store.path("gold", name))
    return store


def discovered(spark: SparkSession, d: str) -> DataFrame:
    store = _tables(spark, d)
    names = [*store.tables("gold"), "gold_none"]
    return spark.createDataFrame([(n, store.read("gold", n) is not None) for n in names], "name string, is_there boolean")


def orphans(spark: SparkSession, d: str) -> DataFrame:
    store = _tables(spark, d)
    gone = store.drop_orphans("gold", ["gold_prices"], "gold_", ["gold_predictions"])
    return spark.createDataFrame([(n, False) for n in gone] + [(n, True) for n in store.tables("gold")], "name string, is_there boolean")


MODELS: dict[str, tuple[Callable, str | None]] = {
    "ml01_lag_features": (lag_features, duck(LAGS, "prices_in")),
    "ml02_target_builder": (target, duck(TARGET, "prices_in")),
    "ml03_enriched_cards": (enriched_cards, duck(ENRICHED, *_MERGED_FEEDS)),
    "ml07_without_leakage": (without_leakage, duck(f"WITH f AS ({PRICE_FEATURES}) SELECT * EXCLUDE (price_ath, price_atl, days_with_price) FROM f", "prices_in", "meta_in")),
    "ml15_per_tier": (per_tier, _SCORED + " SELECT 'mean' AS model, tier, COUNT(*) AS n_cards, ROUND(AVG(e), 6) AS mae, ROUND(AVG(pct), 6) AS mape FROM s GROUP BY tier"),
    "ml16_worst": (worst, _SCORED + " SELECT uuid || ' ' || snapshot_date AS uuid, tier, ROUND(pct, 6) AS pct_error FROM s ORDER BY pct DESC, 1 LIMIT 20"),
    "ml17_error_by_group": (error_by_group, _SCORED + " SELECT tier, ROUND(AVG(e), 6) AS mean_error, COUNT(*) AS n, ROUND(stddev_samp(e), 6) AS std_error, ROUND(SUM(e) / (SELECT SUM(e) FROM s), 6) AS share_of_total FROM s GROUP BY tier"),
    "ml18_residuals": (residuals, _SCORED + " SELECT uuid, snapshot_date, p AS predicted, y - p AS residual FROM s"),
    "ml20_importances": (importances, None),
    "arr07_missing_lists": (missing_lists, MISSING),
    "dat03_date_minus_date": (date_minus_date, "SELECT l_orderkey, l_linenumber, DATE '2001-12-31' - l_shipdate::DATE AS age FROM lineitem"),
    "dat06_whole_days": (whole_days, "SELECT event_id, floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-10 12:00:00')) / 86400000000.0)::BIGINT AS days FROM events"),
    "dat09_folds": (folds, FOLDS),
    "mon06_retrain_decision": (decision, duck(DECISION, "meta_in")),
    "mon07_promotion": (promotion, None),
    "prj15_positional": (positional, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate::DATE BETWEEN DATE '1996-01-01' AND DATE '1997-06-30' AND o_orderstatus = 'F'"),
    "sta08_seasonal": (seasonal, None),
    "sta09_cointegration": (cointegration, None),
    "sta12_causality": (causality, None),
    "sta14_power": (power_by_tier, None),
    "src20_discovery": (discovered, "SELECT unnest(['gold_old', 'gold_predictions', 'gold_prices', 'notes', 'gold_none']) AS name, unnest([true, true, true, true, false]) AS is_there"),
    "snk05_orphans": (orphans, "SELECT unnest(['gold_old', 'gold_predictions', 'gold_prices', 'notes']) AS name, unnest([false, true, true, true]) AS is_there"),
}
