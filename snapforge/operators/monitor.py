"""Monitoring: error of predictions by day, alerts, drift between periods, health of the tables, the decision to retrain and promote."""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ranking, silver

# ---------------------------------------------------------------- predictions against prices


def rolling_mape(predictions: DataFrame, prices: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """(snapshot_date, mape) of the last days: predictions beside the prices 7 days on."""
    recent = predictions.where(F.col("snapshot_date") >= F.date_sub(F.to_date(F.lit(as_of)), days))
    actual = prices.select("uuid", F.date_sub("snapshot_date", 7).alias("snapshot_date"), F.col("eur").alias("actual"))
    error = F.abs(F.col("predicted_eur") - F.col("actual")) / F.greatest(F.col("actual"), F.lit(0.01))
    return recent.join(actual.where("actual IS NOT NULL"), ["uuid", "snapshot_date"]).groupBy("snapshot_date").agg((F.avg(error) * 100).alias("mape"))


def mape_alert(mapes: DataFrame, threshold: float = 30.0, n: int = 3) -> bool:
    """Whether each of the last n days is beyond the threshold; fewer days are no alert."""
    worst_days = mapes.orderBy(F.desc("snapshot_date")).limit(n).agg(F.count("mape").alias("n"), F.min("mape").alias("least")).first()
    return worst_days["n"] == n and worst_days["least"] > threshold


def events_on(events: DataFrame, day: str) -> DataFrame:
    return events.where(F.col("event_date") == F.to_date(F.lit(day)))


def should_retrain(events: DataFrame | None, mapes: DataFrame, day: str) -> tuple[bool, str]:
    """An event of the day comes first, then the alert; without a table of events there is none."""
    if events is not None and not events_on(events, day).isEmpty():
        return True, "event"
    return (True, "mape") if mape_alert(mapes) else (False, "none")


def should_promote(cross_validation: DataFrame, model: str, production_mape: float | None) -> tuple[bool, float]:
    """Whether the model's mean error over the folds of tier 1 is at most that in production; the first model is always promoted, one
    without any fold only then."""
    mape = cross_validation.where((F.col("tier") == 1) & (F.col("model") == model)).agg(F.avg("mape")).first()[0]
    mape = math.inf if mape is None else mape
    return production_mape is None or mape <= production_mape, mape


def retrain(prices: DataFrame, cards: DataFrame, day: str, *, candidate: Callable, name: str = "boosted", production_mape: float | None = None, windows: list | None = None) -> dict:
    """Cross-validates the candidate, fits it on the day's rows with a target, and says whether it should replace the one in use. With
    too short a history for folds it is only fitted."""
    from . import ml

    rows = ml.training_frame(prices, cards, day).where("log_return_7d IS NOT NULL")
    if rows.isEmpty():
        raise RuntimeError(f"no rows with a target on {day}")
    try:
        results = ml.walk_forward(prices, cards, {name: candidate}, windows)
    except ValueError:
        results = ml.walk_forward(prices, cards, {}, [])
    promote, mape = should_promote(results, name, production_mape)
    return {"cross_validation": results, "fitted": candidate(rows, rows), "cv_mape_tier1": mape, "promote": promote}


def latest(prices: DataFrame) -> DataFrame:
    """(latest, trainable): the last snapshot, and the last that has one 7 days on."""
    days = prices.select("snapshot_date").distinct()
    ahead = days.select(F.date_sub("snapshot_date", 7).alias("snapshot_date"), F.lit(True).alias("ok"))
    return days.join(ahead, "snapshot_date", "left").agg(F.max("snapshot_date").alias("latest"), F.max(F.when(F.col("ok"), F.col("snapshot_date"))).alias("trainable"))


# ---------------------------------------------------------------- drift


def period(prices: DataFrame, first: str, last: str) -> DataFrame:
    return prices.where(F.col("snapshot_date").between(F.to_date(F.lit(first)), F.to_date(F.lit(last)))).select("uuid", "eur", F.log1p("eur").alias("log_eur"), "snapshot_date")


def ks(reference: DataFrame, current: DataFrame, column: str) -> DataFrame:
    """(column, n_reference, n_current, ks): the largest distance of the two distributions, over each distinct value once."""
    both = reference.select(F.col(column).cast("double").alias("v"), F.lit(1).alias("r"), F.lit(0).alias("c")).union(current.select(F.col(column).cast("double").alias("v"), F.lit(0).alias("r"), F.lit(1).alias("c")))
    values = both.where("v IS NOT NULL").groupBy("v").agg(F.sum("r").alias("r"), F.sum("c").alias("c"))
    steps = ranking.running(values, "v", {"upto_r": "r", "upto_c": "c"})
    # the last running sums are the totals
    total = steps.agg(F.max("upto_r").alias("n_r"), F.max("upto_c").alias("n_c"))
    distance = F.abs(F.col("upto_r") / F.nullif(F.col("n_r").cast("double"), F.lit(0.0)) - F.col("upto_c") / F.nullif(F.col("n_c").cast("double"), F.lit(0.0)))
    return steps.crossJoin(F.broadcast(total)).agg(F.max("n_r").alias("n_reference"), F.max("n_c").alias("n_current"), F.max(distance).alias("ks")).select(F.lit(column).alias("column"), "n_reference", "n_current", "ks")  # one row is broadcast


def js(reference: DataFrame, current: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """(column, js): the Jensen-Shannon distance, base 2, of the histograms over equal bins from the least to the greatest value of both."""
    both = reference.select(F.col(column).cast("double").alias("v"), F.lit(1).alias("r")).union(current.select(F.col(column).cast("double").alias("v"), F.lit(0).alias("r"))).where("v IS NOT NULL")
    span = both.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("r").alias("n_r"), F.sum(1 - F.col("r")).alias("n_c"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(width > 0, F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1))).otherwise(F.lit(0))
    counts = both.crossJoin(F.broadcast(span)).groupBy(at.alias("bin")).agg((F.sum("r") / F.max("n_r")).alias("p"), (F.sum(1 - F.col("r")) / F.max("n_c")).alias("q"))  # one row is broadcast
    m = (F.col("p") + F.col("q")) / 2
    part = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    return counts.agg(F.sqrt(F.greatest(F.sum(part(F.col("p")) + part(F.col("q"))) / 2, F.lit(0.0))).alias("js")).select(F.lit(column).alias("column"), "js")


def drift(reference: DataFrame, current: DataFrame, columns: tuple[str, ...] = ("eur", "log_eur"), threshold: float = 0.1) -> DataFrame:
    """(column, n_reference, n_current, ks, p_value, js, drifted) of each column: drifted if, up to 1,000 values in either period, the
    p-value of the Kolmogorov-Smirnov test is below 0.05, and beyond that if the Jensen-Shannon distance reaches the threshold."""
    out = None
    for c in columns:
        row = ks(reference, current, c).join(js(reference, current, c), "column")
        n = F.col("n_reference") * F.col("n_current") / (F.col("n_reference") + F.col("n_current"))
        x = F.col("ks") * (F.sqrt(n) + 0.12 + 0.11 / F.sqrt(n))
        p = F.when(x < 0.2, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), sum((2 * (-1) ** (k - 1) * F.exp(-2.0 * k * k * x * x) for k in range(1, 30)), F.lit(0.0)))))
        small = F.least("n_reference", "n_current") <= 1000
        row = row.withColumn("p_value", p).withColumn("drifted", F.when(small, F.col("p_value") < 0.05).otherwise(F.col("js") >= threshold))
        out = row if out is None else out.unionByName(row)
    return out.select("column", "n_reference", "n_current", "ks", "p_value", "js", "drifted")


def is_drifted(report: DataFrame, share: float = 0.5) -> bool:
    """Whether at least that share of the columns drifted."""
    n, found = report.agg(F.count(F.lit(1)), F.count(F.when(F.col("drifted"), 1))).first()
    return n > 0 and found >= share * n


# ---------------------------------------------------------------- health

TABLES = {
    "bronze": ["bronze_scryfall_cards", "bronze_mtgjson_cards", "bronze_mtgjson_prices_history"],
    "silver": ["silver_cards", "silver_prices_history", "silver_language_prices_history", "silver_meta_history", "silver_format_staples_history", "silver_tournament_results_history"],
    "gold": ["gold_card_features", "gold_price_features", "gold_language_premiums", "gold_demand_signals", "gold_format_staples", "gold_tournament_signals", "gold_ml_dataset"],
}
DATED = ["silver_prices_history", "silver_language_prices_history", "silver_format_staples_history"]
NEVER_NULL = ["name", "set_code", "collector_number"]
MOST_CONFLICTS = 20
RESULT = "name string, layer string, status string, detail string"


def _result(name: str, layer: str, ok: Column, detail: Column, bad: str = "FAIL") -> list[Column]:
    return [F.lit(name).alias("name"), F.lit(layer).alias("layer"), F.when(ok, "PASS").otherwise(bad).alias("status"), detail.alias("detail")]


def has_rows(df: DataFrame | None, name: str, layer: str, spark: SparkSession) -> DataFrame:
    if df is None:
        return spark.createDataFrame([(f"{name} exists", layer, "FAIL", "table not found")], RESULT)
    n = df.agg(F.count(F.lit(1)).alias("n"))
    return n.select(*_result(f"{name} rows", layer, F.col("n") > 0, F.format_string("%d rows", F.col("n"))))


def is_fresh(df: DataFrame, name: str, as_of: str, layer: str = "silver") -> DataFrame:
    n = df.agg(F.count(F.when(F.col("snapshot_date") == F.to_date(F.lit(as_of)), 1)).alias("n"))
    return n.select(*_result(f"{name} freshness", layer, F.col("n") > 0, F.format_string("%d rows for " + as_of, F.col("n"))))


def no_nulls(df: DataFrame, name: str, columns: list[str], layer: str = "silver") -> DataFrame:
    """All columns in one pass."""
    n = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in columns])
    rows = n.select(F.inline(F.array(*[F.struct(F.lit(f"{name}.{c} nulls").alias("name"), F.col(c).alias("n")) for c in columns])))
    return rows.select("name", F.lit(layer).alias("layer"), F.when(F.col("n") == 0, "PASS").otherwise("FAIL").alias("status"), F.format_string("%d null values", F.col("n")).alias("detail"))


def no_duplicates(cards: DataFrame) -> DataFrame:
    twice = cards.where("uuid IS NOT NULL AND uuid = canonical_uuid").groupBy("canonical_uuid").count().where("count > 1").agg(F.count(F.lit(1)).alias("n"))
    return twice.select(*_result("silver_cards duplicate canonical_uuid", "silver", F.col("n") == 0, F.format_string("%d duplicated canonical_uuid values", F.col("n"))))


def few_conflicts(cards: DataFrame, most: int = MOST_CONFLICTS) -> DataFrame:
    """Names with several oracle ids: least and greatest differ."""
    several = cards.where("oracle_id IS NOT NULL").groupBy("name").agg(F.min("oracle_id").alias("a"), F.max("oracle_id").alias("b")).where("a <> b").agg(F.count(F.lit(1)).alias("n"))
    return several.select(*_result("silver_cards oracle_id conflicts", "silver", F.col("n") <= most, F.format_string(f"%d conflicts (at most {most})", F.col("n"))))


def positive_prices(prices: DataFrame, as_of: str) -> DataFrame:
    n = prices.where(F.col("snapshot_date") == F.to_date(F.lit(as_of))).agg(F.count(F.when(F.col("eur") <= 0, 1)).alias("n"))
    return n.select(*_result("silver_prices_history EUR <= 0", "silver", F.col("n") == 0, F.format_string("%d rows with EUR <= 0 for " + as_of, F.col("n"))))


def has_targets(dataset: DataFrame) -> DataFrame:
    n = dataset.agg(F.count("target_price_7d").alias("n"))
    return n.select(*_result("gold_ml_dataset target_price_7d", "gold", F.col("n") > 0, F.format_string("%d rows with a target", F.col("n"))))


def combo_drift(points: DataFrame, as_of: str, expected: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """A warning for combinations of the day's price points that aren't expected, and one for expected ones that are missing."""
    spark, names = points.sparkSession, ["retailer", "tx_type", "finish"]
    known = spark.createDataFrame(list(silver.POINT_PRICES.values()) if expected is None else expected, ", ".join(f"{n} string" for n in names)).distinct()
    found = points.where(F.col("snapshot_date") == F.to_date(F.lit(as_of))).select(*names).distinct()
    sides = found.join(known, names, "left_anti").select(F.lit("new").alias("kind"), *names).union(known.join(found, names, "left_anti").select(F.lit("missing").alias("kind"), *names))
    listed = sides.groupBy("kind").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("/", *names))), ", ").alias("list"), F.count(F.lit(1)).alias("n"))  # one row a combination
    warn = listed.select(F.lit("bronze mtgjson price schema drift").alias("name"), F.lit("bronze").alias("layer"), F.lit("WARN").alias("status"), F.format_string("%d %s combinations: %s", "n", "kind", "list").alias("detail"))
    none = listed.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit("bronze mtgjson price schema drift").alias("name"), F.lit("bronze").alias("layer"), F.lit("PASS").alias("status"), F.lit("all combinations as expected").alias("detail"))
    return warn.union(none)


def health(spark: SparkSession, table: Callable[[str], DataFrame | None], as_of: str) -> DataFrame:
    """(name, layer, status, detail) of all checks; `table` gives a table or None. Quality is looked at only in layers whose tables are
    all there and have rows."""
    found = {n: table(n) for names in TABLES.values() for n in names}
    structure = {layer: [has_rows(found[n], n, layer, spark) for n in names] for layer, names in TABLES.items()}
    whole = {layer: all(r["status"] == "PASS" for part in parts for r in part.collect()) for layer, parts in structure.items()}
    out = [*structure["bronze"], *structure["silver"], *structure["gold"]]
    if found["bronze_mtgjson_prices_history"] is not None:
        out.append(combo_drift(found["bronze_mtgjson_prices_history"], as_of))
    if whole["silver"]:
        cards = found["silver_cards"]
        out += [is_fresh(found[n], n, as_of) for n in DATED]
        out += [no_nulls(cards, "silver_cards", NEVER_NULL), no_duplicates(cards), few_conflicts(cards), positive_prices(found["silver_prices_history"], as_of)]
    if whole["gold"]:
        out.append(has_targets(found["gold_ml_dataset"]))
    first, *rest = out
    for r in rest:
        first = first.unionByName(r)
    return first


def status(spark: SparkSession, table: Callable[[str], DataFrame | None]) -> dict:
    """What is ready to answer."""
    there = {n: df is not None and not df.isEmpty() for names in TABLES.values() for n in names for df in [table(n)]}
    return {"ready": there["gold_price_features"] and there["gold_card_features"], "tables": there}


def log_alert(path: str, kind: str, **what: object) -> dict:
    """Appends one line of JSON to a file of the driver, and returns what it says."""
    line = {"at": datetime.now(timezone.utc).isoformat(timespec="seconds"), "kind": kind} | what
    with open(path, "a", encoding="utf-8") as f:
        f.write(json.dumps(line, default=str) + "\n")
    return line
