"""Drift, health, retraining, cross-validation and the model's matrix on small histories."""

import json
import math
import re
from collections import Counter
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import functions as F

from snapforge.operators import gold, ml, monitor, silver
from snapforge.plans.tier_queries import TIERS

D = date(2024, 1, 1)


def prices(spark, days=45, n=8):
    rng = np.random.default_rng(2)
    rows = [(f"u{k}", f"s{k}", D + timedelta(i), float(20 * (k + 1) + i * 0.3 + rng.normal())) for k in range(n) for i in range(days) if not (k == 3 and i % 5 == 0)]
    return spark.createDataFrame(rows, "uuid string, scryfall_id string, snapshot_date date, eur double")


def cards(spark, n=8):
    return gold.card_features(spark.createDataFrame([(f"u{k}", f"s{k}", f"o{k}", f"N{k}", ["common", "rare", "special"][k % 3], None if k == 1 else True) for k in range(n)], "uuid string, scryfall_id string, oracle_id string, name string, rarity string, is_reserved boolean"))


def test_drift(spark):
    a = [float(x) for x in np.random.default_rng(1).normal(size=200)]
    b = [x + 0.8 for x in a[:120]] + [None]
    early, late = (spark.createDataFrame([(x,) for x in v], "eur double").withColumn("log_eur", F.col("eur")) for v in (a, b))
    values = sorted(set(a) | {x for x in b if x is not None})
    known = [x for x in b if x is not None]
    want = max(abs(sum(x <= v for x in a) / len(a) - sum(x <= v for x in known) / len(known)) for v in values)
    r = monitor.drift(early, late, ("eur",)).first()
    assert r.ks == pytest.approx(want) and (r.n_reference, r.n_current) == (200, 120) and r.drifted and r.p_value < 1e-6
    edges = np.linspace(min(values), max(values), 11)
    p, q = np.histogram(a, edges)[0] / len(a), np.histogram(known, edges)[0] / len(known)
    m = (p + q) / 2
    entropy = lambda x: sum(u * math.log2(u / v) for u, v in zip(x, m) if u)
    assert r.js == pytest.approx(math.sqrt((entropy(p) + entropy(q)) / 2))
    same = monitor.drift(early, early, ("eur", "log_eur"))
    assert [(x.ks, x.js, x.drifted) for x in same.collect()] == [(0.0, 0.0, False)] * 2 and not monitor.is_drifted(same) and monitor.is_drifted(monitor.drift(early, late))
    rows = spark.createDataFrame([("u", D, 1.0), ("u", D + timedelta(1), None)], "uuid string, snapshot_date date, eur double")
    assert [x.log_eur for x in monitor.period(rows, str(D), str(D + timedelta(1))).collect()] == [math.log(2), None]


def test_health(spark):
    day = str(D)
    cards_ = spark.createDataFrame([("u", "u", "n", "o1", "s", "1"), ("u", "u", "n", "o2", "s", None)], "uuid string, canonical_uuid string, name string, oracle_id string, set_code string, collector_number string")
    dated = spark.createDataFrame([(D, 0.0)], "snapshot_date date, eur double")
    points = spark.createDataFrame([(D, *c) for c in list(silver.POINT_PRICES.values())[1:]] + [(D, "new", "retail", "foil")], "snapshot_date date, retailer string, tx_type string, finish string")
    tables = {n: dated for names in monitor.TABLES.values() for n in names} | {"silver_cards": cards_, "bronze_mtgjson_prices_history": points, "gold_ml_dataset": dated.withColumn("target_price_7d", F.lit(None).cast("double"))}
    got = [(r.name, r.status) for r in monitor.health(spark, tables.get, day).collect()]
    bad = {n for n, s in got if s == "FAIL"}
    assert bad == {"silver_cards.collector_number nulls", "silver_cards duplicate canonical_uuid", "silver_prices_history EUR <= 0", "gold_ml_dataset target_price_7d"}
    assert [s for n, s in got if "drift" in n] == ["WARN", "WARN"] and ("silver_cards oracle_id conflicts", "PASS") in got
    assert monitor.few_conflicts(cards_, 0).first().status == "FAIL" and monitor.is_fresh(dated, "t", "2024-02-01").first().status == "FAIL"
    fewer = {n: t for n, t in tables.items() if n != "silver_meta_history"}
    names = {r.name for r in monitor.health(spark, fewer.get, day).collect()}
    assert "silver_meta_history exists" in names and "silver_cards.name nulls" not in names and "gold_ml_dataset target_price_7d" in names  # the gate
    assert monitor.has_rows(dated.where("false"), "t", "gold", spark).first().status == "FAIL"
    assert monitor.status(spark, tables.get)["ready"] and not monitor.status(spark, {}.get)["ready"]


def test_alert_log(tmp_path):
    monitor.log_alert(f"{tmp_path}/alerts.jsonl", "mape", value=31.5)
    monitor.log_alert(f"{tmp_path}/alerts.jsonl", "event")
    lines = [json.loads(x) for x in (tmp_path / "alerts.jsonl").read_text().splitlines()]
    assert [x["kind"] for x in lines] == ["mape", "event"] and lines[0]["value"] == 31.5


def test_matrix(spark):
    p, c = gold.price_features(prices(spark)), cards(spark)
    frame = ml.training_frame(p, c, str(D + timedelta(20)))
    rows = {r.uuid: r for r in frame.collect()}
    assert not set(ml.LEAKAGE) & set(frame.columns) and rows["u2"].rarity_ord is None and rows["u1"].rarity_ord == 2.0
    assert rows["u1"].is_reserved is None and rows["u0"].is_reserved == 1.0 and rows["u0"].top8_appearances_30d == 0.0 and rows["u0"].has_mtgjson_data == 1.0
    assert rows["u0"].log_eur == pytest.approx(math.log1p(rows["u0"].eur)) and rows["u0"].lag_1d_return == pytest.approx(rows["u0"].eur / rows["u0"].lag_1d - 1)
    assert "u3" not in rows  # no row on that day
    plain = ml.plain_types(spark.createDataFrame([(None, None, None)], "b boolean, i int, x double")).first()
    assert tuple(plain) == (False, 0, None)
    assert "target" not in ml.inference_features(p, c, str(D)).columns and ml.inference_features(p, c, str(D)).count() == 7
    m = ml.Features().fit(frame.withColumn("foil_premium", F.when(F.col("uuid") < "u4", 3.0)))
    fitted = {r.uuid: dict(zip(m.names, r.features)) for r in m.transform(frame).select("uuid", "features").collect()}
    assert fitted["u2"]["rarity_ord"] == ml.MISSING and fitted["u2"]["foil_premium"] == 3.0 and fitted["u2"]["edhrec_rank"] == ml.MISSING and fitted["u2"]["deck_pct"] == 0.0


def test_walk_forward(spark):
    p, c = gold.price_features(prices(spark, 50)), cards(spark)
    with pytest.raises(ValueError):
        ml.walk_forward(p.where("snapshot_date < DATE '2024-01-20'"), c, {"naive": ml.naive})
    models = {"naive": ml.naive, "mean": ml.mean_return, "reversion": ml.reversion, "autoregression": ml.autoregression, "trees": ml.boosted_model(2)}
    windows = ml.folds([D + timedelta(i) for i in range(50)], train_days=20, val_days=7, step=7)[:2]
    got = ml.walk_forward(p, c, models, windows).collect()
    assert {r.model for r in got} >= {"naive", "mean", "reversion", "autoregression"} and {r.fold_idx for r in got} == {0, 1}
    val = D + timedelta(26)
    frame = ml.training_frame(p, c, str(val)).collect()
    for r in (x for x in got if x.fold_idx == 0 and x.model == "naive"):
        own = [f.log_return_7d for f in frame if (f.eur >= 100) == (r.tier == 2)]
        assert r.val_snapshot == val and r.n_cards == len(own) and r.mae == pytest.approx(np.mean(np.abs(own))) and r.mape == pytest.approx(100 * np.mean([abs(y) / max(abs(y), 0.01) for y in own]))
    train = ml.training_frame(p, c, str(D + timedelta(19))).collect()
    x, y = [f.lag_1d_return or 0 for f in train], [f.log_return_7d for f in train]
    a, b = np.polyfit(x, y, 1)
    (one,) = [r for r in got if r.fold_idx == 0 and r.model == "autoregression" and r.tier == 1]
    assert one.mae == pytest.approx(np.mean([abs(f.log_return_7d - a * (f.lag_1d_return or 0) - b) for f in frame if f.eur < 100]))
    results = ml.walk_forward(p, c, {"naive": ml.naive}, windows)
    promote, mape = monitor.should_promote(results, "naive", None)
    assert promote and monitor.should_promote(results, "naive", mape)[0] and not monitor.should_promote(results, "naive", mape - 1)[0] and monitor.should_promote(results, "other", 1.0) == (False, math.inf)
    done = monitor.retrain(p, c, str(val), candidate=ml.naive, name="naive", windows=windows, production_mape=0.0)
    assert not done["promote"] and done["fitted"].count() == len(frame)
    with pytest.raises(RuntimeError):
        monitor.retrain(p, c, "2030-01-01", candidate=ml.naive)


def test_retrain_decision(spark):
    events = spark.createDataFrame([(D, "modern", "ban", 1)], "event_date date, format string, event_type string, card_count long")
    mapes = spark.createDataFrame([(D + timedelta(i), 40.0) for i in range(3)], "snapshot_date date, mape double")
    assert monitor.should_retrain(events, mapes, str(D)) == (True, "event") and monitor.should_retrain(events, mapes, "2024-02-01") == (True, "mape")
    assert monitor.should_retrain(None, mapes.limit(2), str(D)) == (False, "none")
    assert [r.card_count for r in monitor.events_on(events, str(D)).collect()] == [1]
    days = spark.createDataFrame([(D + timedelta(i),) for i in (0, 1, 2, 8, 20)], "snapshot_date date")
    assert tuple(monitor.latest(days).first()) == (D + timedelta(20), D + timedelta(1))


def test_text_vectors(spark):
    texts = ["apple banana apple"] * 5 + ["banana cherry the of"] * 5 + [None, "rare word"]
    docs = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got: dict = {}
    for r in ml.tfidf(docs, "k", "t").collect():
        got.setdefault(r.k, {})[r.term] = r.weight
    n = len(texts)
    idf = {"apple": math.log((1 + n) / 6) + 1, "banana": math.log((1 + n) / 11) + 1, "cherry": math.log((1 + n) / 6) + 1}
    a = {"apple": (1 + math.log(2)) * idf["apple"], "banana": idf["banana"]}
    norm = math.sqrt(sum(v * v for v in a.values()))
    assert got[0] == pytest.approx({k: v / norm for k, v in a.items()}) and set(got[7]) == {"banana", "cherry"} and 11 not in got and 10 not in got
    static = spark.createDataFrame([(0, 1.5, None), (11, None, 2)], "k int, x double, y int")
    rows = {r.k: r.vector for r in ml.stacked(static, ml.tfidf(docs, "k", "t"), "k", ["x", "y"], ["apple", "cherry"]).collect()}
    assert rows[0] == pytest.approx([1.5, 0.0, a["apple"] / norm, 0.0]) and rows[11] == [0.0, 2.0, 0.0, 0.0]


@pytest.mark.parametrize("size", [1 << 22, 40])
def test_weights_of_odd_texts_are_plain(spark, monkeypatch, size):
    """Keys that rows share or that are null, texts null, empty, long, not ASCII, against plain Python."""
    monkeypatch.setattr(ml, "TEXT_SLICE", size)
    texts = ["Apple apple_1 x The apple", None, "", "\u212Aiwi kiwi na\u00efve \u0130con", "a b the", "apple" * 3000 + " kiwi", "don't 12 12", " kiwi\tapple\n", "icon kiwi apple 12", "na ve 12 \U0001F600apple"]
    keys = [0, 1, 2, 3, 4, 5, 0, None, None, 0]
    rows = spark.createDataFrame(list(zip(keys, texts, range(10))), "k int, t string, n int").repartition(3)
    stop = set(StopWordsRemover.loadDefaultStopWords("english"))
    docs: dict = {}
    for k, t in zip(keys, texts):
        docs.setdefault(k, Counter()).update(w for w in re.findall("[a-z0-9_]+", (t or "").lower()) if len(w) > 1 and w not in stop)
    total, df = sum(docs.values(), Counter()), Counter(w for d in docs.values() for w in d)
    top = sorted(sorted((w for w in total if df[w] >= 2), key=lambda w: (-total[w], w))[:3])
    want = {}
    for k, d in docs.items():
        w = {t: (1 + math.log(d[t])) * (math.log(11 / (1 + df[t])) + 1) for t in top if d[t]}
        want[k] = {t: v / math.sqrt(sum(x * x for x in w.values())) for t, v in w.items()}
    got: dict = {k: {} for k in docs}
    for r in ml.tfidf(rows, "k", "t", 3, 2).collect():
        assert r.term not in got[r.k]
        got[r.k][r.term] = r.weight
    assert top == ["12", "apple", "kiwi"] and {k: pytest.approx(v) for k, v in want.items()} == got
    beside = sorted((r.vector for r in ml.text_beside(rows, "k", "t", ["n"], 3, 2).collect()), key=lambda v: v[0])
    # a null key matches nothing, as in stacked
    assert len(beside) == 10 and all(v == pytest.approx([float(i), *[want[k].get(t, 0.0) if k is not None else 0.0 for t in top]]) for i, (k, v) in enumerate(zip(keys, beside)))
    assert ml.tfidf(rows, "k", "t", 3, 100).count() == 0 and {len(r.vector) for r in ml.text_beside(rows, "k", "t", ["n"], 3, 100).collect()} == {1}
    assert ml.tfidf(rows.where("false"), "k", "t").count() == 0 and ml.text_beside(rows.where("false"), "k", "t", []).count() == 0


def test_texts_of_own_keys_are_not_moved(spark):
    plan = TIERS["ml22_text_and_static"][0](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Exchange", "Join", "Window", "Generate"))


def test_lookups(spark):
    rows = spark.createDataFrame([("u1", "A", 50.0, 0.1, "s"), ("u2", "A", 2000.0, 0.1, "t"), ("u3", None, 10.0, None, "s"), ("u0", "B", None, 0.2, "s")], "uuid string, name string, eur double, prediction double, set_code string")
    assert ml.predict(rows, "u1").first().predicted_eur == pytest.approx(math.expm1(math.log1p(50) + 0.1)) and ml.predict(rows, "u2").first().predicted_eur is None
    assert ml.predict(rows, "u0").first().predicted_eur is None and ml.predict(rows, "none").count() == 0 and ml.predict_by_name(rows, "A").first().uuid == "u1"
    assert [r.uuid for r in ml.list_entities(rows).collect()] == ["u1", "u2", "u0"]
    flagged = spark.createDataFrame([("a", 10.0, 14.0), ("b", 10.0, 20.0), ("c", None, 20.0), ("d", 2000.0, 9000.0), ("e", 10.0, 13.0)], "uuid string, eur double, predicted_eur double")
    got = ml.underpriced_listing(flagged).collect()
    assert [(r.uuid, r.reason) for r in got] == [("b", "ML predicts +100% in 7d"), ("a", "ML predicts +40% in 7d")]
    assert [r.uuid for r in ml.underpriced_listing(flagged, least=1.5).collect()] == ["b"]
