"""Unit tests of the builders on inline rows: the edge cases that the operators' semantics hang on."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from snapforge.functions import expr
from snapforge.operators import gold, ml, monitor, silver
from snapforge.sources import extract, io

D = date(2024, 1, 1)


def history(spark, series, key="uuid", value="eur"):
    rows = [(k, D + timedelta(i), v) for k, vs in series.items() for i, v in vs]
    return spark.createDataFrame(rows, f"{key} string, snapshot_date date, {value} double")


def test_spike_is_strict_and_null_first(spark):
    p = history(spark, {"a": [(0, 1.0), (1, 4.0), (2, 16.1)]})
    got = {r.snapshot_date: r.is_price_spike for r in gold.price_features(p).collect()}
    assert got == {D: None, D + timedelta(1): False, D + timedelta(2): True}


def test_rank_ties_and_nulls_last(spark):
    p = history(spark, {"a": [(0, 10.0)], "b": [(0, 10.0)], "c": [(0, None)], "d": [(0, 3.0)]})
    assert {r.uuid: r.price_rank_global for r in gold.price_features(p).collect()} == {"a": 1, "b": 1, "d": 3, "c": 4}


def test_lags_are_row_offsets(spark):
    p = history(spark, {"a": [(i, 1 + i / 10) for i in range(10)], "b": [(0, 5.0), (7, 6.0)]})
    got = {r.uuid: r for r in ml.lag_features(p, str(D + timedelta(7))).collect()}
    assert (got["a"].lag_1d, got["a"].lag_7d, got["a"].lag_14d) == (1.6, 1.0, None)
    assert (got["b"].lag_1d, got["b"].lag_7d) == (5.0, None)
    t = {r.uuid: r.log_return_7d for r in ml.target(p, str(D)).collect()}
    assert set(t) == {"a", "b"} and t["a"] == pytest.approx(__import__("math").log((1 + 1.7) / (1 + 1.0)))


def test_staples_change_needs_eight_rows(spark):
    s = history(spark, {"x": [(0, 10.0), (1, 12.0), (2, 14.0)]}, "id", "deck_pct")
    got = gold.format_staples(s).orderBy("snapshot_date").collect()
    assert [r.deck_pct_7d_avg for r in got] == [10, 11, 12] and all(r.deck_pct_change_7d is None for r in got)


def meta(spark, series):
    rows = [(k, D + timedelta(i), {"modern": s}, None) for k, ss in series.items() for i, s in enumerate(ss)]
    return spark.createDataFrame(rows, "id string, snapshot_date date, legalities map<string,string>, edhrec_rank int")


def test_transitions(spark):
    m = meta(spark, {"a": ["legal", "banned"], "b": ["banned", "legal"], "c": ["legal", "restricted", "banned"]})
    assert sorted((r.id, r.event_type) for r in gold.transitions(m).collect()) == [("a", "ban"), ("b", "unban")]
    assert [r.card_count for r in gold.events(m).collect()] == [1, 1]


def test_impact_windows(spark):
    m = meta(spark, {"a": ["legal"] * 8 + ["banned"]})
    p = history(spark, {"a": [(i, float(i)) for i in range(17)]}).withColumn("scryfall_id", F.col("uuid"))
    r = gold.ban_price_impact(m, p).first()
    assert (r.price_7d_before, r.price_at_event, r.price_7d_after, r.price_30d_before) == (4.0, 8.0, 12.0, 3.5)


def test_forward_fill(spark):
    rows = spark.createDataFrame([("k", D, 1.0, None), ("k", D + timedelta(1), 2.0, 3.0), ("k", D + timedelta(2), None, None), ("j", D + timedelta(2), None, 9.0)], "k string, snapshot_date date, a double, b double")
    today = rows.where(F.col("snapshot_date") == F.lit(D + timedelta(2)))
    got = {r.k: (r.a, r.b) for r in silver.forward_fill(today, rows, "k", ["a", "b"]).collect()}
    assert got == {"k": (2.0, 3.0), "j": (None, 9.0)}
    empty = spark.createDataFrame([("m", D, None, None, "kept"), (None, D, None, None, "null")], "k string, snapshot_date date, a double, b double, __v string")
    assert {r.k: (r.a, r["__v"]) for r in silver.forward_fill(empty, rows, "k", ["a", "b"]).collect()} == {"m": (None, "kept"), None: (None, "null")}


def test_tournament_signals(spark):
    rows = [("o", "s", "modern", "t1", D - timedelta(5), 4, False), ("o", "s", "modern", "t2", D - timedelta(60), 2, False), (None, "s", "modern", "t3", D, 1, False)]
    t = spark.createDataFrame(rows, "oracle_id string, scryfall_id string, format string, tournament_id string, tournament_date date, copies int, is_sideboard boolean")
    (r,) = gold.tournament_signals(t, str(D)).collect()
    assert (r.top8_appearances_30d, r.top8_appearances_90d, r.top8_copies_avg, r.main_deck_pct) == (1, 2, 3.0, 100.0)


def test_premiums_and_cards(spark):
    p = history(spark, {"u": [(0, 0.0)], "v": [(0, 4.0)]}).withColumn("eur_foil", F.col("eur") * 2)
    v = spark.createDataFrame([(f"s{k}", k, "de", D, 5.0, 5.0, None, None) for k in "uvw"], "scryfall_id string, canonical_uuid string, lang string, snapshot_date date, eur double, eur_foil double, usd double, usd_foil double")
    got = {r.canonical_uuid: (r.eur_lang_premium, r.eur_foil_lang_premium, r.canonical_eur) for r in gold.language_premiums(v, p).collect()}
    assert got == {"u": (None, None, 0.0), "v": (1.25, 0.625, 4.0)}
    c = spark.createDataFrame([("1", "o", 20.0, ["etched"]), ("2", "o", 21.0, None), (None, "o", 1.0, []), ("3", None, None, ["foil", "nonfoil"])], "uuid string, oracle_id string, mana_value double, finishes array<string>")
    got = {r.uuid: r for r in gold.card_features(c).collect()}
    assert {k: (r.mana_value, r.print_count, r.finish_count, r.has_etched_finish) for k, r in got.items()} == {"1": (20.0, 2, 1, True), "2": (None, 2, 0, False), "3": (None, 1, 2, False)}
    assert got["1"].format_count is None and got["1"].is_legendary is False and got["1"].color_count == 0


def test_dataset_without_other_tables(spark):
    p = history(spark, {"a": [(0, 10.0), (7, 11.0), (30, 12.01)], "b": [(0, 10.0), (30, 7.9)], "c": [(0, None)], "d": [(0, 10.0), (30, 10.0)]})
    rows = {(r.uuid, r.snapshot_date): r for r in gold.ml_dataset(p).collect()}
    assert ("c", D) not in rows and rows["a", D].target_price_7d == 11.0 and rows["b", D].target_price_7d is None
    assert [rows[k, D].target_change_30d for k in "abd"] == ["up", "down", "flat"] and rows["a", D].staple_pct_modern is None and rows["a", D].rarity is None
    cards = spark.createDataFrame([("a", "o", "A", "rare"), ("b", "o", "B", "rare")], "uuid string, oracle_id string, name string, rarity string")
    staples = spark.createDataFrame([("x", "A", "modern", D, 9.0), ("y", "A", "modern", D + timedelta(1), 8.0)], "id string, card_name string, format string, snapshot_date date, deck_pct double")
    got = {(r.uuid, r.snapshot_date): r for r in gold.ml_dataset(p, cards, staples=gold.format_staples(staples)).collect()}
    assert got["a", D].staple_pct_modern == 9.0 and got["a", D + timedelta(7)].staple_pct_modern is None and got["b", D].rarity == "rare" and got["d", D].rarity is None


def test_merged_catalogue(spark):
    cards = spark.createDataFrame(
        [
            ("u2", '{"scryfall_id": " x "}', "Name", "set ", "7", "ENGLISH", "Legendary Creature — Elf Druid", '["g"]', '{"modern": "Legal"}', None, None),
            ("u1", '{"scryfall_id": "x"}', "Face", "set", "7", "english", None, None, None, None, None),
            ("u3", "{}", "No id", "set", "8", "english", None, None, None, None, None),
            ("u4", '{"scryfall_id": "z"}', "Online", "set", "9", "english", None, None, None, True, None),
            ("u5", '{"scryfall_id": "j"}', "Joke", "set", "9", "english", None, None, None, None, None),
        ],
        "uuid string, identifiers string, name string, set_code string, number string, language string, original_type string, colors string, legalities string, is_online_only boolean, is_funny boolean",
    )
    prints = spark.createDataFrame(
        [("x", "o", "Right", "SET", "7", "en", "normal", "core", None), (" y", "o", "Andere", "set", "7", "zht", "normal", "core", "3"), ("j", "p", "Joke", "set", "9", "en", "normal", "Funny ", None), ("t", "p", "Token", "set", "9", "en", "token", "core", None)],
        "id string, oracle_id string, name string, `set` string, collector_number string, lang string, layout string, set_type string, cmc string",
    )
    got = {r.scryfall_id: r for r in silver.cards(cards, prints).collect()}
    assert set(got) == {"x", "y"}  # a null id goes where any id is left out
    assert (got["x"].uuid, got["x"].name, got["x"].oracle_id, got["x"].canonical_uuid) == ("u1", "Face", "o", "u1")
    assert (got["y"].uuid, got["y"].canonical_uuid, got["y"].language, got["y"].mana_value, got["y"].is_modern_legal, got["y"].format_count) == (None, "u1", "Chinese Traditional", 3.0, None, 0)
    kept = {r.uuid for r in silver.clean_cards(cards, prints.where("false").select("id")).collect()}
    assert kept == {"u1", "u2", "u3", "u5"}
    one = silver.clean_cards(cards, prints.where("false").select("id")).where("uuid = 'u2'").first()
    assert (one.original_supertypes, one.original_types, one.original_subtypes, one.colors, one.keywords, one.set_code, one.scryfall_id) == (["Legendary"], ["Creature"], ["Elf", "Druid"], ["G"], [], "SET", "x")
    merged = silver.cards(cards, prints)
    scalar = spark.createDataFrame([("x", D, None, None, None, None), ("y", D, 2.0, None, None, None)], "id string, snapshot_date date, eur double, eur_foil double, usd double, usd_foil double")
    past = gold.with_columns(spark.createDataFrame([("x", D - timedelta(2), 5.0), ("x", D - timedelta(1), None), ("x", D, 9.0)], "scryfall_id string, snapshot_date date, eur double"), dict.fromkeys([*silver.SCALAR_PRICES, *silver.POINT_PRICES], "double"))
    (r,) = silver.prices(merged, scalar, None, past, str(D)).collect()
    assert (r.uuid, r.scryfall_id, r.eur, r.manapool_usd) == ("u1", "x", None, None)  # the row of the day before, null as it is
    points = spark.createDataFrame([("u1", D, "manapool", "retail", "foil", 3.0)], "uuid string, snapshot_date date, retailer string, tx_type string, finish string, price double")
    assert silver.prices(merged, scalar, points, past, str(D)).first().manapool_usd_foil == 3.0
    (r,) = silver.language_prices(merged, prints, scalar, None, str(D)).collect()
    assert (r.scryfall_id, r.canonical_uuid, r.lang, r.eur) == ("y", "u1", "zht", 2.0)


def test_merge_exclude_and_dedup(spark):
    left = spark.createDataFrame([(" x ", "L")], "id string, name string")
    right = spark.createDataFrame([("x", "R", 1), ("y", "R", 2)], "id string, name string, n int")
    assert sorted(map(tuple, silver.merge(left, right, "id").collect())) == [("x", "L", 1, True), ("y", "R", 2, False)]
    rows = spark.createDataFrame([("a",), (None,)], "id string")
    ids = spark.createDataFrame([("z",)], "x string")
    assert [r.id for r in silver.exclude_ids(rows, "id", ids).collect()] == ["a"]
    assert silver.exclude_ids(rows, "id", ids.where("false")).count() == 2
    assert silver.exclude_ids(rows, "id", spark.createDataFrame([("z",), (None,)], "x string")).count() == 0
    many = spark.createDataFrame([("k", "2"), ("k", "1"), ("k", None), (None, "0")], "k string, uuid string")
    assert [tuple(r) for r in silver.one_per_key(many, "k").collect()] == [("k", "1")]


def test_writes(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    a = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    io.append(a, path, ["k"])
    io.append(spark.createDataFrame([("a", 9), ("c", 3), ("c", 4)], "k string, v int"), path, ["k"])
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [("a", 1), ("b", 2), ("c", 3), ("c", 4)]
    io.upsert(spark.createDataFrame([("a", 7)], "k string, v int"), path, ["k"])
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [("a", 7), ("b", 2), ("c", 3), ("c", 4)]
    assert not io.overwrite(a.where("false"), path) and spark.read.parquet(path).count() == 4
    assert io.overwrite(a.where("false"), path, keep_when_empty=False) and spark.read.parquet(path).count() == 0
    io.overwrite(a, path)
    io.upsert(spark.createDataFrame([("a", 1.5)], "k string, w double"), path, ["k"])
    assert sorted(map(str, spark.read.parquet(path).collect())) == ["Row(k='a', v=None, w=1.5)", "Row(k='b', v=2, w=None)"]
    (tmp_path / "t").rename(tmp_path / "t.old")  # as a crash between two moves leaves it
    assert io.exists(spark, path) and spark.read.parquet(path).count() == 2
    copies = [io.backup(spark, path, f"file://{tmp_path}/copies", keep=2) for _ in range(3)]
    assert sorted(p.name for p in (tmp_path / "copies").iterdir()) == sorted(c.rsplit("/", 1)[-1] for c in copies[1:])


def test_price_points(spark):
    feed = spark.createDataFrame([("u", {"shop": ({"etched": {"2024-01-01": 1.0, "2024-01-02": 2.0, "2024-01-04": 9.0}}, None, "EUR")})], f"uuid string, paper {extract.PRICE_MAP}")
    points = extract.price_points(feed)
    assert points.count() == 3
    (r,) = extract.latest_points(points, "2024-01-03").collect()
    assert (r.finish, r.tx_type, r.price) == ("etched", "buylist", 2.0)
    broken = spark.createDataFrame([("u", "shop", "retail", "foil", D, 1.0), ("u", "shop", "retail", "foil", D + timedelta(1), None)], "uuid string, retailer string, tx_type string, finish string, date date, price double")
    with pytest.raises(Exception, match="null price"):
        extract.latest_points(broken, "2024-01-03").collect()
    assert extract.latest_points(broken, "2024-01-03", quarantine=True).count() == 0 and extract.broken_points(broken, "2024-01-03").count() == 1
    assert extract.latest_points(broken, "2024-01-01").first().price == 1.0 and extract.seed_points(broken).count() == 1


def test_html(spark):
    row = lambda *c: "<tr>" + "".join(f"<td>{x}</td>" for x in c) + "</tr>"
    page = spark.createDataFrame([(1, row("1", "Bolt", "45%", "3.1", "x") + row("a", "b") + row("2", "Bad", "?", "1", "x"))], "id int, html string")
    (r,) = extract.staples(page, "modern").collect()
    assert (r.id, r.deck_pct, r.percentage_in_decks, r.played, r.top) == ("Bolt__modern", 45.0, 45, 3.1, 1)
    deck = spark.createDataFrame([(1, '<div class=l id="md1">4 Lightning Bolt</div><div id="sb2">1 Duress</div>')], "id int, html string")
    assert [tuple(x) for x in extract.decklist(deck).collect()] == [(1, 4, "Lightning Bolt", False), (1, 1, "Duress", True)]
    event = spark.createDataFrame([(1, '<tr><td><a href="event?e=77&f=MO">Cup</a></td><td>05/01/24</td></tr><tr><td><a href="?e=77">Later</a></td><td>06/01/24</td></tr>')], "id int, html string")
    (e,) = extract.tournaments(event).collect()
    assert (e.tournament_id, e.event_name, e.tournament_date) == ("77", "Cup", date(2024, 1, 5))


def test_expressions(spark):
    rows = spark.createDataFrame([(99.0,), (100.0,), (1000.0,), (None,)], "eur double")
    assert [r[0] for r in rows.select(expr.tier(F.col("eur"))).collect()] == [1, 2, 3, 1]
    d = spark.createDataFrame([(10.0, 12.0), (10.0, 12.01), (10.0, 7.9), (10.0, None)], "a double, b double")
    assert [r[0] for r in d.select(expr.direction(F.col("a"), F.col("b"))).collect()] == ["flat", "up", "down", None]
    dates = spark.createDataFrame([("31/12/95",), ("12/31/95",), ("Mar 04 24",), ("04 Mar 24",), ("05/06/24",), ("nonsense",), (None,)], "t string")
    assert [r[0] for r in dates.select(expr.any_date(F.col("t"))).collect()] == [date(1995, 12, 31)] * 2 + [date(2024, 3, 4)] * 2 + [date(2024, 6, 5), None, None]
    r = spark.createDataFrame([(1.125,), (1.135,), (2.0,)], "c double").select(expr.reason(F.col("c")))
    assert [x[0] for x in r.collect()] == [f"ML predicts +{(c - 1) * 100:.0f}% in 7d" for c in (1.125, 1.135, 2.0)]
    t = spark.createDataFrame([("Legendary Creature — Elf Druid",), ("Instant",)], "t string")
    assert [tuple(r) for r in t.select(expr.type_parts(F.col("t"), ["Legendary", "Instant"]), expr.subtypes(F.col("t"))).collect()] == [(["Legendary"], ["Elf", "Druid"]), (["Instant"], [])]


def test_monitoring(spark):
    pred = spark.createDataFrame([("a", D, 1.5), ("b", D, 5.5)], "uuid string, snapshot_date date, predicted_eur double")
    actual = history(spark, {"a": [(7, 1.7)], "b": [(7, 5.0)]})
    (r,) = monitor.rolling_mape(pred, actual, str(D + timedelta(3))).collect()
    assert r.mape == pytest.approx(10.88, abs=0.01)
    series = lambda *v: history(spark, {"m": list(enumerate(v))}, value="mape")
    assert monitor.mape_alert(series(40.0, 10.0, 40.0, 40.0, 40.0)) and not monitor.mape_alert(series(40.0, 40.0)) and not monitor.mape_alert(series(40.0, 40.0, 20.0))


def test_folds():
    days = [D + timedelta(i) for i in range(60)]
    assert len(ml.folds(days)) == 4 and {f[0] for f in ml.folds(days)} == {D} and ml.folds(days)[1][1] == D + timedelta(37)
    with pytest.raises(ValueError):
        ml.folds(days[:40])


def test_streaming_changes(spark, tmp_path):
    from snapforge.streaming import twin

    (tmp_path / "in").mkdir()
    spark.createDataFrame([("a", "legal", "2024-01-01"), ("a", "banned", "2024-01-02"), ("b", "legal", "2024-01-01")], "k string, s string, ts string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k string, s string, ts timestamp").parquet(f"{tmp_path}/in")
    q = twin.changes(stream, "k", "s").writeStream.format("memory").queryName("changes").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [tuple(r)[:3] for r in spark.table("changes").collect()] == [("a", "legal", "banned")]


def test_similar_is_brute_force(spark, monkeypatch):
    import numpy as np

    from snapforge.plans.frame_queries import FRAMES

    monkeypatch.setattr(ml, "ROW_BLOCK", 7)
    monkeypatch.setattr(ml, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(3)
    values = [(int(i), None if i % 11 == 0 else float(rng.integers(0, 4)), float(rng.integers(0, 5)), 2.0) for i in range(60)]
    rows = spark.createDataFrame(values, "id long, a double, b double, c double")
    x = np.array([[np.nan if v is None else v for v in r[1:]] for r in values])
    s = np.nanstd(x, axis=0)
    z = np.nan_to_num((x - np.nanmean(x, axis=0)) / np.where(s > 0, s, np.nan))
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-300)
    got = {}
    for r in ml.similar(rows, "id", ["a", "b", "c"], rows.where("id % 4 = 0")).collect():
        got.setdefault(r["query"], {})[r["rank"]] = (r["id"], r["similarity_score"])
    assert set(got) == set(range(0, 60, 4))
    for q, found in got.items():
        near = {i: float(z[i] @ z[q]) for i in range(60) if i != q}
        assert sorted(found) == list(range(1, 11)) and q not in {i for i, _ in found.values()}
        assert [v for _, (_, v) in sorted(found.items())] == pytest.approx(sorted(near.values(), reverse=True)[:10])
        assert all(v == pytest.approx(near[i]) for i, v in found.values())
    asked = FRAMES["so07_similar"][0](spark, "/root/testdata/sf0.001").groupBy("query").count().collect()
    ids = {r.p_partkey for r in spark.read.parquet("/root/testdata/sf0.001/part.parquet").collect()}
    assert {r["query"]: r["count"] for r in asked} == {i: 10 for i in ids if i % 20 == 0}


def test_similar_compares_different_vectors_only(spark, monkeypatch):
    """Twelve vectors in 3,000 rows, a key that rows share, a vector that the query alone has, and null keys."""
    import numpy as np

    blocks, compared = ml._blocks, []
    monkeypatch.setattr(ml, "_blocks", lambda rows, *rest: compared.append(rows.count()) or blocks(rows, *rest))
    rows = [(i, float(i % 4), float(i % 3)) for i in range(3000)] + [(5000, 9.0, -1.0), (None, 1.0, 1.0), *[(4, 0.0, 1.0)] * 12, *[(40, 0.0, 1.0)] * 2]
    got: dict = {}
    for r in ml.similar(spark.createDataFrame(rows, "id long, a double, b double"), "id", ["a", "b"], spark.createDataFrame([(i,) for i in (0, 4, 17, 2999, 5000, 7777)], "id long")).collect():
        got.setdefault(r["query"], {})[r["rank"]] = (r["id"], r["similarity_score"])
    x = np.array([r[1:] for r in rows])
    z = (x - x.mean(0)) / x.std(0)
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    assert max(compared) <= 13 and set(got) == {0, 4, 17, 2999, 5000}
    for q, found in got.items():
        # rows of one vector have one score, so that keys decide
        near = sorted((-round(float(z[i] @ z[[r[0] for r in rows].index(q)]), 9), r[0]) for i, r in enumerate(rows) if r[0] not in (q, None))
        assert [(-round(v, 9), i) for _, (i, v) in sorted(found.items())] == near[:10]


def test_boosting_stops_by_patience(spark):
    assert ml.best_round([3.0, 2.0, 2.5, 2.0, 1.0, 4.0], 3) == (5, False) and ml.best_round([3.0, 2.0, 2.5, 2.0, 2.1, 1.0], 3) == (2, True)
    rows = spark.createDataFrame([(str(i), float(i % 37), i % 37 * 2.0 + i % 2) for i in range(200)], "uuid string, eur double, y double")
    rows = ml.Features([], [], ["eur"]).fit(rows).transform(rows)
    model = ml.boosted(rows, "y", rounds=12, patience=3)
    assert model.getNumTrees > 5 and ml.importances(model, ["eur"]) == [("eur", 1.0)]


def test_boosted_query_has_production_parameters(spark, monkeypatch):
    from snapforge.plans.frame_queries import FRAMES

    asked = []
    monkeypatch.setattr(ml, "boosted", lambda rows, label, key="uuid", rounds=0, patience=50: asked.append((rounds, patience, rows.count())))
    monkeypatch.setattr(ml, "predict_by_tier", lambda rows, models: rows.withColumns({"tier": F.lit(1), "prediction": F.lit(None)}))
    FRAMES["ml12_boosted_by_tier"][0](spark, "/root/testdata/sf0.01")
    assert asked and all(r == 1000 and p == 50 for r, p, _ in asked) and all(n >= 50 for _, _, n in asked[1:])
