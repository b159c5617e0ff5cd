"""Feeds, the store, downloads, configuration and streams."""

import json
import urllib.error
from datetime import date

import pytest
from pyspark.sql import functions as F

from snapforge.sources import config, feeds, http, io
from snapforge.sources.store import Store


def test_feeds(spark, tmp_path):
    (tmp_path / "cards").mkdir()
    doc = {"meta": {}, "data": {"S1": {"cards": [{"uuid": "a", "name": "A", "finishes": ["foil"], "identifiers": {"scryfall_id": "x"}}, {"uuid": "b", "finishes": "none"}]}, "S2": {"cards": []}, "S3": {}}}
    (tmp_path / "cards" / "1.json").write_text(json.dumps(doc, indent=1))
    good, bad = feeds.load(spark, f"file://{tmp_path}/cards", "cards")
    assert [(r.set, r.uuid, r.finishes, r.identifiers) for r in good.collect()] == [("S1", "a", ["foil"], {"scryfall_id": "x"})]
    assert [(r.set, json.loads(r.record)["uuid"]) for r in bad.collect()] == [("S1", "b")]
    text = json.dumps({"data": {"u1": {"paper": {"shop": {"retail": {"foil": {"2024-01-01": 2.5}}, "currency": "EUR"}}}, "u2": {"paper": "?"}}})
    good, bad = feeds.flatten(spark.createDataFrame([(text,)], "value string"), "prices")
    assert [(r.uuid, r.paper["shop"].retail["foil"]) for r in good.collect()] == [("u1", {"2024-01-01": 2.5})] and [r.uuid for r in bad.collect()] == ["u2"]
    text = json.dumps([{"id": "x", "prices": {"eur": "1.5", "usd": None, "tix": "no"}}])
    good, _ = feeds.flatten(spark.createDataFrame([(text,), ("nonsense",), (None,)], "value string"), "prints")
    assert [tuple(r) for r in feeds.scalar_prices(good, "2024-01-02").collect()] == [("x", date(2024, 1, 2), 1.5, None, None, None, None)]
    (tmp_path / "lines.json").write_text('{"k": 1}\n{"k": "x"}\nbroken\n\n')
    good, bad = io.read_json(spark, f"file://{tmp_path}/lines.json", "k int")
    assert [r.k for r in good.collect()] == [1] and sorted(r.record for r in bad.collect()) == ["broken", '{"k": "x"}']


def test_store(spark, tmp_path):
    store = Store(spark, {"silver": f"file://{tmp_path}/silver", "gold": f"file://{tmp_path}/gold"})
    assert store.tables("silver") == [] and store.read("silver", "silver_x") is None and store.find("nothing") is None
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    for layer, name in (("silver", "silver_x"), ("gold", "gold_y"), ("gold", "gold_old"), ("gold", "gold_predictions"), ("gold", "other")):
        io.overwrite(rows, store.path(layer, name))
    assert store.tables("gold") == ["gold_old", "gold_predictions", "gold_y", "other"]
    assert [r.v for r in store.query("SELECT x.v FROM silver_x x JOIN gold_y y ON x.k = y.k WHERE x.k BETWEEN ? AND ?", [2, 9]).collect()] == ["b"]
    assert store.query("SELECT COUNT(*) AS n FROM silver_x").first().n == 2
    assert store.drop_orphans("gold", ["gold_y"], "gold_", ["gold_predictions"]) == ["gold_old"] and store.tables("gold") == ["gold_predictions", "gold_y", "other"]
    assert store.find("gold_y").count() == 2


def test_serialised(spark):
    rows = spark.createDataFrame([(1, [1, 2], {"a": 1.5}, None)], "k int, l array<int>, m map<string,double>, s struct<x:int>")
    assert tuple(io.serialised(rows).first()) == (1, "[1,2]", '{"a":1.5}', None)


def test_downloads():
    waits, left = [], {"busy": 2, "down": 9, "off": 1}

    def get(url):
        if url == "gone":
            raise urllib.error.HTTPError(url, 404, "gone", {}, None)
        if left.get(url, 0):
            left[url] -= 1
            raise urllib.error.URLError("off") if url == "off" else urllib.error.HTTPError(url, 503, "busy", {}, None)
        return url.encode()

    assert http.fetch("busy", get=get, wait=waits.append) == b"busy" and waits == [1.0, 2.0]
    waits.clear()
    got = http.gather(["a", "down", "gone", "off", "a"], get=get, wait=waits.append)
    assert got["a"] == b"a" and got["off"] == b"off" and got["down"].code == 503 and got["gone"].code == 404
    assert left["down"] == 9 - http.ATTEMPTS and sorted(waits) == [1.0, 1.0, 2.0, 4.0, 8.0]


def test_configuration(tmp_path):
    (tmp_path / "a.json").write_text('{"x": 1}')
    (tmp_path / "b.json").write_text("[1]")
    (tmp_path / "c.json").write_text("{")
    assert config.load_json(tmp_path / "a.json") == {"x": 1}
    for name in ("b.json", "c.json", "missing.json"):
        with pytest.raises(config.ConfigError):
            config.load_json(tmp_path / name)
        with pytest.raises(config.ConfigError):
            config.load_yaml(tmp_path / name)
    config.write_status(tmp_path / "status.json", ok=True, at=date(2024, 1, 1))
    assert json.loads((tmp_path / "status.json").read_text()) == {"ok": True, "at": "2024-01-01"}


def test_streams(spark, tmp_path):
    from snapforge.streaming import twin

    rows = [("a", 40.0, "2024-01-01 01:00"), ("a", 50.0, "2024-01-01 02:00"), ("a", 60.0, "2024-01-02 01:00"), ("a", 70.0, "2024-01-03 01:00"), ("b", 40.0, "2024-01-01 01:00"), ("b", 10.0, "2024-01-02 01:00"), ("b", 40.0, "2024-01-02 02:00")]
    data = spark.createDataFrame(rows + rows[:2], "k string, v double, ts string").withColumn("ts", F.to_timestamp("ts"))
    data.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k string, v double, ts timestamp").parquet(f"{tmp_path}/in")

    def run(df, name):
        df.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").outputMode("append").trigger(availableNow=True).start().awaitTermination(180)
        return [tuple(r) for r in spark.table(name).collect()]

    assert len(run(twin.once(stream, ["k", "ts"]), "once")) == 7
    days = {(r[0], str(r[1])): r[2:] for r in run(twin.daily(twin.once(stream, ["k", "ts"], late="0 seconds"), "k", "v", late=None), "daily")}
    assert days["a", "2024-01-01"] == (45.0, 2) and days["b", "2024-01-02"] == (25.0, 2)
    bad = run(twin.bad_days(stream.dropDuplicates(["k", "ts"]), "k", "v"), "bad")
    assert sorted((k, n) for k, _, n in bad) == [("a", 3), ("a", 4)]
    for again in range(2):
        twin.append_batches(stream, f"file://{tmp_path}/out", ["k", "ts"], f"{tmp_path}/c{again}").awaitTermination(180)
        assert spark.read.parquet(f"{tmp_path}/out").count() == 7
