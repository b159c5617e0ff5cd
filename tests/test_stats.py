"""Ranks, percentiles and tests against numpy and plain Python on small tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from snapforge.operators import ranking, stats

R = random.Random(6)
ROWS = [(i, float(R.choice([1, 2, 2, 3, 5, 8, R.random() * 10])), float(R.randint(0, 6)), R.choice("abc")) for i in range(180)] + [(900, None, 1.0, "a"), (901, 3.0, None, None)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "id long, v double, w double, g string").repartition(5).cache()


def ranks(values):
    return [sum(y < x for y in values) + (sum(y == x for y in values) + 1) / 2 for x in values]


def test_running_sums_and_numbers(rows):
    known = rows.where("v IS NOT NULL")
    want = sorted((v, i) for i, v, *_ in ROWS if v is not None)
    assert [(r.v, r.id) for r in ranking.numbered(known, "v", ["id"]).orderBy("rn").collect()] == want
    down = ranking.numbered(known, "v", ["id"], descending=True).orderBy("rn").collect()
    assert [r.rn for r in down] == list(range(1, len(want) + 1)) and [(-r.v, r.id) for r in down] == sorted((-v, i) for v, i in want)
    for r in ranking.numbered(known.where("g IS NOT NULL"), "v", ["id"], within=["g"]).collect():
        assert r.rn == sum((v, i) <= (r.v, r.id) for i, v, _, g in ROWS if g == r.g and v is not None)
    tiles = ranking.tiles(known, "v", ["id"], 7, "tile").collect()
    size, more = divmod(len(want), 7)
    assert [sum(r.tile == k for r in tiles) for k in range(1, 8)] == [size + (k <= more) for k in range(1, 8)]
    assert ranking.numbered(known.where("false"), "v", ["id"]).count() == 0


def test_no_exchange_to_one_task_holds_rows(rows):
    plan = ranking.numbered(rows.where("v IS NOT NULL"), "v", ["id"])._jdf.queryExecution().executedPlan().toString()
    for line, after in zip(plan.split("\n"), plan.split("\n")[1:]):
        if "SinglePartition" in line:
            assert "HashAggregate" in after or "__range" in plan, line


def test_average_ranks(rows):
    values = [v for _, v, *_ in ROWS if v is not None]
    want = dict(zip([i for i, v, *_ in ROWS if v is not None], ranks(values)))
    assert {r.id: r.r for r in ranking.average_ranks(rows, "v", "r").collect()} == want


def test_percentiles(rows):
    got = {r.g: r for r in ranking.percentiles(rows, "v", {"a": 0.0, "b": 0.3, "c": 0.5, "d": 1.0}, ["g"]).collect()}
    for g in {x[3] for x in ROWS}:
        own = [v for _, v, _, h in ROWS if h == g and v is not None]
        assert [got[g][n] for n in "abcd"] == pytest.approx(np.quantile(own, [0, 0.3, 0.5, 1]))


def test_correlations(rows):
    known = [(v, w) for _, v, w, _ in ROWS if v is not None and w is not None]
    x, y = (np.array(ranks(list(c))) for c in zip(*known))
    assert stats.spearman(rows, "v", "w").first().rho == pytest.approx(np.corrcoef(x, y)[0, 1])
    z = np.array(ranks([i for i, v, w, _ in ROWS if v is not None and w is not None]))
    a, b = (c - np.polyval(np.polyfit(z, c, 1), z) for c in (x, y))
    assert stats.partial_spearman(rows, "v", "w", "id").first().rho == pytest.approx(np.corrcoef(a, b)[0, 1])
    rho, low, high = stats.bootstrap_spearman(rows, "v", "id", "id", resamples=200)
    assert low < rho < high and high - low < 0.5 and stats.bootstrap_spearman(rows, "v", "id", "id", resamples=200) == pytest.approx((rho, low, high))
    m = np.array([(v, w, i) for i, v, w, _ in ROWS if v is not None and w is not None])
    assert list(stats.variance_inflation(rows, ["v", "w", "id"]).values()) == pytest.approx(np.diag(np.linalg.inv(np.corrcoef(m.T))).tolist())
    assert stats.mutual_information(rows, "v", "v").first().mi > 1 > stats.mutual_information(rows, "v", "w").first().mi >= 0


def test_rank_tests(rows):
    known = [(v, g) for _, v, _, g in ROWS if v is not None and g]
    r = ranks([v for v, _ in known])
    n = len(r)
    h = 12 / (n * (n + 1)) * sum(sum(x for x, (_, k) in zip(r, known) if k == g) ** 2 / sum(k == g for _, k in known) for g in "abc") - 3 * (n + 1)
    ties = sum(c**3 - c for c in (sum(v == w for v, _ in known) for w in {v for v, _ in known}))
    found = stats.kruskal_wallis(rows, "v", "g")
    assert found["h"] == pytest.approx(h / (1 - ties / (n**3 - n))) and 0 < found["p"] < 1 and found["groups"] == 3
    flagged = rows.withColumn("first", F.col("g") == "a")
    own, rest = [v for v, g in known if g == "a"], [v for v, g in known if g != "a"]
    u = sum((a > b) + (a == b) / 2 for a in own for b in rest)
    found = stats.mann_whitney(flagged, "v", "first")
    assert found["u"] == pytest.approx(u) and found["rank_biserial"] == pytest.approx(2 * u / len(own) / len(rest) - 1)
    d = [v - w for _, v, w, _ in ROWS if v is not None and w is not None and v != w]
    signed = ranks([abs(x) for x in d])
    assert stats.wilcoxon(rows, "v", "w")["w"] == pytest.approx(min(sum(k for k, x in zip(signed, d) if x > 0), sum(k for k, x in zip(signed, d) if x < 0)))
    far = {g: [abs(v - np.median([x for x, k in known if k == g])) for v, k in known if k == g] for g in "abc"}
    mean = np.mean([x for c in far.values() for x in c])
    between = sum(len(c) * (np.mean(c) - mean) ** 2 for c in far.values()) / 2
    within = sum(((np.array(c) - np.mean(c)) ** 2).sum() for c in far.values()) / (n - 3)
    assert stats.levene(rows, "v", "g")["w"] == pytest.approx(between / within)
    v = np.sort([x for _, x, *_ in ROWS if x is not None])
    z = (v - v.mean()) / v.std(ddof=1)
    low, high = (np.array([math.log(0.5 * math.erfc(s * t / math.sqrt(2))) for t in z]) for s in (-1, 1))
    i = np.arange(1, len(v) + 1)
    assert stats.anderson(rows, "v", "id")["a2"] == pytest.approx(-len(v) - np.sum((2 * i - 1) * (low + high[::-1])) / len(v))
    assert math.isnan(stats.kruskal_wallis(rows.where("false"), "v", "g")["h"]) and math.isnan(stats.mann_whitney(rows.where("false").withColumn("f", F.lit(True)), "v", "f")["u"])


def test_distributions():
    assert stats.normal_sf(1.959963985) == pytest.approx(0.025) and stats.chi2_sf(3.841458821, 1) == pytest.approx(0.05) and stats.chi2_sf(18.307038, 10) == pytest.approx(0.05, abs=1e-6)
    assert stats.f_sf(3.885294, 2, 12) == pytest.approx(0.05, abs=1e-6) and stats.t_quantile(0.975, 10) == pytest.approx(2.228139, abs=1e-5)
    assert stats.power(2) == 0 and stats.power(20) < stats.power(64) == pytest.approx(0.8, abs=0.02) and stats.bonferroni([0.01, 0.5]) == [0.02, 1.0]


def test_time_series(spark):
    rng = np.random.default_rng(3)
    noise, walk = rng.normal(size=300), np.cumsum(rng.normal(size=300))
    assert stats.adf(noise)[0] < stats.ADF_CRITICAL[0] and stats.adf(walk)[0] > stats.ADF_CRITICAL[1]
    assert stats.kpss(noise) < stats.KPSS_CRITICAL[1] < stats.KPSS_CRITICAL[0] < stats.kpss(walk)
    assert stats.ljung_box(noise)[1] > 0.01 > 1e-6 > stats.ljung_box(walk)[1]
    pair = stats.engle_granger(walk, 2 * walk + 1 + rng.normal(size=300) * 0.1)
    assert pair["slope"] == pytest.approx(2, abs=0.05) and pair["statistic"] < stats.COINTEGRATION_CRITICAL[0] and 0 < pair["half_life"] < 3
    effect = np.r_[0, 0.8 * noise[:-1]] + rng.normal(size=300) * 0.3
    assert stats.granger(noise, effect, 2)[1] < 1e-6 < 0.001 < stats.granger(effect, noise, 2)[1]
    steps = np.r_[np.zeros(40), np.ones(40) * 5, np.ones(40)] + rng.normal(size=120) * 0.2
    assert stats.breaks(steps) == [40, 80] and stats.breaks(np.ones(50)) == []
    trend, season, rest = stats.seasonal(np.arange(70) * 0.5 + np.tile([0, 1, 2, 3, 2, 1, 0], 10))
    assert np.abs(rest[7:-7]).max() < 0.2 and season[3] > season[0]
    data = [(k, i, float(v)) for k, s in (("n", noise[:60]), ("w", walk[:60]), ("short", noise[:5])) for i, v in enumerate(s)] + [("n", 900, None)]
    got = {r.uuid: r for r in stats.stationarity(spark.createDataFrame(data, "uuid string, snapshot_date int, eur double")).collect()}
    assert set(got) == {"n", "w"} and not got["n"].has_unit_root and got["n"].n_obs == 60 and got["n"].adf == pytest.approx(stats.adf(noise[:60])[0])
    (r,) = stats.structural_breaks(spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(steps)], "uuid string, snapshot_date int, eur double")).collect()
    assert (r.n_breaks, r.at) == (2, [40, 80])
