"""Every catalogue query that has SQL gives DuckDB's rows on the smallest tables, and those without run."""

import math

import duckdb
import pytest

from snapforge.plans import catalogue
from snapforge.plans.dialect import TABLES, to_duckdb

D = "/root/testdata/sf0.001"


def shown(v):
    return "null" if v is None else "nan" if isinstance(v, float) and math.isnan(v) else f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_rows(spark, duck, name):
    got = catalogue.QUERIES[name](spark, D)
    columns = sorted(got.columns)
    rows = sorted(tuple(shown(r[c]) for c in columns) for r in got.collect())
    found = duck.execute(catalogue.ORACLES[name])
    names = [x[0] for x in found.description]
    want = sorted(tuple(shown(dict(zip(names, r))[c]) for c in columns) for r in found.fetchall())
    assert sorted(names) == columns and rows == want


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES) - {"ml12_boosted_by_tier"}))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, D).count() > 0 or name in {"sta07_stationarity", "sta11_structural_breaks"}  # these need 20 days of a key


def test_rewriting():
    assert to_duckdb("datediff(a, date_add(b, 7))") == "date_diff('day', CAST(b + INTERVAL (7) DAY AS DATE), a)"
    assert to_duckdb("size(filter(x, y -> y = ','))") == "CAST(len(list_filter(x, lambda y: y = ',')) AS INT)"
