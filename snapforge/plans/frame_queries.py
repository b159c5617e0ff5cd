"""Queries of the DataFrame builders over the analogue relations; the SQL beside them is for DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import gold, ml, monitor, silver
from ..sources import extract
from .dialect import run, to_duckdb
from .sql_queries import PREDICTED, PRICES


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _prices(spark: SparkSession, d: str) -> DataFrame:
    return run(spark, d, f"WITH {PRICES} SELECT uuid, uuid AS scryfall_id, snapshot_date, eur FROM prices")


def targets(spark: SparkSession, d: str) -> DataFrame:
    p = _prices(spark, d)
    return gold.ml_dataset(p).select("uuid", "snapshot_date", "eur", "target_price_7d", "target_price_30d", "target_change_30d")


TARGETS = f"""WITH {PRICES} SELECT p.uuid, p.snapshot_date, p.eur, a.eur AS target_price_7d, b.eur AS target_price_30d,
  CASE WHEN b.eur IS NULL THEN NULL WHEN b.eur > p.eur * 1.2 THEN 'up' WHEN b.eur < p.eur * 0.8 THEN 'down' ELSE 'flat' END AS target_change_30d
FROM prices p LEFT JOIN prices a ON a.uuid = p.uuid AND a.snapshot_date = CAST(p.snapshot_date + INTERVAL 7 DAY AS DATE) LEFT JOIN prices b ON b.uuid = p.uuid AND b.snapshot_date = CAST(p.snapshot_date + INTERVAL 30 DAY AS DATE)"""


def merged(spark: SparkSession, d: str) -> DataFrame:
    left = _t(spark, d, "customer").select((F.col("c_custkey") + 50).cast("string").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))
    right = _t(spark, d, "supplier").select(F.concat(F.lit(" "), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    return silver.merge(left, right, "id")


MERGED = """SELECT COALESCE(c.c_custkey + 50, s.s_suppkey)::VARCHAR AS id, COALESCE(c_name, s_name) AS name, COALESCE(c_nationkey, s_nationkey) AS nation, s_acctbal AS balance, c_custkey IS NOT NULL AS has_left
FROM customer c FULL OUTER JOIN supplier s ON c.c_custkey + 50 = s.s_suppkey"""


def filled(spark: SparkSession, d: str) -> DataFrame:
    rows = run(spark, d, "SELECT CAST(user_id AS STRING) AS k, CAST(ts AS DATE) AS snapshot_date, MAX(CASE WHEN event_type = 'purchase' THEN value END) AS a, MAX(CASE WHEN event_type = 'click' THEN value END) AS b FROM {events} GROUP BY CAST(user_id AS STRING), CAST(ts AS DATE)")
    return silver.forward_fill(rows, rows, "k", ["a", "b"])


FILLED = """WITH r AS (SELECT user_id::VARCHAR AS k, ts::DATE AS snapshot_date, MAX(CASE WHEN event_type = 'purchase' THEN value END) AS a, MAX(CASE WHEN event_type = 'click' THEN value END) AS b FROM events GROUP BY 1, 2),
l AS (SELECT *, lag(a) OVER w AS pa, lag(b) OVER w AS pb FROM r WINDOW w AS (PARTITION BY k ORDER BY snapshot_date))
SELECT k, snapshot_date, CASE WHEN a IS NULL AND b IS NULL THEN pa ELSE a END AS a, CASE WHEN a IS NULL AND b IS NULL THEN pb ELSE b END AS b FROM l"""


def underpriced(spark: SparkSession, d: str) -> DataFrame:
    return ml.underpriced(run(spark, d, f"WITH {PREDICTED} SELECT uuid, snapshot_date, eur, predicted_eur FROM predictions")).select("uuid", "snapshot_date", "tier", "confidence", "is_underpriced")


UNDERPRICED = to_duckdb(f"WITH {PREDICTED} SELECT uuid, snapshot_date, CASE WHEN eur >= 1000 THEN 3 WHEN eur >= 100 THEN 2 ELSE 1 END AS tier, predicted_eur / GREATEST(eur, 0.01) AS confidence, CASE WHEN eur >= 1000 THEN 3 ELSE 1 END <> 3 AND predicted_eur / GREATEST(eur, 0.01) > 1.3 AS is_underpriced FROM predictions")


def rolling_mape(spark: SparkSession, d: str) -> DataFrame:
    p = run(spark, d, f"WITH {PREDICTED} SELECT uuid, snapshot_date, predicted_eur FROM predictions")
    return monitor.rolling_mape(p, _prices(spark, d), "2024-01-30", 20).withColumn("mape", F.round("mape", 6))


MAPE = to_duckdb(f"WITH {PREDICTED} SELECT snapshot_date, ROUND(AVG(ABS(predicted_eur - actual) / GREATEST(actual, 0.01)) * 100, 6) AS mape FROM scored WHERE snapshot_date >= DATE '2024-01-10' GROUP BY snapshot_date")


def similar(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("s"), F.col("p_retailprice").alias("r"))
    out = ml.similar(rows, "p_partkey", ["s", "r"], rows.where("p_partkey % 20 = 0"))
    return out.select("query", "p_partkey", F.col("rank").cast("int").alias("rank"), F.round("similarity_score", 6).alias("similarity_score"))


def tfidf(spark: SparkSession, d: str) -> DataFrame:
    return ml.tfidf(_t(spark, d, "documents"), "doc_id", "text").select("doc_id", "term", F.round("weight", 6).alias("weight"))


def boosted(spark: SparkSession, d: str) -> DataFrame:
    """The day's rows with a target, by tier."""
    p = _prices(spark, d)
    rows = ml.enrich_lags(ml.lag_features(p, "2024-01-15")).join(ml.target(p, "2024-01-15"), "uuid").where("log_return_7d IS NOT NULL")
    rows = ml.Features([], [], ["eur", "lag_1d", "lag_7d", "rolling_mean_7d", "rolling_min_30d", "rolling_max_30d", "momentum_7d", "log_eur"]).fit(rows).transform(rows)
    models = ml.by_tier(rows, "log_return_7d")
    return ml.predict_by_tier(rows, models).select("uuid", "snapshot_date", "tier", F.col("prediction"))


def links(spark: SparkSession, d: str) -> DataFrame:
    return extract.links(_t(spark, d, "pages"))


LINKS = """SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a[^>]*href="([^"]*)"', 1)) AS href FROM pages"""


def _page(*rows: list) -> Column:
    """An HTML table of rows of cells, each a column or text."""
    cell = lambda c: F.concat(F.lit("<td>"), c if isinstance(c, Column) else F.lit(c), F.lit("</td>"))
    return F.concat(F.lit("<html><table>"), *[F.concat(F.lit('<tr class="hover_tr">'), *map(cell, cells), F.lit("</tr>")) for cells in rows], F.lit("</table></html>"))


def staples_page(spark: SparkSession, d: str) -> DataFrame:
    """A page a part: its row, one with too few cells, and one whose share is no number."""
    rows = _t(spark, d, "part")
    name, size = F.concat(F.lit("<a href='x'>"), "p_name", F.lit("</a>")), F.col("p_size").cast("string")
    html = _page([size, name, F.concat(size, F.lit(".5%")), F.concat(F.lit("1,"), F.lpad(size, 3, "0")), "x"], ["1", "short", "2%"], ["2", "bad", "?", "3", "x"])
    return extract.staples(rows.select(F.col("p_partkey").alias("id"), html.alias("html")), "modern")


STAPLES_PAGE = "SELECT p_name || '__modern' AS id, p_name AS card_name, 'modern' AS format, p_size + 0.5::DOUBLE AS deck_pct, p_size::INT AS percentage_in_decks, (1000 + p_size)::DOUBLE AS played, p_size::INT AS top FROM part"


def tournaments_page(spark: SparkSession, d: str) -> DataFrame:
    """A page a day of orders would be long: a page an order, with its customer's event twice, and a row without a link."""
    rows = _t(spark, d, "orders")
    link = F.concat(F.lit('<a href="event?e='), F.col("o_custkey").cast("string"), F.lit('&f=MO">Cup '), F.col("o_orderkey").cast("string"), F.lit(" &amp; more</a>"))
    day = F.date_format(F.to_date("o_orderdate"), "dd/MM/yy")
    html = _page([link, day], [link, "01/01/01"], ["none", day])
    return extract.tournaments(rows.select(F.col("o_orderkey").alias("id"), html.alias("html"))).select("id", "row", "tournament_id", "event_name", "tournament_date")


TOURNAMENTS_PAGE = "SELECT o_orderkey AS id, 0 AS row, o_custkey::VARCHAR AS tournament_id, 'Cup ' || o_orderkey || ' & more' AS event_name, o_orderdate::DATE AS tournament_date FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1"


def decks_page(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "customer")
    link = lambda i: F.concat(F.lit('<div class="hover_tr"><a href="event?e=1&d='), (F.col("c_custkey") * 20 + i).cast("string"), F.lit('">Deck</a></div>'))
    return extract.decks(rows.select(F.col("c_custkey").alias("id"), F.concat(*[link(i) for i in (0, 1, 1, *range(2, 12))]).alias("html")))


DECKS_PAGE = "SELECT c_custkey AS id, (i + 1)::INT AS placement, (c_custkey * 20 + i)::VARCHAR AS deck_id FROM customer CROSS JOIN (SELECT unnest(range(8)) AS i)"


def decklist_page(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "part")
    line = lambda board, n: F.concat(F.lit(f'<div class="deck_line" id="{board}'), F.col("p_partkey").cast("string"), F.lit('">'), n, F.lit(" <b>"), "p_name", F.lit("</b></div>"))
    html = F.concat(line("md", F.col("p_size").cast("string")), line("sb", F.lit("2")), line("sb", F.lit("many")))
    return extract.decklist(rows.select(F.col("p_partkey").alias("id"), html.alias("html")))


DECKLIST_PAGE = "SELECT p_partkey AS id, p_size::INT AS copies, p_name AS card_name, false AS is_sideboard FROM part UNION ALL SELECT p_partkey, 2, p_name, true FROM part"


FRAMES = {
    "jn12_ml_dataset": (targets, to_duckdb(TARGETS)),
    "jn01_merge_builder": (merged, MERGED),
    "jn20_forward_fill_builder": (filled, FILLED),
    "ml24_underpriced_builder": (underpriced, UNDERPRICED),
    "mon02_rolling_mape": (rolling_mape, MAPE),
    "so07_similar": (similar, None),
    "ml21_tfidf": (tfidf, None),
    "ml12_boosted_by_tier": (boosted, None),
    "src05_staples_page": (staples_page, STAPLES_PAGE),
    "src06_tournaments_page": (tournaments_page, TOURNAMENTS_PAGE),
    "src07_decks_page": (decks_page, DECKS_PAGE),
    "src08_decklist_page": (decklist_page, DECKLIST_PAGE),
    "src06_html_links": (links, LINKS),
}
