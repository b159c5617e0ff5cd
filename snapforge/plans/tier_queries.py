"""Queries of the builders over analogue feeds, with DuckDB SQL written for itself from what each operator has to give.

The feeds are made of the driver's tables, whole: customers are the left catalogue, parts the right one with its languages, daily
events the prices, order lines the tournament results. Their SQL is the same text for both engines; what the builders do with them
isn't shared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr
from ..operators import gold, ml, monitor, ranking, silver, stats
from ..sources import extract, feeds, io
from ..sources.store import Store
from .dialect import run, to_duckdb

DAY, PERIODS = "2024-01-20", (("2024-01-01", "2024-01-20"), ("2024-01-21", "2024-01-30"))

# ---------------------------------------------------------------- analogue feeds: text for both engines

#: Two faces share a scryfall_id; some ids have no counterpart on the right, and nation 24 has none at all.
CARDS = """SELECT concat('u', lpad(CAST(c_custkey AS STRING), 7, '0')) AS uuid,
  CASE WHEN c_nationkey = 24 THEN '{{}}' ELSE concat('{{"scryfall_id": " s', CAST(CAST(floor(c_custkey / 2) AS BIGINT) * 3 AS STRING), ' "}}') END AS identifiers,
  concat(' ', c_name) AS name, concat(lower(c_mktsegment), ' ') AS set_code, CASE WHEN c_nationkey < 3 THEN '_' ELSE CAST(c_nationkey AS STRING) END AS number,
  'ENGLISH' AS language, 'Normal' AS layout, c_mktsegment AS rarity, c_acctbal < -900 AS is_online_only, CASE WHEN c_nationkey = 5 THEN NULL ELSE c_nationkey = 7 END AS is_funny, c_nationkey = 9 AS is_promo,
  CASE WHEN c_acctbal < 0 THEN 'n/a' ELSE CAST(c_nationkey AS STRING) END AS mana_value, CASE WHEN c_nationkey = 11 THEN NULL ELSE concat('["', lower(left(c_mktsegment, 1)), '","w"]') END AS colors,
  concat('["', c_mktsegment, '"]') AS keywords, CASE WHEN c_acctbal > 5000 THEN '["Foil","Etched"]' ELSE '["Nonfoil"]' END AS finishes,
  CASE WHEN c_nationkey = 13 THEN NULL WHEN c_nationkey = 14 THEN 'Instant' ELSE concat('Legendary Old Creature — ', c_name) END AS original_type,
  c_mktsegment AS text, CASE WHEN c_nationkey < 20 THEN 'MACHINERY ' END AS original_text,
  CASE WHEN c_nationkey = 15 THEN NULL ELSE concat('{{"commander":"', CASE WHEN c_acctbal > 0 THEN 'Legal' ELSE 'Banned' END, '","modern":"legal","pauper":"', CASE WHEN c_nationkey > 10 THEN 'LEGAL' ELSE 'x' END, '"}}') END AS legalities
  FROM {customer}"""
PRINTS = """SELECT concat(' s', CAST(p_partkey AS STRING)) AS id, concat('o', CAST(p_size AS STRING)) AS oracle_id, concat(p_name, ' ') AS name, CASE WHEN p_size = 50 THEN 'token' ELSE 'Split' END AS layout,
  p_size = 49 AS digital, CASE p_type WHEN 'SMALL' THEN 'machinery' WHEN 'LARGE' THEN 'building' WHEN 'MEDIUM' THEN 'automobile' WHEN 'PROMO' THEN 'furniture' ELSE 'household' END AS set,
  CAST(p_size AS STRING) AS collector_number, CASE p_type WHEN 'SMALL' THEN 'zhs' WHEN 'LARGE' THEN ' de' WHEN 'MEDIUM' THEN 'xx' WHEN 'PROMO' THEN 'zht' ELSE 'en' END AS lang,
  CASE WHEN p_size = 48 THEN 'Funny' WHEN p_size = 47 THEN NULL ELSE 'Core' END AS set_type, CASE WHEN p_size > 40 THEN 'x' ELSE CAST(p_size AS STRING) END AS cmc, p_size < 10 AS reprint, upper(p_type) AS rarity,
  CASE WHEN p_size < 30 THEN '["u"]' END AS colors, concat('{{"commander":"legal","standard":"', lower(p_type), '"}}') AS legalities FROM {part}"""
#: A user's day: rows of views and errors alone have no price.
SCALAR = """SELECT concat('s', CAST(user_id AS STRING)) AS id, CAST(ts AS DATE) AS snapshot_date, MAX(CASE WHEN event_type = 'purchase' THEN value END) AS eur, MAX(CASE WHEN event_type = 'click' AND value > 30 THEN value END) AS eur_foil,
  MAX(CASE WHEN event_type = 'signup' THEN value END) AS usd, MAX(CASE WHEN event_type = 'signup' AND value > 50 THEN value END) AS usd_foil FROM {events} GROUP BY concat('s', CAST(user_id AS STRING)), CAST(ts AS DATE)"""
POINTS = """SELECT DISTINCT concat('u', lpad(CAST(user_id AS STRING), 7, '0')) AS uuid, CAST(ts AS DATE) AS snapshot_date, CASE event_type WHEN 'view' THEN 'cardmarket' WHEN 'click' THEN 'tcgplayer' WHEN 'signup' THEN 'cardkingdom' ELSE 'manapool' END AS retailer,
  CASE WHEN value > 60 THEN 'buylist' ELSE 'retail' END AS tx_type, CASE WHEN value > 80 THEN 'foil' ELSE 'normal' END AS finish, value AS price FROM {events} WHERE value > 55"""
#: Each day's last event decides the status: error is banned, view is legal.
META = """SELECT id, snapshot_date, concat('{{"commander":"', s, '","standard":"', CASE WHEN s = 'legal' THEN 'restricted' ELSE s END, '","modern":"', s, '","legacy":"legal","vintage":"', CASE WHEN s = 'banned' THEN 'legal' ELSE 'banned' END, '"}}') AS legalities, edhrec_rank
  FROM (SELECT concat('s', CAST(user_id AS STRING)) AS id, CAST(ts AS DATE) AS snapshot_date, CASE event_type WHEN 'error' THEN 'banned' WHEN 'view' THEN 'legal' ELSE event_type END AS s, CAST(round(value * 100) AS INT) AS edhrec_rank,
    row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) AS r FROM {events}) x WHERE r = 1"""
PRICES = """SELECT concat('u', lpad(CAST(user_id AS STRING), 7, '0')) AS uuid, concat('s', CAST(user_id AS STRING)) AS scryfall_id, CAST(ts AS DATE) AS snapshot_date,
  CASE WHEN COUNT(*) = 1 THEN NULL ELSE CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*) END AS eur, MAX(CASE WHEN event_type = 'purchase' THEN value END) AS eur_foil
  FROM {events} GROUP BY user_id, CAST(ts AS DATE)"""
RESULTS = """SELECT CASE WHEN l_partkey = 1 THEN NULL ELSE concat('o', CAST(l_partkey AS STRING)) END AS oracle_id, concat('s', CAST(l_suppkey AS STRING)) AS scryfall_id, o_orderstatus AS format, CAST(l_orderkey AS STRING) AS tournament_id,
  CAST(l_shipdate AS DATE) AS tournament_date, CAST(l_quantity AS INT) AS copies, l_returnflag = 'R' AS is_sideboard FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey"""
STAPLES = """SELECT event_type AS id, concat('Customer#', lpad(CAST(CAST(floor(MIN(value)) AS INT) AS STRING), 9, '0')) AS card_name, CASE event_type WHEN 'view' THEN 'commander' WHEN 'click' THEN 'modern' WHEN 'error' THEN 'legacy' ELSE 'vintage' END AS format,
  CAST(ts AS DATE) AS snapshot_date, double(COUNT(*)) AS deck_pct, double(SUM(user_id)) AS played, CAST(MIN(user_id) AS INT) AS top FROM {events} GROUP BY event_type, CAST(ts AS DATE)"""
FEEDS = {"cards_in": CARDS, "prints_in": PRINTS, "scalar_in": SCALAR, "points_in": POINTS, "meta_in": META, "prices_in": PRICES, "results_in": RESULTS, "staples_in": STAPLES}
FEEDS = {n: t.replace("{{", "\x01").replace("}}", "\x02") for n, t in FEEDS.items()}
_DUCK = {n: to_duckdb(t).replace("\x01", "{").replace("\x02", "}").replace("STRING", "VARCHAR") for n, t in FEEDS.items()}
#: JSON texts of the feeds hold braces, which mark tables in the catalogue's texts.
_SPARK = {n: t.replace("\x01", "\\u007b").replace("\x02", "\\u007d") for n, t in FEEDS.items()}


def feed(spark: SparkSession, d: str, name: str) -> DataFrame:
    return run(spark, d, _SPARK[name])


def duck(text: str, *names: str) -> str:
    """DuckDB SQL over feeds, which come first."""
    text = text.strip()
    more = text.startswith("WITH ")
    return "WITH " + ", ".join(f"{n} AS MATERIALIZED ({_DUCK[n]})" for n in names) + (", " + text[5:] if more else " " + text)


# ---------------------------------------------------------------- cleaned tier

LISTED = ("colors", "keywords", "finishes", "original_supertypes", "original_types", "original_subtypes")
SHOWN = (
    "uuid", "scryfall_id", "canonical_uuid", "oracle_id", "name", "ascii_name", "set_code", "collector_number", "language", "layout", "lang", "rarity", "set_type", "mana_value", "text", "errata",
    "is_reprint", "is_promo", "is_commander_legal", "is_standard_legal", "is_modern_legal", "is_legacy_legal", "format_count",
)


def merged(spark: SparkSession, d: str) -> DataFrame:
    return silver.cards(feed(spark, d, "cards_in"), feed(spark, d, "prints_in"))


def silver_cards(spark: SparkSession, d: str) -> DataFrame:
    return merged(spark, d).select(*SHOWN, *[F.array_join(c, "|").alias(c) for c in LISTED])


#: The merged catalogue, step by step.
MERGED = """WITH out_ids AS (SELECT trim(id) AS id FROM prints_in WHERE lower(trim(COALESCE(set_type, ''))) IN ('funny', 'memorabilia')),
l AS (SELECT trim(uuid) AS uuid, trim(json_extract_string(identifiers, '$.scryfall_id')) AS sid, trim(name) AS name, upper(trim(set_code)) AS set_code, NULLIF(trim(number), '_') AS collector_number,
    'English' AS language, lower(layout) AS layout, lower(rarity) AS rarity, TRY_CAST(mana_value AS DOUBLE) AS mana_value, text, original_text IS NOT NULL AND trim(text) <> trim(original_text) AS errata, COALESCE(is_promo, false) AS is_promo,
    legalities, CASE WHEN colors IS NULL THEN '' ELSE upper(replace(replace(replace(replace(colors, '["', ''), '"]', ''), '","', '|'), '"', '')) END AS colors,
    upper(left(rarity, 1)) || lower(substr(rarity, 2)) AS keywords, CASE WHEN finishes LIKE '%Foil%' THEN 'foil|etched' ELSE 'nonfoil' END AS finishes,
    CASE WHEN original_type LIKE 'Legendary%' THEN 'Legendary' ELSE '' END AS original_supertypes, CASE WHEN original_type LIKE 'Legendary%' THEN 'Creature' WHEN original_type = 'Instant' THEN 'Instant' ELSE '' END AS original_types,
    CASE WHEN original_type LIKE 'Legendary%' THEN split_part(original_type, ' — ', 2) ELSE '' END AS original_subtypes
  FROM cards_in WHERE NOT COALESCE(is_online_only, false) AND NOT COALESCE(is_funny, false)),
lk AS (SELECT * FROM l WHERE (SELECT COUNT(*) FROM out_ids) = 0 OR (sid IS NOT NULL AND NOT EXISTS (SELECT 1 FROM out_ids o WHERE o.id = sid))),
r AS (SELECT trim(id) AS sid, oracle_id, trim(name) AS name, lower(layout) AS layout, upper(set) AS set_code, collector_number, trim(lang) AS lang,
    CASE trim(lang) WHEN 'zhs' THEN 'Chinese Simplified' WHEN 'zht' THEN 'Chinese Traditional' WHEN 'de' THEN 'German' WHEN 'en' THEN 'English' ELSE trim(lang) END AS language, lower(set_type) AS set_type, TRY_CAST(cmc AS DOUBLE) AS mana_value,
    reprint, lower(rarity) AS rarity, CASE WHEN colors IS NULL THEN '' ELSE 'U' END AS colors, legalities
  FROM prints_in WHERE NOT digital AND layout <> 'token' AND NOT EXISTS (SELECT 1 FROM out_ids o WHERE o.id = trim(prints_in.id))),
j AS (SELECT lk.uuid, COALESCE(lk.sid, r.sid) AS scryfall_id, r.oracle_id, COALESCE(lk.name, r.name) AS name, COALESCE(lk.name, r.name) AS ascii_name, COALESCE(lk.set_code, r.set_code) AS set_code, COALESCE(lk.collector_number, r.collector_number) AS collector_number,
    COALESCE(lk.language, r.language) AS language, COALESCE(lk.layout, r.layout) AS layout, r.lang, COALESCE(lk.rarity, r.rarity) AS rarity, r.set_type, COALESCE(lk.mana_value, r.mana_value) AS mana_value, lk.text, lk.errata,
    CASE WHEN lk.uuid IS NOT NULL THEN false ELSE r.reprint END AS is_reprint, COALESCE(lk.is_promo, false) AS is_promo, COALESCE(lk.legalities, r.legalities) AS legalities, COALESCE(lk.colors, r.colors) AS colors, COALESCE(lk.keywords, '') AS keywords, COALESCE(lk.finishes, '') AS finishes,
    lk.original_supertypes, lk.original_types, lk.original_subtypes
  FROM lk FULL OUTER JOIN r ON lk.sid = r.sid),
least_uuid AS (SELECT set_code, collector_number, MIN(uuid) AS u FROM lk WHERE set_code IS NOT NULL AND collector_number IS NOT NULL GROUP BY ALL),
k AS (SELECT j.*, COALESCE(j.uuid, u) AS canonical_uuid FROM j LEFT JOIN least_uuid USING (set_code, collector_number)),
one AS (SELECT * FROM k WHERE scryfall_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY scryfall_id ORDER BY uuid NULLS LAST) = 1),
merged AS (SELECT *, lower(json_extract_string(legalities, '$.commander')) = 'legal' AS is_commander_legal, lower(json_extract_string(legalities, '$.standard')) = 'legal' AS is_standard_legal, lower(json_extract_string(legalities, '$.modern')) = 'legal' AS is_modern_legal,
  lower(json_extract_string(legalities, '$.legacy')) = 'legal' AS is_legacy_legal,
  (CASE WHEN lower(json_extract_string(legalities, '$.commander')) = 'legal' THEN 1 ELSE 0 END + CASE WHEN lower(json_extract_string(legalities, '$.modern')) = 'legal' THEN 1 ELSE 0 END + CASE WHEN lower(json_extract_string(legalities, '$.pauper')) = 'legal' THEN 1 ELSE 0 END)::INT AS format_count FROM one)"""


def silver_prices(spark: SparkSession, d: str) -> DataFrame:
    scalar = feed(spark, d, "scalar_in")
    history = gold.with_columns(scalar.withColumnRenamed("id", "scryfall_id"), dict.fromkeys(silver.POINT_PRICES, "double"))
    return silver.prices(merged(spark, d), scalar, feed(spark, d, "points_in"), history, DAY)


_POINT_SQL = ", ".join(f"MAX(price) FILTER (retailer = '{r}' AND tx_type = '{t}' AND finish = '{f}') AS {n}" for n, (r, t, f) in silver.POINT_PRICES.items())
_ALL_PRICES = [*silver.SCALAR_PRICES, *silver.POINT_PRICES]
SILVER_PRICES = f"""{MERGED},
ids AS (SELECT scryfall_id, COALESCE(uuid, canonical_uuid) AS uuid FROM merged WHERE COALESCE(uuid, canonical_uuid) IS NOT NULL AND (uuid IS NOT NULL OR language = 'English')),
wide AS (SELECT uuid, {_POINT_SQL} FROM points_in WHERE snapshot_date = DATE '{DAY}' GROUP BY uuid),
base AS (SELECT ids.uuid, ids.scryfall_id, s.snapshot_date, eur, eur_foil, usd, usd_foil, {', '.join(silver.POINT_PRICES)} FROM scalar_in s JOIN ids ON ids.scryfall_id = s.id LEFT JOIN wide w ON w.uuid = ids.uuid WHERE s.snapshot_date = DATE '{DAY}'),
earlier AS (SELECT * FROM scalar_in WHERE snapshot_date < DATE '{DAY}' QUALIFY row_number() OVER (PARTITION BY id ORDER BY snapshot_date DESC) = 1)
SELECT base.uuid, base.scryfall_id, base.snapshot_date, {', '.join(f"CASE WHEN COALESCE({', '.join('base.' + c for c in _ALL_PRICES)}) IS NULL THEN earlier.{c} ELSE base.{c} END AS {c}" for c in silver.SCALAR_PRICES)}, {', '.join('base.' + c for c in silver.POINT_PRICES)}
FROM base LEFT JOIN earlier ON earlier.id = base.scryfall_id"""


def _variants(spark: SparkSession, d: str, day: str | None) -> DataFrame:
    scalar = feed(spark, d, "scalar_in")
    return silver.language_prices(merged(spark, d), feed(spark, d, "prints_in"), scalar, scalar.withColumnRenamed("id", "scryfall_id"), day or DAY)


def language_prices(spark: SparkSession, d: str) -> DataFrame:
    return _variants(spark, d, DAY)


LANGUAGE_PRICES = f"""{MERGED},
v AS (SELECT m.scryfall_id, m.canonical_uuid, p.lang FROM merged m LEFT JOIN prints_in p ON trim(p.id) = m.scryfall_id WHERE m.uuid IS NULL AND m.canonical_uuid IS NOT NULL),
earlier AS (SELECT * FROM scalar_in WHERE snapshot_date < DATE '{DAY}' QUALIFY row_number() OVER (PARTITION BY id ORDER BY snapshot_date DESC) = 1),
variants AS (SELECT v.scryfall_id, v.canonical_uuid, v.lang, s.snapshot_date, {', '.join(f"CASE WHEN COALESCE(s.eur, s.eur_foil, s.usd, s.usd_foil) IS NULL THEN e.{c} ELSE s.{c} END AS {c}" for c in silver.SCALAR_PRICES)}
  FROM v JOIN scalar_in s ON s.id = v.scryfall_id LEFT JOIN earlier e ON e.id = v.scryfall_id WHERE s.snapshot_date = DATE '{DAY}')"""


def _exclude(spark: SparkSession, d: str) -> DataFrame:
    rows = run(spark, d, "SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN NULL ELSE c_nationkey END AS k FROM {customer}")
    return silver.exclude_ids(rows, "k", run(spark, d, "SELECT s_nationkey FROM {supplier} WHERE s_acctbal > 8000")).select("c_custkey")


def _semi_and_anti(spark: SparkSession, d: str) -> DataFrame:
    rows = run(spark, d, "SELECT o_orderkey FROM {orders} WHERE o_custkey IN (SELECT c_custkey FROM {customer} WHERE c_acctbal < 0)")
    return silver.exclude_ids(rows, "o_orderkey", run(spark, d, "SELECT l_orderkey FROM {lineitem} WHERE l_quantity > 45"))


# ---------------------------------------------------------------- feature tier


def _rounded(rows: DataFrame, places: int, *names: str) -> DataFrame:
    return rows.withColumns({n: F.round(n, places) for n in names})


def price_features(spark: SparkSession, d: str) -> DataFrame:
    out = gold.price_features(feed(spark, d, "prices_in"), feed(spark, d, "meta_in"))
    out = out.drop("usd", "usd_foil", "cardmarket_eur", "cardmarket_eur_foil", "tcgplayer_usd", "tcgplayer_usd_foil")
    return _rounded(out, 9, "price_7d_avg", "price_30d_avg", "price_volatility_30d")


PRICE_FEATURES = """WITH p AS (SELECT *, row_number() OVER (PARTITION BY uuid ORDER BY snapshot_date) AS n FROM prices_in),
l AS (SELECT p.*, a.eur AS l1, b.eur AS l7, c.eur AS l30 FROM p LEFT JOIN p a ON a.uuid = p.uuid AND a.n = p.n - 1 LEFT JOIN p b ON b.uuid = p.uuid AND b.n = p.n - 7 LEFT JOIN p c ON c.uuid = p.uuid AND c.n = p.n - 30),
h AS (SELECT l.uuid, l.n, AVG(q.eur) FILTER (q.n > l.n - 7) AS a7, AVG(q.eur) FILTER (q.n > l.n - 30) AS a30, stddev_samp(q.eur) FILTER (q.n > l.n - 30) AS s30, MAX(q.eur) AS hi, MIN(q.eur) AS lo, COUNT(q.eur) AS k, MAX(q.snapshot_date) FILTER (q.eur IS NOT NULL) AS seen
  FROM l JOIN p q ON q.uuid = l.uuid AND q.n <= l.n GROUP BY l.uuid, l.n)
SELECT l.uuid, l.scryfall_id, l.snapshot_date, l.eur, l.eur_foil, m.edhrec_rank::DOUBLE AS edhrec_rank, ROUND(a7, 9) AS price_7d_avg, ROUND(a30, 9) AS price_30d_avg,
  l.eur - l1 AS price_change_1d_abs, l.eur - l7 AS price_change_7d_abs, l.eur - l30 AS price_change_30d_abs, (l.eur - l1) / NULLIF(l1, 0) AS price_change_1d_pct, (l.eur - l7) / NULLIF(l7, 0) AS price_change_7d_pct, (l.eur - l30) / NULLIF(l30, 0) AS price_change_30d_pct,
  ROUND(s30, 9) AS price_volatility_30d, l.eur_foil / NULLIF(l.eur, 0) AS foil_premium, hi AS price_ath, lo AS price_atl, k AS days_with_price, date_diff('day', seen, l.snapshot_date) AS days_since_last_real_price,
  (SELECT COUNT(*) FROM prices_in x WHERE x.snapshot_date = l.snapshot_date AND (x.eur > l.eur OR (l.eur IS NULL AND x.eur IS NOT NULL))) + 1 AS price_rank_global, ABS((l.eur - l1) / NULLIF(l1, 0)) > 3 AS is_price_spike
FROM l JOIN h USING (uuid, n) LEFT JOIN meta_in m ON m.id = l.scryfall_id AND m.snapshot_date = l.snapshot_date"""


def card_features(spark: SparkSession, d: str) -> DataFrame:
    return gold.card_features(merged(spark, d)).drop("edhrec_saltiness", "is_full_art", "is_textless", "is_reserved", "color_identity_count", "variation_count")


CARD_FEATURES = f"""{MERGED}
SELECT uuid, scryfall_id, oracle_id, name, set_code, rarity, CASE WHEN mana_value <= 20 THEN mana_value END AS mana_value, is_reprint, is_promo, set_type, len(string_split(finishes, '|'))::INT AS finish_count, finishes LIKE '%etched%' AS has_etched_finish,
  CASE WHEN colors = '' THEN 0 ELSE len(string_split(colors, '|')) END::INT AS color_count, original_supertypes = 'Legendary' AS is_legendary, is_commander_legal, is_standard_legal, is_modern_legal, is_legacy_legal, format_count,
  CASE WHEN oracle_id IS NULL THEN 1 ELSE COUNT(*) OVER (PARTITION BY oracle_id) END AS print_count FROM merged WHERE uuid IS NOT NULL"""


def language_premiums(spark: SparkSession, d: str) -> DataFrame:
    return gold.language_premiums(_variants(spark, d, DAY), feed(spark, d, "prices_in"))


LANGUAGE_PREMIUMS = f"""{LANGUAGE_PRICES}
SELECT v.scryfall_id, v.canonical_uuid, v.lang, v.snapshot_date, v.eur AS lang_eur, v.eur_foil AS lang_eur_foil, v.usd AS lang_usd, v.usd_foil AS lang_usd_foil, p.eur AS canonical_eur, p.eur_foil AS canonical_eur_foil,
  v.eur / NULLIF(p.eur, 0) AS eur_lang_premium, v.eur_foil / NULLIF(p.eur_foil, 0) AS eur_foil_lang_premium FROM variants v JOIN prices_in p ON p.uuid = v.canonical_uuid AND p.snapshot_date = v.snapshot_date"""

_BEFORE = """WITH n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY snapshot_date) AS n FROM meta_in),
s AS (SELECT c.id, c.snapshot_date, c.edhrec_rank, b.edhrec_rank AS prev_rank, f.format, json_extract_string(c.legalities, '$.' || f.format) AS now, json_extract_string(b.legalities, '$.' || f.format) AS prev
  FROM n c LEFT JOIN n b ON b.id = c.id AND b.n = c.n - 1 CROSS JOIN (SELECT unnest(['commander', 'standard', 'modern', 'legacy', 'vintage']) AS format) f),
turns AS (SELECT id, snapshot_date AS event_date, format, CASE now WHEN 'banned' THEN 'ban' ELSE 'unban' END AS event_type FROM s WHERE (prev = 'legal' AND now = 'banned') OR (prev = 'banned' AND now = 'legal'))"""


def demand_signals(spark: SparkSession, d: str) -> DataFrame:
    return gold.demand_signals(feed(spark, d, "meta_in"))


DEMAND_SIGNALS = f"""{_BEFORE}
SELECT id, snapshot_date, MAX(edhrec_rank) AS edhrec_rank, MAX(edhrec_rank - prev_rank) AS edhrec_rank_change, {', '.join(f"MAX(now) FILTER (format = '{f}') AS {f}_legality, COALESCE(bool_or(prev = 'legal' AND now = 'banned') FILTER (format = '{f}'), false) AS {f}_banned, COALESCE(bool_or(prev = 'banned' AND now = 'legal') FILTER (format = '{f}'), false) AS {f}_unbanned" for f in gold.FORMATS)}
FROM s GROUP BY id, snapshot_date"""


def events(spark: SparkSession, d: str) -> DataFrame:
    return gold.events(feed(spark, d, "meta_in"))


EVENTS = f"{_BEFORE} SELECT event_date, format, event_type, COUNT(*) AS card_count FROM turns GROUP BY ALL"


def impact(spark: SparkSession, d: str) -> DataFrame:
    out = gold.ban_price_impact(feed(spark, d, "meta_in"), feed(spark, d, "prices_in"))
    return _rounded(out, 9, *[c for c in out.columns if c.startswith("price_")])


_MEAN = "(SELECT AVG(eur) FROM prices_in p WHERE p.scryfall_id = t.id AND p.snapshot_date BETWEEN t.event_date + INTERVAL ({}) DAY AND t.event_date + INTERVAL ({}) DAY)"
IMPACT = f"""{_BEFORE}, m AS (SELECT id AS scryfall_id, format, event_type, event_date, {_MEAN.format(-30, -1)} AS b30, {_MEAN.format(-7, -1)} AS b7, {_MEAN.format(0, 0)} AS at0, {_MEAN.format(1, 7)} AS a7, {_MEAN.format(1, 30)} AS a30 FROM turns t)
SELECT scryfall_id, format, event_type, event_date, ROUND(b30, 9) AS price_30d_before, ROUND(b7, 9) AS price_7d_before, ROUND(at0, 9) AS price_at_event, ROUND(a7, 9) AS price_7d_after, ROUND(a30, 9) AS price_30d_after,
  ROUND((a7 - b7) / NULLIF(b7, 0), 9) AS price_change_7d_pct, ROUND((a30 - b30) / NULLIF(b30, 0), 9) AS price_change_30d_pct FROM m"""

AS_OF = "2001-12-31"


def tournament_signals(spark: SparkSession, d: str) -> DataFrame:
    return gold.tournament_signals(feed(spark, d, "results_in"), AS_OF)


TOURNAMENTS = f"""WITH b AS (SELECT *, date_diff('day', tournament_date, DATE '{AS_OF}') AS age FROM results_in WHERE oracle_id IS NOT NULL)
SELECT oracle_id, MIN(scryfall_id) AS scryfall_id, format, COUNT(DISTINCT CASE WHEN age <= 30 AND NOT is_sideboard THEN tournament_id END) AS top8_appearances_30d, COUNT(DISTINCT CASE WHEN age <= 90 AND NOT is_sideboard THEN tournament_id END) AS top8_appearances_90d,
  AVG(CASE WHEN NOT is_sideboard THEN copies::DOUBLE END) AS top8_copies_avg, COUNT(DISTINCT CASE WHEN age <= 30 AND is_sideboard THEN tournament_id END) AS sideboard_appearances_30d,
  COUNT(DISTINCT CASE WHEN age <= 90 AND NOT is_sideboard THEN tournament_id END) * 100.0::DOUBLE / NULLIF(COUNT(DISTINCT CASE WHEN age <= 90 THEN tournament_id END), 0) AS main_deck_pct, MAX(CASE WHEN NOT is_sideboard THEN tournament_date END) AS last_top8_date FROM b GROUP BY oracle_id, format"""


def staples(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(gold.format_staples(feed(spark, d, "staples_in")), 6, "deck_pct_7d_avg", "deck_pct_30d_avg")


_STAPLED = """n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY snapshot_date) AS n FROM staples_in),
st AS (SELECT c.id, c.card_name, c.format, c.snapshot_date, c.deck_pct, c.played, c.top, (SELECT AVG(q.deck_pct) FROM n q WHERE q.id = c.id AND q.n BETWEEN c.n - 6 AND c.n) AS a7, (SELECT AVG(q.deck_pct) FROM n q WHERE q.id = c.id AND q.n BETWEEN c.n - 29 AND c.n) AS a30,
  c.deck_pct - b.deck_pct AS c7, c.deck_pct - e.deck_pct AS c30 FROM n c LEFT JOIN n b ON b.id = c.id AND b.n = c.n - 7 LEFT JOIN n e ON e.id = c.id AND e.n = c.n - 30)"""
STAPLED = f"WITH {_STAPLED} SELECT id, card_name, format, snapshot_date, deck_pct, played, top, ROUND(a7, 6) AS deck_pct_7d_avg, ROUND(a30, 6) AS deck_pct_30d_avg, c7 AS deck_pct_change_7d, c30 AS deck_pct_change_30d FROM st"


def dataset(spark: SparkSession, d: str) -> DataFrame:
    prices, meta, cards = feed(spark, d, "prices_in"), feed(spark, d, "meta_in"), gold.card_features(merged(spark, d))
    out = gold.ml_dataset(prices, cards, gold.demand_signals(meta), gold.tournament_signals(feed(spark, d, "results_in"), AS_OF), gold.format_staples(feed(spark, d, "staples_in")))
    names = ["rarity", "mana_value", "format_count", "print_count", "modern_banned", "edhrec_rank_change", "top8_30d_total", "top8_90d_total", "staple_pct_commander", "staple_pct_vintage"]
    return _rounded(out.select("uuid", "scryfall_id", "snapshot_date", "eur", "target_price_7d", "target_price_30d", "target_change_30d", "top8_copies_avg", *names), 6, "top8_copies_avg")


DATASET = f"""{MERGED},
cf AS (SELECT *, CASE WHEN oracle_id IS NULL THEN 1 ELSE COUNT(*) OVER (PARTITION BY oracle_id) END AS print_count FROM merged WHERE uuid IS NOT NULL),
{_BEFORE[5:]},
dm AS (SELECT id, snapshot_date, COALESCE(bool_or(prev = 'legal' AND now = 'banned') FILTER (format = 'modern'), false) AS modern_banned, MAX(edhrec_rank - prev_rank) AS edhrec_rank_change FROM s GROUP BY id, snapshot_date),
tr AS (SELECT oracle_id, SUM(a)::BIGINT AS t30, SUM(b)::BIGINT AS t90, AVG(c) AS cp FROM (SELECT oracle_id, format, COUNT(DISTINCT tournament_id) FILTER (date_diff('day', tournament_date, DATE '{AS_OF}') <= 30 AND NOT is_sideboard) AS a,
  COUNT(DISTINCT tournament_id) FILTER (date_diff('day', tournament_date, DATE '{AS_OF}') <= 90 AND NOT is_sideboard) AS b, AVG(copies::DOUBLE) FILTER (NOT is_sideboard) AS c FROM results_in WHERE oracle_id IS NOT NULL GROUP BY oracle_id, format) z GROUP BY oracle_id)
SELECT p.uuid, p.scryfall_id, p.snapshot_date, p.eur, a.eur AS target_price_7d, b.eur AS target_price_30d, CASE WHEN b.eur IS NULL THEN NULL WHEN b.eur > p.eur * 1.2 THEN 'up' WHEN b.eur < p.eur * 0.8 THEN 'down' ELSE 'flat' END AS target_change_30d,
  ROUND(cp, 6) AS top8_copies_avg, cf.rarity, CASE WHEN cf.mana_value <= 20 THEN cf.mana_value END AS mana_value, cf.format_count, cf.print_count, dm.modern_banned, dm.edhrec_rank_change, t30 AS top8_30d_total, t90 AS top8_90d_total, sc.deck_pct AS staple_pct_commander, sv.deck_pct AS staple_pct_vintage
FROM prices_in p LEFT JOIN prices_in a ON a.uuid = p.uuid AND a.snapshot_date = p.snapshot_date + INTERVAL 7 DAY LEFT JOIN prices_in b ON b.uuid = p.uuid AND b.snapshot_date = p.snapshot_date + INTERVAL 30 DAY
LEFT JOIN cf ON cf.uuid = p.uuid LEFT JOIN dm ON dm.id = p.scryfall_id AND dm.snapshot_date = p.snapshot_date LEFT JOIN tr ON tr.oracle_id = cf.oracle_id
LEFT JOIN (SELECT card_name, snapshot_date, MAX(deck_pct) AS deck_pct FROM staples_in WHERE format = 'commander' GROUP BY ALL) sc ON sc.card_name = cf.name AND sc.snapshot_date = p.snapshot_date
LEFT JOIN (SELECT card_name, snapshot_date, MAX(deck_pct) AS deck_pct FROM staples_in WHERE format = 'vintage' GROUP BY ALL) sv ON sv.card_name = cf.name AND sv.snapshot_date = p.snapshot_date WHERE p.eur IS NOT NULL"""

# ---------------------------------------------------------------- sources and sinks


def _walk(spark: SparkSession, d: str) -> DataFrame:
    """Each event as a record of the nested price feed."""
    rows = run(spark, d, "SELECT CAST(event_id AS STRING) AS uuid, event_type, CAST(CAST(ts AS DATE) AS STRING) AS day, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value, value > 50 AS buys FROM {events}")
    dated = F.create_map(F.when(F.col("value") > 80, "foil").otherwise("etched"), F.create_map("day", "value"))
    shop = F.struct(F.when(F.col("buys"), dated).alias("buylist"), F.when(~F.col("buys"), dated).alias("retail"), F.lit("EUR").alias("currency"))
    return extract.price_points(rows.select("uuid", F.create_map("event_type", shop).alias("paper")))


def price_walk(spark: SparkSession, d: str) -> DataFrame:
    return _walk(spark, d)


WALK = "SELECT event_id::VARCHAR AS uuid, event_type AS retailer, CASE WHEN value > 50 THEN 'buylist' ELSE 'retail' END AS tx_type, CASE WHEN value > 80 AND event_type <> 'error' THEN 'foil' ELSE 'etched' END AS finish, ts::DATE AS date, CASE WHEN event_type <> 'error' THEN value END AS price FROM events"


def _user_points(spark: SparkSession, d: str) -> DataFrame:
    return run(spark, d, "SELECT CAST(user_id AS STRING) AS uuid, event_type AS retailer, 'retail' AS tx_type, 'normal' AS finish, CAST(ts AS DATE) AS date, MAX(CASE WHEN value > 5 THEN value END) AS price FROM {events} GROUP BY user_id, event_type, CAST(ts AS DATE)")


def asof_latest(spark: SparkSession, d: str) -> DataFrame:
    points = _user_points(spark, d)
    good = extract.latest_points(points, "2024-01-15", quarantine=True)
    return good.unionByName(extract.broken_points(points, "2024-01-15").withColumn("price", F.lit(-1.0)))


ASOF = """WITH p AS (SELECT user_id::VARCHAR AS uuid, event_type AS retailer, ts::DATE AS date, MAX(value) FILTER (value > 5) AS price FROM events GROUP BY ALL)
SELECT uuid, DATE '2024-01-15' AS snapshot_date, retailer, 'retail' AS tx_type, 'normal' AS finish, COALESCE(price, -1.0) AS price FROM p a WHERE date = (SELECT MAX(date) FROM p b WHERE b.uuid = a.uuid AND b.retailer = a.retailer AND b.date <= DATE '2024-01-15')"""


def seed(spark: SparkSession, d: str) -> DataFrame:
    return extract.seed_points(_user_points(spark, d))


SEED = "SELECT user_id::VARCHAR AS uuid, ts::DATE AS snapshot_date, event_type AS retailer, 'retail' AS tx_type, 'normal' AS finish, MAX(value) AS price FROM events WHERE value > 5 GROUP BY ALL"
_CARD = feeds.Feed("uuid string, size int, tags array<string>", feeds.listed)


def set_cards(spark: SparkSession, d: str) -> DataFrame:
    """A document a part: its set's cards are a good record and, for size 13, one that doesn't fit."""
    text = F.concat(F.lit('{"data": {"'), "p_brand", F.lit('": {"cards": [{"uuid": "'), F.col("p_partkey").cast("string"), F.lit('", "size": '), F.col("p_size").cast("string"), F.lit(', "tags": ["'), "p_type", F.lit('"]}'), F.when(F.col("p_size") == 13, ', {"uuid": "bad", "size": "x"}').otherwise(""), F.lit("]}}}"))
    good, bad = feeds.flatten(run(spark, d, "SELECT * FROM {part}").select(text.alias("value")), _CARD)
    return good.select(F.col("set").alias("brand"), "uuid", "size", F.array_join("tags", ",").alias("tags"), F.lit(False).alias("is_error")).union(bad.select("set", F.lit(None), F.lit(None), F.lit(None), F.lit(True)))


SET_CARDS = "SELECT p_brand AS brand, p_partkey::VARCHAR AS uuid, p_size AS size, p_type AS tags, false AS is_error FROM part UNION ALL SELECT p_brand, NULL, NULL, NULL, true FROM part WHERE p_size = 13"


def keyed_records(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit('{"data": {"'), F.col("c_custkey").cast("string"), F.lit('": {"size": '), F.col("c_nationkey").cast("string"), F.lit(', "tags": []}, "'), F.concat(F.lit("x"), F.col("c_custkey").cast("string")), F.lit('": {"size": 7}}}'))
    good, bad = feeds.flatten(run(spark, d, "SELECT * FROM {customer}").select(text.alias("value")), feeds.Feed("size int, tags array<string>", feeds.keyed))
    return good.select("uuid", "size", F.size("tags").alias("n_tags")).union(bad.select("uuid", F.lit(-1), F.lit(-1)))


KEYED = "SELECT c_custkey::VARCHAR AS uuid, c_nationkey::INT AS size, 0 AS n_tags FROM customer UNION ALL SELECT 'x' || c_custkey::VARCHAR, 7, NULL FROM customer"


def quarantine(spark: SparkSession, d: str) -> DataFrame:
    rows = run(spark, d, "SELECT event_id, CASE event_type WHEN 'error' THEN replace(props, ':', '') WHEN 'signup' THEN replace(props, ': ', ': \"a') ELSE props END AS record FROM {events}")
    good, bad = io.records(rows, "k int")
    return good.select("event_id", "k", F.lit(False).alias("is_error")).union(bad.select("event_id", F.lit(None), F.lit(True)))


QUARANTINE = "SELECT event_id, CASE WHEN event_type NOT IN ('error', 'signup') THEN json_extract(props, '$.k')::INT END AS k, event_type IN ('error', 'signup') AS is_error FROM events"


def serialised(spark: SparkSession, d: str) -> DataFrame:
    rows = run(spark, d, "SELECT p_partkey, split(p_name, ' ') AS words, p_size FROM {part}").withColumn("item", F.struct("p_size"))
    return io.serialised(rows)


SERIALISED = """SELECT p_partkey, '["' || replace(p_name, ' ', '","') || '"]' AS words, p_size, '{"p_size":' || p_size || '}' AS item FROM part"""


def _table(spark: SparkSession) -> str:
    return io.scratch(spark, "sink")


def upserted(spark: SparkSession, d: str) -> DataFrame:
    path, rows = _table(spark), run(spark, d, "SELECT c_custkey, c_name, c_acctbal FROM {customer}")
    io.overwrite(rows, path)
    io.upsert(run(spark, d, "SELECT s_suppkey AS c_custkey, s_acctbal AS c_acctbal, s_name AS other FROM {supplier}"), path, ["c_custkey"])
    io.upsert(rows.where("false"), path, ["c_custkey"])  # changes nothing
    return spark.read.parquet(path)


UPSERTED = "SELECT COALESCE(s_suppkey, c_custkey) AS c_custkey, CASE WHEN s_suppkey IS NULL THEN c_name END AS c_name, COALESCE(s_acctbal, c_acctbal) AS c_acctbal, s_name AS other FROM customer FULL OUTER JOIN supplier ON s_suppkey = c_custkey"


def appended(spark: SparkSession, d: str) -> DataFrame:
    path, rows = _table(spark), feed(spark, d, "prices_in").select("uuid", "snapshot_date", "eur")
    first = rows.where("snapshot_date <= DATE '2024-01-20'")
    io.append(first, path, ["uuid", "snapshot_date"])
    io.append(rows.where("snapshot_date >= DATE '2024-01-18'").withColumn("eur", F.lit(-1.0)), path, ["uuid", "snapshot_date"])
    return spark.read.parquet(path)


APPENDED = "SELECT uuid, snapshot_date, CASE WHEN snapshot_date <= DATE '2024-01-20' THEN eur ELSE -1.0 END AS eur FROM prices_in"


def kept_when_empty(spark: SparkSession, d: str) -> DataFrame:
    path, rows = _table(spark), run(spark, d, "SELECT s_suppkey, s_name FROM {supplier}")
    io.overwrite(rows, path)
    io.overwrite(rows.where("s_suppkey < 0"), path)
    return spark.read.parquet(path)


def replaced_run(spark: SparkSession, d: str) -> DataFrame:
    path, rows = _table(spark), feed(spark, d, "prices_in").select("uuid", F.col("eur").alias("predicted_eur"))
    one = rows.where("predicted_eur IS NOT NULL").groupBy("uuid").agg(F.max("predicted_eur").alias("predicted_eur"))
    for run_id, day, scale in (("a", "2024-01-20", 1), ("b", "2024-01-20", 2), ("a", "2024-01-20", 3), ("a", "2024-01-21", 4)):
        io.save_predictions(one.withColumn("predicted_eur", F.col("predicted_eur") * scale), path, run_id, day)
    return spark.read.parquet(path).drop("created_at")


REPLACED = "SELECT uuid, d AS snapshot_date, m * k AS predicted_eur, r AS model_run_id FROM (SELECT uuid, MAX(eur) AS m FROM prices_in WHERE eur IS NOT NULL GROUP BY uuid) CROSS JOIN (VALUES ('a', DATE '2024-01-20', 3), ('b', DATE '2024-01-20', 2), ('a', DATE '2024-01-21', 4)) v(r, d, k)"


def across_layers(spark: SparkSession, d: str) -> DataFrame:
    """Tables of two layers in one query with positional arguments; one table is an orphan and goes first."""
    base = _table(spark)
    store = Store(spark, {"silver": f"{base}/silver", "gold": f"{base}/gold"})
    io.overwrite(run(spark, d, "SELECT * FROM {customer}"), store.path("silver", "silver_people"))
    io.overwrite(run(spark, d, "SELECT * FROM {nation}"), store.path("gold", "gold_nations"))
    io.overwrite(run(spark, d, "SELECT * FROM {region}"), store.path("gold", "gold_orphan"))
    store.drop_orphans("gold", ["gold_nations"], "gold_", ["gold_predictions"])
    listed = spark.createDataFrame([(",".join(store.tables("gold")),)], "tables string")
    return store.query("SELECT n_name, COUNT(*) AS n FROM silver_people JOIN gold_nations ON c_nationkey = n_nationkey WHERE c_acctbal BETWEEN ? AND ? GROUP BY n_name", [0.0, 5000.0]).crossJoin(listed)


ACROSS = "SELECT n_name, COUNT(*) AS n, 'gold_nations' AS tables FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal BETWEEN 0 AND 5000 GROUP BY n_name"

# ---------------------------------------------------------------- statistics and monitoring


def drift(spark: SparkSession, d: str) -> DataFrame:
    prices = feed(spark, d, "prices_in")
    return _rounded(monitor.drift(*(monitor.period(prices, *p) for p in PERIODS)), 6, "ks", "js", "p_value")


DRIFT = f"""WITH a AS (SELECT eur AS v FROM prices_in WHERE eur IS NOT NULL AND snapshot_date BETWEEN DATE '{PERIODS[0][0]}' AND DATE '{PERIODS[0][1]}'), b AS (SELECT eur AS v FROM prices_in WHERE eur IS NOT NULL AND snapshot_date BETWEEN DATE '{PERIODS[1][0]}' AND DATE '{PERIODS[1][1]}'),
n AS (SELECT (SELECT COUNT(*) FROM a)::DOUBLE AS na, (SELECT COUNT(*) FROM b)::DOUBLE AS nb),
ab AS (SELECT v, 1 AS r FROM a UNION ALL SELECT v, 0 FROM b),
e AS (SELECT v, SUM(SUM(r)) OVER (ORDER BY v) AS ca, SUM(SUM(1 - r)) OVER (ORDER BY v) AS cb FROM ab GROUP BY v),
t AS (SELECT 'eur' AS c, v, r FROM ab UNION ALL SELECT 'log_eur', ln(1 + v), r FROM ab),
sp AS (SELECT c, MIN(v) AS lo, MAX(v) AS hi FROM t GROUP BY c),
h AS (SELECT c, LEAST(floor((v - lo) / ((hi - lo) / 10)), 9) AS bin, SUM(r) / MAX(na) AS p, SUM(1 - r) / MAX(nb) AS q FROM t JOIN sp USING (c) CROSS JOIN n GROUP BY ALL),
j AS (SELECT c, sqrt(SUM(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2) AS js FROM h GROUP BY c),
k AS (SELECT MAX(ABS(ca / na - cb / nb)) AS ks FROM e CROSS JOIN n),
x AS (SELECT c, na, nb, ks, js, ks * (sqrt(na * nb / (na + nb)) + 0.12 + 0.11 / sqrt(na * nb / (na + nb))) AS x FROM j CROSS JOIN k CROSS JOIN n),
y AS (SELECT *, CASE WHEN x < 0.2 THEN 1.0 ELSE LEAST(1.0, GREATEST(0.0, list_sum([2 * (CASE WHEN i % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0 * i * i * x * x) for i in range(1, 30)]))) END AS p FROM x)
SELECT c AS column, na::BIGINT AS n_reference, nb::BIGINT AS n_current, ROUND(ks, 6) AS ks, ROUND(p, 6) AS p_value, ROUND(js, 6) AS js, CASE WHEN LEAST(na, nb) <= 1000 THEN p < 0.05 ELSE js >= 0.1 END AS drifted FROM y"""


def ks_drift(spark: SparkSession, d: str) -> DataFrame:
    prices = feed(spark, d, "prices_in")
    early, late = (monitor.period(prices, *p) for p in PERIODS)
    return monitor.ks(early, late, "eur").select(F.round("ks", 7).alias("ks"))


KS = f"""WITH a AS (SELECT eur AS v, snapshot_date <= DATE '{PERIODS[0][1]}' AS early FROM prices_in WHERE eur IS NOT NULL), c AS (SELECT v, SUM(COUNT(*) FILTER (early)) OVER (ORDER BY v) AS x, SUM(COUNT(*) FILTER (NOT early)) OVER (ORDER BY v) AS y FROM a GROUP BY v)
SELECT ROUND(MAX(ABS(x / (SELECT COUNT(*) FROM a WHERE early)::DOUBLE - y / (SELECT COUNT(*) FROM a WHERE NOT early)::DOUBLE)), 7) AS ks FROM c"""


def health(spark: SparkSession, d: str) -> DataFrame:
    cards = merged(spark, d)
    prices = feed(spark, d, "prices_in")
    tables = {
        "bronze_scryfall_cards": feed(spark, d, "prints_in"), "bronze_mtgjson_cards": feed(spark, d, "cards_in"), "bronze_mtgjson_prices_history": feed(spark, d, "points_in"), "silver_cards": cards, "silver_prices_history": prices,
        "silver_language_prices_history": feed(spark, d, "scalar_in"), "silver_meta_history": feed(spark, d, "meta_in"), "silver_format_staples_history": feed(spark, d, "staples_in"), "silver_tournament_results_history": feed(spark, d, "results_in"), "gold_price_features": prices,
    }
    return monitor.health(spark, tables.get, DAY).select("name", "layer", "status")


HEALTH = f"""{MERGED},
v AS (SELECT 'silver_cards.' || c || ' nulls' AS name, 'silver' AS layer, CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM (SELECT unnest(['name', 'set_code', 'collector_number']) AS c, unnest([COUNT(*) FILTER (name IS NULL), COUNT(*) FILTER (set_code IS NULL), COUNT(*) FILTER (collector_number IS NULL)]) AS n FROM merged)),
combos AS (SELECT DISTINCT retailer || '/' || tx_type || '/' || finish AS c FROM points_in WHERE snapshot_date = DATE '{DAY}'), known AS (SELECT unnest([{', '.join("'" + '/'.join(c) + "'" for c in silver.POINT_PRICES.values())}]) AS c),
odd AS (SELECT DISTINCT 'new' AS k FROM combos WHERE c NOT IN (SELECT c FROM known) UNION ALL SELECT DISTINCT 'missing' FROM known WHERE c NOT IN (SELECT c FROM combos))
SELECT unnest(['bronze_scryfall_cards rows', 'bronze_mtgjson_cards rows', 'bronze_mtgjson_prices_history rows']) AS name, 'bronze' AS layer, 'PASS' AS status
UNION ALL SELECT unnest(['silver_cards rows', 'silver_prices_history rows', 'silver_language_prices_history rows', 'silver_meta_history rows', 'silver_format_staples_history rows', 'silver_tournament_results_history rows', 'silver_prices_history freshness', 'silver_language_prices_history freshness', 'silver_format_staples_history freshness', 'silver_prices_history EUR <= 0', 'silver_cards duplicate canonical_uuid']), 'silver', 'PASS'
UNION ALL SELECT unnest(['gold_card_features exists', 'gold_language_premiums exists', 'gold_demand_signals exists', 'gold_format_staples exists', 'gold_tournament_signals exists', 'gold_ml_dataset exists']), 'gold', 'FAIL' UNION ALL SELECT 'gold_price_features rows', 'gold', 'PASS'
UNION ALL SELECT * FROM v
UNION ALL SELECT 'silver_cards oracle_id conflicts', 'silver', CASE WHEN COUNT(*) <= 20 THEN 'PASS' ELSE 'FAIL' END FROM (SELECT name FROM merged WHERE oracle_id IS NOT NULL GROUP BY name HAVING COUNT(DISTINCT oracle_id) > 1) z
UNION ALL SELECT 'bronze mtgjson price schema drift', 'bronze', 'WARN' FROM odd UNION ALL SELECT 'bronze mtgjson price schema drift', 'bronze', 'PASS' WHERE NOT EXISTS (SELECT 1 FROM odd)"""


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return run(spark, d, "SELECT p_partkey, p_size, p_retailprice, length(p_name) AS letters FROM {part}")


_RANKS = "WITH r AS (SELECT rank() OVER (ORDER BY p_size) + (COUNT(*) OVER (PARTITION BY p_size) - 1) / 2.0::DOUBLE AS x, rank() OVER (ORDER BY p_retailprice) + (COUNT(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0::DOUBLE AS y, rank() OVER (ORDER BY length(p_name)) + (COUNT(*) OVER (PARTITION BY length(p_name)) - 1) / 2.0::DOUBLE AS z FROM part)"


def spearman(spark: SparkSession, d: str) -> DataFrame:
    return stats.spearman(_parts(spark, d), "p_size", "p_retailprice").select(F.round("rho", 7).alias("rho"))


def partial_spearman(spark: SparkSession, d: str) -> DataFrame:
    return stats.partial_spearman(_parts(spark, d), "p_size", "p_retailprice", "letters").select("n", F.round("rho", 7).alias("rho"))


PARTIAL = _RANKS + ", f AS (SELECT regr_slope(x, z) AS a, regr_intercept(x, z) AS b, regr_slope(y, z) AS c, regr_intercept(y, z) AS e FROM r) SELECT COUNT(*) AS n, ROUND(corr(x - a * z - b, y - c * z - e), 7) AS rho FROM r CROSS JOIN f"


def _one(spark: SparkSession, found: dict, places: int, **names: str) -> DataFrame:
    return spark.createDataFrame([tuple(round(float(found[k]), places) for k in names.values())], ", ".join(f"{n} double" for n in names))


def kruskal(spark: SparkSession, d: str) -> DataFrame:
    return _one(spark, stats.kruskal_wallis(run(spark, d, "SELECT * FROM {customer}"), "c_nationkey", "c_mktsegment"), 6, h="h", epsilon_squared="epsilon_squared")


KRUSKAL = """WITH r AS (SELECT c_mktsegment AS g, c_nationkey AS v, rank() OVER (ORDER BY c_nationkey) + (COUNT(*) OVER (PARTITION BY c_nationkey) - 1) / 2.0::DOUBLE AS r FROM customer), s AS (SELECT SUM(r) AS s, COUNT(*)::DOUBLE AS n FROM r GROUP BY g),
t AS (SELECT SUM(c * c * c - c) AS t FROM (SELECT COUNT(*)::DOUBLE AS c FROM r GROUP BY v)), a AS (SELECT SUM(n) AS n, COUNT(*) AS k, SUM(s * s / n) AS q FROM s), h AS (SELECT n, k, (12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - t / (n * n * n - n)) AS h FROM a CROSS JOIN t)
SELECT ROUND(h, 6) AS h, ROUND(GREATEST((h - k + 1) / (n - k), 0.0), 6) AS epsilon_squared FROM h"""


def mann_whitney(spark: SparkSession, d: str) -> DataFrame:
    rows = run(spark, d, "SELECT c_nationkey, c_acctbal > 0 AS rich FROM {customer}")
    return _one(spark, stats.mann_whitney(rows, "c_nationkey", "rich"), 6, u="u", rank_biserial="rank_biserial")


MANN_WHITNEY = "WITH u AS (SELECT SUM(CASE WHEN a.c_nationkey > b.c_nationkey THEN 1.0 WHEN a.c_nationkey = b.c_nationkey THEN 0.5 ELSE 0 END)::DOUBLE AS u, COUNT(*)::DOUBLE AS n FROM customer a JOIN customer b ON a.c_acctbal > 0 AND NOT b.c_acctbal > 0) SELECT ROUND(u, 6) AS u, ROUND(2 * u / n - 1, 6) AS rank_biserial FROM u"


def levene(spark: SparkSession, d: str) -> DataFrame:
    return _one(spark, stats.levene(run(spark, d, "SELECT * FROM {customer}"), "c_acctbal", "c_mktsegment"), 6, w="w")


LEVENE = """WITH m AS (SELECT c_mktsegment AS g, quantile_cont(c_acctbal, 0.5) AS m FROM customer GROUP BY ALL), d AS (SELECT g, ABS(c_acctbal - m) AS d FROM customer JOIN m ON g = c_mktsegment), a AS (SELECT g, COUNT(*)::DOUBLE AS n, AVG(d) AS m, var_pop(d) AS v FROM d GROUP BY g),
t AS (SELECT SUM(n) AS n, COUNT(*) AS k, SUM(n * m) / SUM(n) AS m, SUM(n * v) AS w FROM a) SELECT ROUND((ANY_VALUE(t.n) - ANY_VALUE(k)) / (ANY_VALUE(k) - 1) * SUM(a.n * (a.m - t.m) * (a.m - t.m)) / ANY_VALUE(w), 6) AS w FROM a CROSS JOIN t"""


def mutual_information(spark: SparkSession, d: str) -> DataFrame:
    return stats.mutual_information(run(spark, d, "SELECT o_totalprice, o_custkey FROM {orders}"), "o_totalprice", "o_custkey").select(F.round("mi", 7).alias("mi"))


MUTUAL = """WITH r AS (SELECT rank() OVER (ORDER BY o_totalprice) + (COUNT(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0::DOUBLE AS x, rank() OVER (ORDER BY o_custkey) + (COUNT(*) OVER (PARTITION BY o_custkey) - 1) / 2.0::DOUBLE AS y, COUNT(*) OVER () AS n FROM orders),
c AS (SELECT floor((x - 0.5) * 10 / n) AS i, floor((y - 0.5) * 10 / n) AS j, COUNT(*)::DOUBLE AS c FROM r GROUP BY ALL), m AS (SELECT c, SUM(c) OVER (PARTITION BY i) AS a, SUM(c) OVER (PARTITION BY j) AS b, SUM(c) OVER () AS n FROM c) SELECT ROUND(SUM(c / n * ln(c * n / (a * b))), 7) AS mi FROM m"""


def inflation(spark: SparkSession, d: str) -> DataFrame:
    found = stats.variance_inflation(run(spark, d, "SELECT l_quantity, l_extendedprice FROM {lineitem}"), ["l_quantity", "l_extendedprice"])
    return spark.createDataFrame([(c, round(v, 6)) for c, v in found.items()], "column string, vif double")


INFLATION = "SELECT unnest(['l_quantity', 'l_extendedprice']) AS column, ROUND(1 / (1 - corr(l_quantity, l_extendedprice) ** 2), 6) AS vif FROM lineitem"


def wilcoxon(spark: SparkSession, d: str) -> DataFrame:
    return _one(spark, stats.wilcoxon(run(spark, d, "SELECT CAST(l_quantity AS INT) AS q, 26 + CAST(l_discount * 100 AS INT) AS t FROM {lineitem}"), "q", "t"), 3, w="w", n="n")


WILCOXON = """WITH d AS (SELECT CAST(l_quantity AS INT) - 26 - CAST(l_discount * 100 AS INT) AS d FROM lineitem), r AS (SELECT d, rank() OVER (ORDER BY ABS(d)) + (COUNT(*) OVER (PARTITION BY ABS(d)) - 1) / 2.0::DOUBLE AS r FROM d WHERE d <> 0)
SELECT ROUND(LEAST(SUM(r) FILTER (d > 0), SUM(r) FILTER (d < 0)), 3) AS w, COUNT(*)::DOUBLE AS n FROM r"""


def deciles(spark: SparkSession, d: str) -> DataFrame:
    """The median of a tile is that of its middle rows, which their numbers tell."""
    orders = run(spark, d, "SELECT o_totalprice, o_orderkey FROM {orders}")
    rows = ranking.tiles(orders, "o_totalprice", ["o_orderkey"], 10, "decile")
    return rows.groupBy("decile").agg(F.count(F.lit(1)).alias("n")).join(ranking.percentiles(rows, "o_totalprice", {"median": 0.5}, ["decile"]), "decile")


def percentiles(spark: SparkSession, d: str) -> DataFrame:
    return ranking.percentiles(run(spark, d, "SELECT l_returnflag, l_extendedprice FROM {lineitem}"), "l_extendedprice", {"p50": 0.5, "p95": 0.95}, ["l_returnflag"])


def pareto(spark: SparkSession, d: str) -> DataFrame:
    orders = run(spark, d, "SELECT o_totalprice, o_orderkey FROM {orders}")
    top = ranking.numbered(orders, "o_totalprice", ["o_orderkey"], "r", descending=True).where(F.col("r") <= orders.count() * 0.05)
    x, y = F.log("o_totalprice"), F.log("r")
    return top.agg(F.round(F.regr_slope(y, x), 5).alias("slope"), F.round(F.regr_r2(y, x), 6).alias("r2"), F.count(F.lit(1)).alias("k"))


def bootstrap(spark: SparkSession, d: str) -> DataFrame:
    rho, low, high = stats.bootstrap_spearman(_parts(spark, d), "p_size", "letters", "p_partkey")
    return spark.createDataFrame([(rho, low, high)], "rho double, low double, high double")


def stationarity(spark: SparkSession, d: str) -> DataFrame:
    return stats.stationarity(feed(spark, d, "prices_in"))


def structural(spark: SparkSession, d: str) -> DataFrame:
    return stats.structural_breaks(feed(spark, d, "prices_in")).withColumn("at", F.array_join(F.col("at").cast("array<string>"), ","))


def anderson(spark: SparkSession, d: str) -> DataFrame:
    found = stats.anderson(run(spark, d, "SELECT c_acctbal, c_custkey FROM {customer}"), "c_acctbal", "c_custkey")
    return spark.createDataFrame([(found["a2"], found["n"])], "a2 double, n long")


def walk_forward(spark: SparkSession, d: str) -> DataFrame:
    """The history has 30 days, so its windows are shorter than the default ones."""
    prices, cards = gold.price_features(feed(spark, d, "prices_in")), gold.card_features(merged(spark, d))
    days = [r[0] for r in prices.select("snapshot_date").distinct().collect()]
    windows = ml.folds(days, train_days=9, val_days=7, step=5)
    models = {"naive": ml.naive, "mean": ml.mean_return, "reversion": ml.reversion, "autoregression": ml.autoregression}
    return _rounded(ml.walk_forward(prices, cards, models, windows), 6, "mae", "mape")


def inference(spark: SparkSession, d: str) -> DataFrame:
    prices = gold.price_features(feed(spark, d, "prices_in"), feed(spark, d, "meta_in"))
    out = ml.inference_features(prices, gold.card_features(merged(spark, d)), DAY)
    return _rounded(out.select("uuid", "eur", "lag_1d", "lag_7d", "log_eur", "rolling_mean_7d", "lag_1d_return", "rarity_ord", "is_legendary", "top8_appearances_30d", "has_mtgjson_data", "format_count", "is_promo"), 7, "log_eur", "rolling_mean_7d", "lag_1d_return")


INFERENCE = f"""{MERGED}, p AS (SELECT *, row_number() OVER (PARTITION BY uuid ORDER BY snapshot_date) AS n FROM prices_in)
SELECT p.uuid, p.eur, a.eur AS lag_1d, b.eur AS lag_7d, ROUND(ln(1 + p.eur), 7) AS log_eur, ROUND(ln(1 + (SELECT AVG(q.eur) FROM p q WHERE q.uuid = p.uuid AND q.n BETWEEN p.n - 6 AND p.n)), 7) AS rolling_mean_7d, ROUND((p.eur - a.eur) / NULLIF(a.eur, 0), 7) AS lag_1d_return,
  NULL::DOUBLE AS rarity_ord, (m.original_supertypes = 'Legendary')::INT::DOUBLE AS is_legendary, 0.0::DOUBLE AS top8_appearances_30d, 1.0::DOUBLE AS has_mtgjson_data, m.format_count, m.is_promo
FROM p JOIN merged m ON m.uuid = p.uuid LEFT JOIN p a ON a.uuid = p.uuid AND a.n = p.n - 1 LEFT JOIN p b ON b.uuid = p.uuid AND b.n = p.n - 7 WHERE p.snapshot_date = DATE '{DAY}'"""


def text_and_static(spark: SparkSession, d: str) -> DataFrame:
    """The text's weights of the most frequent terms beside the text's length; shown is each vector's length and sum."""
    docs = run(spark, d, "SELECT doc_id, text, n_chars FROM {documents}")
    out = ml.text_beside(docs, "doc_id", "text", ["n_chars"], terms=50)
    return out.select("doc_id", F.size("vector").alias("n"), F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


def reasons(spark: SparkSession, d: str) -> DataFrame:
    """Confidence in sixteenths, so that no rounding is in doubt."""
    rows = run(spark, d, "SELECT c_custkey, 1.0D + c_nationkey / 16.0D AS confidence FROM {customer}")
    return rows.select("c_custkey", expr.reason(F.col("confidence")).alias("reason"))


REASONS = "SELECT c_custkey, 'ML predicts +' || printf('%.0f', c_nationkey / 16.0::DOUBLE * 100) || '% in 7d' AS reason FROM customer"


def listing(spark: SparkSession, d: str) -> DataFrame:
    return ml.list_entities(merged(spark, d))


def codes(spark: SparkSession, d: str) -> DataFrame:
    names = [*expr.LANGUAGES, "xx"]
    rows = run(spark, d, "SELECT doc_id, lang FROM {documents}").withColumn("code", F.coalesce(F.element_at(F.array(*map(F.lit, names)), (F.pmod("doc_id", F.lit(len(names))) + 1).cast("int")), "lang"))
    return rows.select("doc_id", expr.lookup(F.col("lang"), expr.LANGUAGES).alias("language"), expr.lookup(F.col("code"), expr.LANGUAGES).alias("other"))


CODES = """WITH c AS (SELECT * FROM (VALUES (0, 'en', 'English'), (1, 'es', 'Spanish'), (2, 'fr', 'French'), (3, 'de', 'German'), (4, 'it', 'Italian'), (5, 'pt', 'Portuguese'), (6, 'ja', 'Japanese'), (7, 'ko', 'Korean'), (8, 'ru', 'Russian'), (9, 'zhs', 'Chinese Simplified'), (10, 'zht', 'Chinese Traditional'),
  (11, 'he', 'Hebrew'), (12, 'la', 'Latin'), (13, 'grc', 'Ancient Greek'), (14, 'ar', 'Arabic'), (15, 'sa', 'Sanskrit'), (16, 'ph', 'Phyrexian'), (17, 'qya', 'Quenya'), (18, 'xx', 'xx')) v(i, code, name))
SELECT doc_id, COALESCE((SELECT name FROM c WHERE code = lang), lang) AS language, (SELECT name FROM c WHERE i = doc_id % 19) AS other FROM documents"""


def format_dates(spark: SparkSession, d: str) -> DataFrame:
    """Each order's date in one of four formats; the first two are ambiguous up to the 12th, as they are tried in turn."""
    patterns = ["dd/MM/yy", "MM/dd/yy", "MMM dd yy", "dd MMM yy"]
    day = F.to_date("o_orderdate")
    text = F.element_at(F.array(*[F.date_format(day, p) for p in patterns]), (F.pmod("o_orderkey", F.lit(4)) + 1).cast("int"))
    return run(spark, d, "SELECT o_orderkey, o_orderdate FROM {orders}").select("o_orderkey", expr.any_date(text).alias("d"))


FORMAT_DATES = """WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS d, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%d/%m/%y') WHEN 1 THEN strftime(o_orderdate, '%m/%d/%y') END AS t FROM orders)
SELECT o_orderkey, CASE WHEN t IS NULL THEN d ELSE COALESCE(try_strptime(t, '%d/%m/%y'), try_strptime(t, '%m/%d/%y'))::DATE END AS d FROM o"""


def json_lists(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("p_size") < 5, None).otherwise(F.concat(F.lit('["'), "p_type", F.lit('","x '), "p_name", F.lit('"]')))
    rows = run(spark, d, "SELECT * FROM {part}").withColumn("t", text)
    return rows.select("p_partkey", F.array_join(expr.json_list(F.col("t"), F.lower), "|").alias("items"), F.size(expr.json_list(F.col("t"))).alias("n"))


JSON_LISTS = "SELECT p_partkey, CASE WHEN p_size < 5 THEN '' ELSE lower(p_type || '|x ' || p_name) END AS items, CASE WHEN p_size < 5 THEN 0 ELSE 2 END AS n FROM part"


def counted_formats(spark: SparkSession, d: str) -> DataFrame:
    names = silver.COUNTED_FORMATS
    entry = lambda i, n: F.concat(F.lit(f'"{n}":"'), F.when(F.pmod(F.col("p_partkey") + F.col("p_size") * i, F.lit(3)) == 0, "Legal").otherwise("banned"), F.lit('"'))
    rows = run(spark, d, "SELECT p_partkey, p_size FROM {part}").withColumn("legalities", F.concat(F.lit("{"), F.concat_ws(",", *[entry(i, n) for i, n in enumerate(names)]), F.lit("}")))
    return rows.select("p_partkey", sum((F.coalesce(silver.legal(n).cast("int"), F.lit(0)) for n in names), F.lit(0)).alias("format_count"))


COUNTED = "SELECT p_partkey, list_sum([CASE WHEN (p_partkey + p_size * i) % 3 = 0 THEN 1 ELSE 0 END for i in range(20)])::INT AS format_count FROM part"


def without(spark: SparkSession, d: str) -> DataFrame:
    return run(spark, d, "SELECT * EXCEPT (o_orderdate) FROM {orders}")


def missing_column(spark: SparkSession, d: str) -> DataFrame:
    rows = gold.with_columns(run(spark, d, "SELECT * FROM {supplier}"), {"s_comment": "string", "s_name": "int"})
    return rows.select("s_suppkey", "s_name", "s_comment")


def sorted_confidence(spark: SparkSession, d: str) -> DataFrame:
    rows = run(spark, d, "SELECT CAST(user_id AS STRING) AS uuid, MAX(value) AS eur, MAX(value) * (1 + CAST(user_id % 7 AS DOUBLE) / 4) AS predicted_eur FROM {events} GROUP BY user_id")
    return ml.underpriced_listing(rows, least=1.5).select("uuid", "tier", "confidence")


SORTED = "WITH r AS (SELECT user_id::VARCHAR AS uuid, MAX(value) AS eur, MAX(value) * (1 + CAST(user_id % 7 AS DOUBLE) / 4) AS p FROM events GROUP BY user_id) SELECT uuid, CASE WHEN eur >= 100 THEN 2 ELSE 1 END AS tier, p / GREATEST(eur, 0.01) AS confidence FROM r WHERE eur < 1000 AND p / GREATEST(eur, 0.01) > 1.3 AND p / GREATEST(eur, 0.01) >= 1.5"


def latest(spark: SparkSession, d: str) -> DataFrame:
    return monitor.latest(feed(spark, d, "prices_in"))


LATEST = "SELECT MAX(snapshot_date) AS latest, (SELECT MAX(a.snapshot_date) FROM prices_in a JOIN prices_in b ON b.snapshot_date = a.snapshot_date + INTERVAL 7 DAY) AS trainable FROM prices_in"

_MERGED_FEEDS = ("cards_in", "prints_in")
#: name: (query, DuckDB SQL or None)
TIERS: dict[str, tuple[Callable, str | None]] = {
    "jn01_silver_cards": (silver_cards, duck(f"{MERGED} SELECT {', '.join(SHOWN)}, {', '.join(LISTED)} FROM merged", *_MERGED_FEEDS)),
    "jn06_silver_prices": (silver_prices, duck(SILVER_PRICES, *_MERGED_FEEDS, "scalar_in", "points_in")),
    "jn08_language_prices": (language_prices, duck(f"{LANGUAGE_PRICES} SELECT * FROM variants", *_MERGED_FEEDS, "scalar_in")),
    "jn03_null_aware_anti": (_exclude, "SELECT c_custkey FROM customer WHERE CASE WHEN c_nationkey = 3 THEN NULL ELSE c_nationkey END NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000)"),
    "jn21_semi_and_anti": (_semi_and_anti, "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)"),
    "wn01_price_features": (price_features, duck(PRICE_FEATURES, "prices_in", "meta_in")),
    "ag10_card_features": (card_features, duck(CARD_FEATURES, *_MERGED_FEEDS)),
    "jn10_language_premiums": (language_premiums, duck(LANGUAGE_PREMIUMS, *_MERGED_FEEDS, "scalar_in", "prices_in")),
    "wn11_demand_signals": (demand_signals, duck(DEMAND_SIGNALS, "meta_in")),
    "wn12_events_builder": (events, duck(EVENTS, "meta_in")),
    "ag16_ban_price_impact": (impact, duck(IMPACT, "meta_in", "prices_in")),
    "ag04_tournament_signals": (tournament_signals, duck(TOURNAMENTS, "results_in")),
    "wn13_staples_builder": (staples, duck(STAPLED, "staples_in")),
    "jn15_ml_dataset": (dataset, duck(DATASET, *_MERGED_FEEDS, "prices_in", "meta_in", "results_in", "staples_in")),
    "src12_price_walk": (price_walk, WALK),
    "src13_asof_latest": (asof_latest, ASOF),
    "src14_historical_seed": (seed, SEED),
    "src02_quarantine": (quarantine, QUARANTINE),
    "src03_set_cards": (set_cards, SET_CARDS),
    "src04_keyed_records": (keyed_records, KEYED),
    "src17_serialised": (serialised, SERIALISED),
    "src19_across_layers": (across_layers, ACROSS),
    "snk01_kept_when_empty": (kept_when_empty, "SELECT s_suppkey, s_name FROM supplier"),
    "snk02_upsert": (upserted, UPSERTED),
    "snk03_append_anti": (appended, duck(APPENDED, "prices_in")),
    "snk04_replace_run": (replaced_run, duck(REPLACED, "prices_in")),
    "prj02_exclude": (without, "SELECT * EXCLUDE (o_orderdate) FROM orders"),
    "prj07_missing_column": (missing_column, "SELECT s_suppkey, s_name, NULL::VARCHAR AS s_comment FROM supplier"),
    "prj09_code_names": (codes, CODES),
    "so04_by_confidence": (sorted_confidence, SORTED),
    "so06_list_entities": (listing, duck(f"{MERGED} SELECT uuid, name, set_code FROM merged WHERE uuid IS NOT NULL AND name IS NOT NULL", *_MERGED_FEEDS)),
    "str10_reason": (reasons, REASONS),
    "dat08_date_formats": (format_dates, FORMAT_DATES),
    "arr01_json_list": (json_lists, JSON_LISTS),
    "jsn03_count_keys": (counted_formats, COUNTED),
    "ag21_percentiles": (percentiles, "SELECT l_returnflag, quantile_cont(l_extendedprice, 0.5) AS p50, quantile_cont(l_extendedprice, 0.95) AS p95 FROM lineitem GROUP BY l_returnflag"),
    "ag26_decile_medians": (deciles, "SELECT decile, COUNT(*) AS n, quantile_cont(o_totalprice, 0.5) AS median FROM (SELECT o_totalprice, ntile(10) OVER (ORDER BY o_totalprice, o_orderkey)::INT AS decile FROM orders) GROUP BY decile"),
    "ml08_inference_features": (inference, duck(INFERENCE, *_MERGED_FEEDS, "prices_in")),
    "ml10_walk_forward": (walk_forward, None),
    "ml22_text_and_static": (text_and_static, None),
    "mon05_drift_ks": (ks_drift, duck(KS, "prices_in")),
    "mon05_drift": (drift, duck(DRIFT, "prices_in")),
    "mon08_health": (health, duck(HEALTH, *_MERGED_FEEDS, "points_in")),
    "mon09_latest": (latest, duck(LATEST, "prices_in")),
    "sta01_spearman": (spearman, _RANKS + " SELECT ROUND(corr(x, y), 7) AS rho FROM r"),
    "sta01_partial_spearman": (partial_spearman, PARTIAL),
    "sta02_kruskal_wallis": (kruskal, KRUSKAL),
    "sta02_mann_whitney": (mann_whitney, MANN_WHITNEY),
    "sta03_levene": (levene, LEVENE),
    "sta03_wilcoxon": (wilcoxon, WILCOXON),
    "sta03_anderson": (anderson, None),
    "sta04_bootstrap_spearman": (bootstrap, None),
    "sta06_mutual_information": (mutual_information, MUTUAL),
    "sta06_variance_inflation": (inflation, INFLATION),
    "sta07_stationarity": (stationarity, None),
    "sta10_pareto_tail": (pareto, "WITH r AS (SELECT o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS r, COUNT(*) OVER () AS n FROM orders) SELECT ROUND(regr_slope(LN(r), LN(o_totalprice)), 5) AS slope, ROUND(regr_r2(LN(r), LN(o_totalprice)), 6) AS r2, COUNT(*) AS k FROM r WHERE r <= n * 0.05"),
    "sta11_structural_breaks": (structural, None),
}
