"""Relational, scalar, window and statistics operators as SQL over the analogue relations.

prices: daily mean value of each user, as price history (uuid, snapshot_date, eur); status: each user's last event type of a day, as
legality history; long: order totals by priority and day, dense enough for thirty-day targets; series: daily means of each event type, a
group small enough for its pairs.
"""

PRICES = """prices AS (
  SELECT CAST(user_id AS STRING) AS uuid, CAST(ts AS DATE) AS snapshot_date,
    CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*) AS eur, COUNT(*) AS n
  FROM {events} GROUP BY CAST(user_id AS STRING), CAST(ts AS DATE))"""
STATUS = """status AS (
  SELECT uuid, snapshot_date, status FROM (
    SELECT CAST(user_id AS STRING) AS uuid, CAST(ts AS DATE) AS snapshot_date, event_type AS status,
      row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) AS r FROM {events}) x WHERE r = 1)"""
LONG = """long AS (
  SELECT o_orderpriority AS uuid, CAST(o_orderdate AS DATE) AS snapshot_date, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS eur
  FROM {orders} GROUP BY o_orderpriority, CAST(o_orderdate AS DATE))"""
EAV = """eav AS (
  SELECT CAST(user_id AS STRING) AS uuid, CAST(ts AS DATE) AS snapshot_date, event_type AS finish, MAX(value) AS price
  FROM {events} GROUP BY CAST(user_id AS STRING), CAST(ts AS DATE), event_type)"""
SERIES = """series AS (
  SELECT event_type AS uuid, CAST(ts AS DATE) AS snapshot_date, CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*) AS eur
  FROM {events} GROUP BY event_type, CAST(ts AS DATE))"""
EVENTS = f"""{STATUS},
lagged AS (SELECT *, lag(status) OVER (PARTITION BY uuid ORDER BY snapshot_date) AS prev FROM status),
transitions AS (
  SELECT uuid, snapshot_date AS event_date, CASE WHEN status = 'error' THEN 'ban' ELSE 'unban' END AS event_type FROM lagged
  WHERE (prev = 'view' AND status = 'error') OR (prev = 'error' AND status = 'view'))"""
PREDICTED = f"""{PRICES},
predictions AS (
  SELECT uuid, snapshot_date, AVG(eur) OVER (PARTITION BY uuid ORDER BY snapshot_date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS predicted_eur, eur FROM prices),
scored AS (SELECT p.*, a.eur AS actual FROM predictions p JOIN prices a ON a.uuid = p.uuid AND a.snapshot_date = date_add(p.snapshot_date, 7))"""
TIER = "CASE WHEN eur >= 60 THEN 3 WHEN eur >= 30 THEN 2 ELSE 1 END"

SQL: dict[str, str] = {
    # scans, sources and sinks
    "src15_daily_projection": "SELECT p_partkey AS id, DATE '2024-01-30' AS snapshot_date, p_brand, p_size FROM {part}",
    "src16_scalar_prices": "SELECT event_id, CAST(get_json_object(props, '$.k') AS DOUBLE) AS k FROM {events}",
    "src18_date_filtered_scan": "SELECT event_id, user_id, value FROM {events} WHERE CAST(ts AS DATE) = DATE '2024-01-10'",
    "src11_first_seen_top_n": "WITH f AS (SELECT l_partkey, l_returnflag, MIN(l_orderkey) AS first_seen FROM {lineitem} GROUP BY l_partkey, l_returnflag), r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY first_seen, l_partkey) AS k FROM f) SELECT l_returnflag, l_partkey, first_seen FROM r WHERE k <= 10",
    # projections and predicates
    "prj01_computed": "SELECT *, o_totalprice * 2 AS doubled FROM {orders}",
    "prj03_lateral_alias": "SELECT l_orderkey, l_linenumber, l_quantity > 25 AS is_big, CAST(is_big AS INT) + 1 AS score FROM {lineitem}",
    "prj05_bool_default": "SELECT event_id, COALESCE(event_type = 'error', false) AS is_error FROM {events}",
    "prj06_cap_to_null": "SELECT p_partkey, CASE WHEN p_size <= 20 THEN p_size END AS mana_value FROM {part}",
    "prj08_label": f"WITH {PRICES} SELECT p.uuid, p.snapshot_date, CASE WHEN p.eur IS NULL OR t.eur IS NULL THEN NULL WHEN t.eur > p.eur * 1.2 THEN 'up' WHEN t.eur < p.eur * 0.8 THEN 'down' ELSE 'flat' END AS label FROM prices p LEFT JOIN prices t ON t.uuid = p.uuid AND t.snapshot_date = date_add(p.snapshot_date, 7)",
    "prj10_drop_flags": "SELECT o_orderkey FROM {orders} WHERE NOT COALESCE(o_orderstatus = 'P', false) AND NOT COALESCE(o_totalprice > 400000, false)",
    "prj11_not_in_list": "SELECT p_partkey, p_type FROM {part} WHERE COALESCE(p_type, '') NOT IN ('SMALL', 'ECONOMY')",
    "prj12_in_list": "SELECT p_partkey, lower(trim(p_type)) AS t FROM {part} WHERE lower(trim(p_type)) IN ('small', 'economy')",
    "prj13_not_null": "SELECT event_id, value FROM {events} WHERE value IS NOT NULL AND props IS NOT NULL",
    "prj14_between": "SELECT event_id FROM {events} WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-09'",
    "prj16_is_distinct": "SELECT a.s_suppkey FROM {supplier} a LEFT JOIN {customer} b ON a.s_suppkey = b.c_custkey WHERE a.s_nationkey IS DISTINCT FROM b.c_nationkey",
    "prj18_search": "SELECT p_partkey, p_name FROM {part} WHERE lower(p_name) LIKE '%ring%' ORDER BY p_name, p_partkey LIMIT 10",
    "prj19_lookup": "SELECT * FROM {customer} WHERE c_custkey = 42",
    # joins
    "jn01_full_outer_merge": "SELECT COALESCE(c.c_custkey, s.s_suppkey) AS id, COALESCE(c.c_name, s.s_name) AS name, COALESCE(c.c_nationkey, s.s_nationkey) AS nation, COALESCE(c.c_acctbal, s.s_acctbal) AS balance, c.c_custkey IS NOT NULL AS has_left FROM (SELECT c_custkey + 50 AS c_custkey, c_name, c_nationkey, c_acctbal FROM {customer}) c FULL OUTER JOIN {supplier} s ON c.c_custkey = s.s_suppkey",
    "jn02_canonical_id": "WITH m AS (SELECT c_nationkey, c_mktsegment, MIN(c_custkey) AS canonical FROM {customer} GROUP BY c_nationkey, c_mktsegment) SELECT c.c_custkey, m.canonical FROM {customer} c LEFT JOIN m ON c.c_nationkey = m.c_nationkey AND c.c_mktsegment = m.c_mktsegment",
    "jn04_inner_known_ids": "SELECT o.o_orderkey FROM {orders} o JOIN (SELECT DISTINCT c_custkey FROM {customer} WHERE c_mktsegment = 'BUILDING') c ON o.o_custkey = c.c_custkey",
    "jn05_left_anti": "SELECT c.c_custkey FROM {customer} c LEFT JOIN (SELECT * FROM {orders} WHERE o_totalprice > 300000) o ON c.c_custkey = o.o_custkey WHERE o.o_orderkey IS NULL",
    "jn06_id_map": "SELECT l.l_orderkey, l.l_linenumber, p.p_brand, l.l_extendedprice FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey",
    "jn07_two_keys": f"WITH {PRICES}, {EAV} SELECT p.uuid, p.snapshot_date, p.eur, e.price AS view_price FROM prices p LEFT JOIN eav e ON p.uuid = e.uuid AND p.snapshot_date = e.snapshot_date AND e.finish = 'view'",
    "jn08_language_codes": "SELECT d.doc_id, x.name FROM {documents} d JOIN (SELECT 'en' AS code, 'English' AS name UNION ALL SELECT 'de', 'German') x ON d.lang = x.code",
    "jn09_name_lookup": "WITH one AS (SELECT p_name, MIN(p_partkey) AS id FROM {part} GROUP BY p_name) SELECT p.p_partkey, one.id FROM {part} p LEFT JOIN one ON p.p_name = one.p_name AND p.p_size < 40",
    "jn10_language_premium": "SELECT l.l_orderkey, l.l_linenumber, l.l_extendedprice / NULLIF(l.l_quantity, 0) / NULLIF(p.p_retailprice, 0) AS premium FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey",
    "jn11_time_aligned": f"WITH {PRICES}, {STATUS} SELECT p.uuid, p.snapshot_date, p.eur, s.status FROM prices p LEFT JOIN status s ON p.uuid = s.uuid AND p.snapshot_date = s.snapshot_date",
    "jn12_targets": f"WITH {LONG} SELECT p.uuid, p.snapshot_date, p.eur, a.eur AS t7, b.eur AS t30 FROM long p LEFT JOIN long a ON a.uuid = p.uuid AND a.snapshot_date = date_add(p.snapshot_date, 7) LEFT JOIN long b ON b.uuid = p.uuid AND b.snapshot_date = date_add(p.snapshot_date, 30)",
    "jn13_log_return": f"WITH {PRICES} SELECT p.uuid, p.snapshot_date, ROUND(LN(1 + t.eur) - LN(1 + p.eur), 7) AS log_return_7d FROM prices p JOIN prices t ON t.uuid = p.uuid AND t.snapshot_date = date_add(p.snapshot_date, 7)",
    "jn14_trainable_date": f"WITH {PRICES}, d AS (SELECT DISTINCT snapshot_date FROM prices) SELECT MAX(a.snapshot_date) AS trainable FROM d a JOIN d b ON b.snapshot_date = date_add(a.snapshot_date, 7)",
    "jn16_event_impact": f"WITH {EVENTS}, {PRICES}, j AS (SELECT e.uuid, e.event_type, e.event_date, datediff(p.snapshot_date, e.event_date) AS k, p.eur FROM transitions e JOIN prices p ON p.uuid = e.uuid) SELECT uuid, event_type, event_date, ROUND(AVG(CASE WHEN k BETWEEN -30 AND -1 THEN eur END), 10) AS before_30, ROUND(AVG(CASE WHEN k BETWEEN -7 AND -1 THEN eur END), 10) AS before_7, ROUND(AVG(CASE WHEN k = 0 THEN eur END), 10) AS at_event, ROUND(AVG(CASE WHEN k BETWEEN 1 AND 7 THEN eur END), 10) AS after_7, ROUND(AVG(CASE WHEN k BETWEEN 1 AND 30 THEN eur END), 10) AS after_30 FROM j GROUP BY uuid, event_type, event_date",
    "jn17_prediction_actual": f"WITH {PREDICTED} SELECT uuid, snapshot_date, predicted_eur, actual FROM scored",
    "jn18_backtest_join": f"WITH {PRICES} SELECT a.uuid, a.eur AS p0, b.eur AS p1 FROM prices a JOIN prices b ON a.uuid = b.uuid WHERE a.snapshot_date = DATE '2024-01-05' AND b.snapshot_date = DATE '2024-01-20' AND a.uuid IN (SELECT uuid FROM prices WHERE n > 3)",
    "jn22_coverage": "SELECT COUNT(CASE WHEN c.c_custkey IS NOT NULL AND s.s_suppkey IS NOT NULL THEN 1 END) AS in_both, COUNT(CASE WHEN s.s_suppkey IS NULL THEN 1 END) AS only_left, COUNT(CASE WHEN c.c_custkey IS NULL THEN 1 END) AS only_right FROM (SELECT c_custkey + 21 AS c_custkey FROM {customer}) c FULL OUTER JOIN {supplier} s ON c.c_custkey = s.s_suppkey",
    "jn23_using": "SELECT n_name, COUNT(*) AS n FROM {nation} JOIN (SELECT c_nationkey AS n_nationkey FROM {customer}) c USING (n_nationkey) GROUP BY n_name",
    "jn24_scalar_subquery": "SELECT event_id, value FROM {events} WHERE CAST(ts AS DATE) = (SELECT MAX(CAST(ts AS DATE)) FROM {events})",
    "jn15_star_dataset": f"WITH {PRICES}, {STATUS}, agg AS (SELECT CAST(user_id AS STRING) AS uuid, COUNT(*) AS events, COUNT(DISTINCT event_type) AS kinds FROM {{events}} GROUP BY CAST(user_id AS STRING)), pv AS (SELECT CAST(user_id AS STRING) AS uuid, CAST(ts AS DATE) AS d, MAX(CASE WHEN event_type = 'view' THEN value END) AS v_view, MAX(CASE WHEN event_type = 'click' THEN value END) AS v_click, MAX(CASE WHEN event_type = 'signup' THEN value END) AS v_signup, MAX(CASE WHEN event_type = 'error' THEN value END) AS v_error FROM {{events}} GROUP BY CAST(user_id AS STRING), CAST(ts AS DATE)) SELECT p.uuid, p.snapshot_date, p.eur, s.status, a.events, a.kinds, v_view, v_click, v_signup, v_error FROM prices p LEFT JOIN status s ON s.uuid = p.uuid AND s.snapshot_date = p.snapshot_date LEFT JOIN agg a ON a.uuid = p.uuid LEFT JOIN pv ON pv.uuid = p.uuid AND pv.d = p.snapshot_date WHERE p.eur IS NOT NULL",
    "jn19_three_way": f"WITH {PRICES} SELECT a.uuid, a.eur, b.eur AS target, c.c_mktsegment FROM prices a JOIN prices b ON a.uuid = b.uuid AND b.snapshot_date = date_add(a.snapshot_date, 7) JOIN {{customer}} c ON CAST(c.c_custkey AS STRING) = a.uuid WHERE a.snapshot_date = DATE '2024-01-10'",
    # aggregations
    "ag01_eav_pivot": f"WITH {EAV} SELECT uuid, snapshot_date, MAX(CASE WHEN finish = 'view' THEN price END) AS p_view, MAX(CASE WHEN finish = 'click' THEN price END) AS p_click, MAX(CASE WHEN finish = 'purchase' THEN price END) AS p_purchase, MAX(CASE WHEN finish = 'signup' THEN price END) AS p_signup, MAX(CASE WHEN finish = 'error' THEN price END) AS p_error FROM eav GROUP BY uuid, snapshot_date",
    "ag02_min_id": "SELECT c_nationkey, c_mktsegment, MIN(c_custkey) AS id FROM {customer} GROUP BY c_nationkey, c_mktsegment",
    "ag03_event_counts": f"WITH {EVENTS} SELECT event_date, event_type, COUNT(*) AS card_count FROM transitions GROUP BY event_date, event_type",
    "ag05_avg_case": "SELECT l_returnflag, AVG(CASE WHEN l_linestatus <> 'F' THEN l_quantity END) AS avg_open FROM {lineitem} GROUP BY l_returnflag",
    "ag06_min_max_case": "SELECT l_suppkey, MIN(l_orderkey) AS rep, MAX(CASE WHEN l_returnflag = 'R' THEN CAST(l_shipdate AS DATE) END) AS last_return FROM {lineitem} GROUP BY l_suppkey",
    "ag07_distinct_ratio": "SELECT l_suppkey, double(COUNT(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_orderkey END)) / NULLIF(COUNT(DISTINCT l_orderkey), 0) * 100 AS pct FROM {lineitem} GROUP BY l_suppkey",
    "ag08_reaggregate": "WITH a AS (SELECT l_partkey, l_returnflag, COUNT(*) AS n, AVG(l_quantity) AS q FROM {lineitem} GROUP BY l_partkey, l_returnflag) SELECT l_partkey, bigint(SUM(n)) AS n, COUNT(*) AS kinds, MAX(q) AS q FROM a GROUP BY l_partkey",
    "ag09_having_distinct": "SELECT o_custkey FROM {orders} GROUP BY o_custkey HAVING COUNT(DISTINCT o_orderstatus) > 1",
    "ag10_group_size": "SELECT p.p_partkey, COALESCE(c.n, 1) AS print_count FROM {part} p LEFT JOIN (SELECT p_name, COUNT(*) AS n FROM {part} GROUP BY p_name) c ON c.p_name = p.p_name AND p.p_size < 45",
    "ag11_date_span": "SELECT MIN(CAST(ts AS DATE)) AS lo, MAX(CAST(ts AS DATE)) AS hi, datediff(MAX(CAST(ts AS DATE)), MIN(CAST(ts AS DATE))) AS span FROM {events}",
    "ag12_health_counts": "SELECT COUNT(*) AS n, COUNT(CASE WHEN o_totalprice IS NULL THEN 1 END) AS nulls, COUNT(CASE WHEN o_totalprice <= 0 THEN 1 END) AS bad, MAX(CAST(o_orderdate AS DATE)) AS fresh FROM {orders}",
    "ag13_duplicates": "SELECT COUNT(*) AS groups FROM (SELECT l_orderkey, l_partkey FROM {lineitem} GROUP BY l_orderkey, l_partkey HAVING COUNT(*) > 1) x",
    "ag14_combo_drift": "SELECT event_type, 'unexpected' AS kind FROM (SELECT DISTINCT event_type FROM {events}) a WHERE event_type NOT IN ('view', 'click', 'refund') UNION ALL SELECT x, 'missing' FROM (SELECT 'view' AS x UNION ALL SELECT 'click' UNION ALL SELECT 'refund') b WHERE x NOT IN (SELECT event_type FROM {events})",
    "ag15_distinct_dates": "SELECT COUNT(DISTINCT CAST(ts AS DATE)) AS days FROM {events}",
    "ag17_daily_mape": f"WITH {PREDICTED} SELECT snapshot_date, ROUND(AVG(ABS(predicted_eur - actual) / GREATEST(actual, 0.01)) * 100, 6) AS mape FROM scored GROUP BY snapshot_date",
    "ag18_error_by_group": f"WITH {PREDICTED} SELECT {TIER} AS tier, ROUND(AVG(ABS(predicted_eur - actual)), 6) AS mean_error, COUNT(*) AS n, ROUND(STDDEV_SAMP(ABS(predicted_eur - actual)), 6) AS std_error, ROUND(SUM(ABS(predicted_eur - actual)) / SUM(SUM(ABS(predicted_eur - actual))) OVER (), 6) AS share FROM scored GROUP BY {TIER}",
    "ag19_per_tier": f"WITH {PREDICTED} SELECT {TIER} AS tier, COUNT(*) AS n_cards, ROUND(AVG(ABS(predicted_eur - actual)), 6) AS mae, ROUND(AVG(ABS(predicted_eur - actual) / GREATEST(ABS(actual), 0.01)) * 100, 6) AS mape FROM scored GROUP BY {TIER}",
    "ag20_fold_means": f"WITH {PREDICTED}, f AS (SELECT {TIER} AS tier, snapshot_date, AVG(ABS(predicted_eur - actual)) AS mae FROM scored GROUP BY {TIER}, snapshot_date) SELECT tier, ROUND(AVG(mae), 6) AS mae, COUNT(*) AS folds FROM f GROUP BY tier",
    "ag22_share": "SELECT event_type, COUNT(*) AS n, double(COUNT(*)) * 100 / double(SUM(COUNT(*)) OVER ()) AS pct FROM {events} GROUP BY event_type",
    "ag23_coverage": "SELECT double(COUNT(get_json_object(props, '$.k'))) / COUNT(*) AS covered, COUNT(DISTINCT CASE WHEN value > 50 THEN user_id END) AS big_users FROM {events}",
    "ag24_computed_tier": "SELECT CASE WHEN o_totalprice < 100000 THEN 1 WHEN o_totalprice < 300000 THEN 2 ELSE 3 END AS tier, COUNT(*) AS n, MIN(o_totalprice) AS lo FROM {orders} GROUP BY CASE WHEN o_totalprice < 100000 THEN 1 WHEN o_totalprice < 300000 THEN 2 ELSE 3 END",
    "ag25_weekly": "SELECT CAST(date_trunc('week', ts) AS DATE) AS week, COUNT(*) AS n, COUNT(DISTINCT user_id) AS users FROM {events} GROUP BY CAST(date_trunc('week', ts) AS DATE)",
    "ag27_hit_rate": f"WITH {PRICES}, j AS (SELECT a.eur AS p0, b.eur AS p1 FROM prices a JOIN prices b ON a.uuid = b.uuid AND b.snapshot_date = date_add(a.snapshot_date, 14)) SELECT COUNT(*) AS n, AVG(CASE WHEN p1 / NULLIF(p0, 0) - 1 > 0.1 THEN 1.0E0 ELSE 0.0E0 END) AS hit_rate, ROUND(AVG(p1 / NULLIF(p0, 0) - 1), 6) AS mean_appreciation FROM j",
    # windows
    "wn07_rank": f"WITH {PRICES} SELECT uuid, snapshot_date, rank() OVER (PARTITION BY snapshot_date ORDER BY eur DESC NULLS LAST) AS price_rank FROM prices",
    "wn09_dedup": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END, o_orderkey) AS k FROM {orders}) SELECT o_custkey, o_orderkey FROM r WHERE k = 1",
    "wn10_latest_prior": f"WITH {PRICES}, r AS (SELECT *, row_number() OVER (PARTITION BY uuid ORDER BY snapshot_date DESC) AS k FROM prices WHERE snapshot_date < DATE '2024-01-20') SELECT uuid, snapshot_date, eur FROM r WHERE k = 1",
    "wn12_demand_signals": f"WITH {STATUS}, {PRICES}, r AS (SELECT p.uuid, p.snapshot_date, s.status, CAST(rank() OVER (PARTITION BY p.snapshot_date ORDER BY p.eur DESC) AS INT) AS rk FROM prices p JOIN status s ON s.uuid = p.uuid AND s.snapshot_date = p.snapshot_date), l AS (SELECT *, lag(status) OVER w AS prev, lag(rk) OVER w AS prev_rk FROM r WINDOW w AS (PARTITION BY uuid ORDER BY snapshot_date)) SELECT uuid, snapshot_date, rk - prev_rk AS rank_delta, COALESCE(prev = 'view' AND status = 'error', false) AS banned, COALESCE(prev = 'error' AND status = 'view', false) AS unbanned FROM l",
    "wn13_format_staples": "WITH s AS (SELECT event_type AS id, CAST(ts AS DATE) AS snapshot_date, COUNT(*) AS c FROM {events} GROUP BY event_type, CAST(ts AS DATE)), q AS (SELECT id, snapshot_date, double(c) * 100 / double(SUM(c) OVER (PARTITION BY snapshot_date)) AS deck_pct FROM s) SELECT id, snapshot_date, deck_pct, ROUND(AVG(deck_pct) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS avg_7, ROUND(AVG(deck_pct) OVER (w ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), 6) AS avg_30, deck_pct - lag(deck_pct, 7) OVER w AS change_7d FROM q WINDOW w AS (PARTITION BY id ORDER BY snapshot_date)".replace("OVER (w ROWS", "OVER (PARTITION BY id ORDER BY snapshot_date ROWS"),
    "wn14_lag_features": f"WITH {PRICES}, f AS (SELECT uuid, snapshot_date, eur, lag(eur, 1) OVER w AS lag_1d, lag(eur, 7) OVER w AS lag_7d, lag(eur, 14) OVER w AS lag_14d, ROUND(AVG(eur) OVER (PARTITION BY uuid ORDER BY snapshot_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS mean_7, ROUND(STDDEV_SAMP(eur) OVER (PARTITION BY uuid ORDER BY snapshot_date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW), 6) AS std_14, MIN(eur) OVER (PARTITION BY uuid ORDER BY snapshot_date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS min_30, MAX(eur) OVER (PARTITION BY uuid ORDER BY snapshot_date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS max_30 FROM prices WINDOW w AS (PARTITION BY uuid ORDER BY snapshot_date)) SELECT * FROM f WHERE snapshot_date = DATE '2024-01-25'",
    "wn15_global_vs_running": f"WITH {PRICES} SELECT uuid, snapshot_date, MAX(eur) OVER (PARTITION BY uuid) AS ever, MAX(eur) OVER (PARTITION BY uuid ORDER BY snapshot_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS so_far FROM prices",
    "wn16_islands": f"WITH {STATUS}, l AS (SELECT *, lag(status) OVER (PARTITION BY uuid ORDER BY snapshot_date) AS prev FROM status), g AS (SELECT *, bigint(SUM(CASE WHEN status IS DISTINCT FROM prev THEN 1 ELSE 0 END) OVER (PARTITION BY uuid ORDER BY snapshot_date)) AS island FROM l) SELECT uuid, island, status, COUNT(*) AS run_length FROM g GROUP BY uuid, island, status",
    "wn17_max_gap": f"WITH {PRICES}, g AS (SELECT uuid, datediff(snapshot_date, lag(snapshot_date) OVER (PARTITION BY uuid ORDER BY snapshot_date)) AS gap FROM prices) SELECT uuid, MAX(gap) AS max_gap FROM g GROUP BY uuid",
    "wn18_cap_per_date": f"WITH {PRICES}, r AS (SELECT *, row_number() OVER (PARTITION BY snapshot_date ORDER BY uuid) AS rn FROM prices) SELECT uuid, snapshot_date FROM r WHERE rn <= 25",
    "wn19_log_return": f"WITH {PRICES} SELECT uuid, snapshot_date, ROUND(LN(1 + eur) - lag(LN(1 + eur)) OVER (PARTITION BY uuid ORDER BY snapshot_date), 7) AS r FROM prices",
    "wn20_window_over_aggregate": "SELECT o_orderstatus, COUNT(*) AS n, rank() OVER (ORDER BY COUNT(*) DESC, o_orderstatus) AS r FROM {orders} GROUP BY o_orderstatus",
    # sorts, limits, sets
    "so02_exists": "SELECT COUNT(*) AS any_row FROM (SELECT 1 AS x FROM {orders} WHERE o_totalprice > 100000 LIMIT 1) q",
    "so03_worst": f"WITH {PREDICTED} SELECT uuid, snapshot_date, ABS(predicted_eur - actual) / GREATEST(actual, 0.01) AS pct_error FROM scored ORDER BY pct_error DESC, uuid, snapshot_date LIMIT 20",
    "so08_head": "SELECT c_custkey, c_acctbal FROM {customer} ORDER BY c_acctbal DESC, c_custkey LIMIT 10",
    "so09_sorted_dates": "SELECT DISTINCT CAST(ts AS DATE) AS d FROM {events}",
    "so10_abs_desc": "SELECT c_custkey FROM {customer} ORDER BY ABS(c_acctbal) DESC NULLS LAST, c_custkey LIMIT 25",
    "so11_sample": "SELECT o_orderkey FROM {orders} ORDER BY xxhash_text(CAST(o_orderkey AS STRING)), o_orderkey LIMIT 100",
    "st01_unpivot": f"WITH {EVENTS} SELECT uuid, event_date, event_type FROM transitions WHERE event_type = 'ban' UNION ALL SELECT uuid, event_date, event_type FROM transitions WHERE event_type = 'unban'",
    "st03_set_difference": "SELECT DISTINCT c_nationkey AS k FROM {customer} EXCEPT SELECT s_nationkey FROM {supplier} WHERE s_acctbal > 5000",
    "st04_distinct": "SELECT DISTINCT p_brand, p_type FROM {part}",
    "st05_keep_first": "SELECT p_name, MIN(p_partkey) AS id FROM {part} GROUP BY p_name",
    # strings
    "str01_trim_case": "SELECT p_partkey, trim(p_name) AS a, lower(p_brand) AS b, upper(p_type) AS c FROM {part}",
    "str02_sentinel": "SELECT o_orderkey, NULLIF(trim(o_orderstatus), 'P') AS s FROM {orders}",
    "str03_capitalise": "SELECT p_partkey, concat(upper(left(p_name, 1)), lower(substr(p_name, 2))) AS s FROM {part}",
    "str04_split": "SELECT p_partkey, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b, size(split(p_name, ' ')) AS n FROM {part}",
    "str05_position": "SELECT p_partkey, locate('bolt', p_name) > 0 AS has_bolt FROM {part}",
    "str06_replace": "SELECT p_partkey, replace(trim(p_name), ' ', ' // ') AS s FROM {part}",
    "str07_composite_key": "SELECT concat(CAST(l_orderkey AS STRING), '__', CAST(l_linenumber AS STRING)) AS id FROM {lineitem}",
    "str08_regex": "SELECT p_partkey, regexp_extract(p_brand, '([0-9]+)', 1) AS n FROM {part}",
    "str09_percent": "SELECT o_orderkey, try_cast(replace(concat(CAST(o_custkey AS STRING), '%'), '%', '') AS DOUBLE) AS pct FROM {orders}",
    "str11_errata": "SELECT p_partkey, p_type IS NOT NULL AND trim(COALESCE(p_name, '')) <> trim(p_type) AS differs FROM {part}",
    "str12_starts_with": "SELECT p_partkey, startswith(p_name, 'red') AS red FROM {part}",
    # dates
    "dat01_cast": "SELECT o_orderkey, CAST(substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 10) AS DATE) AS d FROM {orders}",
    "dat02_diff": "SELECT l_orderkey, l_linenumber, datediff(DATE '2001-01-01', CAST(l_shipdate AS DATE)) AS age FROM {lineitem}",
    "dat04_add": "SELECT o_orderkey, date_add(CAST(o_orderdate AS DATE), 7) AS d FROM {orders}",
    "dat05_recency": "SELECT COUNT(CASE WHEN datediff(DATE '2001-08-01', CAST(o_orderdate AS DATE)) <= 30 THEN 1 END) AS d30, COUNT(CASE WHEN datediff(DATE '2001-08-01', CAST(o_orderdate AS DATE)) <= 90 THEN 1 END) AS d90 FROM {orders}",
    "dat07_year_week": "SELECT o_orderkey, year(o_orderdate) AS y, CAST(date_trunc('week', o_orderdate) AS DATE) AS w FROM {orders}",
    # math
    "mth01_safe_ratio": "SELECT l_orderkey, l_linenumber, l_extendedprice / NULLIF(l_quantity - 10, 0) AS r FROM {lineitem}",
    "mth02_log1p": "SELECT o_orderkey, ROUND(LN(1 + o_totalprice), 7) AS x FROM {orders}",
    "mth03_inverse": f"WITH {PRICES} SELECT uuid, snapshot_date, ROUND(EXP(LN(1 + eur) + 0.05) - 1, 6) AS predicted FROM prices",
    "mth04_log10": "SELECT o_orderkey, ROUND(log10(o_totalprice + 0.01), 7) AS x FROM {orders}",
    "mth05_greatest": "SELECT c_custkey, GREATEST(ABS(c_acctbal), 0.01) AS x FROM {customer}",
    "mth06_clip": "SELECT c_custkey, GREATEST(c_acctbal, 0.0) AS floored, LEAST(GREATEST(c_acctbal, 0.0), 5000.0) AS clipped FROM {customer}",
    "mth07_bool_sum": "SELECT event_id, CAST(event_type = 'view' AS INT) + CAST(value > 10 AS INT) + CAST(value > 50 AS INT) AS flags FROM {events}",
    "mth08_thresholds": f"WITH {PRICES}, l AS (SELECT *, lag(eur) OVER (PARTITION BY uuid ORDER BY snapshot_date) AS p FROM prices) SELECT uuid, snapshot_date, eur > p * 1.2 AS up, eur < p * 0.8 AS down, ABS((eur - p) / NULLIF(p, 0)) > 3.0 AS spike FROM l",
    "mth09_round": "SELECT l_returnflag, ROUND(double(SUM(CAST(l_quantity AS DECIMAL(18,2)))) / COUNT(*), 4) AS q FROM {lineitem} GROUP BY l_returnflag",
    "mth10_tier": "SELECT o_orderkey, CASE WHEN o_totalprice >= 300000 THEN 3 WHEN o_totalprice >= 100000 THEN 2 ELSE 1 END AS tier FROM {orders}",
    "mth11_try_cast": "SELECT p_partkey, try_cast(p_brand AS DOUBLE) AS a, try_cast(CAST(p_size AS STRING) AS DOUBLE) AS b FROM {part}",
    "mth12_ordinal": "SELECT o_orderkey, CASE o_orderpriority WHEN '5-LOW' THEN 0 WHEN '4-NOT SPECIFIED' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '2-HIGH' THEN 3 END AS p FROM {orders}",
    # arrays and JSON
    "arr02_transform": "SELECT p_partkey, array_join(transform(split(p_name, ' '), x -> upper(x)), '|') AS s FROM {part}",
    "arr03_filter": "SELECT p_partkey, array_join(filter(split(p_name, ' '), x -> array_contains(array('red', 'blue', 'ring'), x)), '|') AS s FROM {part}",
    "arr04_length": "SELECT p_partkey, size(split(p_name, ' ')) AS n FROM {part}",
    "arr05_membership": "SELECT p_partkey, array_contains(split(p_name, ' '), 'ring') AS ring FROM {part}",
    "arr06_default_list": "SELECT p_partkey, size(CASE WHEN p_size > 25 THEN split(p_name, ' ') ELSE filter(array('x'), y -> false) END) AS n FROM {part}",
    "jsn01_extract": "SELECT event_id, CAST(get_json_object(props, '$.k') AS INT) AS k FROM {events}",
    "jsn02_lower_default": "SELECT event_id, COALESCE(lower(props), '[]') AS p FROM {events}",
    "jsn04_distinct_objects": "SELECT user_id, COUNT(DISTINCT props) AS n FROM {events} GROUP BY user_id",
    # models, recommendation, monitoring, statistics
    "ml02_target": f"WITH {PRICES} SELECT p.uuid, ROUND(LN(1 + t.eur) - LN(1 + p.eur), 7) AS log_return_7d FROM prices p JOIN prices t ON t.uuid = p.uuid WHERE p.snapshot_date = DATE '2024-01-10' AND t.snapshot_date = date_add(DATE '2024-01-10', 7)",
    "ml04_lag_enrichment": f"WITH {PRICES}, l AS (SELECT *, lag(eur) OVER (PARTITION BY uuid ORDER BY snapshot_date) AS p FROM prices) SELECT uuid, snapshot_date, ROUND(LN(1 + eur), 7) AS log_price, ROUND(LN(1 + eur) - LN(1 + p), 7) AS ret_1d FROM l",
    "ml05_dtype_defaults": "SELECT event_id, COALESCE(value > 10, false) AS b, COALESCE(CAST(user_id AS INT), 0) AS i FROM {events}",
    "ml06_median_impute": "WITH m AS (SELECT percentile(p_retailprice, 0.5) AS med FROM {part}) SELECT p_partkey, COALESCE(CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_retailprice END, m.med) AS price, COALESCE(CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size END, 0) AS size0 FROM {part} CROSS JOIN m",
    "ml09_folds": f"WITH {PRICES}, d AS (SELECT DISTINCT snapshot_date AS d FROM prices), b AS (SELECT MIN(d) AS lo, MAX(d) AS hi FROM d), k AS (SELECT explode(sequence(0, 2)) AS fold) SELECT CAST(fold AS INT) AS fold, MAX(CASE WHEN datediff(d.d, lo) < 10 + fold * 5 THEN d.d END) AS train_snapshot, MAX(CASE WHEN datediff(d.d, lo) < 15 + fold * 5 THEN d.d END) AS val_snapshot FROM d CROSS JOIN b CROSS JOIN k GROUP BY fold",
    "ml11_baselines": f"WITH {PREDICTED}, y AS (SELECT LN(1 + actual) - LN(1 + eur) AS y, LN(1 + predicted_eur) - LN(1 + eur) AS r FROM scored) SELECT ROUND(AVG(ABS(y)), 6) AS zero_mae, ROUND(AVG(ABS(y - r)), 6) AS reversion_mae, ROUND(regr_slope(y, r), 6) AS slope, ROUND(regr_intercept(y, r), 6) AS intercept FROM y",
    "ml14_mae_mape": f"WITH {PREDICTED} SELECT ROUND(AVG(ABS(predicted_eur - actual)), 6) AS mae, ROUND(AVG(ABS(predicted_eur - actual) / GREATEST(ABS(actual), 0.01)) * 100, 6) AS mape FROM scored",
    "ml24_underpriced": f"WITH {PREDICTED} SELECT uuid, snapshot_date, {TIER} AS tier, predicted_eur / GREATEST(eur, 0.01) AS confidence, {TIER} IN (1, 2) AND predicted_eur / GREATEST(eur, 0.01) > 1.3 AS is_underpriced FROM predictions",
    "ml25_underpriced_query": f"WITH {PREDICTED} SELECT uuid, snapshot_date, predicted_eur / GREATEST(eur, 0.01) AS confidence FROM predictions WHERE eur IS NOT NULL AND {TIER} IN (1, 2) AND predicted_eur / GREATEST(eur, 0.01) > 1.5",
    "ml26_backtest": f"WITH {PREDICTED}, flagged AS (SELECT uuid, snapshot_date, eur FROM predictions WHERE predicted_eur / GREATEST(eur, 0.01) > 1.3) SELECT COUNT(*) AS n, bigint(SUM(CASE WHEN p.eur / NULLIF(f.eur, 0) - 1 > 0.1 THEN 1 ELSE 0 END)) AS hits, ROUND(AVG(p.eur / NULLIF(f.eur, 0) - 1), 6) AS mean_gain FROM flagged f JOIN prices p ON p.uuid = f.uuid AND p.snapshot_date = date_add(f.snapshot_date, 7)",
    "mon03_alert": f"WITH {PREDICTED}, m AS (SELECT snapshot_date, AVG(ABS(predicted_eur - actual) / GREATEST(actual, 0.01)) * 100 AS mape FROM scored GROUP BY snapshot_date), r AS (SELECT *, row_number() OVER (ORDER BY snapshot_date DESC) AS k FROM m) SELECT COUNT(*) = 3 AND MIN(mape) > 30 AS alert FROM r WHERE k <= 3",
    "mon04_events_on": f"WITH {EVENTS} SELECT event_type, COUNT(*) AS card_count FROM transitions WHERE event_date = DATE '2024-01-12' GROUP BY event_type",
    "sta05_mahalanobis": "WITH m AS (SELECT AVG(l_quantity) AS mx, AVG(l_discount) AS my, VAR_SAMP(l_quantity) AS vx, VAR_SAMP(l_discount) AS vy, COVAR_SAMP(l_quantity, l_discount) AS c FROM {lineitem}) SELECT COUNT(*) AS outliers FROM {lineitem} CROSS JOIN m WHERE ((l_quantity - mx) * (l_quantity - mx) * vy - 2 * (l_quantity - mx) * (l_discount - my) * c + (l_discount - my) * (l_discount - my) * vx) / (vx * vy - c * c) > 5.123",
    "sta09_ols_spread": f"WITH {SERIES} SELECT a.uuid AS u, b.uuid AS v, ROUND(regr_slope(b.eur, a.eur), 6) AS slope, ROUND(regr_intercept(b.eur, a.eur), 5) AS intercept, COUNT(*) AS n FROM series a JOIN series b ON a.snapshot_date = b.snapshot_date AND a.uuid < b.uuid GROUP BY a.uuid, b.uuid",
    "sta13_pairwise_corr": f"WITH {SERIES} SELECT a.uuid AS u, b.uuid AS v, COUNT(*) AS n, ROUND(corr(a.eur, b.eur), 6) AS r FROM series a JOIN series b ON a.snapshot_date = b.snapshot_date AND a.uuid < b.uuid GROUP BY a.uuid, b.uuid HAVING COUNT(*) > 5",
    "sta16_rmse": f"WITH {PREDICTED} SELECT {TIER} AS tier, ROUND(SQRT(AVG((predicted_eur - actual) * (predicted_eur - actual))), 6) AS rmse FROM scored GROUP BY {TIER}",
}
