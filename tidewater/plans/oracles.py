"""DuckDB SQL for each query of the catalogue, written from its definition."""

from tidewater.plans import keyed

LOG = "pl AS (SELECT event_id, ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CAST(ts AS DATE) AS day, event_type = 'view' AS entry FROM events)"
CHANGES = """oc AS (SELECT *, CASE WHEN o_orderstatus = 'O' THEN 'insert' ELSE 'update' END AS type,
  lag(o_orderstatus) OVER w AS before_status, lag(o_orderpriority) OVER w AS before_priority, lag(o_orderkey) OVER w AS before_key
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))"""
REPAIRED = """f AS (SELECT *, k % 2 AS was_new, first_value(day) OVER w AS fday, first_value(k % 2) OVER w AS fflag FROM pl WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
rep AS (SELECT *, CASE WHEN was_new = 1 AND day <> CASE WHEN fflag = 1 THEN fday ELSE fday - 1 END THEN 0 ELSE was_new END AS is_new FROM f)"""
VISITORS = "vis AS (SELECT * FROM pl WHERE entry QUALIFY row_number() OVER (PARTITION BY user_id, day ORDER BY ts, event_id) = 1)"
JUMPS = """jmp AS (SELECT * EXCLUDE (nts, nentry) FROM (SELECT *, lead(ts) OVER w AS nts, lead(entry) OVER w AS nentry FROM pl WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
  WHERE entry AND (nts IS NULL OR nentry OR nts >= ts + INTERVAL 1 HOUR))"""
LATEST = "det AS (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC) = 1)"
STT = "strftime(time_bucket(INTERVAL '{w}', ts), '%Y-%m-%d %H:%M:%S') AS stt, strftime(time_bucket(INTERVAL '{w}', ts) + INTERVAL '{w}', '%Y-%m-%d %H:%M:%S') AS edt"
HOUR, DAY = STT.format(w="1 hour"), STT.format(w="1 day")


def money(x: str) -> str:
    return f"CAST(sum(CAST({x} AS DECIMAL(18,2))) AS DOUBLE)"


SQL = {
    "json_valid_split": "SELECT source, coalesce(json_valid(value), false) AS valid, count(*) AS n FROM (SELECT 'events' AS source, props AS value FROM events UNION ALL SELECT 'documents', text FROM documents) GROUP BY ALL",
    "parse_or_divert": "SELECT CASE WHEN json_valid(v) AND v LIKE '{%' THEN 'good' ELSE 'dirty' END AS route, count(*) AS n, CAST(sum(CASE WHEN json_valid(v) THEN CAST(json_extract_string(v, '$.k') AS INTEGER) END) AS BIGINT) AS k_sum FROM (SELECT props AS v FROM events UNION ALL SELECT text FROM benchmark) GROUP BY 1",
    "ods_date_partition": "SELECT strftime(ts, '%Y-%m-%d') AS dt, count(*) AS n FROM events GROUP BY 1",
    "cdc_map_projection": "SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS order_status, CAST(o_custkey AS VARCHAR) AS customer, CAST(epoch(o_orderdate) AS BIGINT) AS ts FROM orders WHERE o_orderstatus = 'O'",
    "cdc_write_ops": "SELECT CASE WHEN o_orderstatus = 'O' THEN 'insert' ELSE 'update' END AS type, o_orderstatus AS order_status, count(*) AS n FROM orders GROUP BY ALL",
    "cart_add_delta": f"WITH {LOG}, b AS (SELECT *, lag(k) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM pl) SELECT event_id, user_id, CASE WHEN before IS NULL THEN k ELSE k - before END AS sku_num, n_name AS dic_name FROM b JOIN nation ON k % 25 = n_nationkey WHERE before IS NULL OR k > before",
    "order_added": "SELECT CAST(o_orderkey AS VARCHAR) AS order_id, CAST(epoch(o_orderdate) AS BIGINT) AS ts FROM orders WHERE o_orderstatus = 'O'",
    "status_transition": f"WITH {CHANGES} SELECT o_orderkey AS order_id, before_status AS old_status FROM oc WHERE o_orderstatus = 'F' AND before_status <> 'F'",
    "status_value": "SELECT o_orderkey AS order_id FROM orders WHERE o_orderstatus = 'P'",
    "changed_key_keep_null": f"WITH {CHANGES} SELECT type, count(*) AS n FROM oc WHERE type = 'insert' OR before_key IS NULL OR before_priority <> o_orderpriority GROUP BY type",
    "changed_key_drop_null": f"WITH {CHANGES} SELECT type, count(*) AS n FROM oc WHERE type = 'update' AND before_priority <> o_orderpriority GROUP BY type",
    "coupon_pay_not_null": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS payment_time, strftime(o_orderdate, '%Y-%m-%d') AS date_id FROM orders WHERE o_orderstatus <> 'O'",
    "coupon_get": "SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS date_id, CAST(epoch(o_orderdate) AS BIGINT) * 1000 AS ts_ms FROM orders WHERE o_orderstatus = 'O'",
    "favor_toggle": f"WITH {LOG}, b AS (SELECT *, lag(k % 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM pl) SELECT event_id, user_id, CASE WHEN before IS NULL THEN 'insert' ELSE 'update' END AS type FROM b WHERE before IS NULL OR (before = 1 AND k % 2 = 0)",
    "dim_route_prune": """SELECT 'dim_user' AS sink_table, CAST(c_custkey AS VARCHAR) AS pk, x.col, x.value FROM customer, LATERAL (VALUES ('id', CAST(c_custkey AS VARCHAR)), ('seg', c_mktsegment)) AS x(col, value) WHERE c_custkey % 7 <> 0
UNION ALL SELECT 'dim_seller', CAST(s_suppkey AS VARCHAR), x.col, x.value FROM supplier, LATERAL (VALUES ('id', CAST(s_suppkey AS VARCHAR)), ('name', s_name)) AS x(col, value) WHERE s_suppkey % 7 <> 0""",
    "dim_upsert_latest": "SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "lookup_inner": "SELECT c_custkey, c_nationkey, n_name AS dic_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey % 3 <> 0",
    "lookup_left": "SELECT c_custkey, c_nationkey, n_name AS dic_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 3 <> 0) ON c_nationkey = n_nationkey",
    "lookup_user_function": "SELECT c_custkey, n_regionkey || '/' || lower(n_name) AS place, CASE WHEN n_name IS NULL THEN 'unknown' ELSE c_mktsegment END AS own_segment FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 4 <> 1) ON c_nationkey = n_nationkey",
    "lookup_two_roles": "SELECT a.n_name AS customer_nation, b.n_name AS supplier_nation, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation a ON c_nationkey = a.n_nationkey LEFT JOIN nation b ON s_nationkey = b.n_nationkey GROUP BY 1, 2",
    "order_detail_wide": "SELECT n_name AS dic_name, o_orderstatus, count(*) AS n, count(*) FILTER (l_partkey % 3 = 0) AS activities, count(*) FILTER (l_partkey % 5 = 0) AS coupons, " + money("CAST(l_extendedprice AS DECIMAL(16,2)) * CAST(l_quantity AS DECIMAL(16,2))") + " AS original FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN nation ON l_suppkey % 25 = n_nationkey GROUP BY 1, 2",
    "payment_success": f"SELECT n_name AS payment_type_name, count(*) AS n, count(DISTINCT o_custkey) AS users, {money('l_extendedprice')} AS paid FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON o_custkey % 25 = n_nationkey WHERE o_orderstatus = 'F' GROUP BY 1",
    "refund_request": f"SELECT o.o_custkey % 34 AS province_id, a.n_name AS refund_type_name, count(*) AS n, count(b.n_name) AS reasons, {money('l_quantity')} AS quantity FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') o ON l_orderkey = o_orderkey LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) a ON l_partkey % 25 = a.n_nationkey LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) b ON l_suppkey % 25 = b.n_nationkey WHERE l_returnflag = 'R' GROUP BY 1, 2",
    "refund_payment": f"""WITH req AS (SELECT * FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 10 QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_quantity DESC, l_extendedprice DESC) = 1)
SELECT n_name AS payment_type_name, count(*) AS n, count(o.o_orderkey) AS with_order, count(req.l_quantity) AS with_request, {money('req.l_quantity')} AS refund_num, {money('l.l_extendedprice')} AS amount
FROM lineitem l LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') o ON l.l_orderkey = o_orderkey LEFT JOIN req ON req.l_orderkey = l.l_orderkey AND req.l_partkey = l.l_partkey LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON l.l_partkey % 25 = n_nationkey
WHERE l.l_returnflag = 'R' AND l.l_linestatus = 'F' GROUP BY 1""",
    "comment_grade": "SELECT o_orderkey, o_custkey % 30 AS appraise_code, n_name AS appraise_name FROM orders LEFT JOIN nation ON o_custkey % 30 = n_nationkey",
    "log_fan_out": f"WITH {LOG} SELECT route, count(*) AS n, max(CAST(epoch(date_trunc('second', ts)) AS BIGINT)) AS last_second FROM (SELECT CASE WHEN event_type = 'signup' THEN 'start' ELSE 'page' END AS route, ts FROM pl UNION ALL SELECT 'error', ts FROM pl WHERE k % 10 = 0) GROUP BY 1",
    "explode_with_parent": "SELECT label, CAST(pos AS INTEGER) AS pos, count(*) AS n, CAST(sum(CAST(round(CAST(embedding[pos + 1] AS DOUBLE) * 1e6) AS BIGINT)) AS BIGINT) AS micro FROM (SELECT label, embedding, unnest(range(len(embedding))) AS pos FROM embeddings) GROUP BY 1, 2",
    "is_new_repair": f"WITH {LOG}, f AS (SELECT *, k % 2 AS is_new, first_value(day) OVER w AS fday, first_value(k % 2) OVER w AS fflag FROM pl WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT event_id, user_id, CASE WHEN is_new = 1 AND day <> CASE WHEN fflag = 1 THEN fday ELSE fday - 1 END THEN 0 ELSE is_new END AS is_new FROM f",
    "unique_visitor": f"WITH {LOG}, {VISITORS} SELECT event_id, user_id, strftime(day, '%Y-%m-%d') AS dt FROM vis",
    "user_jump": f"WITH {LOG}, {JUMPS} SELECT event_id, user_id FROM jmp",
    "keyword_count": r"SELECT lang, word, count(*) AS ct FROM (SELECT lang, unnest(string_split_regex(lower(text), '[^\p{L}\p{N}]+')) AS word FROM documents) WHERE word <> '' GROUP BY 1, 2",
    "keyword_window": f"SELECT {HOUR}, keyword, count(*) AS keyword_count FROM (SELECT ts, unnest([event_type, 'search']) AS keyword FROM events) GROUP BY ALL",
    "page_view_by_dims": f"""WITH {LOG}, {VISITORS}, {JUMPS}, u AS (
SELECT ts, k, user_id, 0 AS uv, CASE WHEN entry THEN 1 ELSE 0 END AS sv, 1 AS pv, coalesce(value, 0) AS dur, 0 AS uj FROM pl
UNION ALL SELECT ts, k, user_id, 1, 0, 0, 0, 0 FROM vis UNION ALL SELECT ts, k, user_id, 0, 0, 0, 0, 1 FROM jmp)
SELECT {DAY}, 'v' || (k % 3) AS vc, 'c' || (user_id % 4) AS ch, 'a' || (user_id % 5) AS ar, CAST(k % 2 AS VARCHAR) AS is_new, CAST(sum(uv) AS BIGINT) AS uv_ct, CAST(sum(sv) AS BIGINT) AS sv_ct, CAST(sum(pv) AS BIGINT) AS pv_ct, {money('dur')} AS dur_sum, CAST(sum(uj) AS BIGINT) AS uj_ct FROM u GROUP BY ALL""",
    "home_detail_uv": f"WITH {LOG}, f AS (SELECT * FROM pl WHERE event_type IN ('view', 'click') QUALIFY row_number() OVER (PARTITION BY user_id, event_type, day ORDER BY ts, event_id) = 1) SELECT {DAY}, count(*) FILTER (event_type = 'view') AS home_uv_ct, count(*) FILTER (event_type = 'click') AS good_detail_uv_ct FROM f GROUP BY ALL",
    "login_back": "WITH d AS (SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) AS day FROM orders), b AS (SELECT *, day - lag(day) OVER (PARTITION BY o_custkey ORDER BY day) AS gap FROM d) SELECT strftime(day, '%Y-%m-%d') AS dt, count(*) AS uu_ct, count(*) FILTER (gap >= 8) AS back_ct FROM b GROUP BY 1",
    "register_window": f"SELECT {HOUR}, count(*) AS register_ct FROM events WHERE event_type = 'signup' GROUP BY ALL",
    "user_register": "SELECT user_id, strftime(ts, '%Y-%m-%d') AS date_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS create_time FROM events WHERE event_type = 'signup'",
    "cart_uu": f"WITH {LOG}, f AS (SELECT * FROM pl WHERE event_type = 'purchase' QUALIFY row_number() OVER (PARTITION BY user_id, day ORDER BY ts, event_id) = 1) SELECT {HOUR}, count(*) AS cart_add_uu_ct FROM f GROUP BY ALL",
    "order_detail_latest": f"WITH {LATEST} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM det",
    "order_window": f"""WITH {LATEST}, d AS (SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) AS day FROM orders), u AS (SELECT day, count(*) AS uu, count(*) FILTER (first) AS nu FROM (SELECT *, day = min(day) OVER (PARTITION BY o_custkey) AS first FROM d) GROUP BY day),
s AS (SELECT CAST(o_orderdate AS DATE) AS day, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) AS a, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(18,2))) AS DOUBLE) AS c, {money('l_extendedprice')} AS o FROM det JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)
SELECT strftime(u.day, '%Y-%m-%d') AS day, uu AS order_unique_user_count, nu AS order_new_user_count, a AS order_activity_reduce_amount, c AS order_coupon_reduce_amount, o AS order_origin_total_amount FROM u LEFT JOIN s ON u.day = s.day""",
    "brand_category_user_order": f"""WITH {LATEST} SELECT {DAY.replace('ts)', 'o_orderdate)')}, p_brand AS trademark_name, r_name AS category1_name, n_name AS category2_name, p_type AS category3_name, o_custkey, p_name AS spu_name, count(*) AS order_count, {money('l_extendedprice')} AS order_amount
FROM det JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""",
    "order_detail_fact": "SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS order_detail_id, l_orderkey AS order_id, o_custkey, o_orderstatus, CASE WHEN l_partkey % 3 = 0 THEN l_partkey END AS activity_id, CASE WHEN l_partkey % 5 = 0 THEN l_partkey END AS coupon_id, n_name AS dic_name, CAST(CAST(CAST(l_extendedprice AS DECIMAL(16,2)) * CAST(l_quantity AS DECIMAL(16,2)) AS DECIMAL(18,2)) AS DOUBLE) AS split_original_amount FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN nation ON l_suppkey % 25 = n_nationkey",
    "payment_fact": "SELECT o_orderkey AS order_id, o_custkey AS user_id, l_linenumber, l_extendedprice, 'c' || (o_custkey % 25) AS payment_type_code, n_name AS payment_type_name FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON o_custkey % 25 = n_nationkey WHERE o_orderstatus = 'F'",
    "refund_request_fact": "SELECT l_orderkey AS order_id, l_partkey AS sku_id, l_quantity, o.o_custkey % 34 AS province_id, a.n_name AS refund_type_name, b.n_name AS refund_reason_type_name FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') o ON l_orderkey = o_orderkey LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) a ON l_partkey % 25 = a.n_nationkey LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) b ON l_suppkey % 25 = b.n_nationkey WHERE l_returnflag = 'R'",
    "refund_payment_fact": """WITH req AS (SELECT * FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 10 QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_quantity DESC, l_extendedprice DESC) = 1)
SELECT l.l_orderkey AS order_id, l.l_partkey AS sku_id, l.l_extendedprice, o.o_custkey AS user_id, o.o_custkey % 34 AS province_id, req.l_quantity AS refund_num, n_name AS payment_type_name
FROM lineitem l LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') o ON l.l_orderkey = o_orderkey LEFT JOIN req ON req.l_orderkey = l.l_orderkey AND req.l_partkey = l.l_partkey LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON l.l_partkey % 25 = n_nationkey
WHERE l.l_returnflag = 'R' AND l.l_linestatus = 'F'""",
    "coupon_order_fact": f"WITH {CHANGES} SELECT o_orderkey AS id, CASE WHEN before_priority <> o_orderpriority THEN before_priority END AS old_priority, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS order_time FROM oc WHERE type = 'update' AND (before_key IS NULL OR before_priority <> o_orderpriority)",
    "log_five_routes": f"""WITH {LOG}, {REPAIRED}, r AS (SELECT event_type, k, CASE WHEN event_type <> 'signup' THEN event_type END AS page_id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS second,
'"ts":' || (epoch_us(ts) // 1000) AS moment, '"common":{{"is_new":"' || is_new || '","mid":"' || user_id || '","sid":"s' || (user_id % 10) || '"}}' AS common,
CASE WHEN event_type = 'signup' THEN ',"start":{{"entry":"icon"}}' WHEN event_type = 'view' THEN ',"page":{{"page_id":"view"}}' ELSE ',"page":{{"last_page_id":"home","page_id":"' || event_type || '"}}' END AS main,
CASE WHEN k % 10 = 0 THEN ',"err":{{"error_code":1}}' ELSE '' END || ',"extra":{{"k":' || k || '}}' AS rest, CASE WHEN k % 7 = 0 THEN '"actions":[{{"action_id":"cart_add"}}],' ELSE '' END AS done,
CASE WHEN k % 3 = 0 THEN ',"displays":[{{"item":"1","order":1}},{{"item":"2","order":2}}]' ELSE '' END AS shown FROM rep),
b AS (SELECT *, '{{' || done || common || shown || rest || main || ',' || moment || '}}' AS whole, '"page_id":"' || page_id || '",' || moment || ',' || common || '}}' AS parent FROM r),
o AS (SELECT 'error' AS route, page_id, second, whole AS body FROM b WHERE k % 10 = 0 UNION ALL SELECT 'start', page_id, second, whole FROM b WHERE event_type = 'signup'
UNION ALL SELECT 'page', page_id, second, '{{' || common || rest || main || ',' || moment || '}}' FROM b WHERE event_type <> 'signup'
UNION ALL SELECT 'display', page_id, second, unnest(['{{"item":"1","order":1,', '{{"item":"2","order":2,']) || parent FROM b WHERE event_type <> 'signup' AND k % 3 = 0
UNION ALL SELECT 'action', page_id, second, '{{"action_id":"cart_add",' || parent FROM b WHERE event_type <> 'signup' AND k % 7 = 0)
SELECT route, page_id, second, md5(body) AS body_md5 FROM o""",
    "search_keyword_window": f"WITH {LOG} SELECT {HOUR}, 'search' AS source, keyword, count(*) AS keyword_count FROM (SELECT ts, unnest([event_type, CAST(k AS VARCHAR)]) AS keyword FROM pl WHERE k % 6 = 0) GROUP BY ALL",
    "logged_in_entries": f"WITH {LOG} SELECT event_id, user_id FROM pl WHERE entry AND k % 3 <> 0 AND k % 10 <> 0",
    "login_window": f"WITH {LOG}, d AS (SELECT DISTINCT user_id, day FROM pl WHERE entry AND k % 3 <> 0 AND k % 10 <> 0), b AS (SELECT *, day - lag(day) OVER (PARTITION BY user_id ORDER BY day) AS gap FROM d) SELECT strftime(day, '%Y-%m-%d') AS dt, count(*) AS uu_ct, count(*) FILTER (gap >= 8) AS back_ct FROM b GROUP BY 1",
    "cart_uu_fallback": f"WITH {LOG}, a AS (SELECT event_id, user_id, date_trunc('second', ts) - CASE WHEN k % 4 <> 0 THEN INTERVAL 0 DAY ELSE INTERVAL 1 DAY END AS moment FROM pl WHERE event_type = 'purchase'), f AS (SELECT moment AS ts FROM a QUALIFY row_number() OVER (PARTITION BY user_id, CAST(moment AS DATE) ORDER BY moment, event_id) = 1) SELECT {DAY}, count(*) AS cart_add_uu_ct FROM f GROUP BY ALL",
    "inserted_details": "SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS order_detail_id, CAST(l_orderkey AS VARCHAR) AS order_id FROM lineitem WHERE l_linenumber <> 7 AND l_returnflag <> 'R'",
    "camel_rename": 'SELECT c_custkey AS "cCustkey", c_mktsegment AS "cMktsegment", c_nationkey AS "cNationkey" FROM customer',
    "time_functions": """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS time_text, epoch_ms(date_trunc('second', ts)) AS ms, epoch_ms(CAST(CAST(ts AS DATE) AS TIMESTAMP)) AS day_ms,
CASE WHEN date_trunc('second', ts) < CAST(ts AS DATE) + INTERVAL 12 HOUR THEN -1 WHEN date_trunc('second', ts) > CAST(ts AS DATE) + INTERVAL 12 HOUR THEN 1 ELSE 0 END AS after_noon,
epoch_ms(CAST(CAST(ts AS DATE) AS TIMESTAMP)) // 86400000 AS epoch_day, strftime(CAST(ts AS DATE) - 1, '%Y-%m-%d') AS day_before, CAST(CAST(ts AS DATE) - DATE '2020-01-01' AS INTEGER) AS days_since FROM events""",
    "scalar_functions": "SELECT o_orderkey, TRY_CAST(o_orderpriority AS INTEGER) AS bad_int, CAST(CAST(o_totalprice AS DECIMAL(16,2)) AS DOUBLE) AS amount, CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS is_open, CAST(len(string_split(o_orderpriority, '-')) AS INTEGER) AS parts, true AS row_is_json, o_orderstatus AS status_back, 'search' AS source FROM orders",
    "table_count": "SELECT count(*) AS ct FROM lineitem",
    **keyed.SQL,
}
SQL["search_keyword_lateral"] = SQL["search_keyword_window"]
