"""Queries that run several micro-batches through keyed tables, so that their changelogs can be held against SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater import sinks, sources
from tidewater.session import shared_folder
from tidewater.streaming import jobs
from tidewater.streaming.updating import Side, UpdatingJoin


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _latest_orders(spark, d, path):
    """Runs the batches of changelog_replay one by one into ``path``."""
    orders = _t(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey", (F.col("o_orderstatus") == "P").alias("gone"), F.quarter("o_orderdate").alias("q"))
    for q in range(1, 5):
        yield sinks.upsert(orders.filter(F.col("q") == q).drop("q"), path, ["o_custkey"], ["o_orderdate", "o_orderkey"], "gone", q, parts=8)


def changelog_replay(spark, d):
    """The latest order of each customer as a keyed table, orders coming in by quarter of the year (so that older ones come later), pending ones as deletes.

    Counts of the changes of each batch, of the table, and of the table that the changelog replays to.
    """
    path = f"{shared_folder(spark)}/latest"
    for _ in _latest_orders(spark, d, path):
        pass
    log = sinks.read_changes(spark, path)
    counted = lambda rows, stage: rows.groupBy(stage.alias("stage")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("orders"))
    table = counted(sinks.read_keyed(spark, path), F.lit("table"))
    replayed = counted(sinks.replay(log, ["o_custkey"]), F.lit("replayed"))
    return counted(log, F.concat_ws(" ", "commit", "row_kind")).unionByName(table).unionByName(replayed)


def upsert_topic(spark, d):
    """The table of changelog_replay published as upsert records, twice after two batches each, and read into a second table, newest records first.

    Counts of the records by the batch that they came from, with a row or as tombstones, and of the second table.
    """
    root = shared_folder(spark)
    for n, _ in enumerate(_latest_orders(spark, d, f"{root}/latest")):
        if n % 2:
            sinks.publish(spark, f"{root}/latest", ["o_custkey"], f"{root}/topic")
    rows = sources.upserts(sources.keyed_records(spark, f"{root}/topic/records"), sinks.read_keyed(spark, f"{root}/latest").schema)
    for n in reversed(range(4)):
        sinks.upsert(rows.filter(F.col("offset") == n), f"{root}/copy", ["o_custkey"], ["offset"], "gone", parts=8)
    counted = lambda some, stage: some.groupBy(stage.alias("stage")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("orders"))
    return counted(rows, F.concat("offset", F.when(F.col("gone"), " tombstone").otherwise(" row"))).unionByName(counted(sinks.read_keyed(spark, f"{root}/copy"), F.lit("copy")))


def updating_join(spark, d):
    """Orders with their customers, each coming in three batches: an order whose customer is not there goes out without, and again later."""
    join = UpdatingJoin(f"{shared_folder(spark)}/join", ["o_orderkey"], [], {"customers": Side(["o_custkey"], [])}, parts=8)
    orders = _t(spark, d, "orders").select("o_orderkey", "o_custkey", F.floor((F.month("o_orderdate") - 1) / 4).alias("b"))
    customers = _t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", F.floor(F.col("c_nationkey") / 9).alias("b"))
    for b in range(3):
        join.apply(orders.filter(F.col("b") == b).drop("b"), b, customers=customers.filter(F.col("b") == b).drop("b"))
    counted = lambda rows, stage: rows.groupBy(stage.alias("stage")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("orders"), F.count("c_name").alias("named"))
    return counted(join.changes(spark), F.concat_ws(" ", "commit", "row_kind")).unionByName(counted(join.result(spark), F.lit("table")))


def dimension_load(spark, d):
    """Dimension tables after five micro-batches that touch them by turns: customers, suppliers, newer customers, older ones together with
    a configuration that stops the suppliers and brings the parts, and parts with suppliers."""
    root = f"{shared_folder(spark)}/dims"
    kind = "`table` string, type string, ts long, data map<string,string>"

    def rows(source: str, key: str, ts: int, where: str = "true", **columns) -> DataFrame:
        pairs = [x for k, c in ({"id": F.col(key)} | columns).items() for x in (F.lit(k), c.cast("string"))]
        return _t(spark, d, source).filter(where).select(F.lit(source).alias("table"), F.lit("update").alias("type"), F.lit(ts).cast("long").alias("ts"), F.create_map(*pairs).alias("data"))

    def setting(ts: int, source: str, sink: str, columns: str, of: str = "insert") -> tuple:
        return "table_process", of, ts, {"source_table": source, "sink_table": sink, "sink_columns": columns}

    settings = lambda *s: spark.createDataFrame(list(s), kind)
    each = jobs.load_dimensions(None, root, parts=4)
    customers = lambda ts, where, name, seg: rows("customer", "c_custkey", ts, where, name=name, seg=seg)
    batches = [
        settings(setting(0, "customer", "dim_user", "id,name,seg"), setting(0, "supplier", "dim_seller", "id, name")).union(customers(1, "true", F.col("c_name"), F.col("c_mktsegment"))),
        rows("supplier", "s_suppkey", 1, name=F.col("s_name"), secret=F.lit("x")),
        customers(3, "c_nationkey < 10", F.col("c_name"), F.lit("NEW")),
        customers(2, "true", F.concat("c_name", F.lit("!")), F.lit("OLD")).union(settings(setting(4, "supplier", "dim_seller", "id", "delete"), setting(4, "part", "dim_part", "id,name"))),
        rows("part", "p_partkey", 1, name=F.col("p_brand")).union(rows("supplier", "s_suppkey", 9, name=F.lit("late"))),
    ]
    for n, batch in enumerate(batches):
        each(batch, n)
    out = [sinks.read_keyed(spark, f"{root}/{t}") for t in ("dim_user", "dim_seller", "dim_part")]
    shaped = [o.select(F.lit(t).alias("dim"), "id", "name", F.col("seg") if "seg" in o.columns else F.lit(None).cast("string").alias("seg"), "ts") for t, o in zip(("user", "seller", "part"), out, strict=True)]
    return shaped[0].unionByName(shaped[1]).unionByName(shaped[2])


def late_lanes(spark, d):
    """Events in three batches, those more than ten days behind the newest of earlier batches set aside: rows and newest time by batch and lane."""
    path = f"{shared_folder(spark)}/lanes"
    each = sinks.split_late(path, "ts", 864_000)
    events = _t(spark, d, "events").select("event_id", "ts", F.floor(F.get_json_object("props", "$.k").cast("int") / 34).alias("b"))
    for b in range(3):
        each(events.filter(F.col("b") == b), b)
    landed = spark.read.option("basePath", path).parquet(*[f"{path}/batch={b}" for b in range(3)])
    return landed.groupBy("b", "lane").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("events"))


QUERIES = {"changelog_replay": changelog_replay, "updating_join": updating_join, "dimension_load": dimension_load, "late_lanes": late_lanes, "upsert_topic": upsert_topic}

#: Latest orders after each batch (l), and those that stay (live).
_CHANGED = """WITH b AS (SELECT o_custkey AS k, o_orderkey AS v, o_orderdate AS d, o_orderstatus = 'P' AS gone, quarter(o_orderdate) AS q FROM orders),
t AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY k, q ORDER BY d DESC, v DESC) = 1),
s AS (SELECT a.k, a.q, c.v, c.gone FROM t a JOIN t c ON a.k = c.k AND c.q <= a.q QUALIFY row_number() OVER (PARTITION BY a.k, a.q ORDER BY c.d DESC, c.v DESC) = 1),
l AS (SELECT *, coalesce(lag(gone) OVER w, true) AS was_gone, lag(v) OVER w AS was FROM s WINDOW w AS (PARTITION BY k ORDER BY q)),
live AS (SELECT v FROM (SELECT *, max(q) OVER (PARTITION BY k) AS last FROM s) WHERE q = last AND NOT gone),
"""

SQL = {
    "changelog_replay": _CHANGED + """c AS (SELECT (q - 1) || ' +I' AS stage, v FROM l WHERE NOT gone AND was_gone UNION ALL SELECT (q - 1) || ' -D', was FROM l WHERE gone AND NOT was_gone
 UNION ALL SELECT (q - 1) || ' -U', was FROM l WHERE NOT gone AND NOT was_gone AND v <> was UNION ALL SELECT (q - 1) || ' +U', v FROM l WHERE NOT gone AND NOT was_gone AND v <> was
 UNION ALL SELECT 'table', v FROM live UNION ALL SELECT 'replayed', v FROM live)
SELECT stage, count(*) AS n, CAST(sum(v) AS BIGINT) AS orders FROM c GROUP BY stage""",
    "upsert_topic": _CHANGED + """c AS (SELECT (q - 1) || ' row' AS stage, v FROM l WHERE NOT gone AND (was_gone OR v <> was) UNION ALL SELECT (q - 1) || ' tombstone', NULL FROM l WHERE gone AND NOT was_gone UNION ALL SELECT 'copy', v FROM live)
SELECT stage, count(*) AS n, CAST(sum(v) AS BIGINT) AS orders FROM c GROUP BY stage""",
    "updating_join": """WITH o AS (SELECT o_orderkey, c_name, (month(o_orderdate) - 1) // 4 AS b, c_nationkey // 9 AS cb FROM orders LEFT JOIN customer ON o_custkey = c_custkey),
c AS (SELECT b || ' +I' AS stage, o_orderkey, CASE WHEN cb <= b THEN c_name END AS c_name FROM o UNION ALL SELECT cb || ' -U', o_orderkey, NULL FROM o WHERE cb > b
 UNION ALL SELECT cb || ' +U', o_orderkey, c_name FROM o WHERE cb > b UNION ALL SELECT 'table', o_orderkey, c_name FROM o)
SELECT stage, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS orders, count(c_name) AS named FROM c GROUP BY stage""",
    "dimension_load": """SELECT 'user' AS dim, CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_nationkey < 10 THEN c_name ELSE c_name || '!' END AS name, CASE WHEN c_nationkey < 10 THEN 'NEW' ELSE 'OLD' END AS seg, CAST(CASE WHEN c_nationkey < 10 THEN 3 ELSE 2 END AS BIGINT) AS ts FROM customer
UNION ALL SELECT 'seller', CAST(s_suppkey AS VARCHAR), s_name, NULL, 1 FROM supplier UNION ALL SELECT 'part', CAST(p_partkey AS VARCHAR), p_brand, NULL, 1 FROM part""",
    "late_lanes": """WITH e AS (SELECT event_id, ts, CAST(json_extract_string(props, '$.k') AS INTEGER) // 34 AS b FROM events),
m AS (SELECT b, epoch_us(max(ts)) // 1000 AS newest FROM e GROUP BY b), w AS (SELECT a.b, max(c.newest) - 864000000 AS low FROM m a LEFT JOIN m c ON c.b < a.b GROUP BY a.b)
SELECT CAST(b AS BIGINT) AS b, CASE WHEN epoch_us(ts) // 1000 < low THEN 'late' ELSE 'on_time' END AS lane, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS events FROM e JOIN w USING (b) GROUP BY 1, 2""",
}
