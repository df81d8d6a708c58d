"""Jobs as streams equal the same jobs over tables, on hand-made logs and change records; keyed tables and readers on files."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from tidewater import sinks, sources, streaming
from tidewater.operators import changes as ch
from tidewater.operators import logs
from tidewater.streaming import jobs

T0 = dt.datetime(2024, 1, 1, 10, tzinfo=dt.UTC)


def text(s):
    return (T0 + dt.timedelta(seconds=s)).strftime("%Y-%m-%d %H:%M:%S")


def change(s, table, kind="insert", old=None, **data):
    return json.dumps({"database": "shop", "table": table, "type": kind, "ts": int(T0.timestamp()) + s, "data": {k: str(v) for k, v in data.items()}, "old": old})


def visit(s, mid, page, last=None, uid=None, item=None, item_type=None, is_new="1", **more):
    page = {"page_id": page, "last_page_id": last, "during_time": 10 + s % 7, "item": item, "item_type": item_type}
    common = {"mid": mid, "vc": "v1", "ch": "app", "ar": "north", "is_new": is_new, "uid": uid}
    return json.dumps({"common": common, "page": {k: v for k, v in page.items() if v is not None}, "ts": 1000 * (int(T0.timestamp()) + s)} | more)


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def both(spark, folder, values, build, parts=2, mode="append"):
    """Rows of ``build`` over a table of the JSON texts, and over a stream that reads them from ``parts`` files, one at a time."""
    folder.mkdir()
    size = -(-len(values) // parts)
    for k in range(parts):
        (folder / f"{k}.txt").write_text("".join(v + "\n" for v in values[k * size : (k + 1) * size]))
        os.utime(folder / f"{k}.txt", (10**9 + 10 * k,) * 2)  # files are read in the order of their times
    table = build(sources.strings(spark, str(folder)))
    stream = build(sources.strings(spark, str(folder), stream=True, maxFilesPerTrigger="1", latestFirst="false"))
    name = folder.name.replace("-", "_")
    stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{folder}-ck").trigger(availableNow=True).start().awaitTermination()
    order = lambda rows: sorted((r.asDict(recursive=True) for r in rows), key=str)
    return order(table.collect()), order(spark.table(name).select(*table.columns).collect())


LOG = [
    visit(0, "m1", "home"), visit(1, "m1", "good_list", "home", err={"error_code": 5, "msg": "x"}, displays=[{"item": "1", "order": 1}, {"item": "2", "order": 2}], actions=[{"action_id": "cart"}]),
    '{"common":{"mid":"m2"},"start":{"entry":"icon"},"err":{"error_code":1},"ts":5}', "{bad", "", "7", '{"ts":3}', visit(9, "m2", "search", "home"),
]


def test_split_log(spark, tmp_path):
    table, stream = both(spark, tmp_path / "split", LOG, jobs.split_log, mode="update")
    assert table == stream
    routes = [r["route"] for r in table]
    assert {r: routes.count(r) for r in set(routes)} == {"page": 3, "error": 2, "start": 1, "display": 2, "action": 1, "dirty": 4}
    assert {r["page_id"] for r in table if r["route"] in ("display", "action")} == {"good_list"}
    page = json.loads(next(r["body"] for r in table if r["route"] == "page" and r["page_id"] == "good_list"))
    assert set(page) == {"common", "page", "err", "ts"}


def test_log_bodies(spark, tmp_path):
    """Bodies are the whole object; display and action carry their page; flags are repaired by device across batches, with or without a schema's fields."""
    logs_ = [
        visit(0, "m1", "home", sid="s1"), visit(1, "m1", "good_list", "home", extra={"a": [1, None, {"b": "é"}]}, displays=[{"item": "1", "page_id": "old"}, {"item": "2", "deep": {"x": 1.5}}], actions=[{"action_id": "cart", "n": 3}]),
        json.dumps({"common": {"mid": "m2", "is_new": "1"}, "start": {"entry": "icon", "ms": 7}, "err": {"error_code": 1}, "ts": 1000 * int(T0.timestamp())}), json.dumps({"page": {"page_id": "bare"}}), json.dumps({"common": {"is_new": "1"}, "page": {"page_id": "nobody"}, "ts": 5}),
        visit(86400, "m1", "home"), json.dumps({"common": {"mid": "m2", "is_new": "1", "uid": None}, "start": None, "page": {"page_id": "next"}, "displays": [], "err": None, "ts": 1000 * (int(T0.timestamp()) + 86400)}), visit(86401, "m3", "home", is_new="0"), visit(86402, "m3", "home"),
    ]
    table, stream = both(spark, tmp_path / "bodies", logs_, jobs.split_log, 3, "update")
    assert table == stream
    got = {(r["route"], r["page_id"], r["ts"]): json.loads(r["body"]) for r in table}
    raw = [json.loads(v) for v in logs_]
    assert got["start", None, raw[2]["ts"]] == got["error", None, raw[2]["ts"]] == raw[2]
    assert got["page", "good_list", raw[1]["ts"]] == {k: v for k, v in raw[1].items() if k not in ("displays", "actions")} and got["page", "bare", None] == raw[3] and got["page", "nobody", 5] == raw[4]
    parent = {"page_id": "good_list", "ts": raw[1]["ts"], "common": raw[1]["common"]}
    shown = [json.loads(r["body"]) for r in table if r["route"] == "display"]
    assert sorted(shown, key=lambda x: x["item"]) == [{"item": "1"} | parent, {"item": "2", "deep": {"x": 1.5}} | parent]
    assert got["action", "good_list", raw[1]["ts"]] == {"action_id": "cart", "n": 3} | parent
    flags = {k[1:]: v["common"].get("is_new") for k, v in got.items() if k[0] == "page" and "common" in v}
    assert flags == {("home", raw[0]["ts"]): "1", ("good_list", raw[1]["ts"]): "1", ("nobody", 5): "1", ("home", raw[5]["ts"]): "0", ("next", raw[6]["ts"]): "0", ("home", raw[7]["ts"]): "0", ("home", raw[8]["ts"]): "0"}
    assert len(table) == 13


def test_repair_keeps_rows_without_a_key(spark):
    rows = spark.createDataFrame([(None, 1, 1), ("a", 1, 1), ("a", 2, 1), (None, 2, 1)], "mid string, day int, is_new int").withColumn("day", F.date_add(F.lit("2024-01-01"), F.col("day")))
    got = sorted(((r.mid or "", r.day.day, r.is_new) for r in logs.repair_is_new(rows, "mid", "day", "is_new", ["day"]).collect()))
    assert got == [("", 2, 1), ("", 3, 1), ("a", 2, 1), ("a", 3, 0)]


VISITS = [
    visit(0, "a", "home", uid="u1"), visit(1, "a", "good_detail", "home"), visit(2, "b", "home"), visit(3, "b", "good_list", "search", item="red Apple", item_type="keyword"),
    visit(4, "a", "home"), visit(12, "c", "good_list", "search", item="apple-pie", item_type="keyword"), visit(13, "c", "good_detail", "search", item="7", item_type="sku_id"),
    visit(86400, "a", "home"), visit(86401, "a", "good_detail", "home", item="x"),
]
LAST = [visit(9 * 86400, "z", "other", "other"), visit(9 * 86400 + 1, "z", "other", "other")]


def test_visits(spark, tmp_path):
    table, stream = both(spark, tmp_path / "uv", VISITS, lambda v: jobs.unique_visitors(jobs.pages(v)).select("mid", "ts"))
    assert table == stream and [r["mid"] for r in table] == ["a", "a", "b"]
    entries = logs.logged_in_entries(jobs.pages(spark.createDataFrame([(v,) for v in VISITS], "value string"))).collect()
    assert [r.common["uid"] for r in entries] == ["u1"]


def test_keywords(spark, tmp_path):
    table, stream = both(spark, tmp_path / "words", VISITS + LAST, lambda v: jobs.keyword_views(jobs.pages(v)))
    assert {(r["stt"][11:], r["keyword"]): r["keyword_count"] for r in table} == {("10:00:00", "red"): 1, ("10:00:00", "apple"): 1, ("10:00:10", "apple"): 1, ("10:00:10", "pie"): 1}
    assert stream == table  # pages that are no searches move the watermark too
    own = F.pandas_udf(lambda s: s.map(lambda t: t.split("-") if "-" in t else None), "array<string>")
    words = logs.explode_words(spark.createDataFrame([("a-b",), ("c d",)], "t string"), "t", own).collect()
    assert [r.word for r in words] == ["a", "b", "c d"]


def test_home_and_detail(spark, tmp_path):
    later = [visit(k * 86400, "z", "home") for k in (5, 6)]
    table, stream = both(spark, tmp_path / "uv2", VISITS + later, lambda v: jobs.home_and_detail(jobs.pages(v), "1 day"), 4)
    assert [(r["home_uv_ct"], r["good_detail_uv_ct"]) for r in table] == [(2, 2), (1, 1), (1, 0), (1, 0)]
    assert stream[:2] == table[:2] and stream == table[: len(stream)]


BOUNCES = [visit(20, "d", "home"), visit(22, "e", "home"), visit(21, "e", "good_list", "home"), visit(35, "d", "good_list", "home"), visit(40, "f", "home"), visit(41, "f", "home"), visit(60, "f", "other", "home")]


def test_bounced(spark, tmp_path):
    """Bounces of the page log by text devices, rows out of order within the delay, as a stream and as a table."""
    rows = [*VISITS[:7], *BOUNCES, *VISITS[7:], *LAST]
    table, stream = both(spark, tmp_path / "bounced", rows, lambda v: jobs.bounced(jobs.pages(v)), 4)
    t0 = 1000 * int(T0.timestamp())
    got = {(r["common"]["mid"], (r["ts"] - t0) // 1000) for r in table}
    assert got == {("d", 20), ("e", 22), ("f", 40), ("f", 41), ("a", 4)} and stream == table


def test_logins(spark, tmp_path):
    rows = [visit(s, "m", "home", uid=u) for s, u in ((0, "u"), (3, "u"), (5, "v"), (86400, "u"), (8 * 86400, "v"), (9 * 86400, "u"), (9 * 86400 + 4, "w"), (9 * 86400 + 5, None))]
    rows += [visit(k * 86400, "m", "home", uid="z") for k in (30, 31)]
    table, stream = both(spark, tmp_path / "logins", rows, lambda v: jobs.user_logins(jobs.pages(v)), 5)
    assert [(r["stt"][5:16], r["uu_ct"], r["back_ct"]) for r in table] == [("01-01 10:00", 2, 0), ("01-02 10:00", 1, 0), ("01-09 10:00", 1, 1), ("01-10 10:00", 2, 1), ("01-31 10:00", 1, 0), ("02-01 10:00", 1, 0)]
    assert stream == table[:-1]  # the last window stays open


def test_page_views(spark, tmp_path):
    """Visitors and bounces come from where their jobs wrote them: each its own rows."""
    rows = VISITS + BOUNCES[:1] + LAST
    build = lambda v: jobs.page_views(jobs.pages(v), *(f(jobs.pages(spark.createDataFrame([(x,) for x in rows], "value string"))) if not v.isStreaming else spark.readStream.schema(made[f].schema).parquet(str(tmp_path / f.__name__)) for f in made), width="1 day")
    values = spark.createDataFrame([(x,) for x in rows], "value string")
    made = {f: f(jobs.pages(values)).select("common", "page", "ts", "rt") for f in (jobs.unique_visitors, jobs.bounced)}
    for f, found in made.items():
        found.write.parquet(str(tmp_path / f.__name__))
    table, stream = both(spark, tmp_path / "views", rows, build, 1)
    closed = [r for r in table if r["stt"] < "2024-01-09"]
    assert stream == closed and sum(r["pv_ct"] for r in closed) == len(VISITS) + 1
    assert (sum(r["uv_ct"] for r in closed), sum(r["sv_ct"] for r in closed), sum(r["uj_ct"] for r in closed)) == (4, 5, 2)


DICTIONARY = [("s1", "app", None, None, None), ("1102", "card", None, None, None), ("g", "good", None, None, None)]
FACTS = [
    change(0, "order_info", id=1, user_id=7, province_id=3, order_status=1001, original_total_amount=30, activity_reduce_amount=1, coupon_reduce_amount=2),
    change(0, "order_detail", id=11, order_id=1, sku_id=5, order_price="10.50", sku_num=2, create_time=text(0), source_type="s1", split_total_amount=20),
    change(1, "order_detail", id=12, order_id=1, sku_id=6, order_price=9, sku_num=1, create_time=text(1), source_type="s1"),
    change(1, "order_detail", id=13, order_id=2, sku_id=6, order_price=9, sku_num=1, create_time=text(1), source_type="none"),
    change(1, "order_detail_activity", id=1, order_detail_id=11, activity_id=4), change(2, "order_detail_coupon", id=1, order_detail_id=12, coupon_id=9),
    change(2, "order_info", id=2, user_id=8), change(3, "payment_info", "update", {"payment_status": "1601"}, order_id=1, user_id=7, payment_type="1102", payment_status=1602, callback_time=text(3)),
    change(3, "payment_info", "update", {"callback_time": "x"}, order_id=2, user_id=8, payment_type="1102", payment_status=1602, callback_time=text(3)),
    change(4, "cart_info", id=1, user_id=7, sku_id=5, sku_num=1, source_type="s1", create_time=text(4)), change(5, "cart_info", "update", {"sku_num": "1"}, id=1, user_id=7, sku_num=3, source_type="s1", create_time=text(4), operate_time=text(5)),
    change(6, "cart_info", "update", {"sku_num": "3"}, id=1, user_id=7, sku_num=2, source_type="s1", create_time=text(4), operate_time=text(6)),
    change(6, "order_refund_info", id=1, user_id=7, order_id=1, sku_id=5, refund_type="g", refund_reason_type="none", refund_num=1, create_time=text(6)),
    change(6, "order_info", "update", {"order_status": "1002"}, id=1, province_id=3, order_status=1005), change(7, "order_info", "update", {"order_status": "1005"}, id=1, user_id=7, province_id=3, order_status=1006),
    change(7, "refund_payment", "update", {"refund_status": "0701"}, id=1, order_id=1, sku_id=5, payment_type="1102", refund_status="0702", callback_time=text(7), total_amount=10),
    change(8, "coupon_use", id=1, coupon_id=2, user_id=7, get_time=text(8)), change(9, "coupon_use", "update", {"using_time": None}, id=1, coupon_id=2, user_id=7, order_id=1, using_time=text(9)),
    change(9, "coupon_use", "update", None, id=2, coupon_id=2, user_id=7, order_id=1, using_time=text(9)), change(9, "coupon_use", "update", {"used_time": None}, id=1, coupon_id=2, user_id=7, order_id=1, using_time=text(9), used_time=text(10)),
    change(10, "favor_info", id=1, user_id=7, sku_id=5, create_time=text(10), is_cancel=0), change(10, "favor_info", "update", {"is_cancel": "1"}, id=1, user_id=7, sku_id=5, create_time=text(10), is_cancel=0), change(10, "favor_info", "update", {"is_cancel": "0"}, id=1, is_cancel=1),
    change(11, "comment_info", id=1, user_id=7, sku_id=5, order_id=1, create_time=text(11), appraise="g"), change(12, "user_info", id=7, create_time=text(12)), change(12, "user_info", "delete", id=8, create_time=text(12)),
]
CLOSING = [change(8 * 86400 + k * 86400, t, id=900 + k, order_id=900 + k, order_detail_id=900 + k, source_type="no", payment_status=0) for k in (0, 4) for t in ("order_info", "order_detail", "order_detail_activity", "order_detail_coupon", "order_refund_info", "refund_payment")]


@pytest.fixture
def words(spark):
    return spark.createDataFrame(DICTIONARY, sources.DICTIONARY)


@pytest.mark.parametrize("name, n", [("cart_additions", 2), ("coupons_received", 1), ("coupons_ordered", 2), ("coupons_paid", 1), ("favours", 2), ("comments", 1), ("registered_users", 1)])
def test_stateless_facts(spark, tmp_path, words, name, n):
    more = [words] if name in ("cart_additions", "comments") else []
    table, stream = both(spark, tmp_path / name, FACTS, lambda v: getattr(jobs, name)(sources.changes(v), *more), 1)
    assert table == stream and len(table) == n
    if name == "cart_additions":
        assert [(r["sku_num"], r["dic_name"]) for r in table] == [(1, "app"), (2, "app")]
    if name == "comments":
        assert (table[0]["appraise_name"], table[0]["date_id"]) == ("good", "2024-01-01")


def test_order_details(spark, tmp_path, words):
    """Two inner and two left joins of one stream; rows without an activity or coupon come when the bound has passed."""
    table, stream = both(spark, tmp_path / "details", FACTS + CLOSING, lambda v: jobs.order_details(sources.changes(v), words).drop("pt", "ts"), 3)
    assert set(jobs.order_details(sources.changes(sources.strings(spark, str(tmp_path / "details"))), words).columns) == {*sources.ORDER_DETAIL_COLUMNS, "event_time"}
    got = {(r["order_detail_id"], r["type"], r["order_status"]): (r["split_original_amount"], r["activity_id"], r["coupon_id"], r["dic_name"]) for r in table}
    assert {k: v for k, v in got.items() if k[1] == "insert"} == {("11", "insert", "1001"): ("21.0000", "4", None, "app"), ("12", "insert", "1001"): ("9.0000", None, "9", "app")}
    assert len(table) == 6 and stream == table
    rows = spark.createDataFrame([(json.dumps({"order_detail_id": "1", "type": "insert"}),), ("",), (json.dumps({"order_detail_id": "2", "type": "update"}),)], "value string")
    assert [r.order_detail_id for r in ch.inserted_details(rows).collect()] == ["1"]


def test_payments_and_refunds(spark, tmp_path, words):
    changes = sources.changes(spark.createDataFrame([(v,) for v in FACTS], "value string"))
    details = jobs.order_details(changes, words)
    assert {r.order_detail_id for r in jobs.placed_orders(details).collect()} == {"11", "12"}
    paid = jobs.successful_payments(changes, jobs.placed_orders(details), words).collect()
    assert sorted((r.order_detail_id, r.user_id, r.payment_type_name) for r in paid) == [("11", "7", "card"), ("12", "7", "card")]
    table, stream = both(spark, tmp_path / "refunds", FACTS + CLOSING, lambda v: jobs.refund_requests(sources.changes(v), words), 3)
    asked = [r for r in table if r["id"] == "1"]
    assert [(r["province_id"], r["refund_type_name"], r["refund_reason_type_name"]) for r in asked] == [("3", "good", None)] and asked == [r for r in stream if r["id"] == "1"]
    back = jobs.refund_payments(changes, words).collect()
    assert [(r.user_id, r.province_id, r.refund_num, r.payment_type_name, r.date_id) for r in back] == [("7", "3", "1", "card", "2024-01-01")]
    cancelled = spark.createDataFrame([("update", "1003", {"order_status": "1001"}), ("update", "1003", {"x": "1"}), ("insert", "1003", None)], "type string, order_status string, old map<string,string>")
    assert jobs.cancelled_orders(cancelled).count() == 1


def test_windows_of_changes(spark, tmp_path):
    rows = [change(s, "user_info", id=s) for s in (0, 3, 12, 5 * 86400)]
    table, stream = both(spark, tmp_path / "registered", rows, lambda v: jobs.registrations(sources.changes(v)))
    assert [r["register_ct"] for r in table] == [2, 1, 1] and stream == table[:2]
    cart = jobs.cart_users(sources.changes(spark.createDataFrame([(v,) for v in FACTS], "value string")), "1 day").collect()
    assert [r.cart_add_uu_ct for r in cart] == [1]


def test_joined_jobs_as_streams(spark, tmp_path, words):
    """Payments with the details of their orders, refunds with their order and request, and cart users, each as one stream, equal their tables."""
    placed = jobs.placed_orders(jobs.order_details(sources.changes(spark.createDataFrame([(v,) for v in FACTS], "value string")), words)).drop("pt", "ts")
    placed.write.parquet(str(tmp_path / "placed"))  # the details come from where their job wrote them
    details = lambda live: spark.readStream.schema(placed.schema).parquet(str(tmp_path / "placed")).withWatermark("event_time", "2 seconds") if live else placed
    build = lambda v: jobs.successful_payments(sources.changes(v), details(v.isStreaming), words)
    table, stream = both(spark, tmp_path / "paid", FACTS + CLOSING, build, 3)
    assert sorted((r["order_detail_id"], r["payment_type_name"]) for r in table) == [("11", "card"), ("12", "card")] and stream == table
    table, stream = both(spark, tmp_path / "refunded", FACTS + CLOSING, lambda v: jobs.refund_payments(sources.changes(v), words), 3)
    mine = lambda rows: [r for r in rows if r["id"] == "1"]
    assert [(r["user_id"], r["refund_num"]) for r in mine(table)] == [("7", "1")] and mine(stream) == mine(table)
    more = [change(k, "cart_info", id=k, user_id=u, sku_num=1, create_time=text(k)) for k, u in ((20, 8), (21, 7), (86400, 7), (5 * 86400, 9), (6 * 86400, 9))]
    table, stream = both(spark, tmp_path / "carts", FACTS + more, lambda v: jobs.cart_users(sources.changes(v), "1 day"), 4)
    assert [r["cart_add_uu_ct"] for r in table] == [2, 1, 1, 1] and stream == table[:2]  # a day later than the watermark


def test_dimensions(spark, tmp_path):
    """Configuration and changes to keyed tables, by micro-batches; the configuration's later row counts, a deleted one routes nothing."""
    config = spark.createDataFrame([("user_info", 1, "insert", "dim_user", "id,name", None, None), ("user_info", 2, "update", "dim_user", "id, name ,level", "id", None), ("sku_info", 1, "insert", "dim_sku", "id", None, None), ("sku_info", 2, "delete", "dim_sku", "id", None, None)], "source_table string, ts int, type string, sink_table string, sink_columns string, sink_pk string, sink_extend string")
    files = tmp_path / "in"
    files.mkdir()
    (files / "0.txt").write_text("\n".join([change(0, "user_info", id=1, name="a", secret="x"), change(0, "user_info", id=2, name="b"), change(1, "sku_info", id=1)]))
    (files / "1.txt").write_text("\n".join([change(5, "user_info", "update", {"name": "a"}, id=1, name="aa", level=3), change(5, "user_info", "delete", id=2), change(5, "other", id=2)]))
    for k in (0, 1):
        os.utime(files / f"{k}.txt", (10**9 + 10 * k,) * 2)
    values = sources.strings(spark, str(files), stream=True, maxFilesPerTrigger="1")
    sinks.stream_batches(sources.changes(values), jobs.load_dimensions(config, str(tmp_path / "dims")), str(tmp_path / "ck")).awaitTermination()
    got = sinks.read_keyed(spark, str(tmp_path / "dims/dim_user"))
    assert got.columns == ["id", "name", "level", "ts"] and sorted((r.id, r.name, r.level) for r in got.collect()) == [("1", "aa", "3"), ("2", "b", None)]
    assert sinks.read_keyed(spark, str(tmp_path / "dims/dim_sku")) is None


def test_keyed_table(spark, tmp_path):
    """Equal times: the later arrival. Only touched parts are written anew. A batch that failed before its list took effect changes nothing."""
    path, kind = str(tmp_path / "t"), "id int, ts int, v string"
    sinks.upsert(spark.createDataFrame([(k, 1, "first") for k in range(200)], kind), path, ["id"], ["ts"])
    before = sinks.keyed_parts(spark, path)
    sinks.upsert(spark.createDataFrame([(1, 1, "same time"), (2, 0, "older"), (900, 1, "new")], kind), path, ["id"], ["ts"])
    now = sinks.keyed_parts(spark, path)
    assert 1 <= sum(now[p] != before.get(p) for p in now) <= 3 and len(before) > 20
    got = {r.id: r.v for r in sinks.read_keyed(spark, path).collect()}
    assert len(got) == 201 and (got[1], got[2], got[900]) == ("same time", "first", "new")
    broken = spark.createDataFrame([(3, 9, "x")], kind).withColumn("v", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception):  # noqa: B017
        sinks.upsert(broken, path, ["id"], ["ts"])
    assert {r.id: r.v for r in sinks.read_keyed(spark, path).collect()} == got
    ties = spark.createDataFrame([(1, 5, "a"), (1, 5, "b"), (1, 4, "c")], kind).coalesce(1)
    assert [r.v for r in sinks.latest(ties, ["id"], ["ts"]).collect()] == ["b"]


def test_order_summary(spark, tmp_path):
    """The stream of details into a table of the latest ones, then its summary: each detail once, whatever versions came."""
    fields = "order_detail_id user_id order_create_time activity_reduce_amount coupon_reduce_amount original_total_amount ts"
    rows = [("1", "u", text(0), "1", None, "10", 1), ("1", "u", text(0), "2", "1", "20", 2), ("2", "u", text(3), "0", "0", "5", 1), ("3", "v", text(20), None, None, "7", 1)]
    source = tmp_path / "in"
    for r in rows:
        spark.createDataFrame([r], ", ".join(f"{c} {'int' if c == 'ts' else 'string'}" for c in fields.split())).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(spark.read.parquet(str(source)).schema).option("maxFilesPerTrigger", 2).parquet(str(source))
    streaming.keep_latest(stream, str(tmp_path / "latest"), ["order_detail_id"], ["ts"], str(tmp_path / "ck")).awaitTermination()
    out = jobs.order_summary(sinks.read_keyed(spark, str(tmp_path / "latest"))).orderBy("stt").collect()
    assert [(r.order_unique_user_count, r.order_new_user_count, r.order_activity_reduce_amount, r.order_coupon_reduce_amount, r.order_origin_total_amount) for r in out] == [(1, 1, 2.0, 1.0, 25.0), (1, 1, 0.0, 0.0, 7.0)]


def test_product_orders(spark):
    frame = lambda rows, kind: spark.createDataFrame(rows, kind)
    details = frame([("u", "1", text(0), "10.5"), ("u", "1", text(1), "2"), ("u", "9", text(2), "1")], "user_id string, sku_id string, order_create_time string, split_total_amount string")
    dims = frame([("1", "2", "3", "4")], "id string, spu_id string, tm_id string, category3_id string"), frame([("2", "pen")], "id string, spu_name string"), frame([("3", "brand")], "id string, tm_name string"), frame([("4", "c3", "5")], "id string, name string, category2_id string"), frame([("5", "c2", "6")], "id string, name string, category1_id string"), frame([], "id string, name string")
    got = {r.spu_name: (r.order_count, r.order_amount, r.trademark_name, r.category2_name, r.category1_id, r.category1_name) for r in jobs.product_orders(details, *dims).collect()}
    assert got == {"pen": (2, 12.5, "brand", "c2", "6", None), None: (1, 1.0, None, None, None, None)}


def test_product_orders_as_a_stream(spark, tmp_path):
    rows = [("u", "1", text(0), "10.5"), ("u", "1", text(1), "2"), ("u", "9", text(2), "1"), ("v", "1", text(3600), "4")]
    frame = lambda rows, kind: spark.createDataFrame(rows, kind)
    dims = frame([("1", "2", "3", "4")], "id string, spu_id string, tm_id string, category3_id string"), frame([("2", "pen")], "id string, spu_name string"), frame([("3", "brand")], "id string, tm_name string"), frame([("4", "c3", "5")], "id string, name string, category2_id string"), frame([("5", "c2", "6")], "id string, name string, category1_id string"), frame([("6", "c1")], "id string, name string")
    values = [json.dumps(dict(zip(("user_id", "sku_id", "order_create_time", "split_total_amount"), r, strict=True))) for r in rows]
    table, stream = both(spark, tmp_path / "products", values, lambda v: jobs.product_orders(sources.order_details(v), *dims), 2)
    assert len(table) == 3 and stream == table[:2] and {r["spu_name"] for r in stream} == {"pen", None}


def test_files_in_and_out(spark, tmp_path):
    """Readers and writers on files: several sources, page log, lookups, query lists, JSON strings, analytic tables, raw landing."""
    for k in ("a", "b"):
        (tmp_path / f"{k}.txt").write_text(visit(0, k, "home") + "\n\n")
    one, two = sources.topics(spark, [str(tmp_path / "a.txt"), str(tmp_path / "b.txt")])
    assert [r.value for r in one.collect()][1] == "" and sources.page_log(two).filter("common is not null").first().rt == T0.replace(tzinfo=None)
    landed = jobs.land(one.union(spark.createDataFrame([(change(0, "t"),), ("{bad",)], "value string")))
    sinks.land_by_date(landed.drop("dt").withColumn("at", F.col("value").isNotNull().cast("int")).withColumn("at", F.lit(T0)), "at", str(tmp_path / "raw"))
    assert {str(r.dt) for r in spark.read.parquet(str(tmp_path / "raw")).collect()} == {"2024-01-01"} and {str(r.dt) for r in landed.collect()} == {"2024-01-01"}
    rows = spark.createDataFrame([("k", 1, "gone")], "id string, n int, sku_id string")
    keyed = sinks.as_json(rows, ["id"]).first()
    assert (json.loads(keyed.key), json.loads(keyed.value)) == ({"id": "k"}, {"id": "k", "n": 1, "sku_id": "gone"})
    sinks.write_strings(rows, str(tmp_path / "out"))
    assert json.loads(spark.read.text(str(tmp_path / "out")).first().value)["n"] == 1
    sinks.write_analytic(rows, ("sku_id",), str(tmp_path / "olap"))
    assert spark.read.parquet(str(tmp_path / "olap")).columns == ["id", "n"]
    spark.createDataFrame(DICTIONARY, sources.DICTIONARY).write.parquet(str(tmp_path / "dic"))
    assert sources.lookup(spark, str(tmp_path / "dic")).count() == 3
    assert sources.query_list(spark, "select 1 as order_id", True).columns == ["orderId"] and sources.query_list(spark, "select 1 as order_id").columns == ["order_id"]
    parsed = sources.changes(spark.createDataFrame([(change(3, "t", "update", {"a": "1"}, a=2),), ("{bad",)], "value string")).collect()
    assert (parsed[0].data, parsed[0].old, json.loads(parsed[0].old_text), parsed[0].event_time) == ({"a": "2"}, {"a": "1"}, {"a": "1"}, dt.datetime(2024, 1, 1, 10, 0, 3)) and parsed[1].table is None
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "x.txt").write_text("\n".join(LOG))
    jobs.start(spark, str(tmp_path / "src"), str(tmp_path / "routes"), str(tmp_path / "ck"), jobs.split_log, ("route",)).awaitTermination()
    assert spark.read.json(str(tmp_path / "routes")).groupBy("route").count().count() == 6


def test_join_within(spark, tmp_path):
    values = [json.dumps({"k": k, "side": side, "ts": text(s)}) for k, side, s in ((1, "l", 0), (2, "l", 0), (3, "l", 0), (1, "r", 60), (2, "r", 8 * 86400), (9, "l", 20 * 86400), (9, "r", 20 * 86400), (8, "l", 30 * 86400), (8, "r", 30 * 86400))]

    def build(v):
        rows = sources.json_rows(v, "k int, side string, ts timestamp")
        left, right = rows.filter("side = 'l'").select("k", F.col("ts").alias("a")), rows.filter("side = 'r'").select("k", F.col("ts").alias("b"))
        return streaming.join_within(left, right, "k", "a", "b", "left").select("k", "b")

    table, stream = both(spark, tmp_path / "within", values, build, 3)
    assert [(r["k"], r["b"] is None) for r in table] == [(1, False), (2, True), (3, True), (8, False), (9, False)]
    assert stream == table
