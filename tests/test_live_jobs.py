"""Jobs that correct what they sent, wait by a clock, or read what changes while they run."""

import datetime as dt
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from test_jobs import T0, change, text
from tidewater import functions as fn
from tidewater import sinks, sources, streaming
from tidewater.operators import changes as ch
from tidewater.operators import windows
from tidewater.streaming import jobs
from tidewater.streaming.updating import Side, UpdatingJoin


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def feed(spark, folder, batches):
    """A stream of JSON texts, one file for each batch."""
    folder.mkdir()
    for k, values in enumerate(batches):
        (folder / f"{k}.txt").write_text("".join(v + "\n" for v in values))
        os.utime(folder / f"{k}.txt", (10**9 + 10 * k,) * 2)
    return sources.strings(spark, str(folder), stream=True, maxFilesPerTrigger="1", latestFirst="false")


def test_updating_join(spark, tmp_path):
    """After every batch the result is the join of all so far; the changelog replays to it; a batch run again changes nothing."""
    join = UpdatingJoin(str(tmp_path / "j"), ["id"], ["v"], {"a": Side(["k"], ["av"]), "b": Side(["id"], ["bv"], "inner")}, parts=2)
    rows, a, b = "id int, k int, v int, deleted boolean", "k int, av int, x string, deleted boolean", "id int, bv int"
    batches = [
        ([(1, 10, 1, False), (2, 20, 1, False), (3, None, 1, False)], [], [(1, 1), (3, 1)]), ([], [(10, 1, "p", False)], [(2, 1)]), ([(1, 20, 2, False)], [(20, 1, "q", False), (10, 0, "old", False)], []),
        ([], [], []), ([(2, 20, 3, True)], [(20, 2, "r", False)], [(9, 9)]), ([(4, 10, 1, False)], [(20, 3, None, True)], [(4, 1)]),
    ]
    held, left, right = {}, {}, {}
    for n, (new, ka, kb) in enumerate(batches):
        for _ in range(2):
            join.apply(spark.createDataFrame(new, rows), n, a=spark.createDataFrame(ka, a), b=spark.createDataFrame(kb, b))
        for store, some in ((held, new), (left, ka), (right, kb)):
            for r in some:
                at = 2 if store is held else 1
                if r[0] not in store or r[at] >= store[r[0]][at]:
                    store[r[0]] = r
        want = set()
        for i, k, v, gone in held.values():
            if not gone and i in right:
                x = left.get(k)
                x = None if x is None or x[3] else x
                want.add((i, k, v, x and x[1], x and x[2], right[i][1]))
        got = join.result(spark)
        assert {(r.id, r.k, r.v, r.av, r.x, r.bv) for r in got.collect()} == want
        assert {tuple(r) for r in sinks.replay(join.changes(spark), ["id"]).select("id", "k", "v", "av", "x", "bv").collect()} == want
    kinds = [r.row_kind for r in join.changes(spark).filter("id = 1").orderBy("commit", "row_kind").collect()]
    assert sorted(kinds) == ["+I", "+U", "+U", "+U", "+U", "-U", "-U", "-U", "-U"] and "-D" in {r.row_kind for r in join.changes(spark).filter("id = 2").collect()}


def test_order_details_at_once(spark, tmp_path):
    """A detail goes out with its order, and again with its activity, its coupon and the order's next version; all 43 columns."""
    words = lambda: spark.createDataFrame([("s1", "app", None, None, None)], sources.DICTIONARY)
    batches = [
        [change(0, "order_detail", id=11, order_id=1, sku_id=5, order_price="10.50", sku_num=2, create_time=text(0), source_type="s1"), change(0, "order_detail", id=12, order_id=2, source_type="s1"), change(0, "order_detail", id=13, order_id=1, source_type="none")],
        [change(1, "order_info", id=1, user_id=7, order_status=1001, consignee="Ann", feight_fee=3, tracking_no="t"), change(1, "user_info", id=1)], [change(2, "order_detail_activity", id=1, order_detail_id=11, activity_id=4)],
        [change(9 * 86400, "order_detail_coupon", id=1, order_detail_id=11, coupon_id=9), change(3, "order_info", "update", {"order_status": "1001"}, id=1, user_id=7, order_status=1003, consignee="Ann")],
    ]
    seen, each = [], jobs.order_details_updating(str(tmp_path / "fact"), words, 2)

    def batch(rows, n):
        each(rows, n)
        found = jobs.updated_details(spark, str(tmp_path / "fact"), n - 1 if n else -1)
        now = jobs.detail_join(str(tmp_path / "fact")).result(spark)
        seen.append([] if now is None else [(r.order_detail_id, r.order_status, r.activity_id, r.coupon_id) for r in now.collect()])
        assert found is None or found.columns == [*sources.ORDER_DETAIL_COLUMNS, "event_time", "row_kind", "commit"]

    sinks.stream_batches(sources.changes(feed(spark, tmp_path / "in", batches)), batch, str(tmp_path / "ck")).awaitTermination()
    assert seen == [[], [("11", "1001", None, None)], [("11", "1001", "4", None)], [("11", "1003", "4", "9")]]
    log = jobs.updated_details(spark, str(tmp_path / "fact")).filter("row_kind like '+%'").orderBy("commit").collect()
    assert [(r.row_kind, r.type, r.consignee, r.split_original_amount, r.dic_name) for r in log] == [("+I", "insert", "Ann", "21.0000", "app"), ("+U", "insert", "Ann", "21.0000", "app"), ("+U", "update", "Ann", "21.0000", "app")]
    assert log[-1].ts >= log[0].ts >= log[0].pt and jobs.cancelled_orders(jobs.updated_details(spark, str(tmp_path / "fact"))).filter("row_kind = '+U'").count() == 1


def until(found, seconds=60):
    end = time.time() + seconds
    while time.time() < end and not found():
        time.sleep(0.5)


def test_latest_detail_by_a_timer(spark, tmp_path):
    """Versions that come within the wait: the latest once; later ones change nothing. Then its summary, as a stream and as a table."""
    row = lambda i, u, s, ts, amount, kind="insert": json.dumps({"order_detail_id": i, "user_id": u, "order_create_time": text(s), "original_total_amount": amount, "activity_reduce_amount": "1", "type": kind, "ts": text(ts)})
    values = feed(spark, tmp_path / "in", [[row("1", "u", 0, 1, "10"), row("1", "u", 0, 3, "20"), row("1", "u", 0, 2, "15"), "", row("2", "u", 3, 1, "5", "update")], [row("2", "u", 3, 1, "5"), row("2", "u", 3, 1, "6"), row("3", "v", 20, 1, "7"), row("4", "u", 86400, 1, "8"), row("5", "z", 5 * 86400, 1, "1")]])
    out = str(tmp_path / "latest")
    query = sinks.stream_append(jobs.latest_details(values, 1500), out, str(tmp_path / "ck"), processingTime="200 milliseconds")
    until(lambda: os.path.exists(out) and spark.read.schema(sources.ORDER_DETAIL).json(out).count() >= 5)
    query.stop()
    kept = spark.read.schema(sources.ORDER_DETAIL).json(out)
    want = {"1": "20", "2": "6", "3": "7", "4": "8", "5": "1"}
    assert {r.order_detail_id: r.original_total_amount for r in kept.collect()} == want and kept.count() == 5
    table = jobs.latest_details(sources.strings(spark, str(tmp_path / "in")))
    assert {r.order_detail_id: r.original_total_amount for r in table.collect()} == want
    order = ["stt", "order_unique_user_count", "order_new_user_count", "order_activity_reduce_amount", "order_origin_total_amount"]
    expected = [tuple(r) for r in jobs.order_summary(table).orderBy("stt").select(*order).collect()]
    assert [x[1:] for x in expected] == [(1, 1, 2.0, 26.0), (1, 1, 1.0, 7.0), (1, 0, 1.0, 8.0), (1, 1, 1.0, 1.0)]
    spark.createDataFrame(sorted(kept.collect(), key=lambda r: r.order_create_time), kept.schema).coalesce(1).write.json(str(tmp_path / "sorted"))
    stream = jobs.order_summary(spark.readStream.schema(sources.ORDER_DETAIL).json(str(tmp_path / "sorted")))
    stream.writeStream.format("memory").queryName("summary").option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start().awaitTermination()
    assert [tuple(r) for r in spark.table("summary").orderBy("stt").select(*order).collect()] == expected[:-1]


def test_configuration_changes_between_batches(spark, tmp_path):
    """A configuration row between two batches reroutes the second; a deleted one stops; tables are there before their first row."""
    setting = lambda s, kind="insert", **data: change(s, "table_process", kind, **data)
    batches = [
        [setting(0, source_table="user_info", sink_table="dim_user", sink_columns="id,name", sink_extend="SALT"), setting(0, source_table="sku_info", sink_table="dim_sku", sink_columns="id"), change(1, "user_info", id=1, name="a", level=2), change(1, "spu_info", id=5)],
        [change(2, "user_info", id=2, name="b")], [setting(3, "update", source_table="user_info", sink_table="dim_person", sink_columns="id, level"), change(3, "user_info", id=3, name="c", level=1)],
        [setting(4, "delete", source_table="user_info", sink_table="dim_person", sink_columns="id"), setting(4, source_table="spu_info", sink_table="dim_spu", sink_columns="id"), change(5, "user_info", id=4), change(5, "spu_info", id=6)],
    ]
    root, counts = str(tmp_path / "dims"), []
    each = jobs.load_dimensions(None, root, parts=2)

    def batch(rows, n):
        each(rows, n)
        counts.append({t: (lambda d: None if d is None else d.count())(sinks.read_keyed(spark, f"{root}/{t}")) for t in ("dim_user", "dim_sku", "dim_person", "dim_spu")})

    sinks.stream_batches(sources.changes(feed(spark, tmp_path / "in", batches)), batch, str(tmp_path / "ck")).awaitTermination()
    assert counts == [{"dim_user": 1, "dim_sku": 0, "dim_person": None, "dim_spu": None}, {"dim_user": 2, "dim_sku": 0, "dim_person": None, "dim_spu": None}, {"dim_user": 2, "dim_sku": 0, "dim_person": 1, "dim_spu": None}, {"dim_user": 2, "dim_sku": 0, "dim_person": 1, "dim_spu": 1}]
    assert sinks.read_keyed(spark, f"{root}/dim_sku").columns == ["id", "ts"] and sinks.properties(spark, f"{root}/dim_user") == "SALT" and [(r.id, r.level) for r in sinks.read_keyed(spark, f"{root}/dim_person").collect()] == [("3", "1")]


def test_lookup_row_added_between_batches(spark, tmp_path):
    words = str(tmp_path / "dic")
    put = lambda code, name: spark.createDataFrame([(code, name, None, None, None)], sources.DICTIONARY).coalesce(1).write.mode("append").parquet(words)
    put("g", "good")
    each = jobs.with_fresh_lookups(jobs.comments, str(tmp_path / "out"), dictionary=sources.fresh(spark, path=words))

    def batch(rows, n):
        each(rows, n)
        put("b", "bad")

    batches = [[change(0, "comment_info", id=1, appraise="g"), change(0, "comment_info", id=2, appraise="b")], [change(1, "comment_info", id=3, appraise="b")]]
    sinks.stream_batches(sources.changes(feed(spark, tmp_path / "in", batches)).drop("pt"), batch, str(tmp_path / "ck")).awaitTermination()
    assert {r.id: r.appraise_name for r in spark.read.json(str(tmp_path / "out")).collect()} == {"1": "good", "2": None, "3": "bad"}


def test_windows_of_arrival(spark, tmp_path):
    """Rows that come a known time apart fall into two windows, whatever their own times; a batch run again keeps its stamps."""
    path, each = str(tmp_path / "stamped"), sinks.land_stamped(str(tmp_path / "stamped"))
    rows = lambda *v: spark.createDataFrame([(x,) for x in v], "value string")
    each(rows("a", "b"), 0)
    before = {tuple(r) for r in spark.read.parquet(path).collect()}
    time.sleep(2.1)
    each(rows("a", "b"), 0)
    assert {tuple(r) for r in spark.read.parquet(path).collect()} == before
    each(rows("c"), 1)
    got = windows.tumble(spark.read.parquet(path), "arrived_at", "2 seconds", [], n=F.count(F.lit(1))).collect()
    assert sorted(r.n for r in got) == [1, 2]
    stream = streaming.in_order(spark.readStream.schema(spark.read.parquet(path).schema).parquet(path), "arrived_at")
    windows.tumble(stream, "arrived_at", "2 seconds", [], n=F.count(F.lit(1))).writeStream.format("memory").queryName("arrivals").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    assert [r.n for r in spark.table("arrivals").collect()] == [2]


def test_late_and_future_rows_go_aside(spark, tmp_path):
    """On time, late and future rows are all rows; a row dated 2099 moves no watermark."""
    path = str(tmp_path / "lanes")
    each = sinks.split_late(path, "at", 2, 60)
    at = lambda s: T0.replace(tzinfo=None) + dt.timedelta(seconds=s)
    rows = lambda *v: spark.createDataFrame([(n, t) for n, t in v], "n int, at timestamp")
    batches = [rows((1, at(0)), (2, at(10)), (3, dt.datetime(2099, 1, 1))), rows((4, at(9)), (5, at(7)), (6, at(8)), (7, None)), rows(), rows((8, at(7)), (9, at(30))), rows((10, at(20)), (11, at(28)))]
    for n, b in enumerate(batches):
        each(b, n)
    each(batches[1], 1)
    got = {r.n: r.lane for r in spark.read.option("basePath", path).parquet(*[f"{path}/batch={n}" for n in (0, 1, 3, 4)]).collect()}
    assert got == {1: "on_time", 2: "on_time", 3: "future", 4: "on_time", 5: "late", 6: "on_time", 7: "late", 8: "late", 9: "on_time", 10: "late", 11: "on_time"}


def test_table_function(spark):
    fn.register_table_functions(spark)
    spark.createDataFrame([(1, "Red Apple_pie"), (2, None), (3, " - "), (4, "été 7")], "id int, item string").createOrReplaceTempView("searched")
    got = spark.sql("SELECT s.id, w.word FROM searched s, LATERAL split_words(s.item) w ORDER BY 1, 2").collect()
    assert [tuple(r) for r in got] == [(1, "apple"), (1, "pie"), (1, "red"), (4, "7"), (4, "été")]
    fn.register_table_functions(spark, lambda t: t.split("-") if "-" in t else 1 / 0)
    got = spark.sql("SELECT s.id, w.word FROM searched s, LATERAL split_words(s.item) w WHERE s.id <> 2 ORDER BY 1, 2").collect()
    assert [tuple(r) for r in got] == [(1, "Red Apple_pie"), (3, " "), (3, " "), (4, "été 7")]


def test_large_rows_are_not_broadcast(spark, monkeypatch):
    facts, dim = spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([(1, "a" * 500)], "id int, n string")
    monkeypatch.setattr(ch, "SMALL_BYTES", 100)
    assert "ResolvedHint" not in ch.enrich(facts, dim, "k", "id", small=True, name="n")._jdf.queryExecution().analyzed().toString()
