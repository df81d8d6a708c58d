"""Keyed tables: batches in any order, empty and repeated ones, deletes, and the changelog, against a dictionary in Python."""

import random

import pytest
from pyspark.sql import functions as F

from tidewater import sinks, sources

KIND = "id int, ts int, v string, gone boolean"


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def put(spark, path, rows, **more):
    return sinks.upsert(spark.createDataFrame(rows, KIND).coalesce(1), path, ["id"], ["ts"], "gone", parts=3, **more)


def merged(held, rows):
    """The dictionary after a batch, and its changes."""
    after = dict(held)
    for id_, ts, v, gone in rows:
        if id_ not in after or ts >= after[id_][0]:
            after[id_] = (ts, v, bool(gone))
    changes = []
    for k in after:
        was, now = held.get(k, (0, 0, True)), after[k]
        if was[2] and not now[2]:
            changes.append((k, "+I", *now[:2]))
        elif not was[2] and now[2]:
            changes.append((k, "-D", *was[:2]))
        elif not was[2] and was[:2] != now[:2]:
            changes += [(k, "-U", *was[:2]), (k, "+U", *now[:2])]
    return after, changes


def test_random_batches(spark, tmp_path):
    """Empty batches between others lose nothing; a batch run again changes nothing; the changelog replays to the table."""
    rng = random.Random(4)
    for run in range(3):
        path, held, want = str(tmp_path / f"t{run}"), {}, []
        for k in range(7):
            rows = [(rng.choice([None, *range(8)]), rng.randint(0, 5), rng.choice("abc"), rng.random() < 0.3) for _ in range(rng.choice([0, 0, 1, 4, 9]))]
            assert put(spark, path, rows, batch_id=k) == bool(rows)
            if rng.random() < 0.4:
                assert not put(spark, path, [(r[0], 99, "again", False) for r in rows], batch_id=k) or not rows
            held, changes = merged(held, rows)
            want += changes
        live = {k: v[:2] for k, v in held.items() if not v[2]}
        assert {r.id: (r.ts, r.v) for r in sinks.read_keyed(spark, path).collect()} == live
        log = sinks.read_changes(spark, path)
        assert sorted(((r.id, r.row_kind, r.ts, r.v) for r in log.collect()), key=str) == sorted(want, key=str)
        assert {r.id: (r.ts, r.v) for r in sinks.replay(log, ["id"]).collect()} == live


def test_two_tables_by_turns(spark, tmp_path):
    """Batches that have rows for one table only, by turns."""
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    for k in range(6):
        rows = [(k, k, "x", False)]
        put(spark, a, rows if k % 2 else [], batch_id=k)
        put(spark, b, [] if k % 2 else rows, batch_id=k)
    assert sorted(r.id for r in sinks.read_keyed(spark, a).collect()) == [1, 3, 5] and sorted(r.id for r in sinks.read_keyed(spark, b).collect()) == [0, 2, 4]


def test_deletes_are_remembered(spark, tmp_path):
    path = str(tmp_path / "t")
    put(spark, path, [(1, 1, "a", False), (2, 1, "b", None)])
    put(spark, path, [(1, 5, None, True), (3, 5, None, True)])
    put(spark, path, [(1, 4, "older", False), (3, 4, "older", False)])
    assert [r.id for r in sinks.read_keyed(spark, path).collect()] == [2]
    put(spark, path, [(1, 6, "back", False)])
    assert {r.id: r.v for r in sinks.read_keyed(spark, path).collect()} == {1: "back", 2: "b"}
    kinds = [(r.commit, r.id, r.row_kind) for r in sinks.read_changes(spark, path).orderBy("commit", "id").collect()]
    assert kinds == [(0, 1, "+I"), (0, 2, "+I"), (1, 1, "-D"), (3, 1, "+I")]
    assert [r.id for r in sinks.read_changes(spark, path, after=2).collect()] == [1] and sinks.read_changes(spark, path, after=3) is None


def test_new_columns_and_maps(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.upsert(spark.createDataFrame([("a", 1, {"x": "1"}), ("b", 1, {"x": "1"})], "id string, ts int, m map<string,string>"), path, ["id"], ["ts"])
    sinks.upsert(spark.createDataFrame([("a", 2, {"x": "1"}, 7), ("b", 1, {"x": "1"}, None)], "id string, ts int, m map<string,string>, n int"), path, ["id"], ["ts"])
    assert {r.id: (r.ts, r.m, r.n) for r in sinks.read_keyed(spark, path).collect()} == {"a": (2, {"x": "1"}, 7), "b": (1, {"x": "1"}, None)}
    assert sorted((r.commit, r.id, r.row_kind, r.n) for r in sinks.read_changes(spark, path).filter("row_kind <> '-U'").collect()) == [(0, "a", "+I", None), (0, "b", "+I", None), (1, "a", "+U", 7)]


def test_created_empty_and_vacuumed(spark, tmp_path):
    path = str(tmp_path / "t")
    assert sinks.read_keyed(spark, path) is None and sinks.read_changes(spark, path) is None
    assert sinks.create_table(spark, path, "id int, ts int, v string", 3, "SALT_BUCKETS=4") and not sinks.create_table(spark, path, "id int")
    assert sinks.read_keyed(spark, path).columns == ["id", "ts", "v"] and sinks.properties(spark, path) == "SALT_BUCKETS=4"
    for k in range(6):
        put(spark, path, [(k, k, "x", False), (0, k, str(k), False)])
    before = {tuple(r) for r in sinks.read_keyed(spark, path).collect()}
    assert len(sinks.lists(spark, path)) == 7 and sinks.vacuum(spark, path, 2) > 0
    assert len(sinks.lists(spark, path)) == 2 and {tuple(r) for r in sinks.read_keyed(spark, path).collect()} == before
    assert sinks.properties(spark, path) == "SALT_BUCKETS=4" and {r.commit for r in sinks.read_changes(spark, path).collect()} == {5, 6}
    put(spark, path, [(9, 9, "y", False)])
    assert sinks.read_keyed(spark, path).count() == len(before) + 1 and sinks.vacuum(spark, path, 50) == 0


def test_second_writer_gets_an_error(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    put(spark, path, [(1, 1, "a", False)])
    from tidewater.sinks import keyed

    stale = keyed._last(spark, path)
    put(spark, path, [(2, 1, "b", False)])
    monkeypatch.setattr(keyed, "_last", lambda *_: stale)
    with pytest.raises(RuntimeError, match="another writer"):
        put(spark, path, [(3, 1, "c", False)])
    monkeypatch.undo()
    assert sorted(r.id for r in sinks.read_keyed(spark, path).select(F.col("id")).collect()) == [1, 2]


def test_published_records_rebuild_the_table(spark, tmp_path):
    """Whatever the batches between two calls, records read in any order give the table; deletes are tombstones; nothing is sent twice."""
    rng = random.Random(9)
    path, to, copy, held, want = str(tmp_path / "t"), str(tmp_path / "topic"), str(tmp_path / "copy"), {}, []
    assert sinks.publish(spark, path, ["id"], to) == -1
    for k in range(6):
        rows = [(rng.choice([None, *range(5)]), rng.randint(0, 5), rng.choice(["a", None]), rng.random() < 0.4) for _ in range(rng.choice([0, 3, 8]))]
        put(spark, path, rows, batch_id=k)
        held, changes = merged(held, rows)
        want += [c for c in changes if c[1] != "-U"]
        if rng.random() < 0.5:
            assert sinks.publish(spark, path, ["id"], to) == sinks.publish(spark, path, ["id"], to) == max(sinks.lists(spark, path), default=-1)
    sinks.publish(spark, path, ["id"], to)
    rows = sources.upserts(sources.keyed_records(spark, f"{to}/records"), "id int, ts int, v string")
    got = rows.collect()
    assert sorted(((r.id, r.gone) for r in got), key=str) == sorted(((c[0], c[1] == "-D") for c in want), key=str)
    assert any(r.gone for r in got) and all(r.ts is None and r.v is None for r in got if r.gone)
    for n in rng.sample(sinks.lists(spark, path), len(sinks.lists(spark, path))):
        sinks.upsert(rows.filter(F.col("offset") == n), copy, ["id"], ["offset"], "gone", parts=2)
    assert {r.id: (r.ts, r.v) for r in sinks.read_keyed(spark, copy).collect()} == {k: v[:2] for k, v in held.items() if not v[2]}
    for k in range(3):
        put(spark, path, [(1, 10 + k, "z", False)])
    sinks.vacuum(spark, path, keep=1)
    with pytest.raises(ValueError, match="were not sent"):
        sinks.publish(spark, path, ["id"], to)


def test_records_keep_times_whole(spark, tmp_path):
    rows = spark.sql("SELECT 1 AS id, timestamp'2024-01-01 00:00:00.123456' AS a, timestamp_ntz'2024-01-01 00:00:00.654321' AS b, map('k', 1.5D) AS c, true AS gone UNION ALL SELECT 2, null, null, null, null")
    path = str(tmp_path / "t")
    sinks.upsert(rows.drop("gone"), path, ["id"], [], parts=1)
    sinks.publish(spark, path, ["id"], str(tmp_path / "topic"))
    back = sources.upserts(sources.keyed_records(spark, str(tmp_path / "topic" / "records")), rows.drop("gone").schema)
    assert [tuple(r) for r in back.orderBy("id").select("id", "a", "b", "c", "gone").collect()] == [(*r[:4], False) for r in rows.orderBy("id").collect()]


def test_kafka_options():
    got = sources.kafka_options("a,b", "h:1", "jobs", startingOffsets="latest", failOnDataLoss="false")
    assert got == {"kafka.bootstrap.servers": "h:1", "subscribe": "a,b", "startingOffsets": "latest", "groupIdPrefix": "jobs", "failOnDataLoss": "false"}
    assert sources.kafka_options("a", "h:1") == {"kafka.bootstrap.servers": "h:1", "subscribe": "a", "startingOffsets": "earliest"}
