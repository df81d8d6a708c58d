"""Streams with Python state processors equal their batch forms."""

import os

import pytest
from pyspark.sql import functions as F

from test_operators import VISITS, at
from tidewater import streaming


@pytest.fixture(autouse=True)
def one_partition(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def run(spark, tmp_path, rows, schema, build, files, mode):
    src = tmp_path / "in"
    size = -(-len(rows) // files)
    for k in range(files):
        spark.createDataFrame(rows[k * size : (k + 1) * size], schema).coalesce(1).write.parquet(str(src / str(k)))
        for f in os.listdir(src / str(k)):
            os.utime(src / str(k) / f, (10**9 + 10 * k,) * 2)
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src / "*"))
    build(df).writeStream.format("memory").queryName(tmp_path.name).outputMode(mode).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    return spark.table(tmp_path.name).collect()


def test_stream_bounces(spark, tmp_path):
    rows = sorted(((u, 100 * u + s, at(s), e) for u, s, e in VISITS), key=lambda r: r[2]) + [(9, 9, at(1000), False), (9, 10, at(2000), False)]
    out = run(spark, tmp_path, rows, "user_id long, event_id long, ts timestamp, entry boolean", lambda df: streaming.bounces(df, "ts", 10_000), 2, "append")
    assert {(r.user_id, r.event_id) for r in out} == {(1, 100), (2, 200), (3, 300), (4, 400)}


DAYS = [(1, 1, at(0), 1), (1, 2, at(5), 1), (1, 3, at(86400), 1), (2, 4, at(86400), 0), (1, 5, at(9 * 86400), 1), (2, 6, at(9 * 86400), 1)]
KIND = "user_id long, event_id long, ts timestamp, flag int"


def test_stream_repair(spark, tmp_path):
    out = run(spark, tmp_path, DAYS, KIND, lambda df: streaming.repair_is_new(df, "ts"), 2, "update")
    assert {r.event_id: r.is_new for r in out} == {1: 1, 2: 1, 3: 0, 4: 0, 5: 0, 6: 0}


def test_stream_returning_users_with_late_days(spark, tmp_path):
    """A day that arrives late, and the newer day again after it, come out once each."""
    rows = [*DAYS, (1, 7, at(4 * 86400), 1), (1, 8, at(9 * 86400 + 5), 1), (1, 9, at(4 * 86400 + 1), 1)]
    out = run(spark, tmp_path, rows, KIND, lambda df: streaming.returning_users(df, "ts"), 3, "update")
    assert {r.event_id: r.back for r in out} == {1: 0, 3: 0, 4: 0, 5: 1, 6: 1, 7: 0} and len(out) == 6


def test_stream_order_users(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    out = run(spark, tmp_path, DAYS, KIND, lambda df: streaming.order_users(df, "ts", ttl_ms=10**9), 2, "update")
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    assert {r.event_id: r.first_ever for r in out} == {1: 1, 3: 0, 4: 1, 5: 0, 6: 0}
    assert streaming.in_order(spark.readStream.format("rate").load().withColumn("t", F.col("timestamp")), "t").isStreaming


@pytest.mark.parametrize("forget, back", [(None, {1: 0, 2: 0, 3: 1, 4: 1, 5: 0, 6: 0}), (12, {1: 0, 2: 0, 3: 1, 4: 0, 5: 0, 6: 0})])
def test_stream_forgets_by_event_time(spark, tmp_path, forget, back):
    """A key whose newest day lies so many days before the watermark is forgotten: it comes back as a new one. Such a stream ends by itself."""
    rows = [(1, 1, at(0)), (2, 2, at(0)), (1, 3, at(9 * 86400)), (3, 5, at(20 * 86400)), (3, 6, at(21 * 86400)), (2, 4, at(22 * 86400))]
    out = run(spark, tmp_path, rows, "user_id long, event_id long, ts timestamp", lambda df: streaming.returning_users(df, "ts", delay="0 seconds", forget_days=forget), 6, "append")
    assert {r.event_id: r.back for r in out} == back
    with pytest.raises(ValueError):
        streaming.returning_users(spark.readStream.format("rate").load().select(F.lit(1).alias("user_id"), "timestamp"), "timestamp", forget_days=3)
