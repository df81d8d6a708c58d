"""Writers: JSON strings, keyed upserts, batched analytic tables, dimensions, dated landing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.sinks import keyed
from tidewater.sinks.keyed import create_table, dealt, keyed_parts, latest, lists, properties, read_changes, read_keyed, replay, upsert, vacuum  # noqa: F401
from tidewater.sinks.topics import publish, upsert_records  # noqa: F401


def as_json(df: DataFrame, key: list[str] | None = None) -> DataFrame:
    """``value`` as JSON of the row, and ``key`` as JSON of the key columns where given: what a Kafka sink takes."""
    value = F.to_json(F.struct(*df.columns)).alias("value")
    return df.select(*([F.to_json(F.struct(*key)).alias("key")] if key else []), value)


def write_strings(df: DataFrame, path: str | None = None, topic: str | None = None, servers: str | None = None, key: list[str] | None = None) -> None:
    """Appends rows as JSON strings to a topic, or to files."""
    rows = as_json(df, key)
    if topic:
        rows.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()
    else:
        rows.select("value").write.mode("append").text(path)


def stream_topic(df: DataFrame, topic: str, servers: str, checkpoint: str, key: list[str] | None = None, **trigger):
    """Stream of rows as JSON strings to a Kafka topic, keyed by JSON of ``key`` where given (an upsert stream). Its connector must be on the classpath."""
    writer = as_json(df, key).writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic)
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()


def stream_append(df: DataFrame, path: str, checkpoint: str, partition_by: tuple[str, ...] = (), **trigger):
    """Append-only stream to JSON files."""
    return df.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).partitionBy(*partition_by).trigger(**trigger or {"availableNow": True}).start()


def stream_batches(df: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, **trigger):
    """Runs ``each`` on every micro-batch."""
    return df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()


def write_analytic(df: DataFrame, transient: tuple[str, ...] = (), path: str | None = None, url: str | None = None, table: str | None = None, batch: int = 5000) -> None:
    """Appends to an analytic table in batches, without transient columns."""
    rows = df.drop(*transient)
    if url:
        rows.write.format("jdbc").option("url", url).option("dbtable", table).option("batchsize", batch).mode("append").save()
    else:
        rows.write.mode("append").parquet(path)


def dimension_rows(routed: DataFrame, columns: list[str], pk: str = "id") -> DataFrame:
    """Rows of one dimension table from routed change maps: all columns text, the key first."""
    names = [pk, *(c for c in columns if c != pk)]
    return routed.select(*[F.try_element_at("data", F.lit(c)).cast("string").alias(c) for c in names], "ts")


def land_by_date(df: DataFrame, ts: str, path: str) -> None:
    """Raw rows in folders by event date."""
    df.withColumn("dt", F.to_date(ts)).write.mode("append").partitionBy("dt").parquet(path)


def land_stamped(path: str):
    """What a micro-batch does: land its rows under ``path`` with ``arrived_at``, the time at which they came in. A batch run again keeps the stamps of its first run."""

    def each(batch: DataFrame, batch_id: int) -> None:
        jvm, fs, done = keyed._files(batch.sparkSession, f"{path}/batch={batch_id}/_SUCCESS")
        if not fs.exists(done):
            batch.withColumn("arrived_at", F.current_timestamp()).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return each


def split_late(path: str, ts: str, delay_s: float = 2.0, skew_s: float = 60.0):
    """What a micro-batch does: land its rows under ``path`` by lane: on_time, late, future.

    Late: older than the latest on-time row of earlier batches less ``delay_s``. Future: more than ``skew_s`` ahead of the
    clock; such rows move no watermark. Null times are late. Each row lies in exactly one lane. A batch run again
    replaces its folder, and keeps its first run's clock.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        jvm, fs, folder = keyed._files(spark, f"{path}/_clock")
        marks = sorted(int(f.getPath().getName()) for f in fs.listStatus(folder) if f.getPath().getName().isdigit()) if fs.exists(folder) else []
        begun = [m for m in marks if m % 2 == 0 and m // 2 == batch_id]
        before = [m for m in marks if m % 2 and m // 2 < batch_id]
        clock = _read_mark(spark, path, begun[-1]) if begun else _write_mark(spark, path, 2 * batch_id, spark.sql("select unix_millis(current_timestamp())").first()[0])
        low = _read_mark(spark, path, before[-1]) if before else None
        at = F.unix_millis(F.col(ts).cast("timestamp"))
        late = at.isNull() if low is None else at.isNull() | (at < low)
        lane = F.when(at > clock + int(1000 * skew_s), "future").when(late, "late").otherwise("on_time")
        batch.withColumn("lane", lane).write.mode("overwrite").partitionBy("lane").parquet(f"{path}/batch={batch_id}")
        _, _, here = keyed._files(spark, f"{path}/batch={batch_id}/lane=on_time")
        newest = spark.read.parquet(f"{path}/batch={batch_id}/lane=on_time").agg(F.max(at)).first()[0] if fs.exists(here) else None
        reached = [x for x in (low, None if newest is None else newest - int(1000 * delay_s)) if x is not None]
        if reached:
            _write_mark(spark, path, 2 * batch_id + 1, max(reached))

    return each


def _read_mark(spark, path: str, number: int) -> int:
    return int(keyed.read_small(spark, f"{path}/_clock/{number}"))


def _write_mark(spark, path: str, number: int, value: int) -> int:
    keyed.write_small(spark, f"{path}/_clock/{number}", str(value))
    return value
