"""Keyed tables as upsert topics: records of key and value, in which a null value deletes the key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import EXACT
from tidewater.sinks import keyed


def upsert_records(changes: DataFrame, keys: list[str]) -> DataFrame:
    """key and value (JSON texts) and commit of what the readers of a changelog need: each changed row as it is after the commit, a deleted key with a null value.

    Rows before a change (-U) are left out, as the record that follows replaces them. Null fields are not in the texts.
    """
    row = F.struct(*[c for c in changes.columns if c not in (keyed.KIND, "commit")])
    value = F.when(F.col(keyed.KIND) != "-D", F.to_json(row, EXACT))
    return changes.filter(F.col(keyed.KIND) != "-U").select(F.to_json(F.struct(*keys), EXACT).alias("key"), value.alias("value"), "commit")


def publish(spark: SparkSession, path: str, keys: list[str], to: str, topic: str | None = None, servers: str | None = None) -> int:
    """Sends what the changelog of the keyed table ``path`` gained since the last call, as upsert records: to a topic, or as JSON lines into ``to/records``.

    ``to`` remembers the last commit sent, which is returned (-1: none yet). The records of a key go out in the order of
    commits, from one task. A call that was cut off is made again as a whole: files are replaced, a topic gets some
    records twice, which readers of upserts do not see. Where ``vacuum`` took changes not yet sent, ValueError.
    """
    _, fs, marks = keyed._files(spark, f"{to}/_sent")
    sent = max((int(f.getPath().getName()) for f in fs.listStatus(marks) if f.getPath().getName().isdigit()), default=-1) if fs.exists(marks) else -1
    numbers = keyed.lists(spark, path)
    if not numbers or numbers[-1] <= sent:
        return sent
    if numbers[0] > sent + 1:
        raise ValueError(f"changes {sent + 1} to {numbers[0] - 1} of {path} were not sent and are gone")
    changes = keyed.read_changes(spark, path, sent)
    if changes is not None:
        records = upsert_records(changes.filter(F.col("commit") <= numbers[-1]), keys).repartition("key").sortWithinPartitions("commit")
        if topic:
            records.select("key", "value").write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()
        else:
            records.write.mode("overwrite").json(f"{to}/records/after={sent}")
    keyed.write_small(spark, f"{to}/_sent/{numbers[-1]}", "")
    return numbers[-1]
