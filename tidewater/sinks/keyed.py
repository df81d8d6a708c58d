"""Keyed Parquet tables: the latest row of each key, deletes, and a changelog of what each batch changed.

A table is a folder. Its rows lie in parts by hash of the key; a batch writes the parts that its keys fall into anew,
and one numbered list of all parts takes effect by a rename. So a crash leaves the table as it was, and readers see
whole batches only. Beside the parts, a batch writes the changes it made: ``+I`` (new key), ``-U`` and ``+U`` (row
before and after) and ``-D`` (row that a delete removed). Replayed in order they give the table.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Parts of a keyed table, unless its first batch says otherwise. A table keeps its number.
PARTS = 64
#: Rows of a part into which a large table is dealt.
TASK_ROWS = 500_000
#: Columns that the files have besides the table's own.
GONE, KIND, PART, TABLE, AGE = "_gone", "row_kind", "_part", "_in", "_new"


def latest(df: DataFrame, keys: list[str], order: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """One row for each key: the one that ``order`` puts last. A partial aggregate, so frequent keys do not gather in one task.

    Of rows that ``order`` does not tell apart, the later arrival stays: rows are numbered as their partitions hand them on.
    ``by``: some of the keys, by which a large table is dealt into parts of bounded size first (see :func:`dealt`). Where keys
    repeat seldom this saves the sort before the shuffle, and a join by the same columns needs no other one.
    """
    rest = [c for c in df.columns if c not in keys]
    top = F.max_by(F.struct(*rest), F.struct(*order, "_arrival")).alias("_top")
    rows = df.withColumn("_arrival", F.monotonically_increasing_id())
    if by:
        rows = dealt(rows, df.count(), *by)
    return rows.groupBy(*keys).agg(top).select(*keys, "_top.*").select(*df.columns)


def dealt(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """``df`` of about so many rows dealt by columns into parts of TASK_ROWS rows, so that a task's memory does not grow with the table; a table of one such part stays as it is."""
    parts = -(-rows // TASK_ROWS)
    return df.repartition(max(parts, df.sparkSession.sparkContext.defaultParallelism), *by) if parts > 1 else df


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def lists(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the table's complete lists, ascending: one for each batch that had rows, and one for its creation."""
    _, fs, folder = _files(spark, f"{path}/_lists")
    names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))


def read_small(spark: SparkSession, path: str) -> str:
    """The text of a small file, read by the driver."""
    jvm, fs, file = _files(spark, path)
    stream = fs.open(file)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_small(spark: SparkSession, path: str, text: str) -> None:
    """A small file, written by the driver; what was there goes."""
    _, fs, file = _files(spark, path)
    stream = fs.create(file, True)
    try:
        stream.write(text.encode())
    finally:
        stream.close()


def _list(spark: SparkSession, path: str, number: int) -> dict:
    return json.loads(read_small(spark, f"{path}/_lists/{number:012d}.json"))


def _last(spark: SparkSession, path: str) -> dict | None:
    found = lists(spark, path)
    return _list(spark, path, found[-1]) | {"number": found[-1]} if found else None


def _commit(spark: SparkSession, path: str, number: int, state: dict) -> None:
    """Makes list ``number`` of the table by one rename; it must not exist yet."""
    draft = f"{path}/_drafts/{uuid.uuid4().hex}"
    write_small(spark, draft, json.dumps(state))
    jvm, fs, folder = _files(spark, f"{path}/_lists")
    fs.mkdirs(folder)
    to = jvm.org.apache.hadoop.fs.Path(f"{path}/_lists/{number:012d}.json")
    if fs.exists(to) or not fs.rename(jvm.org.apache.hadoop.fs.Path(draft), to):
        raise RuntimeError(f"{to} exists: another writer changed the table meanwhile")


def create_table(spark: SparkSession, path: str, schema: str | StructType, parts: int = PARTS, properties: str | None = None) -> bool:
    """Makes an empty keyed table with the columns of ``schema`` and free-form ``properties``, if there is none; whether it did."""
    if lists(spark, path):
        return False
    _commit(spark, path, 0, {"parts": {}, "of": parts, "schema": schema if isinstance(schema, str) else schema.json(), "properties": properties})
    return True


def properties(spark: SparkSession, path: str) -> str | None:
    """What the table was created with."""
    return (_last(spark, path) or {}).get("properties")


def keyed_parts(spark: SparkSession, path: str) -> dict[int, str]:
    """The folder of each part of a keyed table, by its last list; none before its first batch."""
    return {int(k): v for k, v in (_last(spark, path) or {"parts": {}})["parts"].items()}


def read_keyed(spark: SparkSession, path: str) -> DataFrame | None:
    """A keyed table as it is now, without deleted keys; None before it is created."""
    now = _last(spark, path)
    if now is None:
        return None
    if not now["parts"]:
        schema = now["schema"]
        return spark.createDataFrame([], StructType.fromJson(json.loads(schema)) if schema.startswith("{") else schema)
    rows = spark.read.option("mergeSchema", True).parquet(*(f"{path}/{v}" for v in now["parts"].values()))
    return rows.filter(~F.col(GONE)).drop(GONE, KIND)


def read_changes(spark: SparkSession, path: str, after: int = -1) -> DataFrame | None:
    """What the batches after list ``after`` changed: the table's columns, ``row_kind`` (+I, -U, +U, -D) and ``commit`` (the list's number); None where there was no batch."""
    found = None
    for number in lists(spark, path):
        folder = _list(spark, path, number).get("changes") if number > after else None
        if folder:
            rows = spark.read.option("mergeSchema", True).parquet(f"{path}/{folder}").drop(GONE, PART).withColumn("commit", F.lit(number).cast("long"))
            found = rows if found is None else found.unionByName(rows, allowMissingColumns=True)
    return found


def replay(changes: DataFrame, keys: list[str]) -> DataFrame:
    """The table that a changelog from the first batch on leads to."""
    after = latest(changes.filter(F.col(KIND) != "-U"), keys, ["commit"])
    return after.filter(F.col(KIND) != "-D").drop(KIND, "commit")


def upsert(batch: DataFrame, path: str, keys: list[str], order: list[str], deleted: str | None = None, batch_id: int | None = None, source: str = "", parts: int = PARTS) -> bool:
    """Merges rows into a keyed Parquet table: the latest of each key stays, of equal ones that of the later batch. Whether there was anything to merge.

    ``deleted`` names a boolean column (left out of the table): where true, the row removes its key. The delete is
    remembered with its order, so that an older row that comes later does not bring the key back; a newer one does.
    A batch without rows changes nothing. ``batch_id`` (ascending for each ``source``, as a stream numbers its batches)
    makes a repeated batch change nothing. Only the parts that the batch's keys fall into are read and written. One
    writer at a time, as a stream has; a second one gets an error. Null keys are keys like others. What the last list
    no longer names stays for readers who began before; :func:`vacuum` deletes it.
    """
    spark = batch.sparkSession
    now = _last(spark, path) or {"parts": {}, "of": parts, "number": -1}
    done = now.get("batches", {})
    if batch_id is not None and batch_id <= done.get(source, -1):
        return False
    part = F.pmod(F.xxhash64(*[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]), F.lit(now["of"])).cast("int")
    columns = [c for c in batch.columns if c != deleted]
    gone = F.coalesce(F.col(deleted), F.lit(False)) if deleted else F.lit(False)
    rows = batch.select(*columns, gone.alias(GONE), part.alias(PART), F.lit(True).alias(AGE))
    cached = rows.persist()
    try:
        touched = [r[0] for r in cached.select(PART).distinct().collect()]  # at most as many as the table has parts
        if not touched:
            return False
        old = [f"{path}/{now['parts'][str(p)]}" for p in touched if str(p) in now["parts"]]
        if old:
            held = spark.read.option("mergeSchema", True).parquet(*old).drop(KIND)
            rows = held.withColumn(PART, part).withColumn(AGE, F.lit(False)).unionByName(cached, allowMissingColumns=True)
            columns = [c for c in rows.columns if c not in (GONE, PART, AGE)]
        folder = f"{now['number'] + 1:012d}-{uuid.uuid4().hex}"
        _merged(rows, keys, order, columns).hint("rebalance", PART).write.partitionBy(TABLE, PART).parquet(f"{path}/{folder}")
    finally:
        cached.unpersist()
    state = {k: v for k, v in now.items() if k != "number"} | {"parts": now["parts"] | {str(p): f"{folder}/{TABLE}=rows/{PART}={p}" for p in touched}}
    _, fs, changed = _files(spark, f"{path}/{folder}/{TABLE}=changes")
    state |= {"changes": f"{folder}/{TABLE}=changes" if fs.exists(changed) else None, "batches": done | ({} if batch_id is None else {source: batch_id})}
    _commit(spark, path, now["number"] + 1, state)
    return True


def _merged(rows: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Rows of the table and of its changelog, told apart by ``_in``, from the rows held (one for each key) and those of the batch."""
    values = [c for c in columns if c not in keys]
    row = F.struct(*values, GONE)
    top = F.max_by(row, F.struct(*order, AGE, "_arrival")).alias("_top")
    before = F.first(F.when(~F.col(AGE), row), ignorenulls=True).alias("_before")
    both = rows.withColumn("_arrival", F.monotonically_increasing_id()).groupBy(*keys, PART).agg(top, before)
    was, is_ = F.coalesce(~F.col("_before")[GONE], F.lit(False)), ~F.col("_top")[GONE]
    # Maps have no equality in Spark: rows are compared as JSON.
    same = F.to_json(F.struct(F.col("_before").alias("r"))) == F.to_json(F.struct(F.col("_top").alias("r")))
    out = lambda where, kind, row: F.struct(F.lit(where).alias(TABLE), F.lit(kind).cast("string").alias(KIND), F.col(row).alias("_row"))
    some = lambda when, *made: F.when(when, F.array(*made)).otherwise(F.array().cast(f"array<struct<{TABLE}:string,{KIND}:string,_row:{both.schema['_top'].dataType.simpleString()}>>"))
    outputs = F.concat(
        F.array(out("rows", None, "_top")),
        some(is_ & ~was, out("changes", "+I", "_top")),
        some(was & ~is_, out("changes", "-D", "_before")),
        some(was & is_ & ~same, out("changes", "-U", "_before"), out("changes", "+U", "_top")),
    )
    spread = both.select(*keys, PART, F.explode(outputs).alias("_o"))
    picked = {c: F.col("_o")["_row"][c].alias(c) for c in [*values, GONE]} | {k: F.col(k) for k in keys}
    return spread.select(*[picked[c] for c in columns], picked[GONE], F.col("_o")[KIND].alias(KIND), PART, F.col("_o")[TABLE].alias(TABLE))


def vacuum(spark: SparkSession, path: str, keep: int = 10) -> int:
    """Deletes all but the last ``keep`` lists, and the parts and changes that only deleted lists name; how many folders went.

    A changelog can be read as far back as the lists that stay.
    """
    numbers = lists(spark, path)
    if len(numbers) <= keep:
        return 0
    jvm, fs, folder = _files(spark, path)
    kept = [_list(spark, path, n) for n in numbers[-keep:]]
    named = {v for x in kept for v in [*x["parts"].values(), x.get("changes")] if v}
    last = numbers[-1]
    for n in numbers[:-keep]:
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/_lists/{n:012d}.json"), False)
    gone = 0
    for one in fs.listStatus(folder):
        name = one.getPath().getName()
        if name.startswith("_") or int(name.split("-")[0]) > last:  # lists, or a batch under way
            continue
        for inner in [f"{name}/{TABLE}=changes", *(f"{name}/{TABLE}=rows/{f.getPath().getName()}" for f in _under(jvm, fs, f"{path}/{name}/{TABLE}=rows"))]:
            if inner not in named and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{inner}")):
                gone += fs.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/{inner}"), True)
        if not any(v.startswith(f"{name}/") for v in named):
            fs.delete(one.getPath(), True)
    return gone


def _under(jvm, fs, path: str) -> list:
    folder = jvm.org.apache.hadoop.fs.Path(path)
    return list(fs.listStatus(folder)) if fs.exists(folder) else []
