"""Readers: JSON strings, change records, page logs, fact rows and lookups, as tables or as streams."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewater.functions import EXACT, camel

CHANGE = "database string, `table` string, type string, ts bigint, xid bigint, commit boolean, data map<string,string>, old map<string,string>"
COMMON = "common struct<ar:string,ba:string,ch:string,is_new:string,md:string,mid:string,os:string,uid:string,vc:string>"
APP_LOG = (
    COMMON + ", page struct<page_id:string,last_page_id:string,item:string,item_type:string,during_time:bigint,source_type:string>, start string,"
    " displays array<struct<display_type:string,item:string,item_type:string,`order`:int,pos_id:int>>, actions array<map<string,string>>,"
    " err struct<error_code:int,msg:string>, ts bigint"
)
PAGE_LOG = "common map<string,string>, page map<string,string>, ts bigint"
DICTIONARY = "dic_code string, dic_name string, parent_code string, create_time timestamp, operate_time timestamp"
# Fixed names, in the order of the order-detail fact.
ORDER_DETAIL_COLUMNS = (
    "order_detail_id order_id sku_id sku_name order_price sku_num order_create_time source_type source_id split_original_amount split_total_amount "
    "split_activity_amount split_coupon_amount pt consignee consignee_tel total_amount order_status user_id payment_way out_trade_no trade_body operate_time "
    "expire_time process_status tracking_no parent_order_id province_id activity_reduce_amount coupon_reduce_amount original_total_amount feight_fee "
    "feight_fee_reduce type old activity_id activity_rule_id activity_create_time coupon_id coupon_use_id coupon_create_time dic_name ts"
).split()
_OTHER = {"pt": "timestamp", "ts": "timestamp", "old": "map<string,string>"}
ORDER_DETAIL = ", ".join(f"{c} {_OTHER.get(c, 'string')}" for c in ORDER_DETAIL_COLUMNS)


def kafka_options(topic: str, servers: str, group: str | None = None, **options: str) -> dict[str, str]:
    """Options of a Kafka reader. A stream goes on from its checkpoint, which holds what a group's offsets would; one without begins at the
    earliest rows, or at ``startingOffsets``. ``group`` begins the names of its consumer groups, so that two queries do not share one and halve the rows."""
    named = {"groupIdPrefix": group} if group else {}
    return {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest"} | named | options


def strings(spark: SparkSession, path: str | None = None, stream: bool = False, topic: str | None = None, servers: str | None = None, group: str | None = None, **options: str) -> DataFrame:
    """One column ``value``; null becomes empty. A Kafka topic where ``topic`` is given (its connector must be on the classpath), else text files."""
    reader = spark.readStream if stream else spark.read
    if topic:
        raw = reader.format("kafka").options(**kafka_options(topic, servers, group, **options)).load()
        return raw.select(F.coalesce(F.col("value").cast("string"), F.lit("")).alias("value"))
    return reader.format("text").options(**options).load(path).select(F.coalesce("value", F.lit("")).alias("value"))


def keyed_records(spark: SparkSession, path: str | None = None, stream: bool = False, topic: str | None = None, servers: str | None = None, group: str | None = None, **options: str) -> DataFrame:
    """Records of an upsert topic: key, value (null: a deleted key) and offset, which orders the records of a key. A Kafka topic where ``topic`` is given, else the files of ``publish``."""
    reader = spark.readStream if stream else spark.read
    if topic:
        raw = reader.format("kafka").options(**kafka_options(topic, servers, group, **options)).load()
        return raw.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "offset")
    return reader.schema("key string, value string, commit long").options(**options).json(path).select("key", "value", F.col("commit").alias("offset"))


def upserts(records: DataFrame, schema: str | StructType) -> DataFrame:
    """Rows of ``schema`` from upsert records, with ``gone`` (a deleted key, of which only the key's columns are filled) and offset: what ``upsert`` takes, ordered by offset. ``schema`` has no columns of these two names."""
    row = F.from_json(F.coalesce("value", "key"), schema, EXACT)
    return records.select(row.alias("r"), F.col("value").isNull().alias("gone"), "offset").select("r.*", "gone", "offset")


def topics(spark: SparkSession, paths: Iterable[str], **options) -> list[DataFrame]:
    """Several sources of one job."""
    return [strings(spark, p, **options) for p in paths]


def json_rows(values: DataFrame, schema: str) -> DataFrame:
    """Columns of ``schema`` parsed from ``value``; a value that is no object gives nulls."""
    return values.select(F.from_json("value", schema).alias("r")).select("r.*")


def changes(values: DataFrame) -> DataFrame:
    """Change records, with processing time ``pt`` and event time ``event_time`` (ts is in seconds), and ``old`` also as JSON text."""
    rows = values.select(F.from_json("value", CHANGE).alias("r"), F.get_json_object("value", "$.old").alias("old_text"))
    return rows.select("r.*", "old_text", F.current_timestamp().alias("pt"), F.timestamp_seconds("r.ts").alias("event_time"))


def page_log(values: DataFrame, delay: str = "2 seconds") -> DataFrame:
    """Page log with event time ``rt`` of whole seconds and its watermark."""
    rows = json_rows(values, PAGE_LOG)
    return rows.withColumn("rt", F.timestamp_seconds(F.floor(F.col("ts") / 1000))).withWatermark("rt", delay)


def order_details(values: DataFrame, *columns: str) -> DataFrame:
    """Order-detail facts as written by the order-detail job; with ``columns`` only these are parsed."""
    return json_rows(values, ", ".join(f"{c} {_OTHER.get(c, 'string')}" for c in columns or ORDER_DETAIL_COLUMNS))


def lookup(spark: SparkSession, path: str | None = None, table: str | None = None, url: str | None = None, schema: str = DICTIONARY) -> DataFrame:
    """A dimension table as it is when this is called, from JDBC or files: a DataFrame of files keeps the list of files that it began with."""
    if url:
        return spark.read.format("jdbc").option("url", url).option("dbtable", table).load()
    return spark.read.schema(schema).parquet(path)


def fresh(spark: SparkSession, **where: str) -> Callable[[], DataFrame]:
    """A lookup to be read anew: each call gives the table as it is then. Called in each micro-batch, it serves as a lookup at processing time."""
    return lambda: lookup(spark, **where)


def routing_config(rows: DataFrame) -> DataFrame:
    """Latest routing row for each source table: key ``source_table``; a row of type delete removes it. ``ts`` orders; ties by the whole row."""
    last = rows.groupBy("source_table").agg(F.max(F.struct("ts", "type", "sink_table", "sink_columns", "sink_pk", "sink_extend")).alias("c"))
    live = last.filter(F.coalesce(F.col("c.type") != "delete", F.lit(True)))
    return live.select("source_table", "c.sink_table", "c.sink_columns", F.coalesce("c.sink_pk", F.lit("id")).alias("sink_pk"), "c.sink_extend")


def query_list(spark: SparkSession, sql: str, underscore_to_camel: bool = False) -> DataFrame:
    """Result of a query, with columns renamed to lowerCamel if asked."""
    found = spark.sql(sql)
    return renamed_camel(found) if underscore_to_camel else found


def renamed_camel(df: DataFrame) -> DataFrame:
    return df.toDF(*map(camel, df.columns))
