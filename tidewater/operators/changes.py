"""Change records: filters, routing, projections, and the joins that build fact rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions import as_int, has_key, keep_keys, pick
from tidewater.sinks import latest
from tidewater.sources import order_details

#: The most rows, and bytes as JSON, of a side that is broadcast.
SMALL_ROWS, SMALL_BYTES = 100_000, 32 << 20
#: Rows of a dimension beyond which it is hashed part by part instead.
LARGE_ROWS = 2_000_000
INSERTS, WRITES = ("insert",), ("bootstrap-insert", "insert", "update")


def of_table(changes: DataFrame, table: str, types: tuple[str, ...] = INSERTS) -> DataFrame:
    """Records of a table with the given types."""
    return changes.filter((F.col("table") == table) & F.col("type").isin(*types))


def project(changes: DataFrame, keys: list[str], extra: tuple[str, ...] = (), **renamed: str) -> DataFrame:
    """Columns from the keys of ``data``; renamed: new name = key."""
    data = F.col("data")
    return changes.select(*[pick(data, k).alias(k) for k in keys], *[pick(data, k).alias(n) for n, k in renamed.items()], *extra)


def increased(value: str) -> Column:
    """Insert, or update whose old value of ``value`` was less."""
    new, old = as_int(pick(F.col("data"), value)), as_int(pick(F.col("old"), value))
    return (F.col("type") == "insert") | ((F.col("type") == "update") & F.coalesce(new > old, F.lit(False)))


def increase(value: str) -> Column:
    """The value of an insert; of an update, how much it grew."""
    new, old = as_int(pick(F.col("data"), value)), as_int(pick(F.col("old"), value))
    return F.when(F.col("type") == "insert", new).otherwise(new - old)


def became(column: str, value: str) -> Column:
    """Update to ``value`` of a column that changed."""
    return (F.col("type") == "update") & (pick(F.col("data"), column) == value) & pick(F.col("old"), column).isNotNull()


def changed(key: str, keep_null: bool) -> Column:
    """Whether ``old`` has the key; a null ``old`` counts as ``keep_null`` says."""
    return F.coalesce(has_key(F.col("old"), key), F.lit(keep_null))


def favoured(column: str = "is_cancel") -> Column:
    """Insert, or update of the column from 1 to 0."""
    back = (F.col("type") == "update") & (pick(F.col("old"), column) == "1") & (pick(F.col("data"), column) == "0")
    return (F.col("type") == "insert") | F.coalesce(back, F.lit(False))


def inserted_details(values: DataFrame, *columns: str) -> DataFrame:
    """Order details of type insert from a stream of their JSON texts; empty texts, by which an upsert stream deletes, are left out. With ``columns`` only these and the type are parsed."""
    return order_details(values.filter(F.col("value") != ""), *(dict.fromkeys([*columns, "type"]) if columns else [])).filter("type = 'insert'")


def small_side(df: DataFrame) -> DataFrame:
    """``df`` marked for a broadcast, if a count shows that it has at most SMALL_ROWS rows and SMALL_BYTES bytes; else as it is, for a join by shuffles."""
    found = df.limit(SMALL_ROWS + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("size")).first()
    return F.broadcast(df) if found.n <= SMALL_ROWS and (found.size or 0) <= SMALL_BYTES else df


def route(changes: DataFrame, config: DataFrame) -> DataFrame:
    """Records of configured tables, deletes dropped: sink_table, sink_pk, ts and ``data`` with the configured columns only.

    ``config`` holds a row for each table of the source database.
    """
    joined = changes.filter(F.col("type").isin(*WRITES)).join(small_side(config), F.col("table") == F.col("source_table"))
    return joined.select("sink_table", "sink_pk", "sink_extend", "ts", keep_keys(F.col("data"), F.col("sink_columns")).alias("data"))


def enrich(df: DataFrame, dim: DataFrame, key: str, dim_key: str, how: str = "left", small: bool = False, large: bool = False, **columns: str) -> DataFrame:
    """``df`` with columns of a dimension (new name = its column) by key; a missing key gives nulls, or no row with how='inner'.

    The dimension's key must be unique. ``small``: a dimension that should be small, such as a code dictionary, is
    broadcast if a count agrees; for others Spark chooses from their size. ``large``: a dimension with which many rows meet; if a
    count finds it too long for a broadcast, it is hashed part by part, so that those rows need no sort.
    """
    side = dim.select(F.col(dim_key).alias("_k"), *[F.col(c).alias(n) for n, c in columns.items()])
    if large and dim.count() > LARGE_ROWS:
        side = side.hint("shuffle_hash")
    return df.join(small_side(side) if small else side, F.col(key) == F.col("_k"), how).drop("_k")


def enrich_by(df: DataFrame, dim: DataFrame, key: Column, dim_key: Column, joined: Callable[[Column], dict[str, Column]], how: str = "left") -> DataFrame:
    """``df`` with columns made by a user's functions: ``key`` and ``dim_key`` say what meets, ``joined`` makes the new columns (or new values of old ones)
    from the dimension's row, a struct that is null where the key is missing. The dimension's key must be unique; no column of it comes along by itself."""
    side = dim.select(dim_key.alias("_k"), F.struct("*").alias("_dim"))
    rows = df.withColumn("_key", key)
    return rows.join(side, F.col("_key") == F.col("_k"), how).withColumns(joined(F.col("_dim"))).drop("_key", "_k", "_dim")


def order_detail_wide(details: DataFrame, orders: DataFrame, activities: DataFrame, coupons: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Order details with their order (inner), activity and coupon (left, latest of each detail) and source name (inner).

    Projected inputs, named as in the order-detail fact; ``orders`` has order_id, the others order_detail_id.
    """
    wide = details.withColumn("split_original_amount", (F.col("order_price").cast("decimal(16,2)") * F.col("sku_num").cast("decimal(16,2)")).cast("string"))
    wide = wide.join(orders, "order_id")
    for side, ts in ((activities, "activity_create_time"), (coupons, "coupon_create_time")):
        rows = side if ts in side.columns else side.withColumn(ts, F.lit(None).cast("string"))
        wide = wide.join(latest(rows, ["order_detail_id"], [ts]), "order_detail_id", "left")
    return enrich(wide, dictionary, "source_type", "dic_code", "inner", small=True, dic_name="dic_name")


def paid_details(payments: DataFrame, details: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Successful payments joined to the details of their orders, with the payment type's name."""
    joined = payments.join(details.drop("user_id"), "order_id")
    return enrich(joined, dictionary, "payment_type_code", "dic_code", "inner", small=True, payment_type_name="dic_name")


def refund_requests(refunds: DataFrame, orders: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Refund requests with the province of their order (left, latest) and the names of type and reason (one dictionary, two roles)."""
    order_side = latest(orders.select(F.col("id").alias("order_id"), "province_id", "ts"), ["order_id"], ["ts"]).drop("ts")
    joined = refunds.join(order_side, "order_id", "left")
    named = enrich(joined, dictionary, "refund_type_code", "dic_code", small=True, refund_type_name="dic_name")
    return enrich(named, dictionary, "refund_reason_type_code", "dic_code", small=True, refund_reason_type_name="dic_name")


def refund_payments(paid: DataFrame, orders: DataFrame, requests: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Refund payments with their order (left), request by order and product (left), and payment type's name (left)."""
    order_side = latest(orders.select(F.col("id").alias("order_id"), "user_id", "province_id", "ts"), ["order_id"], ["ts"]).drop("ts")
    request_side = latest(requests.select("order_id", "sku_id", "refund_num", "ts"), ["order_id", "sku_id"], ["ts"]).drop("ts")
    joined = paid.join(order_side, "order_id", "left").join(request_side, ["order_id", "sku_id"], "left")
    return enrich(joined, dictionary, "payment_type_code", "dic_code", small=True, payment_type_name="dic_name")
