"""The warehouse's jobs: each builds its output from the streams it reads; tables in place of streams give the batch form.

Change records are those of :func:`tidewater.sources.changes`, logs those of the page, start and other routes. Jobs that keep
state are bounded by watermarks. ``start`` runs a job from its sources to its sink.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater import sinks, sources, streaming
from tidewater.functions import changed_or_created, flag, pick, split_words
from tidewater.operators import changes as ch
from tidewater.operators import logs, windows
from tidewater.streaming.updating import Side, UpdatingJoin

WIDTH = "10 seconds"
# Fixed names, as in the change records.
DETAIL_FIELDS = "order_id sku_id sku_name order_price sku_num source_type source_id split_total_amount split_activity_amount split_coupon_amount"
ORDER_FIELDS = (
    "user_id province_id order_status total_amount original_total_amount activity_reduce_amount coupon_reduce_amount operate_time consignee consignee_tel payment_way "
    "out_trade_no trade_body expire_time process_status tracking_no parent_order_id feight_fee feight_fee_reduce"
)


def _day(c: str) -> Column:
    return F.date_format(F.to_timestamp(pick(F.col("data"), c)), "yyyy-MM-dd").alias("date_id")


def _original() -> Column:
    """Price times number, as text."""
    return (F.col("order_price").cast("decimal(16,2)") * F.col("sku_num").cast("decimal(16,2)")).cast("string")


def _fields(changes: DataFrame, names: str, *more, **renamed: str) -> DataFrame:
    """The named keys of ``data`` as columns, further ones, and event_time, with its watermark on a stream."""
    rows = ch.project(changes, names.split(), (*more, "event_time"), **renamed)
    return rows.withWatermark("event_time", "2 seconds") if rows.isStreaming else rows


def _near(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", bound: str = "3 days") -> DataFrame:
    """Left rows with the right columns of equal ``keys`` whose event times are within ``bound``: a stream-stream join with bounded state, or a join of tables."""
    other = right.select(*[F.col(c).alias(f"_r_{c}" if c in [*keys, "event_time"] else c) for c in right.columns])
    same = F.expr(" AND ".join([*(f"{k} = _r_{k}" for k in keys), f"_r_event_time BETWEEN event_time - INTERVAL {bound} AND event_time + INTERVAL {bound}"]))
    return left.join(other, same, how).drop(*[c for c in other.columns if c.startswith("_r_")])


# Logs.


def split_log(values: DataFrame, repair: bool = True) -> DataFrame:
    """Route, page_id, ts and body of every output of the raw log, new-visitor flags repaired by device; what is no log row goes by route "dirty".

    On a stream, the repair goes by the order in which rows come; logs without a device or a time pass by it. Update mode on a stream, as nothing is held back.
    """
    objects, dirty = logs.log_objects(values)
    if repair and objects.isStreaming:
        visits = logs.visits_of(objects).select("value", "mid", "at", "is_new")
        seen = F.col("mid").isNotNull() & F.col("at").isNotNull()
        flagged = streaming.repair_is_new(visits.filter(seen).withColumnRenamed("is_new", "flag"), "at", key="mid").select("value", "is_new")
        rows = flagged.unionByName(visits.filter(~seen).select("value", "is_new"))
        objects = logs.with_flag(logs.with_object(rows), "is_new")
    elif repair:
        objects = logs.repaired_log(objects)
    return logs.routed(objects).unionByName(dirty.select(F.lit("dirty").alias("route"), F.lit(None).cast("string").alias("page_id"), F.lit(None).cast("long").alias("ts"), F.col("value").alias("body")))


def pages(values: DataFrame) -> DataFrame:
    """Page rows with event time ``rt``."""
    rows = sources.json_rows(values, sources.PAGE_LOG)
    return rows.withColumn("rt", F.timestamp_seconds(F.floor(F.col("ts") / 1000)))


def unique_visitors(page_rows: DataFrame) -> DataFrame:
    """First session entry of each device and day."""
    entries = logs.session_entries(page_rows).withColumn("mid", F.col("common.mid"))
    if entries.isStreaming:
        return streaming.first_of_day(entries, ["mid"], "rt")
    return logs.first_of_day(entries.withColumn("_day", F.to_date("rt")), ["mid"], "_day", ["rt"]).drop("_day")


def keyword_views(page_rows: DataFrame, width: str = WIDTH, tokenizer=split_words) -> DataFrame:
    """Words searched for by window. Every page row moves the watermark, whether it is a search or not."""
    live = page_rows.isStreaming
    words = logs.explode_words(logs.searches(page_rows.withWatermark("rt", "2 seconds") if live else page_rows, "rt" if live else None), "keyword", tokenizer)
    return windows.tumble(words.select("rt", F.lit("search").alias("source"), F.col("word").alias("keyword")), "rt", width, ["source", "keyword"], keyword_count=F.count(F.lit(1)))


def home_and_detail(page_rows: DataFrame, width: str = WIDTH) -> DataFrame:
    """Devices that see the home and a detail page, each once a day, by window."""
    seen = logs.of_pages(page_rows, "home", "good_detail").select("rt", F.col("common.mid").alias("mid"), F.col("page.page_id").alias("page_id"))
    first = streaming.first_of_day(seen, ["mid", "page_id"], "rt") if seen.isStreaming else logs.first_of_day(seen.withColumn("_day", F.to_date("rt")), ["mid", "page_id"], "_day", ["rt"])
    return windows.tumble(first, "rt", width, [], home_uv_ct=F.sum(flag(F.col("page_id") == "home")).cast("long"), good_detail_uv_ct=F.sum(flag(F.col("page_id") == "good_detail")).cast("long"))


def bounced(page_rows: DataFrame, bound_s: int = 10) -> DataFrame:
    """Page rows that are session entries of a device and stay alone for ``bound_s`` seconds: no further page, or another entry."""
    rows = page_rows.withColumn("mid", F.col("common.mid")).withColumn("entry", F.col("page.last_page_id").isNull()).filter("mid is not null")
    if rows.isStreaming:
        return streaming.bounces(rows, "rt", 1000 * bound_s, key="mid", tie="ts").drop("mid", "entry")
    return logs.bounces(rows, "mid", "rt", "ts", "entry", f"{bound_s} seconds").drop("mid", "entry")


def user_logins(page_rows: DataFrame, width: str = WIDTH) -> DataFrame:
    """Users who log in, each once a day, and those of them who come back after a week or more, by window of the day's first login."""
    rows = logs.logged_in_entries(page_rows).select(F.col("common.uid").alias("uid"), "rt", "ts")
    if rows.isStreaming:
        found = streaming.returning_users(rows, "rt", key="uid", tie="ts", delay="0 seconds")
    else:
        first = logs.first_of_day(rows.withColumn("day", F.to_date("rt")), ["uid"], "day", ["rt", "ts"])
        found = first.join(windows.returning_users(first.select("uid", "day"), "uid", "day"), ["uid", "day"])
    return windows.tumble(found, "rt", width, [], uu_ct=F.sum("uu"), back_ct=F.sum("back"))


def page_views(page_rows: DataFrame, visitors: DataFrame, jumps: DataFrame, width: str = WIDTH) -> DataFrame:
    """Visitors, sessions, views, duration and bounces by version, channel, area and new flag: three streams, one watermark after their union."""
    dims = {"vc": "vc", "ch": "ch", "ar": "ar", "is_new": "is_new"}
    shaped = [x.select("rt", *[F.col(f"common.{c}").alias(n) for n, c in dims.items()], F.col("page.during_time").cast("double").alias("during"), F.col("page.last_page_id").isNull().alias("entry")) for x in (page_rows, visitors, jumps)]
    rows = windows.page_view_rows(*shaped, dims=list(dims), ts="rt", during="during", entry="entry")
    rows = rows.withWatermark("rt", "2 seconds") if rows.isStreaming else rows
    return windows.tumble(rows, "rt", width, list(dims), **{c: F.sum(c) for c in ("uv_ct", "sv_ct", "pv_ct", "dur_sum", "uj_ct")})


def registrations(changes: DataFrame, width: str = WIDTH) -> DataFrame:
    rows = ch.of_table(changes, "user_info").select("event_time")
    rows = streaming.in_order(rows, "event_time") if rows.isStreaming else rows
    return windows.tumble(rows, "event_time", width, [], register_ct=F.count(F.lit(1)))


def cart_users(changes: DataFrame, width: str = WIDTH) -> DataFrame:
    """Users who add to their cart, each once a day, by window of the time of change, else of creation."""
    rows = ch.of_table(changes, "cart_info", ("insert", "update")).filter(ch.increased("sku_num"))
    rows = rows.select(pick(F.col("data"), "user_id").alias("user_id"), F.to_timestamp(changed_or_created(F.col("data"))).alias("at"))
    first = streaming.first_of_day(rows, ["user_id"], "at") if rows.isStreaming else logs.first_of_day(rows.withColumn("_day", F.to_date("at")), ["user_id"], "_day", ["at"])
    return windows.tumble(first, "at", width, [], cart_add_uu_ct=F.count(F.lit(1)))


# Facts.


def cart_additions(changes: DataFrame, dictionary: DataFrame) -> DataFrame:
    rows = ch.of_table(changes, "cart_info", ("insert", "update")).filter(ch.increased("sku_num"))
    out = _fields(rows, "id user_id sku_id cart_price sku_name is_checked create_time operate_time is_ordered order_time source_type source_id", ch.increase("sku_num").alias("sku_num"))
    return ch.enrich(out, dictionary, "source_type", "dic_code", "inner", small=True, dic_name="dic_name")


def order_details(changes: DataFrame, dictionary: DataFrame) -> DataFrame:
    """The wide order-detail fact from one stream of changes: detail with order (inner), activity and coupon (left) and source name (inner)."""
    details = _fields(ch.of_table(changes, "order_detail"), DETAIL_FIELDS, "pt", order_detail_id="id", order_create_time="create_time").withColumn("split_original_amount", _original())
    orders = _fields(ch.of_table(changes, "order_info", ("insert", "update")), ORDER_FIELDS, "type", "old", F.col("pt").alias("order_pt"), order_id="id")
    activities = _fields(ch.of_table(changes, "order_detail_activity"), "order_detail_id activity_id activity_rule_id", F.col("pt").alias("activity_pt"), activity_create_time="create_time")
    coupons = _fields(ch.of_table(changes, "order_detail_coupon"), "order_detail_id coupon_id coupon_use_id", F.col("pt").alias("coupon_pt"), coupon_create_time="create_time")
    wide = _near(details, orders, ["order_id"])
    wide = _near(_near(wide, activities, ["order_detail_id"], "left"), coupons, ["order_detail_id"], "left")
    return _detail_columns(ch.enrich(wide, dictionary, "source_type", "dic_code", "inner", small=True, dic_name="dic_name"))


def _detail_columns(wide: DataFrame, *more: str) -> DataFrame:
    """All columns of the order-detail fact, in its order, event_time, and further ones. ``ts``: when the last of its records came in."""
    times = [c for c in ("pt", "order_pt", "activity_pt", "coupon_pt") if c in wide.columns]
    rows = wide.withColumn("ts", F.greatest(*times) if len(times) > 1 else F.col("pt"))
    return rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in sources.ORDER_DETAIL_COLUMNS], "event_time", *more)


def detail_join(root: str, parts: int = sinks.keyed.PARTS) -> UpdatingJoin:
    """The order-detail fact as an updating join of keyed tables under ``root``."""
    return UpdatingJoin(root, ["order_detail_id"], ["event_time"], {
        "orders": Side(["order_id"], ["order_time"], "inner"), "activities": Side(["order_detail_id"], ["activity_time"]), "coupons": Side(["order_detail_id"], ["coupon_time"]),
    }, parts)


def order_details_updating(root: str, dictionary: Callable[[], DataFrame], parts: int = sinks.keyed.PARTS):
    """What a micro-batch of change records does to the order-detail fact: a detail goes out as soon as its order is known, and again
    when its activity, its coupon or a newer version of its order comes. ``detail_join(root)`` has the fact and its changelog.

    The latest order version, activity and coupon of each key count. The dictionary is read anew in each batch.
    """
    join = detail_join(root, parts)

    def each(batch: DataFrame, batch_id: int) -> None:
        details = _fields(ch.of_table(batch, "order_detail"), DETAIL_FIELDS, "pt", order_detail_id="id", order_create_time="create_time").withColumn("split_original_amount", _original())
        orders = _fields(ch.of_table(batch, "order_info", ("insert", "update")), ORDER_FIELDS, "type", "old", F.col("pt").alias("order_pt"), order_id="id").withColumnRenamed("event_time", "order_time")
        activities = _fields(ch.of_table(batch, "order_detail_activity"), "order_detail_id activity_id activity_rule_id", F.col("pt").alias("activity_pt"), activity_create_time="create_time").withColumnRenamed("event_time", "activity_time")
        coupons = _fields(ch.of_table(batch, "order_detail_coupon"), "order_detail_id coupon_id coupon_use_id", F.col("pt").alias("coupon_pt"), coupon_create_time="create_time").withColumnRenamed("event_time", "coupon_time")
        named = ch.enrich(details, dictionary(), "source_type", "dic_code", "inner", small=True, dic_name="dic_name")
        join.apply(named, batch_id, orders=orders, activities=activities, coupons=coupons)

    return each


def updated_details(spark: SparkSession, root: str, after: int = -1) -> DataFrame | None:
    """Changes of the order-detail fact since list ``after``, with all its columns, row_kind and commit; None where there was no batch."""
    found = detail_join(root).changes(spark, after)
    return None if found is None else _detail_columns(found, "row_kind", "commit")


def placed_orders(details: DataFrame) -> DataFrame:
    return details.filter("type = 'insert'")


def cancelled_orders(details: DataFrame) -> DataFrame:
    """Details whose order became cancelled (status 1003)."""
    return details.filter((F.col("type") == "update") & (F.col("order_status") == "1003") & pick(F.col("old"), "order_status").isNotNull())


def successful_payments(changes: DataFrame, details: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Payments that became done (status 1602) with the details of their orders. ``details`` has event_time."""
    paid = _fields(ch.of_table(changes, "payment_info", ("update",)).filter(ch.became("payment_status", "1602")), "user_id order_id callback_time", payment_type_code="payment_type")
    joined = _near(paid, details.drop("user_id"), ["order_id"])
    return ch.enrich(joined, dictionary, "payment_type_code", "dic_code", "inner", small=True, payment_type_name="dic_name")


def refund_requests(changes: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Refund requests with the province of their order where that became refunded (status 1005), and the names of type and reason."""
    asked = _fields(ch.of_table(changes, "order_refund_info"), "id user_id order_id sku_id refund_num refund_amount refund_reason_txt create_time", _day("create_time"), refund_type_code="refund_type", refund_reason_type_code="refund_reason_type")
    orders = ch.of_table(changes, "order_info", ("update",)).filter((pick(F.col("data"), "order_status") == "1005") & ch.changed("order_status", False))
    joined = _near(asked, _fields(orders, "province_id", order_id="id"), ["order_id"], "left")
    named = ch.enrich(joined, dictionary, "refund_type_code", "dic_code", small=True, refund_type_name="dic_name")
    return ch.enrich(named, dictionary, "refund_reason_type_code", "dic_code", small=True, refund_reason_type_name="dic_name")


def refund_payments(changes: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Refunds paid (status 0702) with their order and request, and the payment type's name."""
    paid = ch.of_table(changes, "refund_payment", ("insert", "update")).filter(pick(F.col("data"), "refund_status") == "0702")
    paid = _fields(paid, "id order_id sku_id callback_time total_amount", _day("callback_time"), payment_type_code="payment_type")
    orders = ch.of_table(changes, "order_info", ("update",)).filter((pick(F.col("data"), "order_status") == "1006") & ch.changed("order_status", False))
    requests = _fields(ch.of_table(changes, "order_refund_info", ("insert",)), "order_id sku_id refund_num")
    joined = _near(_near(paid, _fields(orders, "user_id province_id", order_id="id"), ["order_id"], "left"), requests, ["order_id", "sku_id"], "left")
    return ch.enrich(joined, dictionary, "payment_type_code", "dic_code", small=True, payment_type_name="dic_name")


def coupons_received(changes: DataFrame) -> DataFrame:
    return _fields(ch.of_table(changes, "coupon_use"), "id coupon_id user_id get_time", _day("get_time"), "ts")


def coupons_ordered(changes: DataFrame) -> DataFrame:
    """Coupons that an order used: updates that set using_time; a null ``old`` is kept."""
    rows = ch.of_table(changes, "coupon_use", ("update",)).filter(ch.changed("using_time", True))
    return _fields(rows, "id coupon_id user_id order_id", _day("using_time"), "ts", order_time="using_time")


def coupons_paid(changes: DataFrame) -> DataFrame:
    rows = ch.of_table(changes, "coupon_use", ("insert", "update")).filter(pick(F.col("data"), "used_time").isNotNull())
    return _fields(rows, "id coupon_id user_id order_id", _day("used_time"), "ts", payment_time="used_time")


def favours(changes: DataFrame) -> DataFrame:
    rows = ch.of_table(changes, "favor_info", ("insert", "update")).filter(ch.favoured())
    return _fields(rows, "id user_id sku_id create_time", _day("create_time"), "ts")


def comments(changes: DataFrame, dictionary: DataFrame) -> DataFrame:
    rows = _fields(ch.of_table(changes, "comment_info"), "id user_id sku_id order_id create_time", _day("create_time"), "ts", appraise_code="appraise")
    return ch.enrich(rows, dictionary, "appraise_code", "dic_code", small=True, appraise_name="dic_name")


def registered_users(changes: DataFrame) -> DataFrame:
    return _fields(ch.of_table(changes, "user_info"), "create_time", _day("create_time"), "ts", user_id="id")


# Dimensions and summaries of the latest details.


def load_dimensions(config: DataFrame | None, root: str, config_table: str = "table_process", parts: int = sinks.keyed.PARTS):
    """What a micro-batch of change records does: take over changes of the routing configuration, then route the other rows by it and upsert each dimension table under ``root``.

    The configuration is a keyed table itself (``root/_config``): it begins with the rows of ``config``, and records of
    ``config_table`` change it, so a row that comes between two batches reroutes the second. A dimension table is created
    when its row comes, with the configured columns as text and ``sink_extend`` as its properties. A configuration has a
    row for each table of the source; these are collected.
    """
    known = f"{root}/_config"

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if config is not None and not sinks.lists(spark, known):
            sinks.upsert(config.withColumn("gone", F.col("type") == "delete"), known, ["source_table"], ["ts", "type", "sink_table", "sink_columns", "sink_pk", "sink_extend"], "gone", parts=1)
        news = batch.filter(F.col("table") == config_table)
        news = news.select(*[pick(F.col("data"), c).alias(c) for c in ("source_table", "sink_table", "sink_columns", "sink_pk", "sink_extend")], "ts", "type", (F.col("type") == "delete").alias("gone"))
        sinks.upsert(news.filter("source_table is not null"), known, ["source_table"], ["ts"], "gone", batch_id, parts=1)
        now = sinks.read_keyed(spark, known)
        if now is None:
            return
        live = sources.routing_config(now)
        found = live.collect()  # a row for each configured table
        columns = {r.sink_table: list(dict.fromkeys([r.sink_pk, *(c.strip() for c in r.sink_columns.split(","))])) for r in found}
        for r in found:
            sinks.create_table(spark, f"{root}/{r.sink_table}", ", ".join([*(f"`{c}` string" for c in columns[r.sink_table]), "ts bigint"]), parts, r.sink_extend)
        routed = ch.route(batch.filter(F.col("type").isin(*ch.WRITES) & (F.col("table") != config_table)), live).persist()
        filled = {x[0] for x in routed.select("sink_table").distinct().collect()}  # of the configured tables
        for r in found:
            if r.sink_table in filled:
                rows = routed.filter(F.col("sink_table") == r.sink_table)
                sinks.upsert(sinks.dimension_rows(rows, columns[r.sink_table], r.sink_pk), f"{root}/{r.sink_table}", [r.sink_pk], ["ts"], None, batch_id, parts=parts)
        routed.unpersist()

    return each


def with_fresh_lookups(build: Callable[..., DataFrame], out: str, **lookups: Callable[[], DataFrame]):
    """What a micro-batch of change records does: ``build`` over its rows and the lookups as they are at that moment, into JSON files of the batch's own folder under ``out``.

    A lookup is a function that reads its table (see :func:`tidewater.sources.fresh`). A batch run again replaces its folder.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        build(batch, **{name: read() for name, read in lookups.items()}).write.mode("overwrite").json(f"{out}/batch={batch_id}")

    return each


def latest_details(values: DataFrame, wait_ms: int = 2000, ttl_ms: int | None = None) -> DataFrame:
    """Inserted order details, one version of each: of those that come within ``wait_ms`` of the first, the latest by ``ts``. A stream on a clock, or a table."""
    rows = ch.inserted_details(values)
    if rows.isStreaming:
        return streaming.latest_after(rows, "order_detail_id", "ts", wait_ms, ttl_ms)
    return sinks.latest(rows.filter("order_detail_id is not null"), ["order_detail_id"], ["ts"])


def order_summary(details: DataFrame, width: str = WIDTH, split: bool = False) -> DataFrame:
    """Ordering users, new users and amounts by window, of the latest version of each order detail (as keep_latest or latest_details give it).

    Order-level amounts are summed once for each detail, as in the facts; with ``split`` the detail's own shares are.
    """
    rows = details.select("user_id", "order_detail_id", F.to_timestamp("order_create_time").alias("at"), *[F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)).alias(c) for c in _amounts(split)])
    names = ("order_activity_reduce_amount", "order_coupon_reduce_amount", "order_origin_total_amount")
    sums = {n: F.sum(c) for n, c in zip(names, _amounts(split), strict=True)}
    counts = {"order_unique_user_count": F.sum("uu"), "order_new_user_count": F.sum("first_ever")}
    if rows.isStreaming:
        marked = streaming.order_users(rows, "at", key="user_id", delay="2 seconds", every=True)
        return windows.tumble(marked, "at", width, [], **sums, **counts)
    rows = rows.withColumn("day", F.to_date("at"))
    first = windows.order_users(rows.select("user_id", "day", "at", "order_detail_id"), "user_id", "day", ["at", "order_detail_id"])
    users = windows.tumble(first.withColumn("uu", F.lit(1)), "at", width, [], **counts)
    amounts = windows.tumble(rows, "at", width, [], **sums)
    return amounts.join(users, ["stt", "edt"], "left").fillna(0, ["order_unique_user_count", "order_new_user_count"])


def _amounts(split: bool) -> tuple[str, str, str]:
    return ("split_activity_amount", "split_coupon_amount", "split_original_amount") if split else ("activity_reduce_amount", "coupon_reduce_amount", "original_total_amount")


def product_orders(details: DataFrame, skus: DataFrame, spus: DataFrame, trademarks: DataFrame, c3: DataFrame, c2: DataFrame, c1: DataFrame, width: str = WIDTH) -> DataFrame:
    """Orders and amounts by brand, three categories, user and product: six lookups, a missing key gives nulls."""
    rows = details.select("user_id", "sku_id", F.to_timestamp("order_create_time").alias("at"), F.col("split_total_amount").try_cast("double").alias("amount"))
    if rows.isStreaming:
        rows = streaming.in_order(rows, "at")
    rows = ch.enrich(rows, skus, "sku_id", "id", spu_id="spu_id", trademark_id="tm_id", category3_id="category3_id").drop("sku_id")
    rows = ch.enrich(ch.enrich(rows, spus, "spu_id", "id", spu_name="spu_name"), trademarks, "trademark_id", "id", trademark_name="tm_name")
    rows = ch.enrich(rows, c3, "category3_id", "id", category3_name="name", category2_id="category2_id")
    rows = ch.enrich(ch.enrich(rows, c2, "category2_id", "id", category2_name="name", category1_id="category1_id"), c1, "category1_id", "id", category1_name="name")
    keys = ["trademark_id", "trademark_name", "category1_id", "category1_name", "category2_id", "category2_name", "category3_id", "category3_name", "user_id", "spu_id", "spu_name"]
    return windows.tumble(rows, "at", width, keys, order_count=F.count(F.lit(1)), order_amount=F.sum("amount"))


# From source to sink.


def start(spark: SparkSession, source: str, sink: str, checkpoint: str, build, partition_by: tuple[str, ...] = (), **options):
    """Starts ``build`` (from the JSON texts of ``source`` to rows) as a stream into JSON files; by default it reads what is there and ends."""
    values = sources.strings(spark, source, stream=True, **options)
    return sinks.stream_append(build(values), sink, checkpoint, partition_by)


def land(values: DataFrame) -> DataFrame:
    """Raw log rows that are JSON, with the day of their event time (``ts`` in milliseconds, or in seconds as in change records)."""
    ts = F.get_json_object("value", "$.ts").try_cast("long")
    return logs.valid_json(values).withColumn("dt", F.to_date(F.timestamp_seconds(F.when(ts > 100_000_000_000, ts / 1000).otherwise(ts))))
