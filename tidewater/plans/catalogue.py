"""Queries over the driver tables that exercise the operators; each has a SQL twin in :mod:`tidewater.plans.oracles`.

Stand-ins: page log = events (device = user_id, page = event_type, session entry = a view), orders = order_info, lineitem =
order_detail, part = product, customer = user, nation and region = category chain and dictionary. A change record's type is
insert for status O, else update; its old values are those of the customer's order before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.functions import as_amount, as_int, changed_or_created, compare_times, date_part, day_text, days_between, flag, from_millis, is_json, is_json_object, pick, register_table_functions, row_json, split_words, time_text, to_millis, whole_days
from tidewater.operators import changes as ch
from tidewater.operators import logs, windows
from tidewater.operators.order import beside
from tidewater.plans import keyed
from tidewater.sinks import dealt, latest
from tidewater.sources import renamed_camel


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def amount(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(18,2)")


def total(c: Column | str) -> Column:
    return F.sum(amount(c)).cast("double")


def page_log(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return t(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value", k.alias("k"), F.to_date("ts").alias("day"), (F.col("event_type") == "view").alias("entry"))


def order_changes(spark: SparkSession, d: str) -> DataFrame:
    """Orders as change records."""
    values = F.create_map(F.lit("order_status"), F.col("o_orderstatus"), F.lit("priority"), F.col("o_orderpriority"))
    needed = t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority").withColumn("data", values)
    rows = beside(needed, "o_custkey", ["o_orderdate", "o_orderkey"], F.col("data"), F.year("o_orderdate"), "before", after=False).withColumn("before", F.col("before.v"))
    kind = F.when(F.col("o_orderstatus") == "O", "insert").otherwise("update")
    old = F.when(kind == "update", F.map_filter("before", lambda k, v: v != F.col("data")[k]))
    full = F.map_concat("data", F.create_map(F.lit("id"), F.col("o_orderkey").cast("string"), F.lit("user_id"), F.col("o_custkey").cast("string")))
    return rows.select(F.lit("order_info").alias("table"), kind.alias("type"), F.unix_timestamp("o_orderdate").alias("ts"), full.alias("data"), old.alias("old"))


def json_valid_split(spark, d):
    rows = t(spark, d, "events").select(F.lit("events").alias("source"), F.col("props").alias("value")).unionByName(t(spark, d, "documents").select(F.lit("documents").alias("source"), F.col("text").alias("value")))
    return rows.groupBy("source", is_json(F.col("value")).alias("valid")).agg(F.count(F.lit(1)).alias("n"))


def parse_divert(spark, d):
    rows = t(spark, d, "events").select(F.col("props").alias("value")).unionByName(t(spark, d, "benchmark").select(F.col("text").alias("value")))
    good, dirty = logs.parse_or_divert(rows, "k int")
    return good.select(F.lit("good").alias("route"), "k").unionByName(dirty.select(F.lit("dirty").alias("route"), F.lit(None).cast("int").alias("k"))).groupBy("route").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("k_sum"))


def ods_date_partition(spark, d):
    return t(spark, d, "events").groupBy(day_text(F.col("ts")).alias("dt")).agg(F.count(F.lit(1)).alias("n"))


def cdc_map_projection(spark, d):
    return ch.project(ch.of_table(order_changes(spark, d), "order_info"), ["id", "order_status"], ("ts",), customer="user_id")


def cdc_write_ops(spark, d):
    both = ch.of_table(order_changes(spark, d), "order_info", ("insert", "update"))
    return both.groupBy("type", pick(F.col("data"), "order_status").alias("order_status")).agg(F.count(F.lit(1)).alias("n"))


def cart_changes(spark, d):
    rows = page_log(spark, d).withColumn("before", F.lag("k").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return rows.select("event_id", "user_id", "k", F.lit("cart_info").alias("table"), F.when(F.col("before").isNull(), "insert").otherwise("update").alias("type"), F.create_map(F.lit("sku_num"), F.col("k").cast("string")).alias("data"), F.when(F.col("before").isNotNull(), F.create_map(F.lit("sku_num"), F.col("before").cast("string"))).alias("old"))


def cart_add_delta(spark, d):
    rows = cart_changes(spark, d).filter(ch.increased("sku_num")).select("event_id", "user_id", ch.increase("sku_num").alias("sku_num"), (F.col("k") % 25).alias("code"))
    return ch.enrich(rows, t(spark, d, "nation"), "code", "n_nationkey", "inner", small=True, dic_name="n_name").drop("code")


def order_added(spark, d):
    return order_changes(spark, d).filter("type = 'insert'").select(pick(F.col("data"), "id").alias("order_id"), "ts")


def status_transition(spark, d):
    return order_changes(spark, d).filter(ch.became("order_status", "F")).select(pick(F.col("data"), "id").cast("long").alias("order_id"), pick(F.col("old"), "order_status").alias("old_status"))


def status_value(spark, d):
    return order_changes(spark, d).filter(pick(F.col("data"), "order_status") == "P").select(pick(F.col("data"), "id").cast("long").alias("order_id"))


def changed_key(keep: bool):
    return lambda spark, d: order_changes(spark, d).filter(ch.changed("priority", keep)).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def coupon_pay_not_null(spark, d):
    used = F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate"))
    return t(spark, d, "orders").withColumn("used_time", used).filter("used_time is not null").select("o_orderkey", time_text(F.col("used_time")).alias("payment_time"), date_part(time_text(F.col("used_time"))).alias("date_id"))


def coupon_get(spark, d):
    return ch.of_table(order_changes(spark, d), "order_info").select(pick(F.col("data"), "id").cast("long").alias("id"), day_text(F.timestamp_seconds("ts")).alias("date_id"), (F.col("ts") * 1000).alias("ts_ms"))


def favor_toggle(spark, d):
    now = (F.col("k") % 2).cast("string")
    before = F.lag(now).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = page_log(spark, d).select("event_id", "user_id", now.alias("now"), before.alias("before"))
    rows = rows.select("event_id", "user_id", F.when(F.col("before").isNull(), "insert").otherwise("update").alias("type"), F.create_map(F.lit("is_cancel"), F.col("now")).alias("data"), F.when(F.col("before").isNotNull(), F.create_map(F.lit("is_cancel"), F.col("before"))).alias("old"))
    return rows.filter(ch.favoured()).select("event_id", "user_id", "type")


def dim_route_prune(spark, d):
    def tagged(name: str, key: str, columns: dict[str, str]) -> DataFrame:
        pairs = [x for k, c in columns.items() for x in (F.lit(k), F.col(c).cast("string"))]
        return t(spark, d, name).select(F.lit(name).alias("table"), F.when(F.col(key) % 7 == 0, "delete").otherwise("insert").alias("type"), F.lit(0).cast("long").alias("ts"), F.create_map(*pairs).alias("data"))

    rows = tagged("customer", "c_custkey", {"id": "c_custkey", "name": "c_name", "seg": "c_mktsegment"}).unionByName(tagged("supplier", "s_suppkey", {"id": "s_suppkey", "name": "s_name", "nation": "s_nationkey"})).unionByName(tagged("part", "p_partkey", {"id": "p_partkey", "brand": "p_brand"}))
    config = spark.createDataFrame([("customer", "dim_user", "id,seg", "id", None), ("supplier", "dim_seller", "id,name,missing", "id", None)], "source_table string, sink_table string, sink_columns string, sink_pk string, sink_extend string")
    routed = ch.route(rows, config)
    return routed.select("sink_table", F.col("data")["id"].alias("pk"), F.explode("data").alias("col", "value"))


def dim_upsert_latest(spark, d):
    return latest(t(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderstatus")


def lookup_query(how: str):
    def run(spark, d):
        some = t(spark, d, "nation").filter("n_nationkey % 3 <> 0")
        return ch.enrich(t(spark, d, "customer").select("c_custkey", "c_nationkey"), some, "c_nationkey", "n_nationkey", how, small=True, dic_name="n_name")

    return run


def lookup_two_roles(spark, d):
    n = t(spark, d, "nation")
    rows = t(spark, d, "lineitem").select("l_orderkey", "l_suppkey").join(t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    rows = ch.enrich(ch.enrich(rows, t(spark, d, "customer"), "o_custkey", "c_custkey", c_nation="c_nationkey"), t(spark, d, "supplier"), "l_suppkey", "s_suppkey", s_nation="s_nationkey")
    rows = ch.enrich(ch.enrich(rows, n, "c_nation", "n_nationkey", small=True, customer_nation="n_name"), n, "s_nation", "n_nationkey", small=True, supplier_nation="n_name")
    return rows.groupBy("customer_nation", "supplier_nation").agg(F.count(F.lit(1)).alias("n"))


def lookup_user_function(spark, d):
    """A lookup by computed keys whose join function makes columns of both rows."""
    joined = lambda n: {"place": F.concat_ws("/", n["n_regionkey"], F.lower(n["n_name"])), "own_segment": F.when(n["n_name"].isNull(), "unknown").otherwise(F.col("c_mktsegment"))}
    some = t(spark, d, "nation").filter("n_nationkey % 4 <> 1")
    rows = ch.enrich_by(t(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey"), some, F.concat(F.lit("n"), F.col("c_nationkey")), F.concat(F.lit("n"), F.col("n_nationkey")), joined)
    return rows.select("c_custkey", F.nullif("place", F.lit("")).alias("place"), "own_segment")


def wide_details(spark, d):
    details = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("order_detail_id"), "l_partkey", F.col("l_extendedprice").alias("order_price"), F.col("l_quantity").alias("sku_num"), F.concat(F.lit("c"), F.col("l_suppkey") % 25).alias("source_type"))
    orders = t(spark, d, "orders").select(F.col("o_orderkey").alias("order_id"), "o_custkey", "o_orderstatus")
    activities = details.filter("l_partkey % 3 = 0").select("order_detail_id", F.col("l_partkey").alias("activity_id")).distinct()
    coupons = details.filter("l_partkey % 5 = 0").select("order_detail_id", F.col("l_partkey").alias("coupon_id")).distinct()
    dictionary = t(spark, d, "nation").select(F.concat(F.lit("c"), F.col("n_nationkey")).alias("dic_code"), F.col("n_name").alias("dic_name"))
    return ch.order_detail_wide(details, orders, activities, coupons, dictionary)


def order_detail_fact(spark, d):
    return wide_details(spark, d).select("order_detail_id", "order_id", "o_custkey", "o_orderstatus", "activity_id", "coupon_id", "dic_name", F.col("split_original_amount").cast("decimal(18,2)").cast("double").alias("split_original_amount"))


def order_detail_wide(spark, d):
    return wide_details(spark, d).groupBy("dic_name", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.count("activity_id").alias("activities"), F.count("coupon_id").alias("coupons"), F.sum(F.col("split_original_amount").cast("decimal(18,2)")).cast("double").alias("original"))


def paid(spark, d):
    payments = t(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("user_id"), F.concat(F.lit("c"), F.col("o_custkey") % 25).alias("payment_type_code"))
    details = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_suppkey").alias("user_id"), "l_linenumber", "l_extendedprice")
    dictionary = t(spark, d, "nation").select(F.concat(F.lit("c"), F.col("n_nationkey")).alias("dic_code"), F.col("n_name").alias("dic_name"))
    return ch.paid_details(payments, details, dictionary)


def payment_fact(spark, d):
    return paid(spark, d).select("order_id", "user_id", "l_linenumber", "l_extendedprice", "payment_type_code", "payment_type_name")


def payment_success(spark, d):
    return paid(spark, d).groupBy("payment_type_name").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"), total("l_extendedprice").alias("paid"))


def _refund_parts(spark, d):
    returned = t(spark, d, "lineitem").filter("l_returnflag = 'R'")
    orders = t(spark, d, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), (F.col("o_custkey") % 34).alias("province_id"), F.col("o_orderdate").alias("ts"))
    dictionary = t(spark, d, "nation").filter("n_nationkey < 20").select(F.col("n_nationkey").alias("dic_code"), F.col("n_name").alias("dic_name"))
    return returned, orders, dictionary


def refunds_asked(spark, d):
    returned, orders, dictionary = _refund_parts(spark, d)
    refunds = returned.select(F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("sku_id"), "l_quantity", (F.col("l_partkey") % 25).alias("refund_type_code"), (F.col("l_suppkey") % 25).alias("refund_reason_type_code"))
    return ch.refund_requests(refunds, orders, dictionary)


def refund_request_fact(spark, d):
    return refunds_asked(spark, d).select("order_id", "sku_id", "l_quantity", "province_id", "refund_type_name", "refund_reason_type_name")


def refund_request(spark, d):
    return refunds_asked(spark, d).groupBy("province_id", "refund_type_name").agg(F.count(F.lit(1)).alias("n"), F.count("refund_reason_type_name").alias("reasons"), total("l_quantity").alias("quantity"))


def refunds_paid(spark, d):
    returned, orders, dictionary = _refund_parts(spark, d)
    paid = returned.filter("l_linestatus = 'F'").select(F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("sku_id"), "l_extendedprice", (F.col("l_partkey") % 25).alias("payment_type_code"))
    requests = returned.filter("l_quantity > 10").select(F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("sku_id"), F.col("l_quantity").alias("refund_num"), F.struct("l_shipdate", "l_linenumber", "l_quantity", "l_extendedprice").alias("ts"))
    return ch.refund_payments(paid, orders, requests, dictionary)


def refund_payment_fact(spark, d):
    return refunds_paid(spark, d).select("order_id", "sku_id", "l_extendedprice", "user_id", "province_id", "refund_num", "payment_type_name")


def refund_payment(spark, d):
    return refunds_paid(spark, d).groupBy("payment_type_name").agg(F.count(F.lit(1)).alias("n"), F.count("province_id").alias("with_order"), F.count("refund_num").alias("with_request"), total("refund_num").alias("refund_num"), total("l_extendedprice").alias("amount"))


def comment_grade(spark, d):
    rows = t(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 30).alias("appraise_code"))
    return ch.enrich(rows, t(spark, d, "nation"), "appraise_code", "n_nationkey", small=True, appraise_name="n_name")


def event_logs(spark, d):
    """Events as raw log texts, with fields that no schema names."""
    kind, k = F.col("event_type"), F.col("k")
    common = F.struct((k % 2).cast("string").alias("is_new"), F.col("user_id").cast("string").alias("mid"), F.concat(F.lit("s"), F.col("user_id") % 10).alias("sid"))
    page = F.struct(F.when(kind != "view", "home").alias("last_page_id"), kind.alias("page_id"))
    err = F.when(k % 10 == 0, F.struct(F.lit(1).alias("error_code")))
    shown = F.when(k % 3 == 0, F.array(*[F.struct(F.lit(str(i)).alias("item"), F.lit(i).alias("order")) for i in (1, 2)]))
    done = F.when(k % 7 == 0, F.array(F.create_map(F.lit("action_id"), F.lit("cart_add"))))
    start = F.when(kind == "signup", F.struct(F.lit("icon").alias("entry")))
    log = F.struct(common.alias("common"), F.when(kind != "signup", page).alias("page"), start.alias("start"), err.alias("err"), shown.alias("displays"), done.alias("actions"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), F.struct(k.alias("k")).alias("extra"))
    rows = t(spark, d, "events").select("ts", "user_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))
    return rows.select(F.to_json(log).alias("value"))


def log_fan_out(spark, d):
    routes = logs.routed(logs.log_objects(event_logs(spark, d))[0])
    return routes.filter(F.col("route").isin("error", "start", "page")).groupBy("route").agg(F.count(F.lit(1)).alias("n"), F.max(F.floor(F.col("ts") / 1000)).alias("last_second"))


def log_five_routes(spark, d):
    """Every output row of every log, new-visitor flags repaired, bodies whole."""
    objects, _ = logs.log_objects(event_logs(spark, d))
    return logs.routed(logs.repaired_log(objects)).select("route", "page_id", F.floor(F.col("ts") / 1000).alias("second"), F.md5("body").alias("body_md5"))


def event_pages(spark, d):
    """The page log as rows with page and common."""
    page = F.struct(F.when(F.col("k") % 3 == 0, "search").when(~F.col("entry"), "home").alias("last_page_id"), F.when(F.col("k") % 2 == 0, "keyword").alias("item_type"), F.concat_ws(" ", "event_type", "k").alias("item"))
    return page_log(spark, d).select("event_id", "ts", "day", "user_id", page.alias("page"), F.struct(F.when(F.col("k") % 10 != 0, F.col("user_id")).alias("uid")).alias("common"))


def search_keyword_window(spark, d):
    words = logs.explode_words(logs.searches(event_pages(spark, d)), "keyword").select("ts", F.lit("search").alias("source"), F.col("word").alias("keyword"))
    return windows.tumble(words, "ts", "1 hour", ["source", "keyword"], keyword_count=F.count(F.lit(1)))


def search_keyword_lateral(spark, d):
    """The same in SQL, with the table function."""
    register_table_functions(spark)
    searched = logs.searches(event_pages(spark, d)).select("ts", "keyword")
    words = spark.sql("SELECT s.ts, 'search' AS source, w.word AS keyword FROM {searched} s, LATERAL split_words(s.keyword) w", searched=searched)
    return windows.tumble(words, "ts", "1 hour", ["source", "keyword"], keyword_count=F.count(F.lit(1)))


def logged_in_entries(spark, d):
    return logs.logged_in_entries(event_pages(spark, d)).select("event_id", "user_id")


def login_window(spark, d):
    found = windows.returning_users(logs.logged_in_entries(event_pages(spark, d)).select("user_id", "day").distinct(), "user_id", "day")
    return found.groupBy(day_text(F.col("day")).alias("dt")).agg(F.sum("uu").alias("uu_ct"), F.sum("back").alias("back_ct"))


def cart_uu_fallback(spark, d):
    """Cart users by the time of change, else of creation."""
    at = lambda ts: time_text(ts)
    data = F.map_filter(F.create_map(F.lit("operate_time"), F.when(F.col("k") % 4 != 0, at(F.col("ts"))), F.lit("create_time"), at(F.col("ts") - F.expr("interval 1 day"))), lambda _, v: v.isNotNull())
    rows = page_log(spark, d).filter("event_type = 'purchase'").select("event_id", "user_id", F.to_timestamp(changed_or_created(data)).alias("at"))
    first = logs.first_of_day(rows.withColumn("day", F.to_date("at")), ["user_id"], "day", ["at", "event_id"])
    return windows.tumble(first, "at", "1 day", [], cart_add_uu_ct=F.count(F.lit(1)))


def inserted_details(spark, d):
    """Order details read back from an upsert stream: empty texts and updates are left out."""
    row = F.to_json(F.struct(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("order_detail_id"), F.col("l_orderkey").cast("string").alias("order_id"), F.when(F.col("l_returnflag") == "R", "update").otherwise("insert").alias("type")))
    values = t(spark, d, "lineitem").select(F.when(F.col("l_linenumber") == 7, "").otherwise(row).alias("value"))
    return ch.inserted_details(values, "order_detail_id", "order_id").select("order_detail_id", "order_id")


def coupon_order_fact(spark, d):
    rows = order_changes(spark, d).filter((F.col("type") == "update") & ch.changed("priority", True))
    return rows.select(pick(F.col("data"), "id").cast("long").alias("id"), pick(F.col("old"), "priority").alias("old_priority"), time_text(F.timestamp_seconds("ts")).alias("order_time"))


def explode_with_parent(spark, d):
    rows = t(spark, d, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("pos", "x"))
    return rows.groupBy("label", "pos").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("x").cast("double") * 1e6).cast("long")).alias("micro"))


def is_new_repair(spark, d):
    rows = page_log(spark, d).select("event_id", "user_id", "ts", "day", (F.col("k") % 2).alias("is_new"))
    return logs.repair_is_new(rows, "user_id", "day", "is_new", ["ts", "event_id"]).select("event_id", "user_id", "is_new")


def visitors(spark, d):
    return logs.first_of_day(page_log(spark, d).filter("entry"), ["user_id"], "day", ["ts", "event_id"])


def unique_visitor(spark, d):
    return visitors(spark, d).select("event_id", "user_id", day_text(F.col("day")).alias("dt"))


def jumps(spark, d):
    return logs.bounces(page_log(spark, d), "user_id", "ts", "event_id", "entry", "1 hour")


def user_jump(spark, d):
    return jumps(spark, d).select("event_id", "user_id")


def keyword_count(spark, d):
    return logs.keyword_counts(t(spark, d, "documents"), "text", ["lang"])


def keyword_window(spark, d):
    rows = t(spark, d, "events").select("ts", F.explode(split_words(F.concat_ws(" ", "event_type", F.lit("search")))).alias("keyword"))
    return windows.tumble(rows, "ts", "1 hour", ["keyword"], keyword_count=F.count(F.lit(1)))


def page_view_by_dims(spark, d):
    dims = {"vc": F.concat(F.lit("v"), F.col("k") % 3), "ch": F.concat(F.lit("c"), F.col("user_id") % 4), "ar": F.concat(F.lit("a"), F.col("user_id") % 5), "is_new": (F.col("k") % 2).cast("string")}
    shaped = [x.withColumns(dims) for x in (page_log(spark, d), visitors(spark, d), jumps(spark, d))]
    rows = windows.page_view_rows(*shaped, dims=list(dims), ts="ts", during="value", entry="entry")
    return windows.tumble(rows, "ts", "1 day", list(dims), uv_ct=F.sum("uv_ct"), sv_ct=F.sum("sv_ct"), pv_ct=F.sum("pv_ct"), dur_sum=total("dur_sum"), uj_ct=F.sum("uj_ct"))


def home_detail_uv(spark, d):
    first = logs.first_of_day(page_log(spark, d).filter(F.col("event_type").isin("view", "click")), ["user_id", "event_type"], "day", ["ts", "event_id"])
    return windows.tumble(first, "ts", "1 day", [], home_uv_ct=F.sum(flag(F.col("event_type") == "view")).cast("long"), good_detail_uv_ct=F.sum(flag(F.col("event_type") == "click")).cast("long"))


def login_back(spark, d):
    days = t(spark, d, "orders").select("o_custkey", F.to_date("o_orderdate").alias("day")).distinct()
    found = windows.returning_users(days, "o_custkey", "day")
    return found.groupBy(day_text(F.col("day")).alias("dt")).agg(F.sum("uu").alias("uu_ct"), F.sum("back").alias("back_ct"))


def register_window(spark, d):
    return windows.tumble(t(spark, d, "events").filter("event_type = 'signup'"), "ts", "1 hour", [], register_ct=F.count(F.lit(1)))


def user_register(spark, d):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return t(spark, d, "events").filter("event_type = 'signup'").select("user_id", day_text(F.col("ts")).alias("date_id"), from_millis(ms).alias("create_time"))


def cart_uu(spark, d):
    first = logs.first_of_day(page_log(spark, d).filter("event_type = 'purchase'"), ["user_id"], "day", ["ts", "event_id"])
    return windows.tumble(first, "ts", "1 hour", [], cart_add_uu_ct=F.count(F.lit(1)))


def details(spark, d, *columns: str):
    """The latest version of each order detail, with further columns; no other is read."""
    keys, order = ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    return latest(t(spark, d, "lineitem").select(*keys, *order, *columns), keys, order, by=("l_orderkey",))


def order_detail_latest(spark, d):
    return details(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


def order_window(spark, d):
    orders = t(spark, d, "orders")
    users = windows.order_users(orders.select("o_custkey", F.to_date("o_orderdate").alias("day"), "o_orderkey"), "o_custkey", "day", ["o_orderkey"])
    uv = users.groupBy("day").agg(F.count(F.lit(1)).alias("order_unique_user_count"), F.sum("first_ever").cast("long").alias("order_new_user_count"))
    price, rate = amount("l_extendedprice"), amount("l_discount")
    lines = details(spark, d, "l_discount", "l_tax").join(orders.select(F.col("o_orderkey").alias("l_orderkey"), F.to_date("o_orderdate").alias("day")), "l_orderkey")
    sums = lines.groupBy("day").agg(F.sum(F.coalesce(price * rate, F.lit(0))).cast("double").alias("order_activity_reduce_amount"), F.sum(F.coalesce(price * amount("l_tax"), F.lit(0))).cast("double").alias("order_coupon_reduce_amount"), total("l_extendedprice").alias("order_origin_total_amount"))
    return uv.join(sums, "day", "left").withColumn("day", day_text(F.col("day")))


def brand_category_user_order(spark, d):
    orders = t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate")
    orders = ch.enrich(orders, t(spark, d, "customer"), "o_custkey", "c_custkey", large=True, nation="c_nationkey")
    rows = details(spark, d).select("l_orderkey", "l_partkey", "l_extendedprice").join(orders, "l_orderkey")
    rows = ch.enrich(rows, t(spark, d, "part"), "l_partkey", "p_partkey", large=True, trademark_name="p_brand", category3_name="p_type", spu_name="p_name")
    rows = ch.enrich(rows, t(spark, d, "nation"), "nation", "n_nationkey", small=True, category2_name="n_name", region="n_regionkey")
    rows = ch.enrich(rows, t(spark, d, "region"), "region", "r_regionkey", small=True, category1_name="r_name")
    keys = ["trademark_name", "category1_name", "category2_name", "category3_name", "o_custkey", "spu_name"]
    # Nearly each line is a group of its own, so sums before the shuffle would not make it smaller.
    rows = dealt(rows, t(spark, d, "lineitem").count(), "o_custkey", "spu_name")
    return windows.tumble(rows, "o_orderdate", "1 day", keys, order_count=F.count(F.lit(1)), order_amount=total("l_extendedprice"))


def camel_rename(spark, d):
    return renamed_camel(t(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey"))


def time_functions(spark, d):
    text = time_text(F.col("ts"))
    noon = F.concat(day_text(F.col("ts")), F.lit(" 12:00:00"))
    return t(spark, d, "events").select(
        "event_id", text.alias("time_text"), to_millis(text).alias("ms"), to_millis(day_text(F.col("ts"))).alias("day_ms"), compare_times(text, noon).alias("after_noon"),
        whole_days(to_millis(text), F.lit(0)).alias("epoch_day"), day_text(F.date_sub("ts", 1)).alias("day_before"), days_between(F.to_date("ts"), F.lit("2020-01-01").cast("date")).alias("days_since"),
    )


def scalar_functions(spark, d):
    return t(spark, d, "orders").select(
        "o_orderkey", as_int(F.col("o_orderpriority")).alias("bad_int"), as_amount(F.col("o_totalprice").cast("string")).cast("double").alias("amount"), flag(F.col("o_orderstatus") == "O").alias("is_open"),
        F.size(F.split("o_orderpriority", "-")).alias("parts"), is_json_object(row_json("o_orderkey")).alias("row_is_json"), F.get_json_object(row_json("o_orderkey", "o_orderstatus"), "$.o_orderstatus").alias("status_back"), F.lit("search").alias("source"),
    )


def table_count(spark, d):
    return t(spark, d, "lineitem").agg(F.count(F.lit(1)).alias("ct"))


QUERIES = {
    "json_valid_split": json_valid_split,
    "parse_or_divert": parse_divert,
    "ods_date_partition": ods_date_partition,
    "cdc_map_projection": cdc_map_projection,
    "cdc_write_ops": cdc_write_ops,
    "cart_add_delta": cart_add_delta,
    "order_added": order_added,
    "status_transition": status_transition,
    "status_value": status_value,
    "changed_key_keep_null": changed_key(True),
    "changed_key_drop_null": changed_key(False),
    "coupon_pay_not_null": coupon_pay_not_null,
    "coupon_get": coupon_get,
    "favor_toggle": favor_toggle,
    "dim_route_prune": dim_route_prune,
    "dim_upsert_latest": dim_upsert_latest,
    "lookup_inner": lookup_query("inner"),
    "lookup_left": lookup_query("left"),
    "lookup_two_roles": lookup_two_roles,
    "lookup_user_function": lookup_user_function,
    "order_detail_wide": order_detail_wide,
    "payment_success": payment_success,
    "refund_request": refund_request,
    "refund_payment": refund_payment,
    "comment_grade": comment_grade,
    "log_fan_out": log_fan_out,
    "explode_with_parent": explode_with_parent,
    "is_new_repair": is_new_repair,
    "unique_visitor": unique_visitor,
    "user_jump": user_jump,
    "keyword_count": keyword_count,
    "keyword_window": keyword_window,
    "page_view_by_dims": page_view_by_dims,
    "home_detail_uv": home_detail_uv,
    "login_back": login_back,
    "register_window": register_window,
    "user_register": user_register,
    "cart_uu": cart_uu,
    "order_detail_latest": order_detail_latest,
    "order_window": order_window,
    "brand_category_user_order": brand_category_user_order,
    "order_detail_fact": order_detail_fact,
    "payment_fact": payment_fact,
    "refund_request_fact": refund_request_fact,
    "refund_payment_fact": refund_payment_fact,
    "coupon_order_fact": coupon_order_fact,
    "log_five_routes": log_five_routes,
    "search_keyword_window": search_keyword_window,
    "search_keyword_lateral": search_keyword_lateral,
    "logged_in_entries": logged_in_entries,
    "login_window": login_window,
    "cart_uu_fallback": cart_uu_fallback,
    "inserted_details": inserted_details,
    "camel_rename": camel_rename,
    "time_functions": time_functions,
    "scalar_functions": scalar_functions,
    "table_count": table_count,
    **keyed.QUERIES,
}
