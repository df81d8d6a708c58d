"""Application logs: validation, splitting, new-visitor repair, visitors and bounces (batch forms)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions import is_json, is_json_object, split_words
from tidewater.operators.order import beside
from tidewater.sources import APP_LOG


def valid_json(values: DataFrame) -> DataFrame:
    """Rows whose ``value`` is JSON."""
    return values.filter(is_json(F.col("value")))


def parse_or_divert(values: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """Parsed objects, and the rows that are none (empty text included)."""
    good = is_json_object(F.col("value"))
    return values.filter(good).select(F.from_json("value", schema).alias("r")).select("r.*"), values.filter(~good)


def parse_log(values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Application log rows, and dirty values: no object, or neither start nor page."""
    row = F.from_json("value", APP_LOG)
    parsed = values.withColumn("r", row).withColumn("ok", is_json_object(F.col("value")) & (F.col("r.start").isNotNull() | F.col("r.page").isNotNull()))
    return parsed.filter("ok").select("r.*"), parsed.filter(~F.col("ok")).select("value")


def fan_out(log: DataFrame) -> dict[str, DataFrame]:
    """Error, start, page, display and action rows of parsed logs; an error row is also what else it is."""
    page = log.filter("start is null and page is not null")
    parent = ["page.page_id", "ts", "common"]
    return {
        "error": log.filter("err is not null"),
        "start": log.filter("start is not null").drop("err"),
        "page": page.drop("displays", "actions", "err"),
        "display": page.select(F.explode("displays").alias("d"), *parent).select("d.*", *(c.split(".")[-1] for c in parent)),
        "action": page.select(F.explode("actions").alias("action"), *parent),
    }


def has_field(field: str) -> Column:
    """Whether ``object`` has a field, and not as JSON null."""
    found = F.try_element_at("object", F.lit(field))
    return found.isNotNull() & ~F.is_variant_null(found)


def _of(path: str, kind: str) -> Column:
    """The value under a field of ``object`` at a path such as common.mid; null where there is none of that kind."""
    field, _, rest = path.partition(".")
    return F.try_variant_get(F.try_element_at("object", F.lit(field)), "$" + (f".{rest}" if rest else ""), kind)


def with_object(rows: DataFrame) -> DataFrame:
    """Adds ``object``: the fields of the JSON text ``value`` as variants, whatever they are, by name; null where the text is no object.

    It goes through a generator, past which Spark moves no filter: else each condition on a field would parse the text again.
    The text is parsed as the one item of an array, and as the one field of an object, so that nothing may follow it (see :func:`is_json`).
    """
    inside = lambda begin, end: F.try_parse_json(F.concat(F.lit(begin), F.col("value"), F.lit(end)))
    fields = F.try_variant_get(F.when(inside('{"":', "}").isNotNull(), inside("[", "]")), "$[0]", "map<string,variant>")
    return rows.select("*", F.explode(F.array(fields)).alias("object"))


def log_objects(values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Raw logs as ``value`` and ``object`` (see :func:`with_object`); and dirty values: no object, or neither start nor page."""
    rows = with_object(values.select("value"))
    good = F.coalesce(F.col("object").isNotNull() & (has_field("start") | has_field("page")), F.lit(False))
    return rows.filter(good), rows.filter(~good).select("value")


def visits_of(objects: DataFrame) -> DataFrame:
    """``objects`` with what the repair of new-visitor flags needs: mid, at (time of the log), day, and is_new as 1 or 0."""
    at = F.timestamp_millis(_of("ts", "long"))
    return objects.select("*", _of("common.mid", "string").alias("mid"), at.alias("at"), F.to_date(at).alias("day"), F.when(_of("common.is_new", "string") == "1", 1).otherwise(0).alias("is_new"))


def with_flag(objects: DataFrame, is_new: str) -> DataFrame:
    """value and object, with ``common.is_new`` set to 0 where the column ``is_new`` says so and the log has 1."""
    common = F.map_concat(F.map_filter(F.try_variant_get(F.col("object")["common"], "$", "map<string,variant>"), lambda k, _: k != "is_new"), F.create_map(F.lit("is_new"), F.parse_json(F.lit('"0"'))))
    # Back from a map to one variant by way of its text.
    repaired = F.transform_values("object", lambda k, v: F.when(k == "common", F.parse_json(F.to_json(common))).otherwise(v))
    changes = (F.col(is_new) == 0) & (_of("common.is_new", "string") == "1")
    return objects.select("value", F.when(changes, repaired).otherwise(F.col("object")).alias("object"))


def repaired_log(objects: DataFrame) -> DataFrame:
    """value and object of a table of logs, new-visitor flags repaired by device; logs without a device stay as they are."""
    return with_flag(repair_is_new(visits_of(objects), "mid", "day", "is_new", ["at", "value"]), "is_new")


def routed(objects: DataFrame) -> DataFrame:
    """route, page_id, ts, body (JSON) of all five outputs of :func:`log_objects`, in one pass: each row becomes as many as it has routes.

    Error and start: the whole object. Page: the object without displays and actions. Display and action: each of these,
    with page_id, ts and common of its page. An error row is also what else it is. Bodies are written after the rows are
    dealt out, so a filter on ``route``, or a query without ``body``, saves the writing.
    """
    page = ~has_field("start") & has_field("page")
    one = lambda route, made: F.array(F.struct(F.lit(route).alias("route"), made.alias("made")))
    none = F.array().cast("array<struct<route: string, made: map<string,variant>>>")
    if_any = lambda c, rows: F.when(c, rows).otherwise(none)
    parent = F.create_map(F.lit("page_id"), _of("page.page_id", "variant"), F.lit("ts"), F.try_element_at("object", F.lit("ts")), F.lit("common"), F.try_element_at("object", F.lit("common")))
    parent = F.map_filter(parent, lambda _, v: v.isNotNull())

    def each(route: str, field: str) -> Column:
        whole = lambda x: F.map_concat(F.map_filter(x, lambda k, _: ~k.isin("page_id", "ts", "common")), parent)
        return F.coalesce(F.transform(_of(field, "array<map<string,variant>>"), lambda x: F.struct(F.lit(route).alias("route"), whole(x).alias("made"))), none)

    whole = F.col("object")
    outputs = F.concat(
        if_any(has_field("err"), one("error", whole)),
        if_any(has_field("start"), one("start", whole)),
        if_any(page, one("page", F.map_filter(whole, lambda k, _: ~k.isin("displays", "actions")))),
        if_any(page, each("display", "displays")),
        if_any(page, each("action", "actions")),
    )
    dealt = objects.select(F.explode(outputs).alias("o"), _of("page.page_id", "string").alias("page_id"), _of("ts", "long").alias("ts"))
    return dealt.select("o.route", "page_id", "ts", F.to_json("o.made").alias("body"))


def session_entries(pages: DataFrame) -> DataFrame:
    """Page rows that no other page led to."""
    return pages.filter(F.col("page.last_page_id").isNull())


def logged_in_entries(pages: DataFrame) -> DataFrame:
    """Session entries of a user who is logged in."""
    return session_entries(pages).filter(F.col("common.uid").isNotNull())


def of_pages(pages: DataFrame, *names: str) -> DataFrame:
    """Rows of the named pages."""
    return pages.filter(F.col("page.page_id").isin(*names))


def searches(pages: DataFrame, ts: str | None = None) -> DataFrame:
    """Page rows that show the result of a keyword search, with ``keyword``: what was searched for.

    ``ts``: the event time of a stream with a watermark. Named in the condition, it keeps Spark from filtering before
    the watermark is set, so that all rows move it.
    """
    found = (F.col("page.last_page_id") == "search") & (F.col("page.item_type") == "keyword") & F.col("page.item").isNotNull()
    return pages.filter(F.when(found, F.col(ts)).isNotNull() if ts else found).withColumn("keyword", F.col("page.item"))


def explode_words(rows: DataFrame, text: str, tokenizer: Callable[[Column], Column] = split_words) -> DataFrame:
    """``rows`` with ``word``, a row for each word of ``text``. ``tokenizer``: a column function, or a Pandas UDF of a
    segmenter, from text to an array of words; where it gives null, as for a text that it cannot cut, the whole text is the word."""
    words = F.coalesce(tokenizer(F.col(text)), F.array(F.col(text)))
    return rows.withColumn("word", F.explode(words))


def repair_is_new(rows: DataFrame, key: str, day: str, flag: str, order: list[str]) -> DataFrame:
    """New-visitor flag 1 on another day than the key's first visit becomes 0.

    First visit: the key's first row's day if its flag is 1, else the day before (a known visitor). Only the first row
    of each key is aggregated and joined back, so a busy key needs no window of its own. Rows without a key stay as they are.
    """
    first = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(F.col(day).alias("d"), F.col(flag).alias("f")), F.struct(*order)).alias("_first"))
    seen = F.when(F.col("_first.f") == 1, F.col("_first.d")).otherwise(F.date_sub("_first.d", 1))
    joined = rows.join(first, key, "left")
    return joined.withColumn(flag, F.when((F.col(flag) == 1) & (F.col(day) != seen), 0).otherwise(F.col(flag))).drop("_first")


def first_of_day(rows: DataFrame, keys: list[str], day: str, order: list[str]) -> DataFrame:
    """Earliest row of each key and day."""
    rest = [c for c in rows.columns if c not in (*keys, day)]
    return rows.groupBy(*keys, day).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, day, "_r.*").select(*rows.columns)


def bounces(rows: DataFrame, key: str, ts: str, tie: str, entry: str, bound: str = "10 seconds") -> DataFrame:
    """Session entries that stay alone: the key's next row is an entry, comes at the bound or later, or is missing.

    ``entry`` is a boolean column. A next row that is no entry, inside the bound, ends the bounce. A key's rows meet by day,
    so a key with very many rows is spread over tasks; rows with a null key do so within a day only.
    """
    after = beside(rows, key, [ts, tie], F.struct(F.col(ts).alias("t"), F.col(entry).alias("e")), F.to_date(ts), "_next").withColumn("_next", F.col("_next.v"))
    alone = F.col("_next").isNull() | F.col("_next.e") | (F.col("_next.t") >= F.col(ts) + F.expr(f"interval {bound}"))
    return after.filter(F.col(entry) & alone).drop("_next")


def keyword_counts(rows: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """Words of a text column counted by the keys."""
    return explode_words(rows.select(*keys, text), text).groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("ct"))
