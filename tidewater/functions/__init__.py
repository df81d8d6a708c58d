"""Column helpers: dates, JSON, maps, words. All are built-in expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Timestamps keep their microseconds in JSON texts of rows.
EXACT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}

#: JSON texts as RFC 8259 has them, of any length; a text that is none stands in ``bad``.
STRICT = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad", "allowSingleQuotes": "false", "allowNonNumericNumbers": "false", "maxNumLen": str(2**31 - 1), "maxStringLen": str(2**31 - 1)}

DAY, SECOND = "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss"


def day_text(ts: Column) -> Column:
    """Timestamp to yyyy-MM-dd."""
    return F.date_format(ts, DAY)


def time_text(ts: Column) -> Column:
    """Timestamp to yyyy-MM-dd HH:mm:ss."""
    return F.date_format(ts, SECOND)


def to_millis(text: Column) -> Column:
    """Date or date-time text to epoch milliseconds; what is neither gives null."""
    return F.unix_millis(F.coalesce(F.try_to_timestamp(text, F.lit(SECOND)), F.try_to_timestamp(text, F.lit(DAY))))


def from_millis(ms: Column, pattern: str = SECOND) -> Column:
    """Epoch milliseconds to text."""
    return F.date_format(F.timestamp_millis(ms), pattern)


def millis_timestamp(ms: Column) -> Column:
    """Epoch milliseconds to a timestamp of whole seconds."""
    return F.timestamp_seconds(F.floor(ms / 1000))


def seconds_to_millis(s: Column) -> Column:
    return s * 1000


def compare_times(a: Column, b: Column) -> Column:
    """-1, 0 or 1 by the moment that two timestamp texts (fraction of a second optional) name."""
    x, y = F.try_to_timestamp(a), F.try_to_timestamp(b)
    return F.when(x < y, -1).when(x > y, 1).when(x == y, 0)


def days_between(later: Column, earlier: Column) -> Column:
    """Calendar days."""
    return F.datediff(later, earlier)


def whole_days(later_ms: Column, earlier_ms: Column) -> Column:
    """Milliseconds apart, in whole days."""
    return F.floor((later_ms - earlier_ms) / 86_400_000)


def date_part(text: Column) -> Column:
    """The date of a date-time text: what stands before the space."""
    return F.split(text, " ")[0]


def as_int(c: Column) -> Column:
    return c.try_cast("int")


def as_amount(c: Column) -> Column:
    return c.try_cast("decimal(16,2)")


def pick(m: Column, key: str) -> Column:
    """Map value, null for a missing key."""
    return F.try_element_at(m, F.lit(key))


def has_key(m: Column, key: str) -> Column:
    """Whether a map has the key; null for a null map."""
    return F.map_contains_key(m, key)


def keep_keys(m: Column, comma_list: Column) -> Column:
    """The map's entries whose keys stand in a comma list."""
    return F.map_filter(m, lambda k, v: F.array_contains(F.transform(F.split(comma_list, ","), lambda name: F.trim(name)), k))


def is_json(text: Column) -> Column:
    """Whether the whole text is one JSON value of any kind (RFC 8259; a repeated key is allowed).

    Spark's parsers stop behind the first value, so that "7 of them" would pass as 7. What parses both as the one
    item of an array and as the one field of an object has nothing behind its value.
    """
    inside = lambda begin, end: F.from_json(F.concat(F.lit(begin), text, F.lit(end)), "v string, bad string", STRICT)["bad"].isNull()
    return F.coalesce(text.isNotNull() & inside('{"v":[', "]}") & inside('{"v":{"a":', "}}"), F.lit(False))


def is_json_object(text: Column) -> Column:
    return is_json(text) & F.coalesce(F.trim(text).startswith("{"), F.lit(False))


def row_json(*columns: str) -> Column:
    """A row as JSON text."""
    return F.to_json(F.struct(*(columns or ("*",))))


def split_words(text: Column) -> Column:
    """Lower-case words of a text: runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def flag(condition: Column) -> Column:
    """1 where true, else 0."""
    return F.when(condition, 1).otherwise(0)


def camel(name: str) -> str:
    """lower_underscore to lowerCamel."""
    head, *rest = name.lower().split("_")
    return head + "".join(w.capitalize() for w in rest)


def unix_now() -> Column:
    """Seconds since 1970 as of the query's start; a version number, not to be compared."""
    return F.unix_timestamp()


def changed_or_created(data: Column) -> Column:
    """Event time of a change record's values: ``operate_time``, else ``create_time``."""
    return F.coalesce(pick(data, "operate_time"), pick(data, "create_time"))


def words_of(text: str) -> list[str]:
    """Words of a text as :func:`split_words` cuts it."""
    return [w for w in re.split(r"[^\w]+|_+", text.lower()) if w]


def table_function(tokenizer: Callable[[str], list[str] | None] = words_of):
    """A table function for SQL: a row for each word that ``tokenizer`` finds in a text. Where it fails, or gives None, the whole text is the word; null gives no row."""

    class Words:
        def eval(self, text: str):
            if text is None:
                return
            try:
                found = tokenizer(text)
            except Exception:  # noqa: BLE001  a text that cannot be cut is kept whole
                found = None
            for word in [text] if found is None else found:
                yield (word,)

    return F.udtf(Words, returnType="word string")


def register_table_functions(spark: SparkSession, tokenizer: Callable[[str], list[str] | None] = words_of) -> None:
    """Makes ``split_words(text)`` known to SQL: ``SELECT ... FROM t, LATERAL split_words(t.item)``."""
    spark.udtf.register("split_words", table_function(tokenizer))
