"""Chat formatting with Spark expressions only.

Template: ``<|begin|>role\\n`` content ``<|end|>\\n`` for each run of adjacent turns of one role; the texts of a run are
joined by ``<|turn|>``. Inside roles and texts a backslash becomes two, and the ``|`` of any ``<|`` gets a backslash
before it (in roles a line feed becomes backslash n), so no text can contain a control string and reading back is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN, TURN, END = "<|begin|>", "<|turn|>", "<|end|>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    """The inverse: every backslash of an escaped text begins a pair, so one pass from the left suffices."""
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, formatted, loss_spans (start, length in code points of ``formatted``) for each conversation.

    ``turns`` has conv_id, turn, role, text. Turns are ordered by turn, ties by role and text; a null turn comes first,
    a null role or text counts as empty, rows with a null conv_id form one conversation, repeated rows are turns of
    their own. loss_spans cover the text of each assistant turn, escaped, and nothing between. Extra columns are ignored.
    A conversation becomes one string, so one conversation is the unit that must fit in memory; an empty table gives no row.
    """
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sorted_turns = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("turns"))

    def header(t: Column) -> Column:
        return F.concat(F.lit(BEGIN), F.replace(escape(t["role"]), F.lit("\n"), F.lit("\\n")), F.lit("\n"))

    def piece(t: Column, i: Column) -> Column:
        same = (i > 0) & (F.get("turns", i - 1)["role"] == t["role"])
        before = F.when(F.coalesce(same, F.lit(False)), F.lit(TURN)).otherwise(F.concat(F.when(i > 0, F.lit(END)).otherwise(F.lit("")), header(t)))
        return F.struct(before.alias("before"), escape(t["text"]).alias("body"), (t["role"] == "assistant").alias("loss"))

    pieces = sorted_turns.select("conv_id", "turns", F.transform("turns", piece).alias("pieces"))

    def step(done: Column, p: Column) -> Column:
        start = done["at"] + F.char_length(p["before"])
        span = F.struct(start.cast("long").alias("start"), F.char_length(p["body"]).cast("long").alias("length"))
        spans = F.when(p["loss"], F.concat(done["spans"], F.array(span))).otherwise(done["spans"])
        return F.struct((start + F.char_length(p["body"])).cast("long").alias("at"), spans.alias("spans"))

    none = F.from_json(F.lit('{"at": 0, "spans": []}'), "at long, spans array<struct<start: long, length: long>>")
    return pieces.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.concat(F.array_join(F.transform("pieces", lambda p: F.concat(p["before"], p["body"])), ""), F.lit(END)).alias("formatted"),
        F.aggregate("pieces", none, step)["spans"].alias("loss_spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds ``turns`` (role, text in order) and ``loss_text`` (texts under the spans, joined), read from the string alone."""
    runs = F.split(F.substr(F.col("formatted"), F.lit(len(BEGIN) + 1), F.char_length("formatted") - len(BEGIN) - len(END)), r"<\|end\|>\n<\|begin\|>", -1)

    def turns_of(run: Column) -> Column:
        cut = F.locate("\n", run)
        role = unescape(F.regexp_replace(F.substr(run, F.lit(1), cut - 1), r"(?<!\\)((?:\\\\)*)\\n", "$1\n"))
        body = F.split(F.substr(run, cut + 1), r"<\|turn\|>", -1)
        return F.transform(body, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    spans = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return formatted.withColumns({"turns": F.flatten(F.transform(runs, turns_of)), "loss_text": F.array_join(spans, "")})


#: A conversation whose texts hold control strings of a widely used template.
PROBE = "</s>[INST] ok [/INST]"


def op8_chat_format(spark, sf_dir: str) -> DataFrame:
    from tidewater.llm.common import table

    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(own)
    back = read_back(format_conversations(rows))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(joined, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), o AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before,
    length(replace(replace(text, '\\', '\\\\'), '<|', '<\\|')) AS n_text,
    length(replace(replace(replace(role, '\\', '\\\\'), '<|', '<\\|'), chr(10), '\\n')) AS n_role
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n_text + CASE WHEN before = role THEN 8 ELSE 18 + n_role END) AS BIGINT) AS formatted_chars
FROM o GROUP BY conv_id
"""
