"""Document fingerprints: threshold-scaled sketches of word shingles, with Spark expressions only.

A sketch is every 64-bit shingle hash below a fixed fraction of the hash range, and nothing else: the sketch of a union of
shingle sets is the union of their sketches, and shared hashes over a sketch's size estimate containment without bias
however unequal the texts are. A text too short to have any hash below the limit keeps its smallest hash apart, in a
column of its own, which only comparisons of single texts use and merging ignores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import stash, table, words

SHINGLE = 5
#: One in SCALE of the hashes is kept.
SCALE = 8


def shingle_hashes(given: str) -> Column:
    """64-bit hash of each shingle of the word hashes in column ``given`` (under 5 words: of all of them; no word: none)."""
    many = F.transform(F.sequence(F.lit(0), F.size(given) - SHINGLE), lambda i: F.xxhash64(*[F.get(given, i + k) for k in range(SHINGLE)]))
    return F.when(F.size(given) >= SHINGLE, many).when(F.size(given) > 0, F.array(F.xxhash64(given))).otherwise(F.array().cast("array<bigint>"))


def with_sketch(df: DataFrame, text: str, name: str, scale: int = SCALE) -> DataFrame:
    """Adds ``name`` (ascending distinct hashes of ``text`` below the limit) and ``name_least`` (the smallest hash of a text that has words but none below)."""
    last = -(1 << 63) + (1 << 64) // scale - 1
    w, every, kept = f"_{name}_words", f"_{name}_hashes", F.col(name)
    df = df.withColumn(w, F.transform(words(F.col(text)), lambda x: F.xxhash64(x))).withColumn(every, shingle_hashes(w)).drop(w)
    df = df.withColumn(name, F.sort_array(F.array_distinct(F.filter(every, lambda h: h <= last))))
    return df.withColumn(f"{name}_least", F.when(F.size(kept) == 0, F.array_min(every))).drop(every)


def comparable(sketch: str) -> Column:
    """A sketch with the hash that stands in for it where it is empty."""
    least = F.col(f"{sketch}_least")
    return F.when(least.isNotNull(), F.array(least)).otherwise(F.col(sketch))


def printed(sketch: str) -> Column:
    """A sketch as text: 16 hexadecimal digits for each hash, ascending; a tilde before the hash that stands in for an empty one."""
    digits = F.array_join(F.transform(comparable(sketch), lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")
    return F.concat(F.when(F.col(f"{sketch}_least").isNotNull(), "~").otherwise(""), digits)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the first text's shingles that the second has; null where the first sketch is empty."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a))


def likeness(a: Column, b: Column) -> Column:
    """Containment of the smaller sketch in the other, 0 to 1; 1 if both are empty, 0 if one is."""
    least = F.least(F.size(a), F.size(b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when(least == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / least).cast("double")


def merge(sketches: DataFrame, key: str, sketch: str = "sketch") -> DataFrame:
    """Sketch of each key's texts together, exactly the sketch of the union of their shingles; a key (null is one) whose sketches are all empty or null has an empty one."""
    rows = sketches.select(key, F.explode_outer(sketch).alias("h")).distinct()
    return rows.groupBy(key).agg(F.sort_array(F.collect_list("h")).alias(sketch))


def neighbours(ids: DataFrame) -> DataFrame:
    """doc_id, next_id: the next larger doc_id, for the largest the smallest. Distinct ids; range partitions, no global window.

    Ids are dealt into ranges and written; the lead inside a range is a window of that range, and one row for each
    range gives the id after its last one.
    """
    dealt = stash(ids.repartitionByRange("doc_id").withColumn("part", F.spark_partition_id()))
    heads = dealt.groupBy("part").agg(F.min("doc_id").alias("head"))
    first = heads.agg(F.min("head").alias("first"))
    after = heads.select("part", F.lead("head").over(Window.orderBy("part")).alias("after"))  # one row a range
    after = after.withColumn("one", F.lit(1)).join(F.broadcast(first.withColumn("one", F.lit(1))), "one").select("part", F.coalesce("after", "first").alias("after"))
    own = F.lead("doc_id").over(Window.partitionBy("part").orderBy("doc_id"))
    return dealt.withColumn("own", own).join(F.broadcast(after), "part").select("doc_id", F.coalesce("own", "after").alias("next_id"))


def edited_pairs(docs: DataFrame, scale: int = SCALE) -> DataFrame:
    """Every document with its sketch, its edited text and that text's sketch, and the sketch of the next document.

    Edited text: the last floor(n/4) code points replaced by as many first ones of the next document by ascending
    doc_id (the first one after the last). A null text counts as empty, a null doc_id has no next document (empty
    text and sketch). Of rows that repeat a doc_id, each is fingerprinted, and the row before them takes the
    smallest text as its next document. A single document is its own next one. Extra columns are ignored; an empty
    table gives no row; a text is one row, however long.

    Texts are dealt by doc_id once: that one exchange serves the join that finds the heads wanted by the documents
    before, and the join that brings each document its head.
    """
    if docs.schema["doc_id"].dataType.simpleString() != "bigint":  # a cast of none is a new column to Spark, and would keep it from reusing the exchange
        docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    known = docs.filter("doc_id is not null")
    sizes = known.groupBy("doc_id").agg(F.max(F.char_length("text")).alias("n"))
    wanted = neighbours(sizes.select("doc_id")).join(sizes, "doc_id").select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("asker"), F.expr("n div 4").cast("int").alias("need"))
    head = F.struct(F.substr("text", F.lit(1), F.col("need")).alias("head"), F.col("sketch").alias("next_sketch"), F.col("sketch_least").alias("next_sketch_least"))
    heads = with_sketch(known.join(wanted, "doc_id"), "text", "sketch", scale).groupBy(F.col("asker").alias("doc_id")).agg(F.min(head).alias("next"))
    all_of = known.join(heads, "doc_id", "left").unionByName(docs.filter("doc_id is null"), allowMissingColumns=True)
    all_of = with_sketch(all_of, "text", "sketch", scale)
    n, moved = F.char_length("text"), F.expr("char_length(text) div 4").cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - moved), F.substr(F.coalesce("next.head", F.lit("")), F.lit(1), moved))
    following = F.coalesce("next.next_sketch", F.array().cast("array<bigint>")).alias("next_sketch")
    full = all_of.select("doc_id", "text", n.cast("long").alias("n_chars"), "sketch", "sketch_least", edited.alias("edited_text"), following, F.col("next.next_sketch_least").alias("next_sketch_least"))
    return with_sketch(full, "edited_text", "edited_sketch", scale)


def op7_fingerprints(spark, sf_dir: str) -> DataFrame:
    pairs = edited_pairs(table(spark, sf_dir, "documents"))
    return pairs.select(
        "doc_id",
        "n_chars",
        F.sha2("edited_text", 256).alias("edited_sha256"),
        printed("sketch").alias("fingerprint"),
        printed("edited_sketch").alias("edited_fingerprint"),
        likeness(comparable("sketch"), comparable("edited_sketch")).alias("near_edited"),
        likeness(comparable("sketch"), comparable("next_sketch")).alias("near_next"),
    )
