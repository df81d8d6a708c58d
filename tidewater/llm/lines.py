"""Line dedup by an exact set-similarity join, with Spark expressions only.

A line's tokens are its distinct 5-word shingles (a shorter line: the whole of it), hashed to 64 bits. All lines order
their tokens alike, rare ones first: tokens of buckets that a count over all lines finds crowded come last. If two
sets have a Jaccard similarity of at least t, then their prefixes of n - ceil(t * n) + 1 tokens share one; length and
position of a shared token bound the overlap; what passes is verified on the full sets. A line goes if an
earlier line (by doc_id, then version, then place) has the same set or a similar one. The version tells rows of one doc_id apart.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import WORD_PATTERN, stash, table, words

SHINGLE, JACCARD = 5, 0.8
#: Buckets of the token counts: as many as the first, quick map of a compiled count holds.
BUCKETS = 1 << 16
#: Standard deviations of a chance count above which a bucket counts as crowded. Chance crowds some buckets too, whose tokens only come later in the order.
SPREAD = 1.5
#: What names a line.
LINE = ["doc_id", "version", "line"]
#: Candidate lines, or documents with kept lines, whose ids (24 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: The same for the bytes that mark kept lines.
BROADCAST_BYTES = 16 << 20
#: Rows of 64 bits each, broadcast at most, that tell most other lines from candidate lines where these are too many to be broadcast themselves.
MARKS = 1 << 20
#: Pairs for each candidate line whose token sets are shuffled at a time, where they are too many to be broadcast: what this takes of the disks stays in proportion to the lines.
PAIRS_AT_ONCE = 3
#: Tokens of buckets beyond this level of crowding are dealt into two groups, those of the highest into four: the first line of each group meets all lines.
SALT_LEVEL = 13


def line_words(docs: DataFrame, only: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """doc_id, version, line (place from 0), w (words) of each line with a word, or of those that ``only`` leaves of all lines.

    A line whose only separators are single spaces, as of nearly all, is split at them, which costs a fraction of the pattern.
    """
    lines = docs.select("doc_id", "version", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line", "content"))
    lines = lines.filter(F.col("content").rlike(WORD_PATTERN)) if only is None else only(lines)
    content = F.col("content")
    odd = functools.reduce(Column.__or__, [content.contains(x) for x in "\t\x0b\x0c\r"])
    spaced = content.contains("  ") | content.startswith(" ") | content.endswith(" ")
    at_spaces = F.split(content, " ", -1)
    return lines.select(*LINE, F.when(odd, words(content)).when(spaced, F.array_remove(at_spaces, "")).otherwise(at_spaces).alias("w"))


def _hashes() -> Column:
    """Hash of each word, so that the shingles that hold it need not read it again."""
    return F.transform("w", lambda x: F.xxhash64(x))


def _shingle(h: Column, first: Column, i: Column) -> Column:
    """Hash of SHINGLE neighbours among the word hashes ``h``, of which ``first`` is at place i; of those up to the end, if fewer are left."""
    return F.xxhash64(first, *[F.get(h, i + k) for k in range(1, SHINGLE)])


def _shingles(h: Column) -> Column:
    """Hashes of all SHINGLE neighbours among the word hashes ``h``; of fewer: of the whole."""
    each = F.transform(h, lambda x, i: _shingle(h, x, i))
    return F.slice(each, 1, F.greatest(F.size(h) - SHINGLE + 1, F.lit(1)))


def line_tokens(docs: DataFrame, only: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """doc_id, version, line, tokens (distinct hashes) of each line with a word, or of those that ``only`` leaves. (Filter lines before this: Spark would make the tokens anew, word by word, for a filter on them.)"""
    # The function reads the word hashes as its variable: a column's array would be unpacked anew for each read.
    return line_words(docs, only).select(*LINE, F.array_distinct(F.transform(F.array(_hashes()), _shingles)[0]).alias("tokens"))


def crowding(docs: DataFrame) -> list[int]:
    """How crowded each bucket of token hashes is, counted over all lines: BUCKETS levels from 0 to 15.

    The count above the mean estimates that of a bucket's most frequent token (repeats inside a line included). Level 0: less than SPREAD
    standard deviations of a chance count (the root of the mean); above it one level more for each doubling. Word hashes
    are exploded and joined to shingles as columns, not by array functions, so that Spark compiles this part of the count.
    The explosion is an outer one, since Spark would hash the words twice to see that there are any.
    """
    hashed = line_words(docs).select(_hashes().alias("h"))
    at = hashed.select("h", F.posexplode_outer("h").alias("i", "x")).filter((F.col("i") + SHINGLE <= F.size("h")) | (F.col("i") == 0))
    bucket = _shingle(F.col("h"), F.col("x"), F.col("i")).bitwiseAND(F.lit(BUCKETS - 1)).cast("int")
    counts = stash(at.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")))
    mean = max(1.0, (counts.agg(F.sum("n")).first()[0] or 0) / BUCKETS)
    above = (F.col("n") - mean) / (SPREAD * math.sqrt(mean))
    found = [0] * BUCKETS
    for r in counts.filter(above >= 1).select("b", F.least(F.lit(15), F.floor(F.log2(above)).cast("int") + 1).alias("level")).collect():  # BUCKETS rows at most
        found[r.b] = r.level
    return found


def line_sets(docs: DataFrame, jaccard: float = JACCARD) -> DataFrame:
    """set (hashes and size of the token set), doc_id, version and line of its first line, size, prefix: one row for each distinct set."""
    tokens = line_tokens(docs)
    levels = F.split(F.lit(",".join(str(x << 59) for x in crowding(docs))), ",").cast("array<bigint>")
    # The order: by the bucket's level, then by the hash's upper 59 bits. Never null, so that Spark sorts bare numbers.
    level = lambda t: F.coalesce(F.get(levels, t.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")), F.lit(0).cast("long"))
    key = lambda t: level(t).bitwiseOR(F.shiftrightunsigned(t, 5))
    n = F.size("ordered")
    ordered = tokens.select(*LINE, F.sort_array(F.transform("tokens", key)).alias("ordered"))
    prefix = F.slice("ordered", 1, n - F.ceil(n * jaccard - 1e-9).cast("int") + 1)
    each = ordered.select(F.struct(F.xxhash64("ordered").alias("a"), F.hash("ordered").alias("b"), n.alias("size")).alias("set"), *LINE, prefix.alias("prefix"))
    firsts = each.groupBy("set").agg(F.min(F.struct(*LINE, "prefix")).alias("f"))
    return firsts.select("set", *[f"f.{c}" for c in LINE], F.col("set.size").alias("size"), "f.prefix")


def _own() -> Column:
    """A dealt token's line."""
    return F.struct(*LINE, "span")


def salts(token: Column) -> Column:
    """Into how many groups the lines of a token are dealt: one, but for tokens of buckets that the count found most crowded, whose level stands in the token's upper bits."""
    return F.call_function("shiftleft", F.lit(1), F.greatest(F.shiftright(token, 59).bitwiseAND(F.lit(15)).cast("int") - SALT_LEVEL, F.lit(0)))


def shared_prefixes(sets: DataFrame) -> DataFrame:
    """doc_id, version, line, span, token, salt of prefix tokens with an earlier line, prev being the one just before and first the group's first.

    ``span`` holds the size in its upper and the place in its lower half, so that a dealt token is six numbers. Tokens
    are dealt once; those of a single set, nearly all, end there. The lines of a very frequent token are dealt into several groups,
    whose first lines are rows too, without a prev.
    """
    every = sets.select(*LINE, "size", F.posexplode("prefix").alias("place", "token"))
    salt = F.pmod(F.hash(*LINE), salts(F.col("token"))).cast("int")
    every = every.select(*LINE, F.shiftleft(F.col("size").cast("long"), 32).bitwiseOR(F.col("place").cast("long")).alias("span"), "token", salt.alias("salt"))
    by_line = Window.partitionBy("token", "salt").orderBy(*LINE)
    met = every.withColumn("prev", F.lag(_own()).over(by_line)).filter((salts(F.col("token")) > 1) | F.col("prev").isNotNull())
    # A group's first line is the one before its second: found among the few rows that are left.
    return met.withColumn("first", F.first(F.coalesce("prev", _own())).over(by_line.rowsBetween(Window.unboundedPreceding, 0)))


def fitting(rows: DataFrame, jaccard: float = JACCARD) -> DataFrame:
    """a, b, n: of ``rows`` (x and y of one token), pairs with a earlier that pass the length and position filters, with how many tokens bring them."""
    size = lambda c: F.shiftright(f"{c}.span", 32)
    left = lambda c: size(c) - F.col(f"{c}.span").bitwiseAND(F.lit(0xFFFFFFFF))
    at = lambda c: F.struct(*[f"{c}.{k}" for k in LINE])
    need = (size("x") + size("y")) * (jaccard / (1 + jaccard)) - 1e-9
    fits = (F.least(size("x"), size("y")) >= jaccard * F.greatest(size("x"), size("y")) - 1e-9) & (F.least(left("x"), left("y")) >= need)
    return rows.filter((at("x") < at("y")) & fits).groupBy(at("x").alias("a"), at("y").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def few(df: DataFrame, ids: int = 1) -> DataFrame:
    """The written ``df`` of ``ids`` lines a row, to be broadcast if it has few rows, and not otherwise, however small its file."""
    return F.broadcast(df) if df.count() * ids <= BROADCAST_IDS else df.hint("merge")


def marked(lines: DataFrame, ends: DataFrame) -> DataFrame:
    """``lines`` without most of those that are not in ``ends`` (doc_id, version, line): rows whose hash has a bit that one of ``ends`` has set."""
    h = F.xxhash64(*LINE)
    word, bit = F.pmod(F.shiftright(h, 6), F.lit(MARKS)), F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))
    marks = ends.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("mask"))
    return lines.withColumn("word", word).join(F.broadcast(marks), "word").filter(F.col("mask").bitwiseAND(bit) != 0).select(lines.columns)


def similar_to_earlier(docs: DataFrame, pairs: DataFrame, jaccard: float = JACCARD) -> DataFrame:
    """b of the written ``pairs`` (a, b) whose token sets are similar in full.

    Few pairs are sent to the sets; many meet them by shuffles, of the lines that marks let through and not of all texts.
    Each pair then carries a token set, so very many pairs go one part after the other, whose shuffle files go with it.
    """
    n = pairs.count()
    few_pairs = n <= BROADCAST_IDS // 2
    near = F.broadcast if few_pairs else lambda df: df.hint("merge")
    ends = stash(pairs.select(F.explode(F.array("a", "b")).alias("at")).distinct().select(*[f"at.{c}" for c in LINE]))
    texts = docs.join(F.broadcast(ends.select("doc_id", "version").distinct()), ["doc_id", "version"], "left_semi") if few_pairs else docs
    # Marked lines meet the ends in an inner join: Spark would do a semi-join first, of all lines.
    wanted = lambda lines: lines.join(F.broadcast(ends), LINE, "left_semi") if few_pairs else marked(lines, ends).join(ends.hint("merge"), LINE)
    full = stash(line_tokens(texts, wanted)).select(F.struct(*LINE).alias("at"), "tokens")
    shared = F.size(F.array_intersect("x", "y"))

    def similar(of: Callable[[DataFrame], DataFrame]) -> DataFrame:
        later = of(full.select(F.col("at").alias("b"), F.col("tokens").alias("y"))).join(near(of(pairs.select("a", "b"))), "b")
        earlier = full.select(F.col("at").alias("a"), F.col("tokens").alias("x")).join(near(of(pairs).select("a").distinct()), "a", "left_semi")
        return later.join(earlier, "a").filter(shared >= jaccard * (F.size("x") + F.size("y") - shared) - 1e-9).select("b").distinct()

    parts = 1 if few_pairs else math.ceil(n / (PAIRS_AT_ONCE * max(1, ends.count())))
    if parts <= 1:
        return similar(lambda df: df)
    part = F.pmod(F.xxhash64(*[f"b.{c}" for c in LINE]), F.lit(parts))
    return functools.reduce(DataFrame.union, [stash(similar(lambda df, k=k: df.filter(part == k))) for k in range(parts)])


def removed_lines(docs: DataFrame, sets: DataFrame, jaccard: float = JACCARD) -> DataFrame:
    """doc_id, version, line of first lines with a similar earlier one.

    Two rounds, so that a group of m near copies does not make its m * m pairs. First a line meets, by each prefix token,
    the token's first line and the line before it, and is compared with the one it shares most tokens with. Lines found
    similar are done; those still open meet every earlier line of their tokens but for the one already compared.
    """
    rows = stash(shared_prefixes(sets))
    chain = rows.filter("prev is not null").select(F.explode(F.array_distinct(F.array("first", "prev"))).alias("x"), _own().alias("y"))
    best = stash(fitting(chain, jaccard).groupBy("b").agg(F.max_by("a", F.struct("n", "a")).alias("a")))
    found = stash(similar_to_earlier(docs, best, jaccard))
    # A line still open meets all groups of its token, each group in a task of its own.
    groups = F.explode(F.sequence(F.lit(0), salts(F.col("token")) - 1)).alias("salt")
    still = rows.join(few(found.select(*[f"b.{c}" for c in LINE])), LINE, "left_anti").select("token", _own().alias("y"), groups)
    firsts = rows.filter((salts(F.col("token")) == 1) & (F.col("prev") == F.col("first"))).select("token", "salt", F.col("first").alias("x"))
    all_of = rows.select("token", "salt", _own().alias("x")).union(firsts)
    rest = fitting(all_of.join(still, ["token", "salt"]), jaccard).join(few(best.select("a", "b"), 2), ["a", "b"], "left_anti")
    return found.union(similar_to_earlier(docs, stash(rest), jaccard)).select(*[f"b.{c}" for c in LINE])


def text_version(docs: DataFrame) -> Column:
    """What tells rows of one doc_id apart: the text's hash, or nothing to deal out where no doc_id has two texts."""
    texts = docs.filter("doc_id is not null").select("doc_id", F.xxhash64("text").alias("h")).groupBy("doc_id").agg(F.min("h").alias("a"), F.max("h").alias("b"))
    return F.xxhash64("text") if texts.filter("a <> b").limit(1).count() else F.lit(0).cast("long")


def kept_flags(kept: DataFrame) -> DataFrame:
    """doc_id, version, flags of the documents of ``kept`` (doc_id, version, line): one byte for each line up to the last kept one, "1" if it is kept."""
    places = kept.groupBy("doc_id", "version").agg(F.sort_array(F.collect_list("line")).alias("at"))
    marks = F.transform("at", lambda x, i: F.concat(F.repeat(F.lit("0"), x - F.coalesce(F.get("at", i - 1), F.lit(-1)) - 1), F.lit("1")))
    return places.select("doc_id", "version", F.array_join(marks, "").cast("binary").alias("flags"))


def dedup_lines(docs: DataFrame, jaccard: float = JACCARD) -> DataFrame:
    """``docs`` (all columns) with the text reduced to its kept lines, in order; columns added: none.

    A document all of whose lines with words go is dropped; one that had none (null, empty, blank) stays as it is, as
    do blank lines. Rows with a null doc_id stay untouched and unread. Rows that repeat a doc_id with different
    texts are documents of their own, in the order of their texts' hashes; exact repeats are one document, and each of
    them keeps its lines. One line is first by (doc_id, version, line), so ties cannot arise. n_chars, where there is such a column, is counted anew.
    Other columns may have any names; an empty table gives no row. A document's line places, not its lines, are gathered in one row.
    """
    version = text_version(docs)
    known = docs.filter("doc_id is not null").select("doc_id", version.alias("version"), "text")
    sets = stash(line_sets(known, jaccard))
    gone = few(stash(removed_lines(known, sets, jaccard)))
    kept = stash(kept_flags(sets.select(*LINE).join(gone, LINE, "left_anti")))
    small = kept.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum(F.octet_length("flags")), F.lit(0)).alias("bytes")).first()
    near = small.docs <= BROADCAST_IDS and small.bytes <= BROADCAST_BYTES
    rows = docs.select(F.struct("*").alias("row"), "doc_id", version.alias("version"))  # a text goes once where this is shuffled
    joined = rows.join(F.broadcast(kept) if near else kept.hint("merge"), ["doc_id", "version"], "left")
    blank = lambda x: ~F.coalesce(x, F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    read = F.col("doc_id").isNotNull() & F.coalesce(~blank(F.col("row.text")), F.lit(False))
    found = joined.select("row", F.col("row.text").alias("text"), "flags", read.alias("read")).filter(~F.col("read") | F.col("flags").isNotNull())
    stays = lambda x, i: blank(x) | (F.substring("flags", i + 1, F.lit(1)) == F.lit(b"1"))
    text = F.when(F.col("read"), F.array_join(F.filter(F.split("text", "\n", -1), stays), "\n")).otherwise(F.col("text"))
    out = found.select("row", "read", text.alias("text"))
    row = F.col("row").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.when(F.col("read"), F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars")))
    return out.select(row.alias("row")).select("row.*")


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_chars")
