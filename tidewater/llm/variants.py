"""Spelling variants: words that differ by one letter, found through a reduced alphabet.

Letters are hashed to a few symbols, so that near words become equal or near reduced words. Each distinct reduced word
generates its whole one-edit neighbourhood, and the neighbours are joined with the reduced vocabulary. Every pair of
words at one edit meets: one edit changes the reduced word by one edit or not at all. Of the neighbourhood each half is
generated once, from the side that makes it: replacements by a higher symbol, and deletions; the other halves are these
seen from the partner. What meets is verified on the original strings. Neighbours travel as 64-bit hashes of reduced
words, which can only add candidates.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import stash, table, text_groups

#: Shortest word, least occurrences, how many times as frequent as a word its form must be, and every how many runs one loses a letter.
LENGTH, LEAST, RATIO, EVERY = 7, 2, 10, 31
#: Symbols that letters are reduced to.
SYMBOLS = 8
#: Words that a task counts before it hands the counts on.
HELD = 200_000
#: Letters times words that a task generates neighbours of at once.
SLICE = 1 << 18

BASE = 0x9E3779B97F4A7C15
UNBASE = pow(BASE, -1, 1 << 64)
WRAP = (1 << 64) - 1


def count_words(docs: DataFrame, length: int = LENGTH, every: int = EVERY) -> DataFrame:
    """word, n: how often each word occurs in whole texts.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, lower-cased in A-Z only. A run loses one letter where
    ``every`` divides the crc32 of ``<doc_id>:<run>`` (a null id: empty). Null texts have no words. Words are counted
    in the tasks first, so a very frequent word is a few rows.
    """
    run = re.compile(rf"[a-zÀ-ÿ]{{{length},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for group, texts in text_groups(batches):
            for doc, text in zip(group.column("doc_id").to_pylist(), texts, strict=True):
                text = text.lower().decode()
                begin = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for word, n in Counter(run.findall(text) if len(text) < 1 << 20 else (m[0] for m in run.finditer(text))).items():
                    h = zlib.crc32(word.encode(), begin)
                    if h % every == 0:
                        k = h % len(word)
                        word = word[:k] + word[k + 1 :]
                        if len(word) < length:
                            continue
                    held[word] += n
                if len(held) > HELD:
                    yield _counts(held)
                    held.clear()
        if held:
            yield _counts(held)

    found = docs.select("doc_id", "text").mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def _counts(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])


def symbol(letter: str, symbols: int = SYMBOLS) -> int:
    """The symbol that a letter is reduced to."""
    return (ord(letter) * 2654435761 % (1 << 32) >> 16) % symbols


def _powers(n: int) -> np.ndarray:
    out = np.full(n + 1, BASE, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _same_length(words: list[str]) -> Iterator[tuple[list[int], np.ndarray]]:
    """Places and code points of words of one length, in slices."""
    by: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        by.setdefault(len(w), []).append(k)
    for n, places in by.items():
        step = max(1, SLICE // max(1, n))
        for a in range(0, len(places), step):
            part = places[a : a + step]
            yield part, np.frombuffer("".join(words[k] for k in part).encode("utf-32-le"), dtype="<u4").reshape(len(part), n)


def _hashes(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The terms of each reduced word's hash (one more for each symbol, times a power of the base), and the powers."""
    powers = _powers(symbols.shape[1])
    return (symbols + np.uint64(1)) * powers[:-1], powers


def reduce_words(words: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """word, n, reduced (the reduced word as digits) and key (its hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, int] = {}
        for batch in batches:
            texts = batch.column("word").to_pylist()
            keys, reduced = np.zeros(len(texts), dtype=np.uint64), [""] * len(texts)
            for places, letters in _same_length(texts):
                distinct, back = np.unique(letters, return_inverse=True)
                made = np.array([known.setdefault(int(c), symbol(chr(c), symbols)) for c in distinct], dtype=np.uint64)[back.reshape(letters.shape)]
                keys[places] = _hashes(made)[0].sum(axis=1, dtype=np.uint64)
                for k, row in zip(places, (made + np.uint64(48)).astype("u1"), strict=True):
                    reduced[k] = row.tobytes().decode()
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(reduced), pa.array(keys.view(np.int64))], names=["word", "n", "reduced", "key"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, reduced string, key long")


def neighbours(reduced: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """own, key: hashes of each reduced word and of its neighbours: itself, replacements by a higher symbol, deletions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, digits in _same_length(batch.column("reduced").to_pylist()):
                yield from made(digits.astype(np.uint64) - np.uint64(48))

    def made(s: np.ndarray) -> Iterator[pa.RecordBatch]:
        terms, powers = _hashes(s)
        upto = np.cumsum(terms, axis=1, dtype=np.uint64)
        own = upto[:, -1]
        yield pairs(own, own)
        for up in range(1, symbols):
            word, at = np.nonzero(s + np.uint64(up) < symbols)
            yield pairs(own[word], own[word] + np.uint64(up) * powers[at])
        # Of equal symbols side by side, deleting one is deleting any.
        first = np.ones(s.shape, dtype=bool)
        first[:, 1:] = s[:, 1:] != s[:, :-1]
        word, at = np.nonzero(first)
        without = upto[word, at] - terms[word, at] + (own[word] - upto[word, at]) * np.uint64(UNBASE)
        yield pairs(own[word], without)

    def pairs(own: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(key.view(np.int64))], names=["own", "key"])

    return reduced.select("reduced").mapInArrow(run, "own long, key long")


def near_words(words: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """word, n, near, near_n: every pair of words at exactly one inserted, deleted or replaced letter, both ways. ``words``: distinct words with n."""
    keyed = stash(reduce_words(words, symbols))
    met = neighbours(keyed.select("reduced").distinct(), symbols)
    left = keyed.select(F.col("key").alias("own"), F.col("word").alias("a"), F.col("n").alias("a_n"))
    right = keyed.select("key", F.col("word").alias("b"), F.col("n").alias("b_n"))
    both = met.join(right, "key").join(left, "own").filter((F.col("own") != F.col("key")) | (F.col("a") < F.col("b")))
    pairs = both.filter(F.levenshtein("a", "b", 1) == 1).select("a", "a_n", "b", "b_n")
    ways = F.array(F.struct(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("near"), F.col("b_n").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("b_n").alias("n"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    # Dealt by word once, for this distinct (a pair may meet twice where hashes are equal) and for sums by word.
    return pairs.select(F.explode(ways).alias("w")).select("w.*").repartition("word").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where following ``form`` from word to word ends. The length of the ways halves in each round."""
    now = stash(forms.select("word", F.col("form").alias("root")))
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = stash(now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if not after.filter("moved").limit(1).count():
            return after.select("word", "root")
        now = after.select("word", "root")


def variants(words: DataFrame, ratio: int = RATIO, symbols: int = SYMBOLS) -> DataFrame:
    """word, n, n_near, form, form_n, root of each word of ``words`` (distinct words with n).

    form: the near word of largest n (ties: the smallest in code-point order), if that n is at least ``ratio`` times the
    word's; else null. root: the last of word, form, form's form and so on; the word itself without a form. Forms grow
    in n at each step, so there is no circle. An empty table gives an empty result.
    """
    words = words.select("word", "n")
    best = F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w"))).alias("best")
    found = near_words(words, symbols).groupBy("word").agg(F.first("n").alias("own_n"), F.count(F.lit(1)).alias("n_near"), best)
    fits = -F.col("best.m") >= ratio * F.col("own_n")
    found = stash(found.select("word", "n_near", F.when(fits, F.col("best.w")).alias("form"), F.when(fits, -F.col("best.m")).alias("form_n")))
    chained = roots(found.filter("form is not null"))
    return words.join(found, "word", "left").join(chained, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = stash(count_words(table(spark, sf_dir, "documents")).filter(F.col("n") >= LEAST))
    return variants(words).select("word", "form", "root", "n", "n_near", "form_n")
