"""Interpolated modified Kneser-Ney bigram model of words, counted in Spark and scored from memory-mapped arrays.

Three passes over the texts: (1) count training words by 64-bit hash; sorted into shards, a word's place is its id;
(2) count bigrams of ids, sorted into shards of (pair, count), with the sums that smoothing needs; (3) score.
Each shard is one numpy file in the shared folder, written by the task that holds it and mapped by every worker.
"""

from __future__ import annotations

import io
import mmap
import os
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import fold, partitions, shared_dir, table, text_groups

#: Text that a worker holds as arrays at a time.
GROUP = 8 << 20
#: Distinct keys that a worker adds up before it passes them on.
MERGED = 3_000_000
#: The ids of "start of text" and "unknown word" as predecessors; real ids are below.
START, UNKNOWN = (1 << 32) - 1, (1 << 32) - 2
#: What the end of a text hashes as: no word holds a line feed.
END = xxhash.xxh64_intdigest(b"\n")


def local_path(url: str) -> str:
    """The folder of a file: URL. Mapping needs the shared folder mounted on every machine."""
    if url.startswith("file:"):
        return "/" + url[5:].lstrip("/")
    if "://" in url:
        raise ValueError(f"{url} cannot be memory-mapped; spark.checkpoint.dir must be a mounted shared folder")
    return url


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every token (lower-cased words, then the end) of all texts, and tokens in each text."""
    hashed: list[int] = []
    counts = []
    for t in texts:
        before = len(hashed)
        hashed += map(xxhash.xxh64_intdigest, t.lower().split())
        hashed.append(END)
        counts.append(len(hashed) - before)
    return np.array(hashed, dtype=np.uint64), np.array(counts, dtype=np.int64)


def save(path: str, array: np.ndarray) -> None:
    """One array as a file; a repeated task replaces it by the same bytes."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    raw = io.BytesIO()
    np.save(raw, array)
    temporary = f"{path}.{os.getpid()}.part"
    with open(temporary, "wb") as f:
        f.write(raw.getbuffer())
    os.replace(temporary, path)


class Lookup:
    """Sorted uint64 keys in shards by range, or by a hash of the pair."""

    def __init__(self, folder: str, name: str, shards: int):
        self.shards = shards
        self.keys = Shards(f"{folder}/{name}_keys_{{}}.npy", shards)

    def find(self, keys: np.ndarray, shard: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each shard: which of the (sorted, distinct) keys it holds, and where."""
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(self.shards + 1))
        for k in range(self.shards):
            own = order[cuts[k] : cuts[k + 1]]
            if len(own) and self.keys[k] is not None:
                at = np.searchsorted(self.keys[k], keys[own])
                at[at == len(self.keys[k])] = 0
                hit = self.keys[k][at] == keys[own]
                yield k, own[hit], at[hit]


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """Which of ``shards`` equal ranges of all 64-bit numbers each key lies in."""
    return ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def pair_shard(pairs: np.ndarray, shards: int) -> np.ndarray:
    """By a hash of the whole pair, so that a frequent predecessor's pairs spread over all shards."""
    with np.errstate(over="ignore"):
        return shard_of((pairs ^ pairs >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15), shards)


def summed(found: Iterator[tuple[np.ndarray, np.ndarray]], most: int = MERGED) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(distinct keys, counts) of several groups of text, added up until they hold ``most`` keys."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def one() -> tuple[np.ndarray, np.ndarray]:
        if len(held) == 1:
            return held[0]
        keys, n = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        return keys[first], np.add.reduceat(n, first)

    for pair in found:
        held.append(pair)
        if sum(len(k) for k, _ in held) > most:
            yield one()
            held.clear()
    if held:
        yield one()


class Words:
    """Ids of words: the place of a hash in the sorted shards."""

    def __init__(self, folder: str, shards: int, bases: list[int]):
        self.lookup, self.bases = Lookup(folder, "word", shards), bases

    def ids(self, hashed: np.ndarray) -> np.ndarray:
        keys, back = np.unique(hashed, return_inverse=True)
        out = np.full(len(keys), UNKNOWN, dtype=np.uint64)
        for k, own, at in self.lookup.find(keys, shard_of(keys, self.lookup.shards)):
            out[own] = (self.bases[k] + at).astype(np.uint64)
        return out[back]


_models: dict = {}


def _words(folder: str, shards: int, bases: list[int]) -> Words:
    if (folder, "w") not in _models:
        _models.clear()
        _models[folder, "w"] = Words(folder, shards, bases)
    return _models[folder, "w"]


def _pairs(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(predecessor, word) of every token as one number."""
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[np.cumsum(counts) - counts] = START
    return before << np.uint64(32) | ids


def discounts(n: list[int]) -> list[float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more, from how many keys have counts 1 to 4; for degenerate counts plain halves."""
    n1, n2, n3, n4 = (max(0, x) for x in n)
    if not (n1 and n2 and n3):
        return [0.5, 0.5, 0.5]
    y = n1 / (n1 + 2 * n2)
    found = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return [min(max(d, 0.05), k - 0.05) for d, k in zip(found, (1, 2, 3), strict=True)]


def discount(counts: np.ndarray, d: list[float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(counts, 3).astype(np.int64)]


def fit(docs: DataFrame) -> dict:
    """Counts ``docs`` (text) and writes the model; returns what workers need to open it: folder, shards and a few sums.

    A null or empty text is one end token. Without any row the model knows no word: every token has probability 1.
    """
    spark = docs.sparkSession
    folder = local_path(shared_dir(spark))
    shards = partitions(spark)

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, n in summed(np.unique(tokens(texts)[0], return_counts=True) for _, texts in text_groups(batches, GROUP)):
            yield pa.RecordBatch.from_arrays([pa.array(shard_of(keys, shards), pa.int64()), pa.array(keys.view(np.int64) ^ np.int64(-(1 << 63))), pa.array(n, pa.int64())], names=["shard", "key", "n"])

    def write_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, keys, n in by_shard(batches):
            save(f"{folder}/word_keys_{shard}.npy", keys)
            save(f"{folder}/word_counts_{shard}.npy", n)
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([len(n)], pa.int64()), pa.array([int(n.sum())], pa.int64())], names=["shard", "size", "total"])

    def by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Rows sorted by shard and key, gathered shard by shard, the counts of one key added; keys are stored with the sign bit turned, for Spark's signed order."""
        held, last = [], None
        for batch in batches:
            shard = batch.column("shard").to_numpy()
            cuts = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a < b:
                    if held and shard[a] != last:
                        yield last, *joined(held)
                        held = []
                    last = int(shard[a])
                    held.append((batch.column("key").to_numpy()[a:b], batch.column("n").to_numpy()[a:b]))
        if held:
            yield last, *joined(held)

    def joined(held: list) -> tuple[np.ndarray, np.ndarray]:
        keys, n = (np.concatenate(x) for x in zip(*held, strict=True))
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        return (keys[first] ^ np.int64(-(1 << 63))).view(np.uint64), np.add.reduceat(n, first)

    def spread(rows: DataFrame) -> DataFrame:
        """Each shard whole in the task of its number, sorted. (A groupBy here would deal the rows anew, and tear shards apart.)"""
        return rows.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard", "key")

    text = docs.select("text")
    written = spread(text.mapInArrow(count_words, "shard long, key long, n long")).mapInArrow(write_words, "shard long, size long, total long").collect()  # a row for each shard
    sizes = {r.shard: r.size for r in written}
    bases = [sum(sizes.get(j, 0) for j in range(k)) for k in range(shards)]
    vocabulary, total = sum(sizes.values()), sum(r.total for r in written)
    if vocabulary >= UNKNOWN:
        raise ValueError("more than 2^32 distinct words")
    model = {"folder": folder, "shards": shards, "bases": bases, "vocabulary": vocabulary, "total": total}

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(folder, shards, bases)

        def of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            hashed, counts = tokens(texts)
            return np.unique(_pairs(words.ids(hashed), counts), return_counts=True)

        for pairs, n in summed(of(texts) for _, texts in text_groups(batches, GROUP)):
            yield pa.RecordBatch.from_arrays([pa.array(pair_shard(pairs, shards)), pa.array(pairs.view(np.int64) ^ np.int64(-(1 << 63))), pa.array(n, pa.int64())], names=["shard", "key", "n"])

    def write_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Writes the shards; passes on, for each word id, its pairs as predecessor (sum, and how many have count 1, 2, 3 or more) and as successor."""
        for shard, pairs, n in by_shard(batches):
            save(f"{folder}/pair_keys_{shard}.npy", pairs)
            save(f"{folder}/pair_counts_{shard}.npy", n.astype(np.uint16 if n.max() < 1 << 16 else np.uint32 if n.max() < 1 << 32 else np.uint64))
            first, inverse = np.unique(pairs >> np.uint64(32), return_inverse=True)
            sums = [np.bincount(inverse, weights=w).astype(np.int64) for w in (n, n == 1, n == 2, n >= 3)]
            second, prior = np.unique(pairs & np.uint64(0xFFFFFFFF), return_counts=True)
            exact = [int((n == k).sum()) for k in (1, 2, 3, 4)]
            zeros = np.zeros(len(second), dtype=np.int64)
            ids = np.concatenate((first, second, [START + 1] * 4)).astype(np.int64)  # the last four: how many pairs have counts 1 to 4
            columns = [np.concatenate((s, zeros, [0] * 4)) for s in sums] + [np.concatenate((np.zeros(len(first), dtype=np.int64), prior, [0] * 4))]
            level = np.concatenate((np.zeros(len(first) + len(second), dtype=np.int64), [1, 2, 3, 4]))
            columns.append(np.concatenate((np.zeros(len(first) + len(second), dtype=np.int64), exact)))
            names = ["id", "level", "c", "n1", "n2", "n3", "prior", "exact"]
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (ids, level, *columns)], names=names)

    schema = "id long, level long, c long, n1 long, n2 long, n3 long, prior long, exact long"
    measures = ["c", "n1", "n2", "n3", "prior", "exact"]
    sums = spread(text.mapInArrow(count_pairs, "shard long, key long, n long")).mapInArrow(write_pairs, schema)
    per_word = sums.groupBy("id", "level").agg(*[F.sum(c).alias(c) for c in measures])
    span = max(1, -(-vocabulary // shards))
    model["span"] = span

    def write_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Arrays by id for each range of ids; passes on counts of counts."""
        tally: dict = {}
        out: dict[int, list] = {}
        for batch in batches:
            rows = {c: batch.column(c).to_numpy() for c in ("id", "level", *measures)}
            for i in np.flatnonzero(rows["level"]):
                tally[1, int(rows["level"][i])] = tally.get((1, int(rows["level"][i])), 0) + int(rows["exact"][i])
            plain = rows["level"] == 0
            for k in (1, 2, 3, 4):
                tally[2, k] = tally.get((2, k), 0) + int((rows["prior"][plain] == k).sum())
            tally[2, 5] = tally.get((2, 5), 0) + int((rows["prior"][plain] >= 3).sum())
            tally[2, 6] = tally.get((2, 6), 0) + int(rows["prior"][plain].sum())
            block = rows["id"] // span
            block[rows["id"] == START] = shards
            for b in np.unique(block[plain]):
                own = plain & (block == b)
                out.setdefault(int(b), []).append(np.stack([rows[c][own] for c in ("id", *measures[:5])]))
        for b, found in out.items():
            found = np.concatenate(found, axis=1)
            array = np.zeros((5, span if b < shards else 1), dtype=np.int64)
            array[:, found[0] - (b * span if b < shards else START)] = found[1:]
            array = array.astype(np.uint32 if array.max() < 1 << 32 else np.uint64)
            save(f"{folder}/sums_{b}.npy", array)
        keys = list(tally)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array([tally[k] for k in keys], pa.int64())], names=["kind", "level", "n"])

    block = F.when(F.col("id") == START, shards).otherwise(F.floor(F.col("id") / span))
    tally = per_word.withColumn("block", block.cast("int")).repartitionById(shards, F.col("block")).drop("block").mapInArrow(write_sums, "kind long, level long, n long")
    found = {(r.kind, r.level): r.n for r in tally.groupBy("kind", "level").agg(F.sum("n").alias("n")).collect()}  # at most ten rows
    model["d2"] = discounts([found.get((1, k), 0) for k in (1, 2, 3, 4)])
    model["d1"] = discounts([found.get((2, k), 0) for k in (1, 2, 3, 4)])
    model["types"] = found.get((2, 6), 0)  # distinct bigrams
    mass = sum(d * found.get((2, k), 0) for d, k in zip(model["d1"], (1, 2, 5), strict=True))
    model["unknown"] = mass / max(1, model["types"]) / (vocabulary + 1)
    return model


class Scorer:
    """The model's mapped arrays, and log10 probabilities of tokens."""

    def __init__(self, model: dict):
        self.m = model
        folder, shards = model["folder"], model["shards"]
        self.words = Words(folder, shards, model["bases"])
        self.word_counts = Shards(f"{folder}/word_counts_{{}}.npy", shards)
        self.pairs = Lookup(folder, "pair", shards)
        self.pair_counts = Shards(f"{folder}/pair_counts_{{}}.npy", shards)
        self.sums = Shards(f"{folder}/sums_{{}}.npy", shards + 1)

    def sums_of(self, ids: np.ndarray) -> np.ndarray:
        """Sum as predecessor, its counts of 1, 2, 3 or more, and predecessors, for sorted distinct ids; zero for unknown."""
        out = np.zeros((5, len(ids)))
        block = np.where(ids == START, len(self.sums) - 1, np.minimum(ids // np.uint64(self.m["span"]), len(self.sums))).astype(np.int64)
        cuts = np.searchsorted(ids, [k * self.m["span"] for k in range(len(self.sums))])
        for k, (a, b) in enumerate(zip(cuts, [*cuts[1:], cuts[-1]], strict=True)):
            if a < b and k < len(self.sums) - 1 and self.sums[k] is not None:
                own = np.arange(a, b)[block[a:b] == k]
                out[:, own] = self.sums[k][:, (ids[own] - np.uint64(k * self.m["span"])).astype(np.int64)]
        if len(ids) and ids[-1] == START and self.sums[-1] is not None:
            out[:, -1] = self.sums[-1][:, 0]
        return out

    def counts_of(self, ids: np.ndarray) -> np.ndarray:
        """Training count of each sorted distinct id."""
        out = np.zeros(len(ids))
        cuts = np.searchsorted(ids, [*self.m["bases"], self.m["vocabulary"]])
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            if a < b:
                out[a:b] = self.word_counts[k][(ids[a:b] - np.uint64(self.m["bases"][k])).astype(np.int64)]
        return out

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """For each text: tokens, known tokens, base score and the model's log10 probability."""
        m = self.m
        hashed, counts = tokens(texts)
        ids = self.words.ids(hashed)
        keys, back = np.unique(_pairs(ids, counts), return_inverse=True)
        before, word = keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF)
        count = np.zeros(len(keys))
        for k, own, at in self.pairs.find(keys, pair_shard(keys, self.pairs.shards)):
            count[own] = self.pair_counts[k][at]
        distinct, at_word = np.unique(word, return_inverse=True)
        prior = self.sums_of(distinct)[4]
        lower = (prior - discount(prior, m["d1"])) / max(1, m["types"]) + m["unknown"] if m["vocabulary"] else np.ones(len(distinct))
        raw = self.counts_of(distinct)
        firsts, at_first = np.unique(before, return_inverse=True)
        c, n1, n2, n3, _ = self.sums_of(firsts)
        d = m["d2"]
        left = np.where(c > 0, (d[0] * n1 + d[1] * n2 + d[2] * n3) / np.maximum(c, 1), 1.0)
        full = (count - discount(count, d)) / np.maximum(c, 1)[at_first] + left[at_first] * lower[at_word]
        base = np.log10((raw + 0.1) / (m["total"] + 0.1 * (m["vocabulary"] + 1)))[at_word][back]
        ends = np.cumsum(counts) - counts
        known = np.add.reduceat((raw > 0)[at_word][back].astype(np.int64), ends)
        return counts, known, np.add.reduceat(base, ends), np.add.reduceat(np.log10(full)[back], ends)


def _open(path: str) -> np.ndarray | None:
    """An array mapped from its file, without a handle that stays open: a model may have more files than a process may have handles. None where there is no file."""
    if not os.path.exists(path):
        return None
    with open(path, "rb") as f:
        np.lib.format.read_magic(f)
        shape, _, kind = np.lib.format.read_array_header_1_0(f)
        begin, size = f.tell(), int(np.prod(shape)) * kind.itemsize
        if not size:
            return np.zeros(shape, dtype=kind)
        # Without trackfd (Python 3.13 on), a map would keep a handle of its own; older ones read the file instead.
        if sys.version_info >= (3, 13):
            raw = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, trackfd=False)
            return np.frombuffer(raw, dtype=kind, count=size // kind.itemsize, offset=begin).reshape(shape)
    return np.load(path)


class Shards:
    """Arrays of a model by number, each opened when it is first asked for."""

    def __init__(self, pattern: str, n: int):
        self.pattern, self.held = pattern, [False] * n

    def __len__(self) -> int:
        return len(self.held)

    def __getitem__(self, k: int) -> np.ndarray | None:
        if self.held[k] is False:
            self.held[k] = _open(self.pattern.format(k % len(self.held)))
        return self.held[k]


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score, perplexity of each whole text.

    A null or empty text is one end token. Null and repeated doc_ids are rows like others, extra columns are ignored, an
    empty table gives no row, and a text is scored whole, however long.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model["folder"] not in _models:
            _models.clear()
            _models[model["folder"]] = Scorer(model)
        for part, texts in text_groups(batches, GROUP):
            n, known, base, full = _models[model["folder"]].score(texts)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), pa.array(known), pa.array(base), pa.array(full)], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def op10_lm_score(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    held = F.coalesce(fold("doc_id", 10) == 0, F.lit(False))
    model = fit(docs.filter(~held))
    return score(docs, model).select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model["total"]).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")
