"""Near-duplicate documents by SimHash fingerprints and covering locality-sensitive hashing.

Each document has a 64-bit fingerprint of its 4-word shingles. Two fingerprints link when they differ in at most
``radius`` bits. With one label of radius + 1 bits for each bit position, the 2^(radius+1) - 1 masks "positions whose
label has odd parity with v" cover every pair: radius differing positions leave some v that is orthogonal to all of
their labels, and under that mask the pair agrees. So each linked pair meets in one of 31 tables, with no miss.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import partitions, stash, text_groups

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Fingerprints of one bucket that one task compares with each other; larger buckets are cut into blocks of this size.
BLOCK = 2048


def fingerprint(text: bytes) -> int:
    """SimHash of a text: words lower-cased in A-Z, shingles with repeats, bit set where over half of the hashes have it."""
    found = text.lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found])
    n = max(1, len(found) - SHINGLE + 1)
    begins = np.concatenate(([0], ends[: n - 1])).tolist()
    stops = (ends[min(SHINGLE, len(found)) - 1 :] - 1).tolist()
    hashed = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(begins, stops, strict=True)], dtype="<u8")
    return int(np.packbits(2 * _ones(hashed) > n, bitorder="little").view("<u8")[0])


def _ones(hashed: np.ndarray, step: int = 8192) -> np.ndarray:
    """How many of the hashes have each of the 64 bits."""
    total = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashed), step):
        total += np.unpackbits(hashed[k : k + step].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return total


def fingerprints(docs: DataFrame, *longs: str) -> DataFrame:
    """doc_id, ``longs`` (further columns of that type), fp (the fingerprint as a signed long) of every document; a null or wordless text has zero."""
    names = ["doc_id", *longs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_groups(batches):
            fps = np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(fps)], names=[*names, "fp"])

    return docs.select(F.col("doc_id").cast("long"), *longs, "text").mapInArrow(run, ", ".join(f"{c} long" for c in [*names, "fp"]))


def masks(radius: int = RADIUS) -> list[int]:
    """The covering masks over 64 bits: labels go round the non-zero values, so that each mask has about half the bits."""
    top = 1 << (radius + 1)
    labels = [1 + k * 11 % (top - 1) for k in range(64)]
    return [sum(1 << k for k in range(64) if (labels[k] & v).bit_count() & 1) for v in range(1, top)]


def _forest(fps: np.ndarray, nodes: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges (node, root) that connect what the links among these fingerprints connect, at most one for each node."""
    label = np.arange(len(fps))
    for k in range(len(fps) - 1):
        near = label[k + 1 :][np.bitwise_count(fps[k + 1 :] ^ fps[k]) <= radius]
        for other in np.unique(near[near != label[k]]).tolist():
            low, high = sorted((int(label[k]), other))
            label[label == high] = low
    low = np.full(len(fps), np.iinfo(np.int64).max)
    np.minimum.at(low, label, nodes)
    return [(a, b) for a, b in zip(nodes.tolist(), low[label].tolist(), strict=True) if a != b]


def joined(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join by shuffles of both sides, whatever Spark takes their sizes to be.

    It sizes them by compressed files, and an explosion to 31 rows like a single one, so it would broadcast tables far beyond its own limit.
    """
    return left.join(right.hint("merge"), on, how)


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """a, b (ids of nodes, b < a): edges that connect all fingerprints within the radius, as a forest for each bucket.

    ``nodes`` holds node, fp with distinct fp. A bucket of more than BLOCK fingerprints is cut into blocks, and each
    pair of blocks is a unit of work of its own, so that no bucket meets whole in one task and no pair list is made.
    """
    tables = F.array(*[F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("key")) for k, m in enumerate(masks(radius))])
    keyed = nodes.select("node", "fp", F.explode(tables).alias("x")).select("node", "fp", "x.t", "x.key")
    sizes = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK)).cast("int")
    block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    met = joined(keyed, sizes, ["t", "key"]).withColumn("blocks", blocks).withColumn("block", block)
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("t", "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            unit = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("t", "key", "i", "j")])
            cuts = [0, *(np.flatnonzero((unit[:, 1:] != unit[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                this = tuple(unit[:, a].tolist())
                if last is not None and this != last:
                    yield from done(held)
                    held = []
                last = this
                held.append(batch.slice(a, b - a))
        yield from done(held)

    def done(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held and sum(x.num_rows for x in held) > 1:
            t = pa.Table.from_batches(held)
            fps, ids = t["fp"].to_numpy().view(np.uint64), t["node"].to_numpy()
            edges = _forest(fps, ids, radius)
            if edges:
                a, b = zip(*edges, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    spread = met.repartition(partitions(nodes.sparkSession), "t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j")
    return spread.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) of every node with an edge, by alternating large and small stars.

    Each round is a few keyed joins and aggregates; a node's neighbours are never collected. Each round's edges are
    written to the shared folder; only a count and a checksum reach the driver. The least neighbours are written before
    they are joined, so that both sides of a join are plain exchanges, of which Spark splits a hub's part among tasks.
    """
    now, before = stash(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct()), None
    while True:
        sign = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
        if sign.n == 0 or (sign.n, sign.s) == before:
            break
        before = (sign.n, sign.s)
        both = now.union(now.select("v", "u"))
        low = stash(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = stash(joined(both.filter("v > u"), low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct())
        low = stash(large.groupBy("u").agg(F.min("v").alias("m")))
        small = joined(large, low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        now = stash(small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).filter("u > v").distinct())
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id of every document: the smallest doc_id that links of near fingerprints reach.

    Exact copies share a fingerprint, so only distinct fingerprints enter the tables, as nodes of their own: those of rows
    without a doc_id link others too, and such rows get their component's smallest doc_id, null where it has none. Null or
    empty texts all have fingerprint zero and form a group with whatever is near zero. Repeated rows of a doc_id stay,
    each with its own fingerprint, and link these. Extra columns of ``docs`` are ignored. An empty table gives an empty result.
    """
    fps = stash(fingerprints(docs))
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    reach = components(links(nodes.select("fp", F.col("fp").alias("node")), radius))
    rooted = stash(joined(nodes, reach.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("root")))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    rooted = joined(rooted, named, "root").select("fp", "component_id")
    if fps.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").limit(1).count():
        rooted = _merged(fps, stash(rooted))
    return joined(fps, rooted, "fp", "left").select("doc_id", "fp", "component_id")


def _merged(fps: DataFrame, rooted: DataFrame) -> DataFrame:
    """Components joined further where rows of one doc_id have different fingerprints."""
    seen = joined(fps.filter("doc_id is not null"), rooted, "fp").select("doc_id", "component_id").distinct()
    low = seen.groupBy("doc_id").agg(F.min("component_id").alias("low"))
    further = components(joined(seen, low, "doc_id").filter("component_id > low").select(F.col("component_id").alias("a"), F.col("low").alias("b")))
    return joined(rooted, further.withColumnRenamed("node", "component_id"), "component_id", "left").select("fp", F.coalesce("component", "component_id").alias("component_id"))


def keep_first(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The documents (all columns), one row of each group of near fingerprints: that of the smallest doc_id (null: last), then text hash.

    Groups are of fingerprints alone: rows with a null doc_id are members like others, and texts that only share a
    doc_id are different documents. Where several rows have the chosen doc_id and text, one of them stays.
    """
    fps = stash(fingerprints(docs.select("doc_id", "text", F.xxhash64("text").alias("h")), "h"))
    reach = components(links(fps.select("fp", F.col("fp").alias("node")).distinct(), radius))
    rows = joined(fps.groupBy("fp", "doc_id", "h").agg(F.count(F.lit(1)).alias("n")), reach.withColumnRenamed("node", "fp"), "fp", "left")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "h", "n"))
    first = stash(rows.groupBy(F.coalesce("component", "fp").alias("component")).agg(least.alias("f")).select(F.col("f.doc_id").alias("_id"), F.col("f.h").alias("_text"), "f.n"))
    # The row travels whole, so that its columns may have any names.
    hashed = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("h"))
    chosen = lambda only: hashed.join(first.filter(only).drop("n"), F.col("id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_text")), "left_semi")
    once = chosen("n = 1")
    if first.filter("n > 1").limit(1).count():
        once = once.union(chosen("n > 1").dropDuplicates(["id", "h"]))
    return once.select("row.*")


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    from tidewater.llm.common import table

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
