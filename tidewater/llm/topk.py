"""Exact top-k search by inner product, in the three phases of the uniform threshold.

Vectors are dealt into sites. Each site has one score list for each part of the dimensions: the inner products over
that part alone. First every site gives, for each query, the best entries of each of its lists with their exact scores;
the k-th best of all that is gathered is a cutoff no larger than the k-th best score. The cutoffs then travel with the
queries: what scores at least the cutoff has at least the cutoff's equal share in one of its parts, so each site
collects the entries that reach the share in some list, and nothing else can belong to the result. Last, the scores of
the collected entries are resolved exactly; those below the cutoff go, and a site hands on k of each query at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.llm.common import partitions, stash, table

#: Factor of the components before they are floored, results of each query, and lists (parts of the dimensions) of a site.
SCALE, K, PARTS = 1024, 10, 2
#: Bytes of the vectors of one site (as doubles), and scores of one list that a task holds at once.
SITE_BYTES, SCORES = 64 << 20, 1 << 21
#: Whole numbers below this are exact as doubles.
EXACT = 1 << 53

ROW = "query long, query_id long, vec_id long, score long"


def whole_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """row, vec_id, v: vectors whose components are all finite numbers, as floor(scale * component). ``row`` tells rows of one vec_id apart."""
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    return stash(vectors.filter(F.col("embedding").isNotNull() & finite).select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")))


def _matrix(held: list[pa.RecordBatch], dims: int, kind: type) -> tuple[np.ndarray, pa.Table]:
    rows = pa.Table.from_batches(held)
    out = np.zeros((rows.num_rows, dims), dtype=kind)
    v = rows["v"].combine_chunks()
    lengths = v.value_lengths().to_numpy(zero_copy_only=False)
    out[np.arange(dims) < lengths[:, None]] = v.flatten().to_numpy(zero_copy_only=False)
    return out, rows


def _scan(sites: DataFrame, dims: int, kind: type, k: int, parts: int) -> DataFrame:
    """What each site hands on for each of its queries: with a cutoff the entries that reach it, else the best of its lists; k at most."""
    cuts = [dims * p // parts for p in range(parts + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        site, vectors, held = None, None, []
        for batch in batches:
            code = batch.column("site").to_numpy() * 2 + batch.column("is_query").to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if code[a] // 2 != site:
                    site, vectors, held = code[a] // 2, None, []
                if code[a] % 2 == 0:
                    held.append(batch.slice(a, b - a))
                elif held:
                    vectors = vectors or _matrix(held, dims, kind)
                    step = max(1, SCORES // len(vectors[0]))
                    for at in range(a, b, step):
                        yield answer(*vectors, batch.slice(at, min(step, b - at)))

    def answer(v: np.ndarray, rows: pa.Table, asked: pa.RecordBatch) -> pa.RecordBatch:
        q, _ = _matrix([asked], dims, kind)
        lists = [q[:, a:b] @ v[:, a:b].T for a, b in zip(cuts, cuts[1:], strict=False)]
        cutoff = asked.column("cutoff")
        low = cutoff.fill_null(0).to_numpy(zero_copy_only=False)[:, None]
        open_ = cutoff.is_null().to_numpy(zero_copy_only=False)[:, None]
        if asked.column("first").to_numpy(zero_copy_only=False).all():
            chosen = np.zeros(lists[0].shape, dtype=bool)
            most = min(k + 1, len(v))  # one more, as the query's own row may be among them
            for scores in lists:
                np.put_along_axis(chosen, np.argpartition(scores, len(v) - most, axis=1)[:, len(v) - most :], True, axis=1)
        else:
            chosen = np.repeat(open_, len(v), axis=1)
            for scores in lists:
                chosen |= parts * scores >= low
        names, own = rows["row"].to_numpy(), asked.column("row").to_numpy()
        chosen &= names != own[:, None]
        which, entry = np.nonzero(chosen)
        score = sum(scores[which, entry] for scores in lists).astype(np.int64) if parts else np.zeros(0, np.int64)
        keep = open_[which, 0] | (score >= low[which, 0])
        which, entry, score = which[keep], entry[keep], score[keep]
        ids = rows["vec_id"].combine_chunks()
        unnamed, named = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False)
        order = np.lexsort((named[entry], unnamed[entry], -score, which))
        which, entry, score = which[order], entry[order], score[order]
        begin = np.searchsorted(which, np.arange(asked.num_rows))
        best = np.arange(len(which)) - begin[which] < k
        which, entry, score = which[best], entry[best], score[best]
        return pa.RecordBatch.from_arrays([pa.array(own[which], pa.int64()), asked.column("vec_id").take(pa.array(which)), ids.take(pa.array(entry)), pa.array(score)], names=["query", "query_id", "vec_id", "score"])

    return sites.mapInArrow(run, ROW)


def _sites(rows: DataFrame, asked: DataFrame, sites: int) -> DataFrame:
    """Every site's vectors, then all queries."""
    of = F.pmod(F.col("row"), F.lit(sites)).cast("int")
    none = F.lit(None).cast("long")
    vectors = rows.select(of.alias("site"), F.lit(False).alias("is_query"), "row", "vec_id", "v", none.alias("cutoff"), F.lit(False).alias("first"))
    queries = asked.select(F.explode(F.sequence(F.lit(0), F.lit(sites - 1))).alias("site"), F.lit(True).alias("is_query"), "row", "vec_id", "v", "cutoff", "first")
    return vectors.unionByName(queries).repartitionById(sites, "site").sortWithinPartitions("site", "is_query")


def top_k(rows: DataFrame, is_query, k: int = K, parts: int = PARTS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: of each row of :func:`whole_vectors` for which ``is_query`` holds, the k other rows of largest inner product.

    Ties go to the smaller vec_id, a null vec_id last. Rows are told apart by ``row``: of repeated ids each is a query and an entry of its
    own, and only a query's own row is left out. A shorter vector counts as padded by zeros. Scores are exact as long as
    they fit in 64 bits. Fewer than k other rows: all of them. An empty table, or no query: an empty result.
    """
    size = F.max(F.size("v")).alias("dims")
    largest = F.max(F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v")))).alias("largest")
    of = rows.agg(F.count(F.lit(1)).alias("n"), size, largest).first()
    dims = max(of.dims or 0, parts)
    kind = np.float64 if parts * dims * (of.largest or 0) ** 2 < EXACT else np.int64
    sites = max(partitions(rows.sparkSession), -(-of.n * dims * 8 // SITE_BYTES))
    asked = rows.filter(is_query)
    by_score = Window.partitionBy("query").orderBy(F.col("score").desc())
    lists = _scan(_sites(rows, asked.withColumns({"cutoff": F.lit(None).cast("long"), "first": F.lit(True)}), sites), dims, kind, k, parts)
    gathered = lists.select("query", "score").withColumn("place", F.row_number().over(by_score)).filter(F.col("place") <= k)
    cutoffs = stash(gathered.groupBy("query").agg(F.min("score").alias("cutoff"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == k).select(F.col("query").alias("row"), "cutoff"))
    found = _scan(_sites(rows, asked.join(cutoffs, "row", "left").withColumn("first", F.lit(False)), sites), dims, kind, k, parts)
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op12_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(whole_vectors(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 100 == 0)


ORACLE = """WITH v AS (SELECT vec_id, list_transform(embedding, x -> floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, x -> x IS NOT NULL AND isfinite(x))) = len(embedding))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)) WHERE rank <= 10"""
