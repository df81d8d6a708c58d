"""Quality classifier: a byte-level convolutional network in numpy.

A text's bytes are cut into overlapping chunks, so that every filter window lies in some chunk. Bytes become learned
vectors; learned filters slide over each chunk and are max-pooled. Means and maxima over all chunks enter one logistic unit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import fold, table, text_groups
from tidewater.llm.rules import labelled_sample

WIDTH, STRIDE, CHUNK = 8, 2, 512
STEP = CHUNK - WIDTH + STRIDE
EMBED, FILTERS = 8, 16
#: Labelled documents of each quality to learn from, and the longest text among them.
TRAIN_DOCS, TRAIN_BYTES, EPOCHS, SEED = 800, 32 << 10, 12, 7
THRESHOLD = 0.3


def chunks(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All chunks of the texts (rows of CHUNK bytes, zero after a text's end) and chunks in each text (one at least)."""
    counts = np.array([1 + max(0, -(-(len(t) - CHUNK) // STEP)) for t in texts], dtype=np.int64)
    out = np.zeros((counts.sum(), CHUNK), dtype=np.uint8)
    row = 0
    for t, n in zip(texts, counts.tolist(), strict=True):
        raw = np.frombuffer(t, np.uint8)
        for k in range(n):
            own = raw[k * STEP : k * STEP + CHUNK]
            out[row, : len(own)] = own
            row += 1
    return out, counts


class Network:
    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.embed = rng.normal(0, 0.3, (256, EMBED)).astype(np.float32)
        self.filters = rng.normal(0, 0.15, (WIDTH * EMBED, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, dtype=np.float32)
        self.dense = rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32)
        self.out = np.zeros(1, dtype=np.float32)
        self.prior = 0.0

    def windows(self, rows: np.ndarray) -> np.ndarray:
        """Each chunk's filter windows as rows of WIDTH * EMBED numbers."""
        x = self.embed[rows].reshape(len(rows), CHUNK * EMBED)
        view = np.lib.stride_tricks.sliding_window_view(x, WIDTH * EMBED, axis=1)[:, :: STRIDE * EMBED]
        return np.ascontiguousarray(view)

    def pooled(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of each filter in each chunk, and where."""
        most, place = [], []
        for k in range(0, len(rows), 64):
            w = self.windows(rows[k : k + 64])
            y = (w.reshape(-1, WIDTH * EMBED) @ self.filters).reshape(*w.shape[:2], FILTERS)
            most.append(y.max(axis=1))
            place.append(y.argmax(axis=1))
        return np.maximum(np.concatenate(most) + self.bias, 0), np.concatenate(place)

    def largest(self, rows: np.ndarray) -> np.ndarray:
        return np.concatenate([np.maximum((self.windows(rows[k : k + 64]).reshape(-1, WIDTH * EMBED) @ self.filters).reshape(len(rows[k : k + 64]), -1, FILTERS).max(axis=1) + self.bias, 0) for k in range(0, len(rows), 64)])

    def combine(self, pooled: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logit of each text, and the vectors (means, then maxima, over its chunks) that gave it."""
        first = np.cumsum(counts) - counts
        v = np.concatenate((np.add.reduceat(pooled, first) / counts[:, None], np.maximum.reduceat(pooled, first)), axis=1)
        return v @ self.dense + self.out[0], v

    def score(self, texts: list[bytes]) -> np.ndarray:
        rows, counts = chunks(texts)
        logit, _ = self.combine(self.largest(rows), counts)
        return 1 / (1 + np.exp(-np.clip(logit + self.prior, -40, 40).astype(np.float64)))


WEIGHTS = ("embed", "filters", "bias", "dense", "out")


def gradient(net: Network, rows: np.ndarray, counts: np.ndarray, quality: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Gradient of the weighted logistic loss of texts (chunks in ``rows``, ``counts`` of them in each). A maximum that several chunks share is led to all of them in equal parts."""
    pooled, place = net.pooled(rows)
    logit, v = net.combine(pooled, counts)
    error = ((1 / (1 + np.exp(-logit)) - quality) * weight).astype(net.dense.dtype)
    first, doc = np.cumsum(counts) - counts, np.repeat(np.arange(len(counts)), counts)
    dv = error[:, None] * net.dense
    highest = np.maximum.reduceat(pooled, first)[doc] == pooled
    shared = np.maximum(np.add.reduceat(highest.astype(net.dense.dtype), first)[doc], 1)
    d = (dv[doc, :FILTERS] / counts[doc][:, None] + dv[doc, FILTERS:] * highest / shared) * (pooled > 0)
    window = rows[np.arange(len(rows))[:, None, None], (place * STRIDE)[:, :, None] + np.arange(WIDTH)]
    x = net.embed[window].reshape(len(rows), FILTERS, -1)
    grad = {"filters": np.einsum("cf,cfk->kf", d, x), "bias": d.sum(axis=0), "dense": error @ v, "out": error.sum(keepdims=True), "embed": np.zeros_like(net.embed)}
    np.add.at(grad["embed"], window.reshape(-1), (d[:, :, None] * net.filters.T).reshape(-1, EMBED))
    return grad


def train(texts: list[bytes], quality: np.ndarray, positive: float, epochs: int = EPOCHS) -> Network:
    """Adam on the logistic loss; texts of both classes count alike, then the share of label 1 shifts the logit."""
    net, rng = Network(), np.random.default_rng(SEED)
    weight = np.where(quality == 1, 0.5 / max((quality == 1).mean(), 1e-9), 0.5 / max((quality == 0).mean(), 1e-9))
    held = [chunks([t])[0] for t in texts]
    moment = {n: [np.zeros_like(getattr(net, n)), np.zeros_like(getattr(net, n))] for n in WEIGHTS}
    step = 0
    for epoch in range(epochs):
        for batch in np.array_split(rng.permutation(len(texts)), max(1, len(texts) // 32)):
            counts = np.array([len(held[k]) for k in batch])
            grad = gradient(net, np.concatenate([held[k] for k in batch]), counts, quality[batch], weight[batch] / len(batch))
            grad["dense"] = grad["dense"] + 1e-4 * net.dense
            step += 1
            for n in WEIGHTS:
                a, b = moment[n]
                a += 0.1 * (grad[n] - a)
                b += 0.01 * (grad[n] ** 2 - b)
                change = 0.01 * (0.3 if epoch >= epochs - 3 else 1) * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-7)
                setattr(net, n, (getattr(net, n) - change).astype(np.float32))
    net.prior = float(np.log(max(positive, 1e-3) / max(1 - positive, 1e-3)))
    return net


def fit(docs: DataFrame, labels: DataFrame) -> Network:
    """The network from a bounded sample of ``labels`` (doc_id, quality); with labels of one class only, or none, an untrained
    network whose scores are the share of label 1 (one half without labels)."""
    share = labels.filter(F.col("quality").isin(0, 1)).agg(F.avg("quality").alias("p")).first().p
    rows = labelled_sample(docs, labels, TRAIN_DOCS, TRAIN_BYTES).collect()  # bounded by TRAIN_DOCS and TRAIN_BYTES
    rows.sort(key=lambda r: (r.doc_id, r.text))
    quality = np.array([r.quality for r in rows])
    if len(set(quality.tolist())) < 2:
        net = Network()
        net.dense[:] = 0
        net.prior = float(np.log(max(share, 1e-3) / max(1 - share, 1e-3))) if share is not None else 0.0
        return net
    return train([r.text.encode() for r in rows], quality, share)


def score(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, score of each whole text. Null counts as empty, scored as a chunk of zero bytes; repeated rows and null
    doc_ids stay; extra columns are ignored; an empty table gives no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_groups(batches, 2 << 20):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(net.score(texts), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def keep(docs: DataFrame, net: Network, threshold: float = THRESHOLD) -> DataFrame:
    """The documents (all columns, whatever their names) with at least ``threshold``, in one pass over the rows; null ids and repeated rows are judged each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_groups(batches, 2 << 20):
            yield part.filter(pa.array(net.score(texts) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def training_labels(labels: DataFrame) -> DataFrame:
    """Rows whose crc32(doc_id as text) mod 5 is not 0."""
    return labels.filter(fold("doc_id", 5) != 0)


def op3_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = fit(docs, training_labels(table(spark, sf_dir, "labels")))
    held = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    return score(docs, net).select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
