"""Packing token sequences: shortest-pack-first over the length histogram, then patterns joined to pieces by rank.

Documents are cut into pieces of at most ``capacity`` ids. Only the histogram of piece lengths (at most ``capacity``
rows) reaches the driver. Lengths are placed longest first into the open pattern with the most room; a pattern is a
range of sequence ids filled alike, so each placement is one interval of (length, rank) and the plan stays as small as
the histogram, however many documents there are. Pieces then find their place by length and rank.
"""

from __future__ import annotations

import heapq
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import partitions, stash, table, text_slices

CAPACITY, END_ID = 4096, 2
#: Pieces of words in each of the two generations whose ids a task remembers.
CACHE_PIECES = 200_000
#: Pieces encoded as one text.
TOGETHER = 5_000
#: Text that a worker cuts into pieces at a time.
GROUP = 1 << 20
# What the tokenizer's own rule cuts off from runs of letters, and characters that no normal form changes and whose
# lower case is one character wherever they stand (Latin, Cyrillic, Chinese and Japanese letters, common marks). Texts with others go word by word.
SIGNS = r"'(?:s|t|re|ve|m|ll|d)|\p{N}|[^\x09-\x0D\x20\p{L}\p{N}]+"
OTHER = r"[^\x09-\x0D -~\x{A1}-\x{AC}\x{AE}-\x{12F}\x{131}-\x{148}\x{14A}-\x{17E}\x{400}-\x{45F}\x{2010}-\x{2027}\x{20AC}\x{3041}-\x{3094}\x{30A1}-\x{30FA}\x{4E00}-\x{9FA5}]"

_tokenizers: dict = {}


def tokenizer(path: str):
    """The tokenizer of a file, loaded once in each Python worker."""
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
    return _tokenizers[path]


def ids_of(tok, words: list[str]) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit integers."""
    return [np.array(e.ids, dtype="<u4").tobytes() for e in tok.encode_batch_fast(words, add_special_tokens=False)]


class PieceIds:
    """Ids of pieces (runs of letters, digits, runs of signs), remembered in two generations: a full one becomes the old one, pieces met again move to the new one."""

    def __init__(self, path: str, most: int = CACHE_PIECES):
        self.tok, self.most = tokenizer(path), most
        self.ends = np.array([piece.endswith("</w>") for piece, _ in sorted(self.tok.get_vocab().items(), key=lambda x: x[1])])
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def of(self, pieces: list[str]) -> list[bytes]:
        """Ids of each of these distinct pieces, as unsigned 32-bit integers."""
        known = [self.new.get(w) for w in pieces]
        absent = [k for k, ids in enumerate(known) if ids is None]
        if absent and len(self.new) + len(absent) > self.most:
            self.old, self.new = self.new, {}
        unknown = []
        for k in absent:
            ids = self.old.get(pieces[k])
            if ids is None:
                unknown.append(k)
            else:
                known[k] = self.new[pieces[k]] = ids
        for k in range(0, len(unknown), TOGETHER):
            some = unknown[k : k + TOGETHER]
            words = [pieces[j] for j in some]
            for j, w, ids in zip(some, words, self.encode(words), strict=True):
                known[j] = self.new[w] = ids
        return known

    def encode(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece, from one text of all of them: the last token of each piece is one that ends a word."""
        if not pieces:
            return []
        ids = np.array(self.tok.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)[0].ids, dtype="<u4")
        cuts = [0, *(4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()]
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)] if len(cuts) == len(pieces) + 1 else ids_of(self.tok, pieces)


def gathered(flat: np.ndarray, ends: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Items ``at`` of a list of arrays (joined in ``flat``, item k ending at ends[k]): joined, and their lengths."""
    begins = np.concatenate(([0], ends[:-1])).astype(np.int64)
    size = (ends - begins)[at]
    total = np.cumsum(size)
    place = np.arange(total[-1] if len(total) else 0) + np.repeat(begins[at] - (total - size), size)
    return flat[place], size


def document_ids(texts: pa.Array, path: str, table: PieceIds) -> list[np.ndarray]:
    """The ids of each text (null: none), as the whole text has them in the tokenizer of ``path``; ``table``: its ids of pieces."""
    texts = pc.fill_null(texts, "")
    special = "|".join(re.escape(t.content) for t in tokenizer(path).get_added_tokens_decoder().values())
    other = pc.match_substring_regex(texts, f"{OTHER}|{special}" if special else OTHER).to_numpy(zero_copy_only=False)
    plain = pc.if_else(pa.array(other), "", texts)
    cut = pc.utf8_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(plain), SIGNS, r" \0 "))
    coded = cut.flatten().dictionary_encode()
    pieces, at = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
    # A piece of white space only, where a text has no piece, is the empty string.
    ids = [b"" if not w else i for w, i in zip(pieces, table.of(pieces), strict=True)]
    flat, size = gathered(np.frombuffer(b"".join(ids), "<u4"), np.cumsum([len(i) // 4 for i in ids], dtype=np.int64), at)
    begins = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(pc.list_value_length(cut).to_numpy(zero_copy_only=False))))]
    out = [flat[a:b] for a, b in zip(begins.tolist(), begins[1:].tolist(), strict=False)]
    for k in np.flatnonzero(other).tolist():
        words = list(dict.fromkeys(split := texts[k].as_py().encode().split()))
        index = {w: n for n, w in enumerate(words)}
        each = ids_of(tokenizer(path), [w.decode() for w in words])
        out[k] = gathered(np.frombuffer(b"".join(each), "<u4"), np.cumsum([len(i) // 4 for i in each], dtype=np.int64), np.array([index[w] for w in split], dtype=np.int64))[0] if words else np.zeros(0, "<u4")
    return out


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, doc_tokens, ids (binary, unsigned 32-bit) for each piece of each document.

    The tokenizer of ``path`` must lower-case, cut by SIGNS and mark the last token of each such piece by ``</w>``, so that a
    text's ids are its pieces' ids. A null or empty text has only the end id. Repeated rows, null doc_ids included, give
    pieces of their own; extra columns are ignored; a very long text is cut alone; an empty table gives no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = PieceIds(path)
        for part in text_slices(batches, GROUP):
            at, start, length, total, ids = [], [], [], [], []
            for k, found in enumerate(document_ids(part.column("text"), path, table)):
                whole = np.append(found, np.uint32(end_id)).astype("<u4").tobytes()
                for a in range(0, len(whole), 4 * capacity):
                    one = whole[a : a + 4 * capacity]
                    at.append(k)
                    start.append(a // 4)
                    length.append(len(one) // 4)
                    total.append(len(whole) // 4)
                    ids.append(one)
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(at, pa.int32())), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(total, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "start", "length", "doc_tokens", "ids"])
        pa.default_memory_pool().release_unused()  # the worker lives on, beside others

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, start long, length long, doc_tokens long, ids binary")


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Intervals (length, first rank, count, first sequence id, offset): piece r of a length goes to sequence id + r - first rank."""
    rooms: dict[int, list[tuple[int, int]]] = {}
    heap: list[int] = []
    out, sequences = [], 0

    def leave(room: int, first: int, count: int) -> None:
        if room and count:
            if not rooms.get(room):
                heapq.heappush(heap, -room)
            rooms.setdefault(room, []).append((first, count))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            while heap and not rooms[-heap[0]]:
                heapq.heappop(heap)
            if heap and -heap[0] >= length:
                room = -heap[0]
                first, count = rooms[room].pop()
                n = min(left, count)
                out.append((length, rank, n, first, capacity - room))
                leave(room - length, first, n)
                leave(room, first + n, count - n)
            else:  # new sequences, each with as many pieces of this length as fit
                each = min(left, capacity // length)
                packs = left // each
                n = each * packs
                out += [(length, rank + k * packs, packs, sequences, k * length) for k in range(each)]
                leave(capacity - each * length, sequences, packs)
                sequences += packs
            rank, left = rank + n, left - n
    return out


def pack(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``rows`` (with doc_id, start, length from 1 to capacity) with sequence_id and offset.

    Ranks within a length come from counts by length and hash of the piece, so no length meets in one task, however
    common it is. The plan is broadcast: it has a few intervals for each of at most ``capacity`` lengths. Rows alike in
    all columns get places of their own; no row in gives no row out.
    """
    spark = rows.sparkSession
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(4 * partitions(spark))).cast("int"))
    counts = stash(salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n")))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = salted.withColumn("_row", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "start")) - 1)
    ranked = ranked.join(counts.select("length", "_salt", before.alias("_before")), ["length", "_salt"]).withColumn("_rank", F.col("_before") + F.col("_row"))
    steps = spark.createDataFrame(plan(histogram, capacity), "length long, _first long, _count long, _base long, offset long")
    within = (ranked["length"] == steps["length"]) & (ranked["_rank"] >= steps["_first"]) & (ranked["_rank"] < steps["_first"] + steps["_count"])
    placed = ranked.join(F.broadcast(steps), within).withColumn("sequence_id", F.col("_base") + F.col("_rank") - F.col("_first"))
    return placed.select(*[ranked[c] for c in rows.columns], "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids, doc_ids, lengths of each sequence: its pieces by offset (``packed`` with ids)."""
    joined = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "length", "ids"))).alias("p"))
    ids = F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return joined.select("sequence_id", ids.alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.length").alias("lengths"))


def packed_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for each piece of ``docs``."""
    cut = stash(pieces(docs, path).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens"))
    return pack(cut)


def op2_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
