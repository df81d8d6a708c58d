"""BPE encoding and decoding through a table of distinct words.

Spark splits texts into words, so that each word's ids do not depend on its neighbours. Blocks of documents become
positions in the block's list of distinct words. The lists meet by word hash, where each distinct word is encoded once,
and its ids return to the blocks, joined by position. Ids become text through the table of id and piece.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import partitions, stash, table
from tidewater.llm.packing import ids_of, tokenizer

#: A block ends at this much text or this many distinct words.
BLOCK_BYTES, BLOCK_WORDS = 96 << 20, 600_000
#: Parts of a block's word list, by word hash, for each shuffle partition; and how many a block has at most, so that a part is not a few words
#: only. Beyond it the lists of a part are dealt into groups of blocks, and a word is encoded once for each group.
PARTS, MOST_PARTS = 2, 256
#: Leading bytes of numbers with one and with three further bytes; the least number with three.
TWO, FOUR = 160, 240
LARGE = TWO + (FOUR - TWO << 8)
TABLE = "kind int, block long, part int, payload binary"


def special_tokens(path: str) -> list[str]:
    with open(path, encoding="utf-8") as f:
        return [t["content"] for t in json.load(f)["added_tokens"]]


def segments(text: Column, specials: list[str]) -> Column:
    """A text cut where byte-level BPE never merges: before a word with its one leading space, and inside white space as
    the pre-tokenizer cuts it. Special tokens end the text to their left for the pre-tokenizer, so white space before one stays whole."""
    plain = r"(?U) ?\S+|\s+(?!\S)|\s"
    text = F.coalesce(text, F.lit(""))
    if not specials:
        return F.regexp_extract_all(text, F.lit(plain), F.lit(0))
    one = "|".join(r"\Q" + s + r"\E" for s in specials)
    full = rf"(?U)(?:{one})|\s+(?=(?:{one}))| ?(?:(?!(?:{one}))\S)++|\s+(?!\S)|\s"
    has = F.lit(False)
    for s in specials:
        has = has | F.contains(text, F.lit(s))
    return F.when(has, F.regexp_extract_all(text, F.lit(full), F.lit(0))).otherwise(F.regexp_extract_all(text, F.lit(plain), F.lit(0)))


def _by_byte(numbers: np.ndarray) -> bytes:
    """The lowest bytes of all numbers, then the next ones: those of small numbers are runs of zeros."""
    return np.ascontiguousarray(numbers.view(np.uint8).reshape(len(numbers), numbers.itemsize).T).tobytes()


def _from_bytes(raw: bytes, kind: type, n: int, at: int) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T).view(kind).reshape(n)


def _pack(parts: list[bytes], *numbers: np.ndarray) -> bytes:
    """Byte strings and int64 arrays as one compressed value."""
    sizes = np.array([len(p) for p in parts], dtype=np.uint32)
    heads = np.array([len(parts), len(numbers), *(len(n) for n in numbers)], dtype=np.int64)
    return zstandard.compress(b"".join([heads.tobytes(), _by_byte(sizes), *(_by_byte(n.astype(np.int64)) for n in numbers), *parts]), 9)


def _unpack(value: bytes) -> tuple[list[bytes], list[np.ndarray]]:
    raw = zstandard.decompress(value)
    n, k = np.frombuffer(raw, np.int64, 2).tolist()
    counts = np.frombuffer(raw, np.int64, k, 16).tolist()
    at = 16 + 8 * k
    sizes = _from_bytes(raw, np.uint32, n, at)
    at += 4 * n
    numbers = []
    for c in counts:
        numbers.append(_from_bytes(raw, np.int64, c, at))
        at += 8 * c
    ends = (at + np.cumsum(sizes, dtype=np.int64)).tolist()
    return [raw[a:b] for a, b in zip([at, *ends], ends, strict=False)], numbers


def _pack_words(words: list[bytes]) -> bytes:
    """A list of words, each without what it shares with the word before (16 bytes at most)."""
    if not words:
        return _pack([], np.zeros(0, dtype=np.int64))
    heads = np.array(words, dtype="S16").view(np.uint8).reshape(len(words), 16)
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    same = np.cumprod(heads[1:] == heads[:-1], axis=1).sum(axis=1)
    shared = np.concatenate(([0], np.minimum(same, np.minimum(sizes[1:], sizes[:-1]))))
    return _pack([w[n:] for w, n in zip(words, shared.tolist(), strict=True)], shared)


def _unpack_words(value: bytes) -> list[bytes]:
    rests, (shared,) = _unpack(value)
    last, out = b"", []
    for rest, n in zip(rests, shared.tolist(), strict=True):
        last = last[:n] + rest
        out.append(last)
    return out


def _planes(numbers: np.ndarray) -> list[bytes]:
    """Numbers below 2**28 as byte strings: a leading byte for each, then the further bytes of middle and of large numbers, apart.

    Leading bytes: below TWO the number itself, below FOUR one further byte follows, else three.
    """
    middle, large = (numbers >= TWO) & (numbers < LARGE), numbers >= LARGE
    m, g = numbers[middle] - TWO, numbers[large] - LARGE
    lead = numbers.copy()
    lead[middle], lead[large] = TWO + (m >> 8), FOUR + (g >> 24)
    return [x.astype(np.uint8).tobytes() for x in (lead, m & 255, g >> 16 & 255, g >> 8 & 255, g & 255)]


def _numbers(planes: list[bytes]) -> np.ndarray:
    lead, m, a, b, c = (np.frombuffer(v, np.uint8).astype(np.uint32) for v in planes)
    middle, large = (lead >= TWO) & (lead < FOUR), lead >= FOUR
    found = lead.copy()
    found[middle] = (lead[middle] - TWO << 8 | m) + TWO
    found[large] = (lead[large] - FOUR << 24 | a << 16 | b << 8 | c) + LARGE
    return found


def numbered(flat: np.ndarray, words: list[bytes], parts: int) -> tuple[np.ndarray, list[list[bytes]], np.ndarray]:
    """New numbers of a block's words (``flat``: their places in the texts), each part's list of words, and how many words of each part follow each other.

    Words go by doublings of frequency rank, so that frequent ones have small numbers; inside a doubling by part, then in
    byte order, which compresses best. So the lengths of the runs tell each number's part, and a part's list is its runs in order.
    """
    from zlib import crc32

    rank = np.empty(len(words), dtype=np.int64)
    rank[np.argsort(-np.bincount(flat, minlength=len(words)), kind="stable")] = np.arange(len(words))
    doubling = np.frexp(rank + 1)[1] - 1
    part = np.fromiter((crc32(w) % parts for w in words), dtype=np.int64, count=len(words))
    run = doubling * parts + part
    sorted_words = pa.table({"run": run, "word": pa.array(words, pa.binary())})
    order = pc.sort_indices(sorted_words, sort_keys=[("run", "ascending"), ("word", "ascending")]).to_numpy()
    number = np.empty(len(words), dtype=np.int64)
    number[order] = np.arange(len(words))
    lists: list[list[bytes]] = [[] for _ in range(parts)]
    for k, p in zip(order.tolist(), part[order].tolist(), strict=True):
        lists[p].append(words[k])
    return number, lists, np.bincount(run, minlength=(int(doubling.max(initial=-1)) + 1) * parts)


def blocks(docs: DataFrame, specials: list[str], parts: int) -> DataFrame:
    """Rows of two kinds: 0, a part of a block's distinct words; 1, the block's documents as positions in that list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        index: dict[bytes, int] = {}
        ids: list = []
        codes: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        size = 0

        def done() -> Iterator[pa.RecordBatch]:
            nonlocal block, size
            if ids:
                flat, words = np.concatenate(codes), list(index)
                number, lists, runs = numbered(flat, words, parts)
                null = np.array([d is None for d in ids], dtype=np.int64)
                documents = _pack(_planes(number[flat]), np.array([d or 0 for d in ids]), null, np.concatenate(counts), runs)
                payload = [_pack_words(x) for x in lists] + [documents]
                n = len(payload)
                yield pa.RecordBatch.from_arrays([pa.array([0] * parts + [1], pa.int32()), pa.array([block] * n, pa.int64()), pa.array([*range(parts), parts], pa.int32()), pa.array(payload, pa.binary())], names=["kind", "block", "part", "payload"])
                block += 1
                index.clear()
                ids.clear()
                codes.clear()
                counts.clear()
                size = 0

        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                own = batch.slice(k, 1000)
                coded = own.column("words").flatten().dictionary_encode()
                distinct = coded.dictionary.cast(pa.binary()).to_pylist()
                to_block = np.fromiter((index.setdefault(w, len(index)) for w in distinct), dtype=np.int32, count=len(distinct))
                codes.append(to_block[coded.indices.to_numpy()] if len(distinct) else to_block)
                counts.append(pc.list_value_length(own.column("words")).to_numpy().astype(np.int64))
                ids += own.column("doc_id").to_pylist()
                size += own.column("words").nbytes
                if size > BLOCK_BYTES or len(index) > BLOCK_WORDS:
                    yield from done()
        yield from done()

    return docs.select(F.col("doc_id").cast("long"), segments(F.col("text"), specials).alias("words")).mapInArrow(run, TABLE)


def word_ids(lists: DataFrame, path: str, parts: int) -> DataFrame:
    """The word lists, met by part and group: each distinct word is encoded once in a group, and each list comes back as its ids."""
    n = partitions(lists.sparkSession)
    groups = -(-PARTS * n // parts)
    unit = F.col("part") * groups + F.pmod(F.hash("block"), F.lit(groups))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, known, last = tokenizer(path), {}, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["unit"] != last:
                    known, last = {}, row["unit"]
                words = _unpack_words(row["payload"])
                new = [w for w in words if w not in known]
                for w, ids in zip(new, ids_of(tok, [w.decode() for w in new]), strict=True):
                    known[w] = ids
                ids = [known[w] for w in words]
                packed = _pack(_planes(np.frombuffer(b"".join(ids), "<u4")), np.array([len(i) for i in ids], dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([2], pa.int32()), pa.array([row["block"]], pa.int64()), pa.array([row["part"]], pa.int32()), pa.array([packed], pa.binary())], names=["kind", "block", "part", "payload"])

    return lists.withColumn("unit", unit.cast("int")).repartitionById(n, F.col("unit") % n).sortWithinPartitions("unit").mapInArrow(run, TABLE)


def piece_table(path: str) -> dict[int, bytes]:
    """id to piece: the bytes of each vocabulary entry. Byte-level vocabularies write each byte as a printable character."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
    own = {i: bytes(byte_of[c] for c in piece) for piece, i in spec["model"]["vocab"].items()}
    return own | {t["id"]: t["content"].encode() for t in spec["added_tokens"]}


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit), decoded (text of the ids, special tokens kept).

    ``path`` is a byte-level BPE file whose pre-tokenizer keeps one leading space with a word. A null or empty text has
    no ids; repeated rows and null doc_ids stay; extra columns are ignored; very long texts are single rows, as in the input.
    The blocks are written once to the shared folder, so a lost executor cannot number a block's words anew.
    """
    n = partitions(docs.sparkSession)
    parts = min(PARTS * n, MOST_PARTS)
    written = stash(blocks(docs, special_tokens(path), parts))
    encoded = word_ids(written.filter("kind = 0"), path, parts)
    # Block k of input partition p goes to task p + k, so that no task gets several while others have none.
    place = ((F.shiftright("block", 32) + F.col("block").bitwiseAND(F.lit((1 << 32) - 1))) % n).cast("int")
    both = written.filter("kind = 1").unionByName(encoded).repartitionById(n, place).sortWithinPartitions("block", F.desc("kind"), "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, lists = piece_table(path), {}
        for batch in batches:
            for row in batch.to_pylist():
                values, numbers = _unpack(row["payload"])
                if row["kind"] == 2:
                    raw = _numbers(values).astype("<u4").tobytes()
                    ends = np.cumsum(numbers[0]).tolist()
                    lists[row["part"]] = iter([raw[a:b] for a, b in zip([0, *ends], ends, strict=False)])
                    continue
                *numbers, runs = numbers
                ids = [i for k, n in enumerate(runs.tolist()) for i in itertools.islice(lists[k % parts], n)]  # by position in the block's list
                text = [b"".join([pieces[k] for k in np.frombuffer(i, "<u4").tolist()]) for i in ids]
                codes = _numbers(values)
                at, group, size = 0, [], 0
                for doc, null, count in zip(*(x.tolist() for x in numbers), strict=True):
                    own = codes[at : at + count].tolist()
                    at += count
                    group.append((None if null else doc, b"".join([ids[c] for c in own]), b"".join([text[c] for c in own]).decode("utf-8", "replace")))
                    size += len(group[-1][1])
                    if size > 2 << 20:
                        yield out(group)
                        group, size = [], 0
                if group:
                    yield out(group)
                lists = {}

    def out(group: list) -> pa.RecordBatch:
        doc, ids, text = zip(*group, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(text, pa.string())], names=["doc_id", "n_tokens", "ids", "decoded"])

    return both.mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")


def op4_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
