"""Text operators against brute force on small fixtures, with nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tidewater.llm import bpe, chat, common, convnet, kneser, licences, lines, packing, rules, simhash, sketch

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BPE, WORDS = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")


def texts():
    rng = random.Random(3)
    bag = [rng.choice("aeiou") + rng.choice("bcdfg") * rng.randint(1, 3) + rng.choice(["", "é", "X", "!", "'s"]) for _ in range(60)]
    out = [" ".join(rng.choice(bag) for _ in range(rng.randint(1, 80))) for _ in range(30)]
    out += [out[0], out[1] + " z", "", None, " \t\n ", "a", "Same Same", "\n\n x \n y", "  two  spaces \t tab\x85nel ", "a  <|endoftext|>b <|startoftext|> c", "word " * 9000, out[2] + "\n" + out[3], out[3] + "\n" + out[2] + "\n" + out[2]]
    return out


@pytest.fixture(scope="module")
def rows():
    return [(k, t) for k, t in enumerate(texts())]


@pytest.fixture(scope="module")
def docs(spark, rows):
    full = [(k, t, "en", "s", len(t or ""), 0.0, "x") for k, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, score double, words string").repartition(3)


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def test_rules(docs, rows, nothing):
    got = {r.doc_id: r for r in rules.judge(docs, rules.FIXED).collect()}
    for k, t in rows:
        t = t or ""
        w = WORD.findall(t)
        seen = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        ls = t.split("\n")
        dup = sum(bool(WORD.search(x)) and x in ls[:i] for i, x in enumerate(ls))
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered))
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
    assert rules.judge(nothing, rules.FIXED).count() == 0
    kept = {r.doc_id for r in rules.keep(docs, rules.FIXED).select("doc_id").collect()}
    assert kept == {k for k, r in got.items() if r.kept}


def test_sample_has_one_row_of_each_id(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (2, "c"), (None, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    got = [tuple(r) for r in rules.labelled_sample(docs, labels, 5, 10).collect()]
    assert sorted(got) == [(1, "a", 1), (2, "c", 0)]


def test_viterbi_is_best():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5):
        emit, move = rng.normal(size=n), rng.normal(size=(2, 2))
        value = lambda y: sum(e * b for e, b in zip(emit, y)) + sum(move[a, b] for a, b in zip(y, y[1:]))  # noqa: B023, E731
        best = max((tuple(int(c) for c in f"{k:0{n}b}") for k in range(1 << n)), key=value)
        assert math.isclose(value(best), value(rules.viterbi(emit, move).tolist()))


def test_packing(docs, rows, nothing):
    t = packing.tokenizer(WORDS)
    got = packing.packed_documents(docs, WORDS).collect()
    by, own = collections.defaultdict(list), collections.defaultdict(dict)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
        own[r.doc_id][r.start] = r
    for k, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        at = 0
        for start in sorted(own[k]):
            r = own[k][start]
            assert start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[start : start + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.packed_documents(nothing, WORDS).count() == 0


def test_ids_by_pieces_are_those_of_the_whole_text():
    rng, t = random.Random(4), packing.tokenizer(WORDS)
    atoms = ["a", "B", "é", "e\u0301", "\u0338", "<", "<|endoftext|>", "'s", "'LL", "'", "\x85", "\u00a0", "中", "1", "Σ", "ß", "\u1100", "\x00", "#", ".", " ", "\n", "\x0b", "²", "Ж", "の", "’", "İ", "ŉ", "\u00ad", "_", "\x1c"]
    plain = [chr(c) for a, b in ((9, 13), (32, 126), (0xA1, 0xAC), (0xAE, 0x12F), (0x131, 0x148), (0x14A, 0x17E), (0x400, 0x45F), (0x2010, 0x2027), (0x20AC, 0x20AC), (0x3041, 0x3094), (0x30A1, 0x30FA), (0x4E00, 0x9FA5)) for c in range(a, b + 1)]
    some = ["".join(rng.choices(atoms, k=rng.randint(0, 12))) for _ in range(3000)] + ["".join(rng.choices(plain, k=rng.randint(0, 14))) for _ in range(6000)] + ["", "   ", None]
    want = [t.encode(x or "", add_special_tokens=False).ids for x in some]
    for most in (packing.CACHE_PIECES, 50):
        table = packing.PieceIds(WORDS, most)
        for k in range(0, len(some), 500):
            assert [x.tolist() for x in packing.document_ids(pa.array(some[k : k + 500], pa.string()), WORDS, table)] == want[k : k + 500]


def test_packing_plan_places_all():
    rng = random.Random(1)
    histogram = {n: rng.randint(1, 50) for n in rng.sample(range(1, 101), 40)}
    placed = collections.Counter()
    room = collections.Counter()
    for length, _, count, first, _ in packing.plan(histogram, 100):
        placed[length] += count
        for k in range(count):
            room[first + k] += length
    assert placed == histogram and max(room.values()) <= 100


def test_bpe(docs, rows, nothing):
    t = packing.tokenizer(BPE)
    got = {r.doc_id: r for r in bpe.encode(docs, BPE).collect()}
    for k, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(got[k].ids, "<u4").tolist() == ids and got[k].n_tokens == len(ids)
        assert got[k].decoded == t.decode(ids, skip_special_tokens=False)
    assert bpe.encode(nothing, BPE).count() == 0


def test_bpe_with_few_parts_and_groups_of_blocks(spark, docs, rows, monkeypatch):
    """More partitions than parts: a part's lists are dealt into groups, and ids are the same."""
    monkeypatch.setattr(bpe, "MOST_PARTS", 3)
    monkeypatch.setattr(bpe, "BLOCK_WORDS", 20)
    t = packing.tokenizer(BPE)
    got = {r.doc_id: r.ids for r in bpe.encode(docs, BPE).collect()}
    assert {k: np.frombuffer(v, "<u4").tolist() for k, v in got.items()} == {k: t.encode(text or "", add_special_tokens=False).ids for k, text in rows}


def brute_fingerprint(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(docs, rows, nothing):
    fp = {k: brute_fingerprint(t) for k, t in rows}
    label = {k: k for k in fp}
    for _ in fp:
        for a in fp:
            for b in fp:
                if (fp[a] ^ fp[b]).bit_count() <= 4:
                    label[a] = label[b] = min(label[a], label[b])
    got = simhash.near_duplicates(docs).collect()
    assert {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in got} == {k: (fp[k], label[k]) for k in fp}
    assert {r.doc_id for r in simhash.keep_first(docs).select("doc_id").collect()} == set(label.values())
    assert simhash.near_duplicates(nothing).count() == 0


def test_one_row_of_each_group_stays(spark):
    """Null doc_ids are members of their groups, repeated rows leave one, and texts that share a doc_id are told apart."""
    a, b, c, d = ("".join(f"{w}{k} " for k in range(40)) for w in "abcd")
    rows = [(None, a, "x"), (None, b, "x"), (None, b, "y"), (3, c, "x"), (3, c, "x"), (4, c, "x"), (None, c, "x"), (3, d, "x")]
    fps = {t: brute_fingerprint(t) for t in (a, b, c, d)}
    assert all((fps[s] ^ fps[t]).bit_count() > 4 for s in fps for t in fps if s != t)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = simhash.keep_first(docs)
    assert got.columns == docs.columns
    assert sorted((r.text, r.doc_id) for r in got.collect()) == [(a, None), (b, None), (c, 3), (d, 3)]
    assert simhash.keep_first(docs.filter("doc_id is not null and text like 'd%'")).count() == 1 and simhash.keep_first(docs.limit(0)).count() == 0


def test_rows_without_an_id_link_others(spark, monkeypatch):
    """Fingerprints a, b, c, each 4 bits from the next, the middle one of a row without an id only; rows of one id link theirs."""
    made = {"a": 0, "b": 0xF, "c": 0xFF, "far": 0xFFFF << 40, "lone": -1, "near lone": -2}
    table = spark.createDataFrame([(1, "a"), (None, "b"), (2, "c"), (None, "c"), (5, "far"), (None, "lone"), (None, "near lone"), (6, "a"), (6, "far")], "doc_id long, text string")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs: docs.select("doc_id", F.element_at(F.create_map(*[F.lit(x) for kv in made.items() for x in kv]).cast("map<string,bigint>"), F.col("text")).alias("fp")))
    got = lambda rows: sorted(((r.doc_id or 0, r.fp, r.component_id) for r in simhash.near_duplicates(rows).collect()), key=str)
    want = [(1, 0, 1), (0, 0xF, 1), (2, 0xFF, 1), (0, 0xFF, 1), (5, 0xFFFF << 40, 5), (0, -1, None), (0, -2, None)]
    assert got(table.filter("doc_id is null or doc_id <> 6")) == sorted(want, key=str)
    want = [(i, fp, c and 1) for i, fp, c in want] + [(6, 0, 1), (6, 0xFFFF << 40, 1)]
    assert got(table) == sorted(want, key=str)


def test_kept_rows_have_any_columns(spark):
    rows = [(1, "one two three four five six", "h", "i", "t", "r", 1), (2, "one two three four five six", "h", "i", "t", "r", 2), (2, "one two three four five six", "h", "i", "t", "r", 2), (None, "nine ten", "x", "y", "z", "q", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _h string, _id string, _text string, row string, n long")
    got = simhash.keep_first(docs)
    assert got.columns == docs.columns and sorted(map(tuple, got.collect()), key=str) == sorted([rows[0], rows[3]], key=str)
    assert sorted(r.n for r in simhash.keep_first(docs.filter("doc_id = 2")).collect()) == [2]


def test_masks_cover():
    rng = random.Random(5)
    found = simhash.masks()
    for _ in range(2000):
        flips = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(not m & flips for m in found)


def test_large_bucket_keeps_links(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 3)
    fps = [(k, (1 << k) - 1) for k in range(20)]
    edges = simhash.links(spark.createDataFrame(fps, "node long, fp long"), 1)
    assert {r.component for r in simhash.components(edges).collect()} == {0}


def test_near_duplicates_broadcast_no_table(spark, monkeypatch):
    """A file far below Spark's limit may hold rows far beyond it, 31 times more once they are exploded: no join broadcasts, before or after Spark has seen sizes."""
    rows = [(k, f"{' '.join(f'w{k // 2}x{i}' for i in range(40))} end{k}") for k in range(40)]
    docs = spark.createDataFrame([*rows, (1, "another text of this id")], "doc_id long, text string")
    plans, write = [], simhash.stash
    monkeypatch.setattr(simhash, "stash", lambda df: plans.append(df) or write(df))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        for found in (simhash.near_duplicates(docs), simhash.links(simhash.fingerprints(docs).select("fp", F.col("fp").alias("node")))):
            plans.append(found)
        texts = [df._jdf.queryExecution().executedPlan().toString() for df in plans if df.count() >= 0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sum(x.count("SortMergeJoin") for x in texts) >= 5 and not any("BroadcastHashJoin" in x for x in texts)


def line_oracle(rows, t=0.8):
    sets, out = [], {}
    for k, text in rows:
        kept, had = [], False
        for line in (text or "").split("\n"):
            w = WORD.findall(line)
            if not w:
                kept.append((line, False))
                continue
            had = True
            s = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)])
            if not any(len(s & o) >= t * len(s | o) - 1e-9 for o in sets):
                kept.append((line, True))
            sets.append(s)
        if not had:
            out[k] = text
        elif any(x for _, x in kept):
            out[k] = "\n".join(x for x, _ in kept)
    return out


def test_lines(docs, rows, nothing):
    got = lines.dedup_lines(docs)
    assert got.columns == docs.columns
    assert {r.doc_id: r.text for r in got.collect()} == line_oracle(rows)
    assert lines.dedup_lines(nothing).count() == 0


def test_lines_similar_to_a_middle_one(spark):
    """A tree of copies of copies, one word changed at a time: many lines resemble neither the first one nor the one before."""
    rng = random.Random(8)
    family = [[f"w{rng.randint(0, 400)}" for _ in range(60)]]
    for k in range(120):
        one = list(rng.choice(family))
        one[rng.randrange(60)] = f"new{k}"
        family.append(one)
    rows = [(k, " ".join(one)) for k, one in enumerate(family)]
    rng.shuffle(rows)
    rows = [(k, text) for k, (_, text) in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.text for r in lines.dedup_lines(docs).collect()} == line_oracle(rows)


def test_lines_of_rows_with_one_doc_id(spark):
    """Rows of one doc_id with different texts keep and lose lines each for itself; exact repeats stay alike."""
    base = [f"w{k}" for k in range(30)]
    near, own = " ".join([*base[:-1], "other"]), "a line of its own"
    rows = [(0, " ".join(base)), (1, near), (1, own), (1, f"{near}\nsecond {own}"), (2, f"{own}\nlast"), (2, f"{own}\nlast"), (None, own)]
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = [(0, " ".join(base)), (1, own), (1, f"second {own}"), (2, "last"), (2, "last"), (None, own)]
    assert collections.Counter((r.doc_id, r.text) for r in got) == collections.Counter(want)


def test_few_lines_found_are_broadcast(spark, monkeypatch):
    """Joins with the few lines found similar do not shuffle and sort all lines, whatever Spark's own limit; results are the same."""
    rows = [(k, f"{' '.join(f'w{(k // 2) * 40 + i}' for i in range(30))} end{k}") for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    plans, write = [], lines.stash
    monkeypatch.setattr(lines, "stash", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r.doc_id: r.text for r in lines.dedup_lines(docs).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == line_oracle(rows) and len(got) == 6
    joins = [x for plan in plans for x in plan.split("\n") if "Join" in x and "LeftAnti" in x]
    assert len(joins) == 3 and all("BroadcastHashJoin" in x for x in joins)


def test_many_candidate_lines_do_not_shuffle_all_texts(spark, monkeypatch):
    """Where candidate lines are too many to be broadcast, marks drop most others before any shuffle; no shuffle files stay behind; results are the same."""
    rows = [(k, f"{' '.join(f'w{(k // 2) * 40 + i}' for i in range(30))} end{k}\na line {k}\n\n  another {k}") for k in range(12)]
    docs = spark.createDataFrame([*rows, (None, "no id")], "doc_id long, text string").repartition(3)
    plans, write = [], lines.stash
    monkeypatch.setattr(lines, "stash", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df))
    monkeypatch.setattr(lines, "BROADCAST_IDS", -1)
    blocks = lambda: {x for x in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ").split() if x.startswith("shuffle_")}
    for marks in (1 << 20, 2):
        monkeypatch.setattr(lines, "MARKS", marks, raising=False)
        known, plans[:] = docs.filter("doc_id is not null").withColumn("version", F.lit(0).cast("long")), []
        sets = write(lines.line_sets(known))
        assert len({r.doc_id for r in lines.removed_lines(known, sets).collect()}) == 6
        verified = [x for x in plans if "posexplode" in x and "array_distinct" in x]
        assert len(verified) == 2 and all(x.index("SortMergeJoin") < x.index("BroadcastHashJoin") < x.index("Generate") for x in verified)
        texts = {r.doc_id: r.text for r in lines.dedup_lines(docs).collect()}
        assert texts.pop(None) == "no id" and texts == line_oracle(rows)
    before = blocks()
    held = lines.stash(docs.groupBy("doc_id").agg(F.min("text")).repartition(2))
    deadline = time.time() + 20
    while blocks() - before and time.time() < deadline:
        time.sleep(0.1)
    assert not blocks() - before and held.count() == 13 and spark.conf.get(common.CLEANUP, "false") == "false"


def test_very_many_pairs_are_compared_part_by_part(spark, monkeypatch):
    """Pairs carry token sets through the shuffles, so they go in parts that are written one after the other; each b is found once."""
    rows = [(k, f"{' '.join(f'w{i}' for i in range(60))} end{k}") for k in range(20)] + [(k, " ".join(f"v{k}x{i}" for i in range(30))) for k in range(20, 24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("version", F.lit(0).cast("long"))
    kind = "struct<doc_id:long,version:long,line:int>"
    pairs = lines.stash(spark.createDataFrame([((a, 0, 0), (b, 0, 0)) for b in range(24) for a in range(b)], f"a {kind}, b {kind}"))
    written, write = [], lines.stash
    monkeypatch.setattr(lines, "stash", lambda df: written.append(df.columns) or write(df))
    monkeypatch.setattr(lines, "BROADCAST_IDS", -1)
    got = [r.b.doc_id for r in lines.similar_to_earlier(docs, pairs).collect()]
    assert sorted(got) == list(range(1, 20)) and written.count(["b"]) == 4


def test_marks_keep_the_lines_they_are_made_from(spark):
    every = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("version"), (F.col("id") % 3).cast("int").alias("line"), F.lit("text").alias("content"))
    ends = every.filter("doc_id % 100 = 0").drop("content")
    got = lines.marked(every, ends)
    found = {r.doc_id for r in got.collect()}
    assert got.columns == every.columns and set(range(0, 3000, 100)) <= found and len(found) < 60


def test_words_of_lines(spark):
    """Lines with only spaces are split at them, others by the pattern: the words are the same."""
    texts = ["a b", "  a   b ", "a\tb", "a \x0b\x0c\r b", "a\u00a0b c", " \t ", "", None, "x\ny  z\r\n\t\u2003 q", "\x1f a\x85b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("version", F.lit(0).cast("long"))
    got = {(r.doc_id, r.line): r.w for r in lines.line_words(docs).collect()}
    assert got == {(k, i): w for k, t in enumerate(texts) for i, x in enumerate((t or "").split("\n")) if (w := WORD.findall(x))}


def test_crowding_counts_the_tokens_of_lines(spark):
    """The compiled count over word hashes finds the buckets of the very tokens that lines have, short lines and odd separators included."""
    rng = random.Random(12)
    texts = [f"one two three four five x{k} {' '.join(f'w{rng.randint(0, 10**6)}' for _ in range(6))}\n  short\tone " for k in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("version", F.lit(0).cast("long"))
    counts = collections.Counter(t % lines.BUCKETS for r in lines.line_tokens(docs).collect() for t in r.tokens)
    mean = max(1.0, counts.total() / lines.BUCKETS)
    above = {b: (n - mean) / (lines.SPREAD * mean**0.5) for b, n in counts.items()}
    got = lines.crowding(docs)
    assert len(got) == lines.BUCKETS and max(counts.values()) >= 300
    assert {b: x for b, x in enumerate(got) if x} == {b: min(15, math.floor(math.log2(a)) + 1) for b, a in above.items() if a >= 1}


def test_shared_prefixes_keep_lines_with_an_earlier_one(spark):
    """Of a token's lines all but the first are rows, with the first and the one before; a token of one line leaves no row."""
    sets = [(k, 0, 0, 4, p) for k, p in enumerate([[7], [5, 7], [6, 7], [8]])]
    got = lines.shared_prefixes(spark.createDataFrame(sets, "doc_id long, version long, line int, size int, prefix array<long>").repartition(3)).collect()
    assert sorted((r.token, r.doc_id, r.span & 0xFFFFFFFF, r.first.doc_id, r.prev.doc_id) for r in got) == [(7, 1, 1, 0, 0), (7, 2, 1, 0, 1)]


def brute_shingles(text):
    w = WORD.findall(text or "")
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_sketch(spark, docs, rows, nothing):
    got = {r.doc_id: r for r in sketch.edited_pairs(docs, 2).collect()}
    every = {r.doc_id: r for r in sketch.edited_pairs(docs, 1).collect()}
    for (k, t), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        t, after = t or "", after or ""
        q = len(t) // 4
        assert got[k].edited_text == t[: len(t) - q] + after[:q] and got[k].n_chars == len(t)
        # With every hash kept, the sketch is the shingle set, and a scaled sketch is that set below the limit.
        assert len(every[k].sketch) == len(brute_shingles(t)) and len(every[k].edited_sketch) == len(brute_shingles(got[k].edited_text))
        assert got[k].sketch == sorted(h for h in every[k].sketch if h < 0) and got[k].next_sketch == sorted(h for h in every[k].next_sketch if h < 0)
        assert got[k].sketch_least == (min(every[k].sketch, default=None) if not got[k].sketch else None)
        assert len(set(every[k].sketch) & set(every[k].next_sketch)) == len(brute_shingles(t) & brute_shingles(after))
    same = {r.text: set() for r in docs.collect()}
    for k, t in rows:
        same[t].add(tuple(got[k].sketch))
    assert all(len(s) == 1 for s in same.values())
    assert sketch.edited_pairs(nothing).count() == 0


def test_sketch_rows(spark):
    """Null doc_ids have no next document; of repeated ids the smallest text is the next document."""
    rows = [(None, "abcd efgh"), (1, "one two three four"), (2, "zz yy"), (2, "aa bb cc dd"), (2, "aa bb cc dd"), (9, None)]
    got = sorted((r.doc_id or 0, r.edited_text) for r in sketch.edited_pairs(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect())
    assert got == [(0, "abcd ef"), (1, "one two three aa b"[:18]), (2, "aa bb cc "), (2, "aa bb cc "), (2, "zz y"), (9, "")]


def test_sketches_merge_exactly(spark):
    rng = random.Random(2)
    words_of = lambda n: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n))
    small, large, other = words_of(300), words_of(20000), words_of(7)
    texts = [(1, small), (1, large), (1, other), (2, small), (3, f"{large} {small}"), (4, "three words only"), (5, None)]
    one = sketch.with_sketch(spark.createDataFrame(texts, "k int, text string"), "text", "sketch", 8)
    merged = {r.k: set(r.sketch) for r in sketch.merge(one, "k").collect()}
    full = sketch.with_sketch(spark.createDataFrame(texts, "k int, text string"), "text", "sketch", 1)
    limit = -(1 << 63) + (1 << 61)
    assert merged == {r.k: {h for h in r.sketch if h < limit} for r in sketch.merge(full, "k").collect()}
    assert merged[4] == merged[5] == set()
    pair = spark.createDataFrame([(sorted(merged[2]), sorted(merged[3]))], "a array<long>, b array<long>")
    r = pair.select(sketch.containment(F.col("a"), F.col("b")).alias("c"), sketch.containment(F.col("b"), F.col("a")).alias("d")).first()
    assert r.c == 1 and abs(r.d - 300 / 20300) < 0.01


def test_likeness_estimates_containment(spark):
    """Against brute force on texts that share a known part: within four standard deviations of the sampling."""
    rng = random.Random(6)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(4000)]
    rows = [(k, " ".join(base[: 40 * k] + [f"x{k}y{j}" for j in range(4000 - 40 * k)])) for k in range(0, 101, 10)]
    df = sketch.with_sketch(spark.createDataFrame([(k, t, " ".join(base)) for k, t in rows], "k int, text string, whole string"), "text", "a")
    for r in sketch.with_sketch(df, "whole", "b").select("k", "text", sketch.likeness(sketch.comparable("a"), sketch.comparable("b")).alias("x")).collect():
        s, t = brute_shingles(r.text), brute_shingles(" ".join(base))
        p = len(s & t) / min(len(s), len(t))
        assert abs(r.x - p) <= 4 * math.sqrt(p * (1 - p) / 500) + 0.02


def test_chat(spark):
    raw = [(1, 0, "user", "a<|end|>\n\\|b"), (1, 1, "user", None), (1, 2, "assistant", "x\\"), (1, 3, "assistant", "<|turn|><\\|"), (2, 0, "we\\n\nird<|", ""), (None, 1, "assistant", "n"), (3, 1, "assistant", "t"), (3, 1, "assistant", "t")]
    back = chat.read_back(chat.format_conversations(spark.createDataFrame(raw, "conv_id long, turn long, role string, text string")))
    got = {r.conv_id: r for r in back.collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("user", "a<|end|>\n\\|b"), ("user", ""), ("assistant", "x\\"), ("assistant", "<|turn|><\\|")]
    assert got[1].loss_text == "x\\<|turn|><\\|" and got[1].formatted.count(chat.BEGIN) == 2
    assert [(t.role, t.text) for t in got[2].turns] == [("we\\n\nird<|", "")]
    assert got[3].loss_text == "tt" and got[None].loss_text == "n"
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string, formatted string, turns string")
    assert chat.read_back(chat.format_conversations(none)).count() == 0


def test_licences(spark, nothing):
    files = [("a/LICENSE", "Released under the MIT License."), ("a/b/x.c", "code here"), ("a/b/y.c", "some\nLicensed under the Apache License, Version 2.0.\nmore words of code that go on and on and on for a while"), ("z/q.c", "code"), ("z/n.c", None), ("top.c", "the version of this")]
    got = {r.path: (r.licence, r.found, r.origin) for r in licences.scan(spark.createDataFrame(files, "path string, text string")).collect()}
    assert got == {"a/LICENSE": ("MIT", "own", "a/LICENSE"), "a/b/x.c": ("MIT", "inherited", "a/LICENSE"), "a/b/y.c": ("Apache-2.0", "own", "a/b/y.c"), "z/q.c": (None, None, None), "z/n.c": (None, None, None), "top.c": (None, None, None)}
    assert licences.scan(nothing.select(F.lit("p").alias("path"), "text")).count() == 0


def test_licences_whatever_the_size_and_the_prose(spark):
    """A full notice is found amid prose and over line ends, in few files and in many; a rare word of it alone is not."""
    notices = {
        "c.c": ("Copyright 2024 Acme Corp. All rights reserved.", "Proprietary"),
        "see.c": ("Licensed under the Apache License, Version 2.0 (see file LICENSE)", "Apache-2.0"),
        "prose.c": ("see the code " * 40 + "which is Released under the MIT License, " + "and are see code " * 40, "MIT"),
        "wrapped.c": ("/* Licensed under the GNU Lesser\n * General Public\n * License, version 3. */\nsee code", "LGPL-3.0"),
        "no.c": ("the words are of human rights and of all rights of way in the code that we see and are the words of", None),
    }
    for n in (20, 5000):
        files = [*((f"{p}/{p}", t) for p, (t, _) in notices.items()), *((f"f{k}/x.c", "see the words of code that are in this file") for k in range(n))]
        got = {r.path: r.licence for r in licences.scan(spark.createDataFrame(files, "path string, text string")).collect()}
        assert {p: got[f"{p}/{p}"] for p in notices} == {p: name for p, (_, name) in notices.items()}
        assert len(got) == len(files) and sum(x is not None for x in got.values()) == 4
    counts = {r.t: r.df for r in licences.document_frequencies(spark.createDataFrame([("a a b.",), ("a 2.0.",), (None,)], "text string")).collect()}
    assert counts == {"a": 2, "b": 1, "2.0": 1}


def test_language_model_in_many_shards(spark, docs):
    """The model does not depend on the number of shards, and without adaptive execution every shard is a task of its own."""
    got = []
    for n, adaptive in (("4", "true"), ("7", "false")):
        before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        model = kneser.fit(docs)
        got.append((model["vocabulary"], model["total"], sorted((r.doc_id, round(r.score, 9)) for r in kneser.score(docs, model).collect())))
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got[0] == got[1]


def test_maps_keep_no_handles(tmp_path):
    """More arrays than a process may have open files; arrays of any kind and size, and files that are not there."""
    import resource

    for k in range(300):
        kneser.save(f"{tmp_path}/x_{k}.npy", np.arange(k, dtype=np.uint16 if k % 2 else np.uint64))
    kneser.save(f"{tmp_path}/y_0.npy", np.arange(10, dtype=np.int64).reshape(5, 2))
    before = resource.getrlimit(resource.RLIMIT_NOFILE)
    resource.setrlimit(resource.RLIMIT_NOFILE, (min(before[0], 250), before[1]))
    try:
        shards = kneser.Shards(f"{tmp_path}/x_{{}}.npy", 301)
        assert all(shards[k].tolist() == list(range(k)) for k in range(300)) and shards[300] is None and len(shards) == 301
        assert kneser.Shards(f"{tmp_path}/y_{{}}.npy", 1)[-1].tolist() == np.arange(10).reshape(5, 2).tolist()
    finally:
        resource.setrlimit(resource.RLIMIT_NOFILE, before)


def test_language_model(docs, rows, nothing):
    toks = {k: [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), "\n"] for k, t in rows}
    train = [k for k in toks if k % 3]
    model = kneser.fit(docs.filter("doc_id % 3 <> 0"))
    c = collections.Counter(w for k in train for w in toks[k])
    pairs = collections.Counter(p for k in train for p in zip(["<s>", *toks[k]], toks[k]))
    prior = collections.Counter(w for _, w in pairs)
    left = collections.defaultdict(collections.Counter)
    for (u, w), n in pairs.items():
        left[u][w] = n
    n, v = sum(c.values()), len(c)
    d2, d1 = (kneser.discounts([collections.Counter(x.values())[k] for k in (1, 2, 3, 4)]) for x in (pairs, prior))
    cut = lambda x, d: d[min(x, 3) - 1] if x else 0
    spare = sum(cut(x, d1) for x in prior.values()) / len(pairs)

    def p(u, w):
        low = (prior[w] - cut(prior[w], d1)) / len(pairs) + spare / (v + 1)
        if u not in left:
            return low
        total = sum(left[u].values())
        return (left[u][w] - cut(left[u][w], d2)) / total + sum(cut(x, d2) for x in left[u].values()) / total * low

    for r in kneser.score(docs, model).collect():
        t = toks[r.doc_id]
        assert (r.n_tokens, r.n_known, model["total"]) == (len(t), sum(w in c for w in t), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), rel_tol=1e-9)
        assert math.isclose(r.score, sum(math.log10(p(u, w)) for u, w in zip(["<s>", *t], t)), rel_tol=1e-9)
    assert math.isclose(sum(p("a", w) for w in c) + p("a", "unseen"), 1)
    assert kneser.score(nothing, model).count() == 0
    assert kneser.fit(nothing)["vocabulary"] == 0


def test_convnet(docs, nothing):
    good = [b"plain words in a row, and more of them. " * k for k in range(1, 25)]
    bad = [b"wo### rds*** in$$$ a%%% row&&& " * k for k in range(1, 25)]
    net = convnet.train(good + bad, np.array([1] * 24 + [0] * 24), 0.5, epochs=6)
    assert (net.score(good) > 0.5).mean() > 0.9 and (net.score(bad) < 0.5).mean() > 0.9
    scored = convnet.score(docs, net).collect()
    assert len(scored) == docs.count() and all(0 <= r.score <= 1 for r in scored)
    assert convnet.score(nothing, net).count() == 0
    chunks, counts = convnet.chunks([b"x" * 2000, b""])
    assert counts.tolist() == [4, 1] and (chunks[:4] == ord("x")).any(axis=1).all()


def test_chunks_hold_every_byte():
    rng = np.random.default_rng(2)
    for n in range(505, 1031):
        text = rng.integers(1, 256, n, dtype=np.uint8).tobytes()
        rows, counts = convnet.chunks([text])
        rebuilt = b"".join(bytes(r[: convnet.STEP]) for r in rows[:-1]) + bytes(rows[-1])
        assert len(rows) == counts[0] and rebuilt.rstrip(b"\0") == text


def test_hashes_are_of_whole_texts(docs, rows):
    got = {r.doc_id: r.h for r in bpe.encode(docs, BPE).select("doc_id", F.sha2(F.col("decoded").cast("binary"), 256).alias("h")).collect()}
    assert got == {k: hashlib.sha256((t or "").encode()).hexdigest() for k, t in rows}


def test_lines_of_a_very_frequent_token(spark, monkeypatch):
    """Lines of a salted token still meet each other, first and in the second round; columns may be named as helpers are."""
    monkeypatch.setattr(lines, "SALT_LEVEL", 0)
    rng = random.Random(9)
    rows = [(k, f"the same five words here {' '.join(f'w{rng.randint(0, 9)}' for _ in range(6))}\n\nown{k}") for k in range(150)]
    full = [(k, t, "x", k, len(t)) for k, t in rows]
    docs = spark.createDataFrame(full, "doc_id long, text string, _kept string, flags long, n_chars int").repartition(3)
    got = lines.dedup_lines(docs)
    assert got.columns == docs.columns
    want = line_oracle(rows)
    assert {r.doc_id: (r.text, r["_kept"], r["flags"], r.n_chars) for r in got.collect()} == {k: (t, "x", k, len(t)) for k, t in want.items()}


def test_field_likelihood_is_that_of_brute_force():
    rng = np.random.default_rng(1)
    k = len(rules.FEATURES)
    chains = [(rng.normal(size=(n, k)), rng.integers(0, 2, n), w) for n, w in ((1, 1.0), (3, 0.5), (5, 2.0))]
    theta = rng.normal(size=k + 4) / 2

    def score(f, y):
        return sum(f[t] @ theta[:k] * y[t] for t in range(len(y))) + sum(theta[k + 2 * a + b] for a, b in zip(y, y[1:]))

    want = 0.0
    for f, y, w in chains:
        every = [score(f, [int(c) for c in f"{m:0{len(f)}b}"]) for m in range(1 << len(f))]
        want += w * (score(f, y.tolist()) - math.log(sum(map(math.exp, every))))
    value, grad = rules.likelihood(theta, rules.Chains(chains))
    assert math.isclose(value, want, rel_tol=1e-9)
    for j in range(len(theta)):
        step = np.zeros(len(theta))
        step[j] = 1e-5
        slope = (rules.likelihood(theta + step, rules.Chains(chains))[0] - rules.likelihood(theta - step, rules.Chains(chains))[0]) / 2e-5
        assert abs(slope - grad[j]) < 1e-6


def test_line_labels_keep_to_the_document():
    score, words = np.array([3.0, -0.1, -2.0, 0.2]), np.array([10.0, 10.0, 10.0, 10.0])
    assert rules.line_labels(score, words, True).tolist() == [1, 1, 0, 1]
    assert rules.line_labels(score, words, False).tolist() == [1, 0, 0, 1]
    assert rules.line_labels(np.ones(3), np.ones(3), False).sum() == 2 and rules.line_labels(-np.ones(3), np.ones(3), True).sum() == 3


def test_lines_are_labelled_one_by_one(spark):
    """Learned from documents' labels alone, the field marks planted boilerplate inside good documents and prose inside bad ones, and judges documents by shares."""
    rng = random.Random(12)
    prose = lambda: " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(rng.randint(8, 20)))
    menu = lambda: " | ".join("".join(rng.choices("ABCDEF", k=rng.randint(3, 6))) + "!!" for _ in range(rng.randint(8, 15)))
    made, truth = [], {}
    for k in range(240):
        bad = k % 3 == 0
        kinds = [rng.random() < (0.15 if bad else 0.88) for _ in range(rng.randint(6, 14))]
        ls = [prose() if c else menu() for c in kinds]
        share = sum(len(x.split()) for c, x in zip(kinds, ls, strict=True) if c) / sum(len(x.split()) for x in ls)
        truth[k] = kinds, share >= rules.CONTENT_SHARE
        made.append((k, "\n".join(ls), int(share >= rules.CONTENT_SHARE)))
    docs = spark.createDataFrame([(k, t) for k, t, _ in made], "doc_id long, text string")
    labels = spark.createDataFrame([(k, q) for k, _, q in made if k % 2], "doc_id long, quality int")
    weights = rules.fit(docs, labels)
    got = {r.doc_id: r for r in rules.judge(docs, weights).collect()}
    right = [rules.viterbi(rules.measure(t.encode())[1] @ weights[0], weights[1]).tolist() == [int(c) for c in truth[k][0]] for k, t, _ in made]
    assert sum(right) > 0.95 * len(made)
    assert sum(got[k].kept == truth[k][1] for k in truth if not got[k].base_failed) > 0.97 * len(made)
    assert sum(0 < r.content_share < 1 for r in got.values()) > 0.6 * len(made)
    assert rules.fit(docs, labels.limit(0)) is rules.FIXED


def test_network_is_that_of_brute_force():
    rng = np.random.default_rng(3)
    net = convnet.Network()
    net.dense, net.bias, net.out = rng.normal(size=len(net.dense)), rng.normal(size=convnet.FILTERS) / 3, np.array([0.3])
    texts = [b"", b"abc", rng.integers(1, 256, 700, dtype=np.uint8).tobytes(), rng.integers(1, 256, 1500, dtype=np.uint8).tobytes()]
    want = []
    for t in texts:
        each = []
        for c in range(1 + max(0, -(-(len(t) - convnet.CHUNK) // convnet.STEP))):
            chunk = t[c * convnet.STEP : c * convnet.STEP + convnet.CHUNK].ljust(convnet.CHUNK, b"\0")
            windows = [np.concatenate([net.embed[b] for b in chunk[p : p + convnet.WIDTH]]) for p in range(0, convnet.CHUNK - convnet.WIDTH + 1, convnet.STRIDE)]
            each.append([max(0.0, max(float(w @ net.filters[:, f]) for w in windows) + net.bias[f]) for f in range(convnet.FILTERS)])
        v = np.concatenate((np.mean(each, axis=0), np.max(each, axis=0)))
        want.append(1 / (1 + math.exp(-(float(v @ net.dense) + 0.3))))
    assert np.allclose(net.score(texts), want, atol=1e-5)


def test_network_gradient_is_the_slope():
    rng = np.random.default_rng(5)
    net = convnet.Network()
    for n in convnet.WEIGHTS:
        setattr(net, n, getattr(net, n).astype(np.float64))
    net.dense, net.bias = rng.normal(size=len(net.dense)), np.full(convnet.FILTERS, 0.2)
    texts = [rng.integers(1, 256, n, dtype=np.uint8).tobytes() for n in (30, 600, 1100)]
    rows, counts = convnet.chunks(texts)
    y, weight = np.array([1, 0, 1]), np.array([0.5, 1.0, 0.25])

    def loss():
        z = net.combine(net.pooled(rows)[0], counts)[0]
        return float((weight * (np.log1p(np.exp(z)) - y * z)).sum())

    grad = convnet.gradient(net, rows, counts, y, weight)
    for n in convnet.WEIGHTS:
        flat, slope = getattr(net, n).reshape(-1), grad[n].reshape(-1)
        for j in rng.choice(len(flat), min(12, len(flat)), replace=False):
            old = flat[j]
            flat[j] = old + 1e-6
            up = loss()
            flat[j] = old - 1e-6
            down = loss()
            flat[j] = old
            assert abs((up - down) / 2e-6 - slope[j]) < 1e-4, n


def test_samples_and_stages_keep_rows(spark):
    """Null ids, repeated rows, clashing columns and empty tables in the stages that filter."""
    rows = [(None, "one two three four five six seven eight nine ten eleven", 1), (3, "short", 2), (3, "one two three four five six seven eight nine ten eleven", 3), (3, "one two three four five six seven eight nine ten eleven", 3), (4, None, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score long")
    assert sorted(r.score for r in rules.keep(docs, rules.FIXED).collect()) == [1, 3, 3]
    assert rules.keep(docs.limit(0), rules.FIXED).count() == 0
    net = convnet.Network()
    assert sorted(r.score for r in convnet.keep(docs, net, 0.0).collect()) == [1, 2, 3, 3, 4] and convnet.keep(docs, net, 1.1).count() == 0
    assert convnet.keep(docs.limit(0), net).count() == 0
    fit = convnet.fit(docs, spark.createDataFrame([(3, 1)], "doc_id long, quality int"))
    assert all(abs(r.score - 0.999) < 1e-3 for r in convnet.score(docs, fit).collect())


def test_licence_families_are_told_apart(spark):
    notice = "This program is free software: you can redistribute it and/or modify\n it under the terms of the GNU {} Public License as published by\n the Free Software Foundation, either version 3 of the License, or\n (at your option) any later version.\nint main"
    files = {
        "a/COPYING": ("GNU GENERAL PUBLIC LICENSE\n Version 3, 29 June 2007\n\n Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.", "GPL-3.0"),
        "b/COPYING": ("GNU AFFERO GENERAL PUBLIC LICENSE\n Version 3, 19 November 2007\n\n Everyone is permitted to copy", "AGPL-3.0"),
        "c/COPYING.LESSER": ("GNU LESSER GENERAL PUBLIC LICENSE\n Version 3, 29 June 2007\n", "LGPL-3.0"),
        "d/COPYING": ("GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991\n\nCopyright (C) 1989", "GPL-2.0"),
        "e/gpl.c": (notice.format("General"), "GPL-3.0"),
        "e/agpl.c": (notice.format("Affero General"), "AGPL-3.0"),
        "e/lgpl.c": (notice.format("Lesser General"), "LGPL-3.0"),
        "f/isc.c": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\nx = 1", "ISC"),
        "g/mit.c": ("// SPDX-License-Identifier: MIT\nint x;", "MIT"),
        "g/apache.c": ("# SPDX-License-Identifier: Apache-2.0\nimport os", "Apache-2.0"),
        "h/deep/er/x.c": ("code", None),
        "a/deep/er/x.c": ("code", "GPL-3.0"),
        "h/null.c": (None, None),
    }
    rows = [(p, t, 1.0) for p, (t, _) in files.items()] * 2 + [(None, "Released under the MIT License.", 1.0)] + [(f"k{k}/x.c", f"some ordinary words of code number {k} version file", 1.0) for k in range(200)]
    got = {r.path: r for r in licences.scan(spark.createDataFrame(rows, "path string, text string, score double")).collect()}
    assert {p: got[p].licence for p in files} == {p: name for p, (_, name) in files.items()}
    assert len(got) == len(files) + 200 and got["a/deep/er/x.c"].origin == "a/COPYING" and all(got[f"k{k}/x.c"].licence is None for k in range(200))


def test_packed_words_come_back():
    rng = random.Random(3)
    words_ = sorted(bytes(rng.choices([0, 97, 98, 99], k=rng.randint(0, 30))) for _ in range(500))
    for some in ([], [b""], [b"a", b"a\0", b"a\0\0b"], words_, words_[::-1]):
        assert bpe._unpack_words(bpe._pack_words(some)) == some
    numbers = np.array([0, 1, 255, 256, 1 << 40, -1])
    parts, (back, none) = bpe._unpack(bpe._pack([b"", b"xy"], numbers, numbers[:0]))
    assert parts == [b"", b"xy"] and back.tolist() == numbers.tolist() and len(none) == 0


BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice.\n2. Redistributions in binary form must reproduce the above copyright notice.\n"
MIT_TEXT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"
LICENCE_CASES = {
    "bsd2/LICENSE": ("Copyright 2020 A. All rights reserved.\n" + BSD, "BSD-2-Clause"), "bsd2/x.c": ("code here", "BSD-2-Clause"),
    "bsd3/LICENSE": (BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "BSD-3-Clause"),
    "zlib/x.c": ("Copyright 1995 M. All rights reserved.\nThis software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "Zlib"),
    "art/x.c": ("Licensed under the Artistic License, Version 2.0.", "Artistic-2.0"), "eupl/x.c": ("Licensed under the EUPL, Version 1.2", "EUPL-1.2"), "eupl/COPYING": ("European Union Public Licence v. 1.2\nEUPL (c) the European Union", "EUPL-1.2"),
    "mit0/LICENSE": ("MIT No Attribution\n\nCopyright 2020 A\n\n" + MIT_TEXT, "MIT-0"), "mit/LICENSE": ("Copyright 2020 A\n\n" + MIT_TEXT, "MIT"), "prose/x.c": ("This tool, as a whole, is covered by the GNU General Public License, version 3, as its authors say.", "GPL-3.0"),
    "wtf/COPYING": ("DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nVersion 2, December 2004", "WTFPL"), "ms/x.c": ("Microsoft Public License (Ms-PL)", "MS-PL"), "gpl2/x.c": ("licensed under the GNU General Public License, version 2.", "GPL-2.0"), "no/x.c": ("the license of version 2.0 of the work", None),
}


def test_licences_that_resemble_others(spark):
    rows = [(p, t) for p, (t, _) in LICENCE_CASES.items()] + [(f"k{k}/x.c", f"some ordinary words of code number {k} version file") for k in range(300)]
    got = {r.path: (r.licence, r.score) for r in licences.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert {p: got[p][0] for p in LICENCE_CASES} == {p: name for p, (_, name) in LICENCE_CASES.items()}, {p: got[p] for p in LICENCE_CASES}
    assert all(got[f"k{k}/x.c"][0] is None for k in range(300))


def brute_matches(files, templates, cosine, passage):
    """Best score by licence of the lines and of the passages of a template's length that have a telling token in its place, by vectors over whole texts."""
    token = re.compile(r"[^\W_](?:(?:[^\W_]|[.+-])*(?:[^\W_]|\+))?")
    cut = lambda t: token.findall(t.lower())
    df = collections.Counter(t for _, text in files for t in set(cut(text or "")))
    weigh = lambda ts: {t: n * (math.log((len(files) + 1) / (df[t] + 1)) + 1) for t, n in collections.Counter(ts).items()}
    size = lambda v: math.sqrt(sum(x * x for x in v.values()))
    out = {}
    for path, text in files:
        for name, template in templates:
            own = weigh(cut(template))
            must = {t for t in licences.TELLING.get(name, []) if t in own}
            lines = [(cut(x), False) for x in (text or "").split("\n")]
            flat, here = cut(text or ""), cut(template)
            n, anchors = len(here), set(licences.marks(own, passage))
            aligned = lambda k: any(0 <= k + j < len(flat) and flat[k + j] == t and t in anchors for j, t in enumerate(here))  # noqa: B023, E731
            for words, whole in lines + [(flat[max(0, k) : k + n], True) for k in range(1 - n, len(flat)) if aligned(k)]:
                v = weigh(words)
                if not words or not must <= set(words):
                    continue
                products = [v[t] * own[t] for t in v if t in own]
                score = round(sum(products) / size(v) / size(own), 9)
                if score >= passage if whole else len(words) <= n and score >= cosine and max(products) <= licences.ALONE * sum(products):
                    out.setdefault(path, {})[name] = max(score, out.get(path, {}).get(name, 0))
    return out


def test_licence_scores_by_brute_force(spark):
    """Scores of files equal a TF-IDF over all lines and all passages, computed apart."""
    files = [(p, t) for p, (t, _) in LICENCE_CASES.items() if len(t) < 700] + [("w/a.c", "/* Licensed under the GNU Lesser\n * General Public\n * License, version 3. */\nsee code"), ("w/b.c", "see which is Released under the MIT License, and code"), ("w/c.c", None), ("w/d.c", "All rights reserved.")]
    want = brute_matches(files, licences.TEMPLATES, licences.COSINE, licences.PASSAGE)
    _, found = licences.matches(spark.createDataFrame(files, "path string, text string"))
    got = {r.path: -r.b.less for r in found.groupBy("path").agg(F.min(F.struct((-F.col("score")).alias("less"), "licence")).alias("b")).collect()}
    assert got == {p: max(x.values()) for p, x in want.items()} and len(got) > 8
