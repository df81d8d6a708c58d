"""Spelling variants, exact top-k search and conversation repair against brute force, with nulls, ties, repeats, empty tables and clashing columns."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm import repair, topk, variants


def edits_apart(a, b):
    """Levenshtein distance."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def word_counts(rows):
    n = collections.Counter()
    for doc, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def brute_variants(n):
    out = {}
    for w, c in n.items():
        near = [v for v in n if v != w and abs(len(v) - len(w)) < 2 and edits_apart(v, w) == 1]
        best = min(near, key=lambda v: (-n[v], v), default=None)
        out[w] = (best if best and n[best] >= 10 * c else None, c, len(near))
    for w in n:
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w] += (root,)
    return out


def variant_rows():
    rng = random.Random(5)
    stems = ["".join(rng.choice("aeinorstlcÉéßü") for _ in range(rng.randint(6, 10))) for _ in range(40)]
    rows = []
    for k in range(60):
        words = []
        for _ in range(120):
            w = stems[min(int(rng.expovariate(0.12)), 39)]
            if rng.random() < 0.15:
                i = rng.randrange(len(w))
                w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("aeñX") + w[i:], w[:i] + rng.choice("aeñX") + w[i + 1 :]])
            words.append(w.upper() if rng.random() < 0.05 else w)
        rows.append((k, " ".join(words)))
    rows += [(100 + k, "planetary " * 80 + "planetarys planetarys" + " planetarysy" * (k % 3 == 0)) for k in range(12)]
    rows += [(None, rows[0][1]), (3, rows[3][1]), (61, None), (62, ""), (63, "x" * 3000 + " " + "x" * 3001 + " " + "x" * 3000 + " " + "x" * 3001), (64, "aaaaaaa aaaaaaa aaaaaaaa aaaaaaaa aaaaaaaaa aaaaaaaaa œuvres×÷ œuvres×÷ abc"), (65, "word; " * 4000)]
    return rows


@pytest.mark.parametrize("symbols", [1, 3, 8])
def test_variants(spark, symbols):
    rows = variant_rows()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n long, word string").repartition(3)
    words = variants.count_words(docs).filter("n >= 2")
    want = brute_variants(word_counts(rows))
    got = {r.word: (r.form, r.n, r.n_near, r.root) for r in variants.variants(words, symbols=symbols).collect()}
    assert got == want
    assert sum(w[3] != k for k, w in want.items()) > 20 and any(want[w[0]][0] for w in want.values() if w[0])
    forms = {r.word: r.form_n for r in variants.variants(words, symbols=symbols).collect()}
    assert all(forms[k] == (want[w[0]][1] if w[0] else None) for k, w in want.items())


def test_variants_query_and_nothing(spark, tmp_path):
    rows = variant_rows()
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = variants.op11_variants(spark, str(tmp_path))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = brute_variants(word_counts(rows))
    assert {r.word: (r.form, r.n, r.n_near, r.root) for r in got.collect()} == want
    assert variants.variants(variants.count_words(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


def test_words_counted_in_parts_are_whole(spark, monkeypatch):
    monkeypatch.setattr(variants, "HELD", 3)
    rows = variant_rows()[:5]
    got = {r.word: r.n for r in variants.count_words(spark.createDataFrame(rows, "doc_id long, text string")).filter("n >= 2").collect()}
    assert got == word_counts(rows)


def brute_top(rows, k, scale=1024):
    rows = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (qi, q) in enumerate(rows):
        if qi is not None and qi % 100 == 0:
            scored = [(-sum(x * y for x, y in zip(q, v, strict=False)), i is None, i or 0, i) for b, (i, v) in enumerate(rows) if b != a]
            out += [(qi, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


def vector_rows(n=700):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(5, 12)).astype("f4")
    rows = [(int(k), (centres[k % 5] * 0.3 + 0.1 * rng.normal(size=12)).astype("f4").tolist()) for k in range(n)]
    rows += [(1000 + k, rows[300][1]) for k in range(60)] + [(400, rows[400][1]), (400, rows[7][1]), (None, rows[300][1]), (None, rows[1][1])]
    return rows + [(1100, None), (1200, [1.0, None, 2.0]), (1300, [float("nan")] * 12), (1400, [float("inf")] + [0.0] * 11), (1500, []), (1600, [0.5, -0.25]), (1700, [-x for x in rows[0][1]])]


@pytest.mark.parametrize(("k", "parts"), [(10, 2), (3, 1), (10, 4)])
def test_top_k(spark, k, parts):
    rows = vector_rows()
    vectors = spark.createDataFrame([(i, v, 1, 2.0, "x") for i, v in rows], "vec_id long, embedding array<float>, row int, score double, site string").repartition(3)
    got = topk.top_k(topk.whole_vectors(vectors), F.col("vec_id") % 100 == 0, k, parts)
    assert sorted(map(tuple, got.collect()), key=str) == brute_top(rows, k)


def test_top_k_is_exact_beyond_doubles(spark):
    rng = np.random.default_rng(3)
    rows = [(int(k), [float(x) for x in rng.integers(-(10**6), 10**6, size=4)]) for k in range(300)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.top_k(topk.whole_vectors(vectors), F.col("vec_id") % 100 == 0).collect()), key=str) == brute_top(rows, 10)


def test_top_k_of_few_and_none(spark):
    rows = [(100, [1.0, 2.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (200, [2.0, -1.0])]
    for some in (rows, rows[:1], rows[1:3], []):
        vectors = topk.whole_vectors(spark.createDataFrame(some, "vec_id long, embedding array<float>"))
        assert sorted(map(tuple, topk.top_k(vectors, F.col("vec_id") % 100 == 0).collect()), key=str) == brute_top(some, 10)


def test_sites_cut_scores_into_slices(spark, monkeypatch):
    monkeypatch.setattr(topk, "SCORES", 50)
    monkeypatch.setattr(topk, "SITE_BYTES", 4096)
    rows = vector_rows(450)
    vectors = topk.whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert sorted(map(tuple, topk.top_k(vectors, F.col("vec_id") % 100 == 0).collect()), key=str) == brute_top(rows, 10)


GOOD = re.compile(r"(s?(ua)+)?")


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def applied(rows, kinds, edits):
    """Roles, texts and cost of a string of edits with chosen roles; None where an edit is not allowed."""
    k, cost, out = 0, 0, []
    for e, role in edits:
        if e == "I":
            out.append((role, ""))
            cost += 5
            continue
        was, text = rows[k]
        if e != "D":
            if kinds[k] in ("blank", "duplicate"):
                return None
            cost += 5 * (kinds[k] == "truncated") + (e == "R")
            out.append((was if e == "K" else role, text))
        else:
            cost += 2
        k += 1
    return cost, out


def brute_repair(rows):
    """All strings of edits, with up to two insertions before each turn and at the end."""
    kinds = faults(rows)
    inserted = [()] + [(("I", r),) for r in ("user", "assistant")] + [(("I", a), ("I", b)) for a in ("user", "assistant") for b in ("user", "assistant")]
    steps = [x + (y,) for x in inserted for y in (("D", ""), ("K", ""), ("R", "user"), ("R", "assistant"))]
    best = None
    for choice in itertools.product(*[steps] * len(rows), inserted):
        edits = [e for part in choice for e in part]
        found = applied(rows, kinds, edits)
        if found and GOOD.fullmatch("".join(r[:1] or "?" for r, _ in found[1])):
            one = (found[0], "".join(e for e, _ in edits), "\n".join(f"{r}:{t}" for r, t in found[1]))
            best = one if best is None else min(best, one)
    return best


def brute_long(rows):
    """Cheapest edits by comparing whole strings at every place."""
    kinds, after = faults(rows), {"": "u", "s": "u", "u": "a", "a": "u"}
    kept = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def with_inserts(now):
        for _ in range(3):
            for s, (c, e) in list(now.items()):
                one = (c + 5, e + "I")
                if after[s] not in now or one < now[after[s]]:
                    now[after[s]] = one
        return now

    now = with_inserts({"": (0, "")})
    for (role, _), kind in zip(rows, kinds, strict=True):
        new, more = {}, 5 * (kind == "truncated")
        for s, (c, e) in now.items():
            ways = [(s, c + 2, e + "D")]
            if kind not in ("blank", "duplicate"):
                ways += [(after[s], c + 1 + more, e + "R")] + ([(kept[s, role[:1]], c + more, e + "K")] if (s, role[:1]) in kept else [])
            for to, cost, edits in ways:
                new[to] = min(new.get(to, (cost, edits)), (cost, edits))
        now = with_inserts(new)
    return min(now[s] for s in ("", "a") if s in now)


def decoded(rows):
    d, out, most = repair.Decoder(), [], 0
    for (role, text), kind in zip(rows, faults(rows), strict=True):
        out += d.add(0, role, text, kind)
        most = max(most, len(d.turns))
    out += d.end()
    return sum(x[-1] for x in out), "".join(x[0] for x in out), "\n".join(f"{x[3]}:{x[4]}" for x in out if x[0] != "D"), most


def test_decoder_is_cheapest_and_first():
    rng = random.Random(1)
    for n in (0, 1, 2, 3):
        for _ in range(1 if n == 0 else 40 if n < 3 else 6):
            rows = [(rng.choice(["system", "user", "assistant", "user", "tool", " ", ""]), rng.choice(["a.", "b.", "c", "d!", " ", "e?"])) for _ in range(n)]
            assert decoded(rows)[:3] == brute_repair(rows), rows
    for roles in (["system", "user", "assistant", "tool", " "], ["user"], ["tool"], ["user", "assistant"], ["system"], ["assistant", "system"]):
        for _ in range(60):
            rows = [(rng.choice(roles), rng.choice(["a.", "b.", "c", "d", f"{rng.random()}.", f"{rng.random()}", " "])) for _ in range(rng.randint(1, 40))]
            cost, audit = brute_long(rows)
            assert decoded(rows)[:2] == (cost, audit), rows


def test_unresolved_part_stays_short():
    rows = [(("user", "assistant")[k % 2], f"{k}.") for k in range(5000)]
    assert decoded(rows)[3] <= 12
    rows = [("user", f"{k}.") for k in range(5000)]
    assert decoded(rows)[1].count("K") > 2000


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def test_repair_query(spark, tmp_path):
    rng = random.Random(9)
    rows = []
    for conv in [*range(120), None]:
        for turn in range(rng.randint(1, 9)):
            rows.append((conv, rng.choice([turn, turn, turn, turn * 3, None]), rng.choice(["user", "assistant", "system", "tool", None]), rng.choice(["One.", "Two two!", "three", None, "", "\t\n", "é ok?", "x. \n"])))
    rows += [(500, k, ("user", "assistant")[k % 2], f"Turn {k}.") for k in range(800)] + [(501, 1, "user", "long " * 50000 + ".")]
    rows += [rows[0], rows[1]]
    rows += [(c, 0, "user", "Gone.") for c in range(2000, 2060)]
    full = [(*r, "x", 1, "y") for r in rows]
    spark.createDataFrame(full, "conv_id long, turn long, role string, text string, edit string, cost int, fault string").repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in repair.op13_conversation_repair(spark, str(tmp_path)).collect()}
    assert set(got) == {r[0] for r in rows}
    by = collections.defaultdict(list)
    for conv, turn, role, text in damaged(rows):
        by[conv].append((turn is not None, turn or 0, role, text, turn))
    assert any(c not in by for c in got)
    for conv, r in got.items():
        mine = sorted(by[conv], key=lambda x: x[:4])
        pairs, turns = [(x[2], x[3]) for x in mine], [x[4] for x in mine if x[4] is not None]
        kinds = faults(pairs)
        cost, audit = brute_long(pairs)
        assert (r.cost, r.audit) == (cost, audit), conv
        assert (r.blank, r.duplicate, r.truncated) == tuple(kinds.count(k) for k in ("blank", "duplicate", "truncated"))
        assert r.gaps == (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0)
        assert r.illegal == sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(pairs))
        assert r.repaired_sha256 == hashlib.sha256(decoded(pairs)[2].encode()).hexdigest()


def test_repair_of_nothing_and_of_text_ids(spark):
    assert repair.report(repair.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0
    rows = spark.createDataFrame([("a", 2, "assistant", "Yes."), ("a", 1, "user", "Is it?"), ("b", 1, "user", "Only one.")], "conv_id string, turn int, role string, text string")
    got = {r.conv_id: (r.audit, r.cost) for r in repair.report(repair.repair(rows)).collect()}
    assert got == {"a": ("KK", 0), "b": ("D", 2)}
    edits = repair.repair(rows).filter("conv_id = 'a'").collect()
    assert [(e.edit, e.turn, e.was, e.role, e.text) for e in edits] == [("K", 1, "user", "user", "Is it?"), ("K", 2, "assistant", "assistant", "Yes.")]
