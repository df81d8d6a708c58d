"""Quality rules: counts over the whole text, and a linear-chain conditional random field over its lines.

Each line with a word is a node with two labels, content and boilerplate. Viterbi decoding finds the best labelling, and the
share of words in content lines decides whether a document stays. Nobody has labelled single lines, so the field learns from a
bounded sample of labelled documents with the lines' labels latent: in turns, lines take the label that the field prefers,
as far as a good document keeps at least CONTENT_SHARE of its words in content and a bad one stays below, and the field
is trained on those chains. Without labelled rows fixed weights serve.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import table, text_groups

WINDOW = 5
#: Labelled documents of each quality that the field learns from, and the longest text among them.
TRAIN_DOCS, TRAIN_BYTES = 800, 32 << 10
#: Training cuts longer chains into pieces of this many lines.
TRAIN_LINES = 64
#: How often lines are labelled anew and the field is trained on them.
TURNS = 3
#: Least share of words in content lines.
CONTENT_SHARE = 0.7

FEATURES = ("bias", "words", "symbols", "upper", "digits", "exclaims", "pipes", "repeats", "duplicate", "word length", "distinct")
#: Fixed weights for content against boilerplate, and for staying in a label, where nothing is labelled.
FIXED = np.array([2.0, 0.1, -20.0, -3.0, -3.0, -8.0, -4.0, -6.0, -1.0, 0.0, 1.0]), np.array([[1.0, 0.0], [0.0, 1.0]])

_WORD = np.ones(256, dtype=bool)
_WORD[[32, *range(9, 14)]] = False


def _mask(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


_SYMBOL, _UPPER, _LETTER, _DIGIT = _mask(b"#*$%&|<>"), _mask(bytes(range(65, 91))), _mask(bytes([*range(65, 91), *range(97, 123)])), _mask(b"0123456789")
_CLASSES = [_SYMBOL, _UPPER, _LETTER, _DIGIT, _mask(b"!"), _mask(b"|")]


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a window of WINDOW words found at least twice, first occurrence included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), dtype=np.int64, count=len(words))
    size, key = len(index), ids[:n].copy()
    top = size
    for k in range(1, WINDOW):
        if top > (1 << 62) // size:
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
            top = n
        key = key * size + ids[k : k + n]
        top *= size
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    if not twice.any():
        return 0
    covered = np.zeros(len(words), dtype=bool)
    for k in range(WINDOW):
        covered[k : k + n] |= twice
    return int(covered.sum())


def measure(text: bytes) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Counts (words, word characters, symbols, duplicate lines, repeated words), and features and words of each line with a word."""
    raw = np.frombuffer(text, np.uint8)
    words = text.split()
    lines = text.split(b"\n")
    seen: set[bytes] = set()
    rows, duplicates, at, word_at = [], 0, 0, 0
    for line in lines:
        own = line.split()
        if own:
            again = line in seen
            duplicates += again
            seen.add(line)
            repeats = sum(a == b for a, b in zip(own, own[1:], strict=False))
            rows.append((at, at + len(line), len(own), again, repeats, len(set(own))))
            word_at += len(own)
        at += len(line) + 1
    is_word = _WORD[raw]
    chars = int(np.count_nonzero(is_word & ((raw & 0xC0) != 0x80)))
    counts = [len(words), chars, int(np.count_nonzero(_SYMBOL[raw])), duplicates, repeat_words(words)]
    if not rows:
        return counts, np.zeros((0, len(FEATURES))), np.zeros(0)
    info = np.array(rows, dtype=np.float64)
    begin, end, n = info[:, 0].astype(int), info[:, 1].astype(int), info[:, 2]
    sums = [np.concatenate(([0], np.cumsum(c[raw], dtype=np.int32))) for c in _CLASSES]
    symbols, upper, letters, digits, exclaims, pipes = (s[end] - s[begin] for s in sums)
    size = np.maximum(end - begin, 1)
    features = [np.ones(len(n)), np.log1p(n) / 4, symbols / size, upper / np.maximum(letters, 1), digits / size, np.minimum(exclaims / n, 1), np.minimum(pipes / n, 1), info[:, 4] / n, info[:, 3], np.minimum(size / n / 10, 3), info[:, 5] / n]
    return counts, np.stack(features, axis=1), n


def viterbi(emit: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Best labelling (1: content) of a chain; emit: score of content over boilerplate at each node, move[a, b]: of b after a. Ties: content."""
    (mm, mc), (cm, cc) = move.tolist()
    bad, good, back = 0.0, float(emit[0]), []
    for e in emit[1:].tolist():
        to_bad, to_good = (good + cm >= bad + mm), (good + cc >= bad + mc)
        back.append((to_bad, to_good))
        bad, good = max(good + cm, bad + mm), max(good + cc, bad + mc) + e
    now = int(good >= bad)
    out = [now]
    for choice in reversed(back):
        now = int(choice[now])
        out.append(now)
    return np.array(out[::-1])


class Chains:
    """Chains of (features, label of each line, weight), cut into pieces of TRAIN_LINES and filled up to one length."""

    def __init__(self, chains: list[tuple[np.ndarray, np.ndarray, float]]):
        cut = [(f[k : k + TRAIN_LINES], y[k : k + TRAIN_LINES], w) for f, y, w in chains for k in range(0, len(f), TRAIN_LINES)]
        size = len(cut), max(len(f) for f, _, _ in cut)
        self.x, self.real, self.y = np.zeros((*size, len(FEATURES))), np.zeros(size, dtype=bool), np.zeros(size, dtype=int)
        self.weight = np.array([w for _, _, w in cut])
        for k, (f, y, _) in enumerate(cut):
            self.x[k, : len(f)], self.real[k, : len(f)], self.y[k, : len(f)] = f, True, y


def likelihood(theta: np.ndarray, c: Chains) -> tuple[float, np.ndarray]:
    """Weighted log-likelihood of the chains' labels, and its gradient, by the forward and backward sums. theta: emission weights, then moves [a, b]."""
    k = len(FEATURES)
    move, emit = theta[k:].reshape(2, 2), np.zeros((*c.real.shape, 2))
    emit[:, :, 1] = c.x @ theta[:k]
    ahead, behind = np.zeros_like(emit), np.zeros_like(emit)
    ahead[:, 0] = emit[:, 0]
    for t in range(1, emit.shape[1]):
        new = np.logaddexp(ahead[:, t - 1, :1] + move[0], ahead[:, t - 1, 1:] + move[1]) + emit[:, t]
        ahead[:, t] = np.where(c.real[:, t, None], new, ahead[:, t - 1])
    for t in range(emit.shape[1] - 2, -1, -1):
        after = emit[:, t + 1] + behind[:, t + 1]
        new = np.logaddexp(move[:, 0] + after[:, :1], move[:, 1] + after[:, 1:])
        behind[:, t] = np.where(c.real[:, t + 1, None], new, 0.0)
    total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
    pair, content = c.real[:, 1:], np.exp(ahead[:, :, 1] + behind[:, :, 1] - total[:, None]) * c.real
    told = (emit[:, :, 1] * c.y * c.real).sum(axis=1) + (move[c.y[:, :-1], c.y[:, 1:]] * pair).sum(axis=1)
    grad = np.zeros_like(theta)
    grad[:k] = np.einsum("dt,dtf->f", (c.real * c.y - content) * c.weight[:, None], c.x)
    for a in (0, 1):
        for b in (0, 1):
            expect = np.exp(ahead[:, :-1, a] + move[a, b] + emit[:, 1:, b] + behind[:, 1:, b] - total[:, None]) * pair
            seen = pair * ((c.y[:, :-1] == a) & (c.y[:, 1:] == b))
            grad[k + 2 * a + b] = ((seen - expect) * c.weight[:, None]).sum()
    return float((c.weight * (told - total)).sum()), grad


def train(c: Chains, theta: np.ndarray | None = None, rounds: int = 120, rate: float = 0.15, decay: float = 1e-3) -> np.ndarray:
    """Emission weights and moves by gradient ascent (Adam) on the likelihood less ``decay`` halves of the squared weights."""
    theta = np.zeros(len(FEATURES) + 4) if theta is None else theta.copy()
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        grad = likelihood(theta, c)[1] - decay * theta
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        theta = theta + rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return theta


def line_labels(score: np.ndarray, words: np.ndarray, good: bool) -> np.ndarray:
    """Content (1) where the score is above zero, then as few lines changed, the least certain first, as the document's own label asks for."""
    y = (score > 0).astype(int)
    share = (y * words).sum() / words.sum()
    for k in np.argsort(np.abs(score), kind="stable").tolist():
        if (share >= CONTENT_SHARE) == good:
            break
        if y[k] != good:
            y[k] = good
            share = (y * words).sum() / words.sum()
    return y


def learn(chains: list[tuple[np.ndarray, np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Emission weights and moves from (features, words of each line, quality) of documents."""
    quality = np.array([q for _, _, q in chains])
    if len(set(quality.tolist())) < 2:
        return FIXED
    weight = np.where(quality == 1, 0.5 / (quality == 1).sum(), 0.5 / (quality == 0).sum())
    k = len(FEATURES)
    # To begin with, every line by itself, with its document's label.
    theta = train(Chains([(f[j : j + 1], np.array([q]), w / len(f)) for (f, _, q), w in zip(chains, weight, strict=True) for j in range(len(f))]))
    theta[k:] = 0
    for _ in range(TURNS):
        told = [(f, line_labels(f @ theta[:k], n, bool(q)), w) for (f, n, q), w in zip(chains, weight, strict=True)]
        theta = train(Chains(told), theta)
    return theta[:k], theta[k:].reshape(2, 2)


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int, longest: int) -> DataFrame:
    """doc_id, text, quality of at most ``most`` labelled documents of each quality, by hash of the id, of at most ``longest`` bytes; of rows that repeat a doc_id, the least text."""
    one = labels.select(F.col("doc_id").cast("long"), "quality").dropDuplicates(["doc_id"])
    picked = [one.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for q in (0, 1)]
    chosen = F.broadcast(picked[0].union(picked[1]))  # at most 2 * most rows
    return docs.select(F.col("doc_id").cast("long"), "text").filter(F.octet_length("text") <= longest).join(chosen, "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text")).select("doc_id", "text", "quality")


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    rows = labelled_sample(docs, labels, TRAIN_DOCS, TRAIN_BYTES).collect()  # bounded by TRAIN_DOCS and TRAIN_BYTES
    rows.sort(key=lambda r: (r.doc_id, r.text))
    measured = [(*measure(r.text.encode())[1:], r.quality) for r in rows]
    return learn([x for x in measured if len(x[0])])


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines long, content_lines long, content_share double"


def judge(docs: DataFrame, weights: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id and the counts and verdicts of SCHEMA for each whole text.

    A null or wordless text has no line, fails the base rules and is not kept. Repeated rows are judged each; a null doc_id
    stays; extra columns are ignored; one text is measured at a time, however long.
    """
    w, move = weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_groups(batches):
            rows = []
            for text in texts:
                counts, features, n = measure(text)
                failed = counts[0] < 10 or 100 * counts[4] > 20 * counts[0]
                content = viterbi(features @ w, move) if len(features) else np.zeros(0)
                share = float((content * n).sum() / n.sum()) if len(n) else 0.0
                rows.append((*counts, failed, not failed and share >= CONTENT_SHARE, len(n), int(content.sum()), share))
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, {SCHEMA}")


def keep(docs: DataFrame, weights: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """The documents (all columns, whatever their names) that the rules keep, in one pass over the rows; null ids and repeated rows are judged each."""
    from pyspark.sql.types import StructType

    schema: StructType = docs.schema
    w, move = weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_groups(batches):
            kept = []
            for text in texts:
                counts, features, n = measure(text)
                fine = counts[0] >= 10 and 100 * counts[4] <= 20 * counts[0]
                kept.append(fine and (viterbi(features @ w, move) * n).sum() / n.sum() >= CONTENT_SHARE)
            yield part.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, schema)


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, fit(docs, table(spark, sf_dir, "labels")))
