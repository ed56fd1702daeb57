"""Toxicity: gradient-boosted trees over dense text features, calibrated by isotonic regression; all in numpy."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7
#: The bounded training sample: rows of each class.
SAMPLE_ROWS = 3000
#: Words, and beginnings of words, in the learned lexicon, the toxic texts that one must be in, and the least log odds.
LEXICON = 200
MIN_TEXTS = 5
MIN_ODDS = 3.0
#: Clean texts that a term is taken to be in besides those seen, so that rare terms need many toxic texts.
UNSEEN = 2.0
#: Lengths of the beginnings, which catch stems whose endings vary.
STEMS = (4, 5, 6)
TREES, DEPTH, RATE, BINS = 80, 3, 0.2, 64
#: Rows that the calibration pools by score at least, but no more than a twentieth of all: its line runs from pool to pool.
POOL = 50
#: Words between a term and a second-person word that still count as close.
NEAR = 5

# Common English insults, and second-person words.
INSULTS = "idiot stupid moron dumb loser trash scum worthless pathetic disgusting clown fool ugly hate garbage jerk freak creep imbecile coward vermin filthy shut die kill".split()
YOU = "you your yours yourself u ur tu te toi vous votre vos du dich dir dein ihr euch tú usted ustedes vosotros".split()
# Marks that stand for letters.
LOOKS_LIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "", "_": "", ".": "", "-": ""}

@dataclass
class Lexicon:
    """Learned terms and their weights."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)


_KIND = np.zeros(256, np.int64)  # 1 upper, 2 lower, 3 digit, 4 ! and ?, 5 other marks, 6 beyond ASCII
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:] = 1, 2, 3, 6
for _c in range(33, 127):
    if not _KIND[_c]:
        _KIND[_c] = 4 if chr(_c) in "!?" else 5
_IN_WORD, _LETTER, _MARK = re.compile(r"\w"), re.compile(r"[^\W\d_]"), re.compile(r"[0-9@$!*_.\-]")
_PLAIN = str.maketrans(LOOKS_LIKE)


def words_of(text: str) -> list[str]:
    return text.lower().split()


def _bare(word: str) -> str:
    """``word`` without the marks around it; every character is looked at once or twice."""
    if word.isalnum():
        return word
    first = _IN_WORD.search(word)
    return word[first.start() : len(word) - _IN_WORD.search(word[::-1]).start()] if first else ""


def _odd(word: str) -> bool:
    """Whether a digit or mark, as they stand for letters, comes before some letter."""
    mark = _MARK.search(word)
    return mark is not None and _LETTER.search(word, mark.end()) is not None


@dataclass
class Text:
    """What is learned from a whole text: each word once, how often it comes, how often of these near a second-person word, and bytes by kind."""

    words: str
    counts: np.ndarray
    near: np.ndarray
    kinds: np.ndarray
    marks: tuple[int, ...] = ()


def summary(text: str) -> Text:
    words = words_of(text)
    counts, near = Counter(words), Counter()
    if not _YOU.isdisjoint(counts):
        you = (i for i, w in enumerate(words) if w in _YOU)
        near.update(words[j] for j in {j for i in you for j in range(max(0, i - NEAR), min(len(words), i + NEAR + 1))})
    kinds = np.bincount(_KIND[np.frombuffer(text.encode(), np.uint8)], minlength=7)
    return Text(" ".join(counts), np.array(list(counts.values()), np.int64), np.array([near[w] for w in counts], np.int64), kinds)


def features(text: str | Text, lexicon: Lexicon) -> list[float]:
    """Densities by word or byte, all finite for any text, and independent of the text's order except for closeness."""
    text = summary(text) if isinstance(text, str) else text
    counts = dict(zip(text.words.split(), text.counts.tolist(), strict=True))
    total = sum(counts.values())
    n = max(1, total)
    strong = fixed = hidden = weight = 0.0
    best, terms = 0.0, set()
    stems = stem_weight = stem_best = 0.0
    kinds = set()
    odd = []
    learned, beginnings = lexicon.words, lexicon.stems
    for w, k in counts.items():
        for size in STEMS:
            if (stem := w[:size]) in beginnings and len(w) > size:
                stems += k
                stem_weight += k * beginnings[stem]
                stem_best = max(stem_best, beginnings[stem])
                kinds.add(w)
                break
        if (b := w if w.isalpha() else _bare(w)) in learned:
            strong += k
            weight += k * learned[b]
            best = max(best, learned[b])
            terms.add(w)
        if b in _INSULTS:
            fixed += k
            terms.add(w)
        elif b and not b.isalpha() and _odd(b):
            odd.append((w, k))
    for w, k in odd:
        plain = w.translate(_PLAIN)
        if plain in _INSULTS or plain in learned:
            hidden += k
            terms.add(w)
    you = sum(counts.get(w, 0) for w in YOU)
    close = float(sum(k for w, k in zip(counts, text.near.tolist(), strict=True) if w in terms)) if terms and you else 0.0
    raw = text.kinds.astype(float)
    letters, size = max(1.0, raw[1] + raw[2]), max(1.0, raw[1:].sum())
    return [
        strong / n, math.log1p(strong), weight / n, best, fixed / n, math.log1p(fixed), hidden / n, len(odd) / n, you / n,
        close / n, math.log1p(close), stems / n, math.log1p(stems), stem_weight / n, stem_best, math.log1p(len(kinds)), raw[1] / letters, raw[3] / size, raw[4] / size, raw[5] / size, raw[6] / size,
        math.log1p(total), len(counts) / n,
    ]


_INSULTS, _YOU = frozenset(INSULTS), frozenset(YOU)


def _marks(text: str) -> tuple[int, ...]:
    """Three MinHash values of the 5-word shingles."""
    words = words_of(text)
    h = np.array([zlib.crc32(" ".join(words[j : j + 5]).encode()) for j in range(max(1, len(words) - 4))], np.uint64)
    return tuple(int((h * np.uint64(m) % np.uint64(4294967291)).min()) for m in (1, 2654435761, 2246822519))


def _without_copies(texts: list[Text]) -> list[int]:
    """Rows that share none of three MinHash values of their 5-word shingles with an earlier row.

    Words that only the copies of one text have would pass for a lexicon, on held-out copies too.
    """
    seen: set[tuple[int, int]] = set()
    kept = []
    for i, text in enumerate(texts):
        marks = set(enumerate(text.marks))
        if seen.isdisjoint(marks):
            kept.append(i)
        seen |= marks
    return kept


def learn_lexicon(texts: list[Text], labels: np.ndarray) -> Lexicon:
    """Words and stems that mark the toxic class: log odds of the texts that hold them, for those in MIN_TEXTS toxic texts or more."""
    inside, stems = [Counter(), Counter()], [Counter(), Counter()]
    for text, y in zip(texts, labels, strict=True):
        words = {b for w in text.words.split() if (b := _bare(w))}
        inside[int(y)].update(words)
        stems[int(y)].update({w[:k] for w in words for k in STEMS if len(w) > k})
    n0, n1 = max(1, int((labels == 0).sum())), max(1, int((labels == 1).sum()))

    def best(count: list[Counter]) -> dict[str, float]:
        odds = {w: math.log(k / n1) - math.log((count[0][w] + UNSEEN) / n0) for w, k in count[1].items() if k >= MIN_TEXTS}
        return {w: -v for v, w in sorted((-v, w) for w, v in odds.items() if v > MIN_ODDS)[:LEXICON]}

    return Lexicon(best(inside), best(stems))


@dataclass
class Tree:
    """A complete tree: at node i go to 2i + 1 if the feature is at or below the cut, else to 2i + 2."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        row = np.arange(len(x))
        for _ in range(DEPTH):
            at = 2 * at + 1 + (x[row, self.feature[at]] > self.cut[at])
        return self.leaf[at - (2**DEPTH - 1)]


def _grow(x: np.ndarray, bins: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, some: np.ndarray) -> Tree:
    inner = 2**DEPTH - 1
    tree = Tree(np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(2**DEPTH))
    at = np.zeros(len(x), np.int64)
    for node in range(inner):
        rows = np.flatnonzero(at == node)
        best = 1e-9
        if len(rows) >= 20:
            gs, hs = g[rows].sum(), h[rows].sum()
            for f in some:
                b = bins[rows, f]
                gl = np.cumsum(np.bincount(b, g[rows], BINS + 1))[: len(edges[f])]
                hl = np.cumsum(np.bincount(b, h[rows], BINS + 1))[: len(edges[f])]
                gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                gain[(hl < 2) | (hs - hl < 2)] = 0
                if len(gain) and gain.max() > best:
                    k = int(gain.argmax())
                    best, tree.feature[node], tree.cut[node] = gain[k], f, edges[f][k]
        at[rows] = 2 * node + 1 + (x[rows, tree.feature[node]] > tree.cut[node])
    for leaf in range(2**DEPTH):
        rows = at == inner + leaf
        tree.leaf[leaf] = -RATE * g[rows].sum() / (h[rows].sum() + 1)
    return tree


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def boost(x: np.ndarray, y: np.ndarray) -> tuple[float, list[Tree]]:
    """Trees on the logistic loss, cuts at quantiles of each feature.

    Every tree sees its own half of the features, so that a text with some of the signs is judged by all of them.
    """
    rng = np.random.default_rng(11)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    start = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    score, trees = np.full(len(y), start), []
    for _ in range(TREES):
        p = _sigmoid(score)
        some = np.sort(rng.permutation(x.shape[1])[: (x.shape[1] + 1) // 2])
        trees.append(_grow(x, bins, edges, p - y, p * (1 - p), some))
        score = score + trees[-1].predict(x)
    return start, trees


def isotonic(score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the knots of the non-decreasing function of ``score`` that is nearest to ``y``."""
    at, which = np.unique(score, return_inverse=True)
    total = np.bincount(which, weight)
    mean, weight = np.bincount(which, weight * y) / total, total
    blocks: list[list[float]] = []  # mean, weight, first and last score
    for s, v, w in zip(at, mean, weight, strict=True):
        blocks.append([float(v), float(w), float(s), float(s)])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            w2 = a[1] + b[1]
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / w2, w2, a[2], b[3]])
    knots = [(s, b[0]) for b in blocks for s in dict.fromkeys((b[2], b[3]))]
    return np.array([k[0] for k in knots]), np.array([k[1] for k in knots])


def pools(score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean score, mean label and weight of runs of rows by score, each of POOL rows or a twentieth of all; equal scores stay together."""
    order = np.argsort(score, kind="stable")
    score, y, weight = score[order], y[order], weight[order]
    size = max(1, min(POOL, len(y) // 20))
    last = np.searchsorted(score, score[np.minimum(np.arange(size, len(y) + size, size), len(y)) - 1], side="right")
    start = np.unique(np.concatenate([[0], last[:-1]]))
    start = start[start < len(y)]
    total = np.add.reduceat(weight, start)
    return np.add.reduceat(weight * score, start) / total, np.add.reduceat(weight * y, start) / total, total


@dataclass
class Model:
    learned: Lexicon = field(default_factory=Lexicon)
    start: float = 0.0
    trees: list[Tree] = field(default_factory=list)
    knots: tuple[np.ndarray, np.ndarray] | None = None

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for t in self.trees:
            out += t.predict(x)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.knots is None:
            return np.full(len(x), 0.0)
        return np.clip(np.interp(self.raw(x), *self.knots), 0, 1)


def train(texts: list[Text], labels: list[int], weights: dict[int, float] | None = None, seed: int = 3) -> Model:
    """Lexicon and trees from all labelled texts, calibration from scores that models of two thirds give the other third.

    ``weights`` say how many texts one of each class stands for. A text is never scored by a model that learned from it
    or from a near copy, so words that mark only the training texts gain nothing.
    """
    kept = _without_copies(texts)
    texts, labels = [texts[i] for i in kept], [labels[i] for i in kept]
    y = np.array(labels, float)
    if len(set(labels)) < 2:
        return Model()
    part = np.empty(len(y), int)
    for v in (0, 1):  # a third of each class in each part
        rows = np.random.default_rng(seed).permutation(np.flatnonzero(y == v))
        part[rows] = np.arange(len(rows)) % 3
    model = _fit(texts, y)
    raw = model.raw(np.array([features(t, model.learned) for t in texts]))
    for k in range(3):
        ins, out = np.flatnonzero(part != k), np.flatnonzero(part == k)
        if len(out) and len(set(y[ins])) == 2:
            m = _fit([texts[i] for i in ins], y[ins])
            raw[out] = m.raw(np.array([features(texts[i], m.learned) for i in out]))
    w = np.array([(weights or {}).get(int(v), 1.0) for v in y])
    model.knots = isotonic(*pools(raw, y, w))
    return model


def _fit(texts: list[Text], y: np.ndarray) -> Model:
    learned = learn_lexicon(texts, y)
    x = np.array([features(t, learned) for t in texts])
    return Model(learned, *boost(x, y))


def _fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % FOLDS


_SUMMARY = "doc_id long, t long, toxic int, words string, counts binary, near binary, kinds binary, marks array<long>"


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column("text").to_pylist()
        parts = [summary(x) for x in texts]
        cols = [b.column("doc_id"), b.column("t"), b.column("toxic"), pa.array([x.words for x in parts], pa.string())]
        cols += [pa.array([getattr(x, c).astype(np.int64).tobytes() for x in parts], pa.binary()) for c in ("counts", "near", "kinds")]
        cols.append(pa.array([_marks(x) for x in texts], pa.list_(pa.int64())))
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "t", "toxic", "words", "counts", "near", "kinds", "marks"])


def sample(docs: DataFrame, labels: DataFrame) -> tuple[list[Text], list[int], dict[int, float]]:
    """About SAMPLE_ROWS labelled texts of each class by the hash of their doc_id, none held out.

    Whole texts are summed up where they lie; the driver takes their distinct words and counts.
    """
    known = labels.filter(F.col("toxic").isin(0, 1) & (_fold(F.col("doc_id")) != HELD_OUT)).select("doc_id", F.col("toxic").cast("int"))
    counts = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    share = F.when(F.col("toxic") == 1, F.lit(min(1.0, SAMPLE_ROWS / max(1, counts.get(1, 0))))).otherwise(F.lit(min(1.0, SAMPLE_ROWS / max(1, counts.get(0, 0)))))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    some = known.filter(draw < share).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(some), "doc_id")
    rows = rows.select("doc_id", F.xxhash64("text").alias("t"), "text", "toxic").mapInArrow(_summaries, _SUMMARY).collect()
    rows = sorted(rows, key=lambda r: (r["doc_id"], r["t"], r["toxic"]))
    found = [Text(r["words"], *(np.frombuffer(r[c], np.int64) for c in ("counts", "near", "kinds")), tuple(r["marks"])) for r in rows]
    y = [r["toxic"] for r in rows]
    n = Counter(y)
    return found, y, {k: counts.get(k, 0) / max(1, n[k]) for k in (0, 1)}


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = np.array([features(t.as_py() or "", model.learned) for t in b.column(1)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x), pa.float64())], ["doc_id", "score"])

    return run


def score(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: ``doc_id, held_out, score, predicted``.

    Time grows with the length of texts and words alone. Without ``model`` one is learned from ``labels(doc_id, toxic)`` of 0 or 1 whose crc32(doc_id as text) does not leave
    1 by 3; the largest label of a doc_id counts. Features come from the whole text. Null texts count as empty, and
    empty texts get the score of a text without any of the features. Without labels of both classes every score is 0.
    """
    model = model or train(*sample(docs, labels))
    out = docs.select("doc_id", "text").mapInArrow(_score(model), "doc_id long, score double")
    held = F.coalesce(_fold(F.col("doc_id")) == HELD_OUT, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
