"""Language ID: a bidirectional gated recurrent network over bytes, trained in numpy by backpropagation through time."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workers import lean

#: Bytes of a window; the network starts anew at each, in both directions.
STEPS = 64
HIDDEN = 8
#: Windows that a worker runs side by side.
WIDE = 4096
#: Rows that a worker predicts, and in the pipeline returns, together.
ROWS = 1024
#: The bounded training sample: so many documents of each language, so many windows of each. Where there are so many languages
#: that this makes more than MANY_DOCS, each has fewer, but LEAST_DOCS at least, so that none is without.
SAMPLE_DOCS = 400
SAMPLE_WINDOWS = 6
MANY_DOCS = 25_600
LEAST_DOCS = 25
UPDATES = 260
BATCH = 256
FOLDS = 5
UNKNOWN = "und"
#: In the pipeline a document goes if it has no letter or if no language gets more than this.
MIN_SCORE = 0.3


@dataclass
class Gru:
    """One direction. ``e``: what each byte adds to the three gates, ``u``: what the state adds, ``c``: the candidate's bias."""

    e: np.ndarray
    u: np.ndarray
    c: np.ndarray

    def run(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States after each of the steps of ``x`` (steps, windows): (steps, hidden, windows)."""
        hid, n = len(self.c), x.shape[1]
        h = np.zeros((hid, n), np.float32)
        out = np.empty((len(x), hid, n), np.float32)
        g = np.empty((3 * hid, n), np.float32)
        half = np.float32(0.5)
        for t in range(len(x)):
            np.take(self.e, x[t], axis=1, out=g)
            m = self.u @ h
            zr = g[: 2 * hid]
            zr += m[: 2 * hid]
            zr *= half
            np.tanh(zr, out=zr)
            zr *= half
            zr += half
            z, r = zr[:hid], zr[hid:]
            mn = m[2 * hid :]
            mn += self.c
            a = g[2 * hid :]
            a += r * mn
            np.tanh(a, out=a)
            if keep is not None:
                keep.append((h, z.copy(), r.copy(), a.copy(), mn))
            d = h - a
            d *= z
            h = np.add(a, d, out=out[t])
        return out

    def back(self, x: np.ndarray, keep: list, dout: np.ndarray) -> list[np.ndarray]:
        """Gradients of ``e``, ``u`` and ``c`` from those of the states."""
        hid, n = len(self.c), x.shape[1]
        dh, du, dc = np.zeros((hid, n), np.float32), np.zeros_like(self.u), np.zeros_like(self.c)
        dg = np.empty((len(x), 3 * hid, n), np.float32)
        for t in reversed(range(len(x))):
            h, z, r, a, mn = keep[t]
            dh = dh + dout[t]
            da = dh * (1 - z) * (1 - a * a)
            dg[t, :hid] = dh * (h - a) * z * (1 - z)
            dg[t, hid : 2 * hid] = da * mn * r * (1 - r)
            dg[t, 2 * hid :] = da
            dm = dg[t].copy()
            dm[2 * hid :] *= r
            dc += dm[2 * hid :].sum(axis=1, keepdims=True)
            du += dm @ h.T
            dh = dh * z + self.u.T @ dm
        flat = x.ravel()
        de = np.stack([np.bincount(flat, dg[:, k].ravel(), 256) for k in range(3 * hid)]).astype(np.float32)
        return [de, du, dc]


@dataclass
class Model:
    langs: list[str]
    forth: Gru
    back: Gru
    w: np.ndarray
    b: np.ndarray

    def states(self, x: np.ndarray, keep: tuple[list, list] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Of the text before and with each position, and of the text from it on."""
        f, b = keep or (None, None)
        return self.forth.run(x, f), self.back.run(x[::-1], b)[::-1]

    def chances(self, f: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The probabilities of one step, (languages, windows), from the states of both directions there."""
        k = self.w.shape[1] // 2
        p = self.w[:, :k] @ f
        p += self.w[:, k:] @ b
        p += self.b
        p -= p.max(axis=0)
        np.exp(p, out=p)
        p /= p.sum(axis=0)
        return p

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """The mean over all positions of each text, (texts, languages); a text without a byte has zeros."""
        out = np.zeros((len(texts), len(self.langs)))
        if not self.langs:
            return out
        sizes = np.array([len(t) for t in texts], np.int64)
        raw = np.frombuffer(b"".join(texts) + bytes(STEPS), np.uint8)
        windows = -(-sizes // STEPS)
        of = np.repeat(np.arange(len(texts)), windows)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
        start = (np.cumsum(sizes) - sizes)[of] + nth * STEPS
        length = np.minimum(sizes[of] - nth * STEPS, STEPS)
        step = np.arange(STEPS)[:, None]
        for i in range(0, len(of), WIDE):
            s, n, o = start[i : i + WIDE], length[i : i + WIDE], of[i : i + WIDE]
            inside = step < n
            x = raw[s + step]
            x[~inside] = 0
            sums = np.zeros((len(self.langs), x.shape[1]), np.float32)
            for t, (f, b) in enumerate(zip(*self.states(x), strict=True)):
                p = self.chances(f, b)
                p *= inside[t]
                sums += p
            for k in range(len(self.langs)):
                out[:, k] += np.bincount(o, sums[k], len(texts))
        return out / np.maximum(sizes, 1)[:, None]


def _windows(text: bytes) -> list[bytes]:
    """Up to SAMPLE_WINDOWS windows, spread evenly over the text."""
    n = max(1, -(-len(text) // STEPS))
    at = sorted({round(i * (n - 1) / max(1, SAMPLE_WINDOWS - 1)) for i in range(SAMPLE_WINDOWS)})
    return [text[i * STEPS : (i + 1) * STEPS] for i in at]


def train(sample: list[tuple[str, bytes]], seed: int = 5) -> Model:
    """A model of the languages in ``sample`` by Adam on the cross-entropy of every position, languages drawn evenly."""
    langs = sorted({x[0] for x in sample})
    data = [(langs.index(lang), w) for lang, text in sample for w in _windows(text) if w]
    rng = np.random.default_rng(seed)
    f32 = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
    gru = lambda: Gru(f32(3 * HIDDEN, 256), f32(3 * HIDDEN, HIDDEN), np.zeros((HIDDEN, 1), np.float32))
    model = Model(langs, gru(), gru(), f32(len(langs), 2 * HIDDEN), np.zeros((len(langs), 1), np.float32))
    if len(langs) < 2 or not data:
        return model
    label = np.array([x[0] for x in data])
    size = np.array([len(x[1]) for x in data])
    raw = np.stack([np.frombuffer(w.ljust(STEPS, b"\0"), np.uint8) for _, w in data]).T
    chance = 1 / np.bincount(label, minlength=len(langs))[label]
    params = [model.forth.e, model.forth.u, model.forth.c, model.back.e, model.back.u, model.back.c, model.w, model.b]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for k in range(1, UPDATES + 1):
        pick = rng.choice(len(data), BATCH, p=chance / chance.sum())
        x, keep = np.ascontiguousarray(raw[:, pick]), ([], [])
        hf, hb = model.states(x, keep)
        h = np.concatenate([hf, hb], axis=1)
        p = np.matmul(model.w, h) + model.b
        p = np.exp(p - p.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[:, label[pick], np.arange(BATCH)] -= 1
        inside = np.arange(STEPS)[:, None] < size[pick]
        d = p * inside[:, None] / np.float32(inside.sum())
        dw, db = np.einsum("tln,thn->lh", d, h), d.sum(axis=(0, 2))[:, None]
        dh = np.matmul(model.w.T, d)
        grads = [*model.forth.back(x, keep[0], dh[:, :HIDDEN]), *model.back.back(x[::-1], keep[1], dh[::-1, HIDDEN:]), dw, db]
        rate = 0.03 * min(1.0, 2 * (1 - k / (UPDATES + 1)))
        for v, g, a, b in zip(params, grads, first, second, strict=True):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            v -= (rate * (a / (1 - 0.9**k)) / (np.sqrt(b / (1 - 0.99**k)) + 1e-8)).astype(np.float32)
    return model


def _fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % FOLDS


def sample(docs: DataFrame) -> list[tuple[str, bytes]]:
    """About SAMPLE_DOCS labelled texts of every language by the hash of their doc_id, none of them held out.

    The only place where texts are cut: training sees windows of them, spread over the whole text.
    """
    known = docs.filter(F.col("lang").isNotNull() & (_fold(F.col("doc_id")) != 0))
    counts = [(r["lang"], r["count"]) for r in known.groupBy("lang").count().collect()]
    each = min(SAMPLE_DOCS, max(LEAST_DOCS, MANY_DOCS // max(1, len(counts))))
    # an Arrow table becomes a local relation; rows of Python objects would start a second set of workers on the executors
    shares = pa.table({"lang": pa.array([lang for lang, _ in counts], pa.string()), "share": pa.array([min(1.0, each / n) for _, n in counts], pa.float64())})
    shares = known.sparkSession.createDataFrame(shares)
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    n = F.octet_length("text")
    at = [F.substring(text, (F.lit(i / max(1, SAMPLE_WINDOWS - 1)) * F.greatest(n - STEPS, F.lit(0))).cast("int") + 1, STEPS) for i in range(SAMPLE_WINDOWS)]
    part = F.when(n <= STEPS * SAMPLE_WINDOWS, text).otherwise(F.concat(*at))
    rows = known.join(F.broadcast(shares), "lang").filter(draw < F.col("share")).select("lang", part.alias("text"), F.xxhash64("doc_id").alias("h")).collect()
    return [(r["lang"], bytes(r["text"] or b"")) for r in sorted(rows, key=lambda r: (r["h"], r["lang"], bytes(r["text"] or b"")))]


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                part = b.slice(i, ROWS)
                texts = [x or "" for x in part.column(1).to_pylist()]
                p = model.pooled([t.encode() for t in texts])
                best = p.argmax(axis=1) if model.langs else np.zeros(len(texts), int)
                known = [bool(model.langs) and any(map(str.isalpha, t)) for t in texts]
                lang = [model.langs[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), known, strict=True)]
                score = [min(1.0, float(p[j, k])) if ok else 0.0 for j, (k, ok) in enumerate(zip(best.tolist(), known, strict=True))]
                cols = [part.column(0), part.column(2), pa.array(lang), pa.array(score, pa.float64())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "t", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per row of ``docs(doc_id, text, lang, ...)``: ``doc_id, t, held_out, lang_pred, score``.

    Without ``model`` one is trained on the labelled rows whose crc32(doc_id as text) leaves a remainder by 5; the
    prediction uses every byte of the text and nothing else. Null texts and texts without a letter are ``und`` with
    score 0, as is everything where nothing can be learned. A null doc_id is never trained on and not held out.
    """
    model = model or train(sample(docs))
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("t"))
    out = rows.mapInArrow(lean(_predict(model)), "doc_id long, t long, lang_pred string, score double")
    held = F.coalesce(_fold(F.col("doc_id")) == 0, F.lit(False))
    return out.select("doc_id", "t", held.alias("held_out"), "lang_pred", "score")


def _keep(model: Model, min_score: float):
    score = _predict(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, ROWS):  # never a second copy of a whole batch
                part = b.slice(i, ROWS)
                rows = pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), part.column("doc_id")], ["doc_id", "text", "t"])
                found = [y for x in score(iter([rows])) for y in zip(x.column("lang_pred").to_pylist(), x.column("score").to_pylist(), strict=True)]
                yield part.filter(pa.array([lang != UNKNOWN and s > min_score for lang, s in found], pa.bool_()))

    return run


def keep_identified(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """``docs`` without the documents that have no letter or no language above ``min_score``; all columns are kept."""
    return docs.mapInArrow(lean(_keep(train(sample(docs)), min_score)), docs.schema)
