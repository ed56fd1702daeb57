"""Context-triggered piecewise hashing: rolling-hash boundaries, a sign per chunk, edit distance at compatible block sizes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch
from .hashing import Powers, sums

#: Bytes that decide on a boundary.
WINDOW = 7
MIN_BLOCK = 1
#: Chunks aimed at; the block size is MIN_BLOCK times a power of two.
LENGTH = 64
#: A chunk has a quarter of its block at least, and the block is halved so often at most: a signature has 32 * LENGTH signs at
#: most, however often a text repeats itself, and no text is cut.
LEAST_SHARE, MAX_HALVINGS = 4, 3

_SIGNS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_GEAR = np.random.default_rng(7).integers(0, 1 << 32, 256, np.uint32)
_POWERS = Powers(0x5851F42D4C957F2D)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


def _rolling(raw: np.ndarray) -> np.ndarray:
    """A hash of each byte and the six before it (fewer at the start)."""
    g = _GEAR[raw]
    out = g.copy()
    for k in range(1, min(WINDOW, len(raw))):
        out[k:] += g[:-k] * np.uint32(2 * k + 1) ** np.uint32(3)
    return _scramble(out)


def _apart(cut: np.ndarray, least: int) -> np.ndarray:
    """Those of the ascending places that lie ``least`` behind the one before them that was taken, or behind the start."""
    if least <= 1 or not len(cut) or (cut[0] >= least and (np.diff(cut) >= least).all()):
        return cut
    taken, at = [], 0
    if len(cut) < 4096:
        for c in cut.tolist():
            if c - at >= least:
                taken.append(c)
                at = c
    else:
        i = 0
        while (i := int(np.searchsorted(cut, at + least))) < len(cut):
            at = int(cut[i])
            taken.append(at)
    return np.array(taken, np.int64)


class _Text:
    """What the block sizes of a text share: its rolling hashes and the sums that give any chunk's hash (30 bytes a byte)."""

    def __init__(self, data: bytes) -> None:
        raw = np.frombuffer(data, np.uint8)
        self.n = len(raw)
        self.roll = _rolling(raw)
        self.sums, self.down = sums(raw.astype(np.uint64) + np.uint64(1), _POWERS)

    def signature(self, block: int) -> bytes:
        cut = _apart(np.flatnonzero(self.roll % np.uint32(block) == np.uint32(block - 1)) + 1, block // LEAST_SHARE)
        starts = np.concatenate([[0], cut])
        ends = np.concatenate([cut, [self.n]])
        if starts[-1] == self.n:
            starts, ends = starts[:-1], ends[:-1]
        h = (self.sums[ends] - self.sums[starts]) * self.down[starts]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return _SIGNS[(h >> np.uint64(58)).astype(np.int64)].tobytes()


def fingerprint(data: bytes) -> str:
    """``block:signs:signs at twice the block``. Equal bytes have equal fingerprints; no bytes give ``1::``.

    The block size is the smallest that would give LENGTH chunks of random bytes, halved until the first signature
    has half of them, MAX_HALVINGS times at most; no signature is cut, so every byte counts, and time grows with the
    length alone.
    """
    if not data:
        return f"{MIN_BLOCK}::"
    text, block = _Text(data), MIN_BLOCK
    while block * LENGTH < text.n:
        block *= 2
    one, least = text.signature(block), max(MIN_BLOCK, block >> MAX_HALVINGS)
    while len(one) < LENGTH // 2 and block > least:
        block //= 2
        one = text.signature(block)
    return f"{block}:{one.decode()}:{text.signature(2 * block).decode()}"


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: one less the edit distance over the longer signature, the best over block sizes that both have.

    Equal fingerprints give 1, those without a common block size 0.
    """
    x, y = F.split(a, ":"), F.split(b, ":")
    bx, by = x[0].cast("long"), y[0].cast("long")

    def alike(s: Column, t: Column) -> Column:
        most = F.greatest(F.length(s), F.length(t))
        return F.when(most == 0, F.lit(1.0)).otherwise(F.lit(1.0) - F.levenshtein(s, t) / most)

    best = (
        F.when(bx == by, F.greatest(alike(x[1], y[1]), alike(x[2], y[2])))
        .when(bx == 2 * by, alike(x[1], y[2]))
        .when(by == 2 * bx, alike(x[2], y[1]))
        .otherwise(F.lit(0.0))
    )
    return F.when(a == b, F.lit(1.0)).otherwise(best)


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by as many of the beginning of the next document, or all of it."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


_COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string"


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(part, edge, own, text)`` in order, ``own`` the doc_id as given; the last of each part, with ``edge`` set, only follows the others."""
    names = [x.split()[0] for x in _COLUMNS.split(", ")]
    last: tuple | None = None
    for b in batches:
        out: list[tuple] = []
        texts = b.column(3)
        for i, (part, edge, doc_id) in enumerate(zip(*(b.column(k).to_pylist() for k in range(3)), strict=True)):
            text = texts[i].as_py() or ""
            mark = fingerprint(text.encode())
            if last is not None and last[0] == part:
                _, _, id_, before, mark_ = last
                new = edited(before, text).encode()
                out.append((id_, len(before), hashlib.sha256(new).hexdigest(), mark_, fingerprint(new), mark))
            last = (part, edge, doc_id, text, mark)
        cols = list(zip(*out, strict=True)) or [()] * len(names)
        kinds = [pa.int64(), pa.int64(), *[pa.string()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def _below(cuts: list[int], step: int = 256) -> Column:
    """How many of the sorted cuts lie below doc_id: first among every ``step``-th one, then in the stretch found."""
    if not cuts:
        return F.lit(0)

    def lower(xs: Column) -> Column:
        return F.size(F.filter(xs, lambda c: c < F.col("doc_id")))

    coarse = lower(F.lit(cuts[step - 1 :: step])) if len(cuts) >= step else F.lit(0)
    return coarse * step + lower(F.slice(F.lit(cuts), coarse * step + 1, step))


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``, with the next document by ascending doc_id (the first after the last).

    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``. Null text is empty. Null
    doc_ids come first, and rows that share a doc_id are ordered by their text's hash; a single row follows itself. An
    empty table gives no rows. Long texts are taken whole, in time that grows with their length. Documents are dealt out by doc_id range in one shuffle, and each range also gets the
    first document of the next one: as many extra rows as ranges.
    """
    spark = docs.sparkSession
    doc_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(doc_id.alias("doc_id"), "text", F.col("doc_id").cast("long").alias("own"))
    ids = rows.select("doc_id")
    n = ids.count()
    if not n:
        return spark.createDataFrame([], "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    tasks = scratch.tasks(docs)
    parts = max(1, min(4 * tasks, n // 16))
    cuts = ids.select(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 100 * parts)).first()[0] if parts > 1 else []
    cuts = sorted(set(cuts))
    least = _below(cuts)
    ids = ids.withColumn("part", least)
    heads = ids.groupBy("part").agg(F.min("doc_id").alias("doc_id")).collect()  # a row for each part
    heads = sorted((r["part"], r["doc_id"]) for r in heads)
    before = [(heads[i - 1][0], h) for i, (_, h) in enumerate(heads)]
    edge = spark.createDataFrame(before, "part int, first_id long")
    first = rows.join(F.broadcast(edge), rows.doc_id == edge.first_id).groupBy("part", "doc_id")
    place = F.struct(F.col("own").isNotNull(), F.xxhash64("text"))
    first = first.agg(F.min_by(F.struct("text"), place).alias("x"))
    first = first.select("part", F.lit(1).alias("edge"), "doc_id", F.col("x.text").alias("text"), F.lit(None).cast("long").alias("own"))
    all_rows = rows.select(least.alias("part"), F.lit(0).alias("edge"), "doc_id", "text", "own").union(first)
    ordered = all_rows.repartition(tasks, "part").sortWithinPartitions("part", "edge", "doc_id", place)
    out = ordered.select("part", "edge", "own", "text").mapInArrow(_chain, _COLUMNS)
    return out.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
