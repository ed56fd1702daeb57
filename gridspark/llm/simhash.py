"""SimHash near-duplicates: segment-popcount embedding, grid join under Manhattan distance, exact check."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch
from .components import components
from .workers import lean

SEED = 42
WORDS = 4
MAX_BITS = 4
#: A larger cell is cut into blocks of so many fingerprints, and each pair of blocks becomes a task of its own.
CELL_BLOCK = 1 << 16
#: A cell beyond it is dense: what SCANS scans leave of it is dealt out by bits before pairs are compared.
DENSE = 1 << 10
SCANS = 64
PAIRS_UP_TO = 16
#: Grid points that a fingerprint is sent to, on average.
POINTS = 38


def fingerprint(data: bytes) -> int:
    """64-bit SimHash of UTF-8 text as a signed long: A-Z lower-cased, 4-word shingles with repeats, XXH64 seed 42.

    Fewer than four words make one shingle; no word gives zero. A bit is set if over half the shingles have it.
    """
    words = data.lower().split()  # bytes: only A-Z change, and only \x20 \x09-\x0D separate
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= WORDS:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
        starts = [0, *(gaps[: len(words) - WORDS] + 1).tolist()]
        ends = [*gaps[WORDS - 1 :].tolist(), len(joined)]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)]
    n, counts = len(hashes), np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        part = np.array(hashes[i : i + (1 << 16)], "<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(1).cast(pa.binary())
        fp = pa.array([fingerprint(x.as_py() or b"") for x in texts], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), fp], ["doc_id", "t", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, t, fp)`` of every document; ``t`` is a hash of the text that tells rows of one doc_id apart."""
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("t"))
    return rows.select("doc_id", "text", "t").mapInArrow(lean(_fingerprints), "doc_id long, t long, fp long")


def cells(fps: DataFrame) -> DataFrame:
    """``(cell, fp)``: the points of the grid of popcounts where each fingerprint meets those within range.

    The embedding is the 32 counts of the two-bit segments, packed in a long. Of a Manhattan distance of 4 or less, the
    lower 16 counts hold 2 at most or the upper 16 hold 1 at most. Below, a fingerprint goes to its point and all next to
    it, so that two within 2 share one between them. Above, only those of an even sum go to the points next to theirs, as
    neighbours never have equal parities. Some 25 and 13 points, however many fingerprints there are.
    """
    odd = F.lit(0x5555555555555555)
    half = F.shiftrightunsigned("fp", 1)
    ones = F.col("fp").bitwiseXOR(half).bitwiseAND(odd)
    twos = F.shiftleft(F.col("fp").bitwiseAND(half).bitwiseAND(odd), 1)
    rows = fps.select("fp", ones.bitwiseOR(twos).alias("e"))
    rows = rows.select("fp", F.col("e").bitwiseAND(F.lit(0xFFFFFFFF)).alias("lower"), F.shiftrightunsigned("e", 32).alias("upper"))

    def around(point: Column, also: Column | None = None) -> list[Column]:
        out = []
        for i in range(0, 32, 2):
            count, step = F.shiftright(point, i).bitwiseAND(F.lit(3)), F.lit(1 << i)
            for fits, to in ((count < 2, point + step), (count > 0, point - step)):
                out.append(F.when(fits if also is None else fits & also, to))
        return out

    lower, upper = F.col("lower"), F.col("upper") + F.lit(1 << 32)
    even = F.bit_count(F.col("upper").bitwiseAND(odd)) % 2 == 0
    return rows.select(F.explode(F.array_compact(F.array(lower, *around(lower), upper, *around(upper, even)))).alias("cell"), "fp")


def _embed(v: np.ndarray) -> np.ndarray:
    odd, half = np.uint64(0x5555555555555555), v >> np.uint64(1)
    return ((v ^ half) & odd) | (((v & half) & odd) << np.uint64(1))


def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of uint64 fingerprints differ in 4 bits or fewer: Manhattan distance of the popcounts first."""
    odd = np.uint64(0x5555555555555555)
    x = _embed(a) ^ _embed(b)
    low, high = x & odd, (x >> np.uint64(1)) & odd
    bound = np.bitwise_count(low) + 2 * np.bitwise_count(high & ~low)  # of 0, 1, 2: 01 and 11 differ by one, 10 by two
    ok = bound <= MAX_BITS
    ok[ok] = np.bitwise_count(a[ok] ^ b[ok]) <= MAX_BITS
    return ok


def _scan(v: np.ndarray, scans: int | None = None) -> tuple[list, list, np.ndarray]:
    """Links along which near pairs connect ``v``, no more than there are points, and the points not compared after ``scans``."""
    a, b, left, todo = [], [], np.unique(v), []
    while len(left) and scans != 0:
        scans = None if scans is None else scans - 1
        if not todo:
            todo, left = [left[0]], left[1:]
        x = todo.pop()
        hit = near(np.full(len(left), x, np.uint64), left)
        if hit.any():
            found = left[hit]
            a.append(np.full(len(found), x, np.uint64))
            b.append(found)
            todo.extend(found)
            left = left[~hit]
    return a, b, np.concatenate([np.array(todo, np.uint64), left]) if len(left) else left


def _spanning(v: np.ndarray) -> tuple[list, list]:
    """Links that connect all of ``v`` that are connected by near pairs: no more than there are points."""
    return _scan(v)[:2]


def _pairs(key: np.ndarray, v: np.ndarray) -> tuple[list, list]:
    """Links between points of equal key, rows in the order of the key: all near pairs of up to PAIRS_UP_TO, spanning links of more."""
    if not len(key):
        return [], []
    at = _runs(key)
    size = np.diff(at)
    of = np.repeat(size, size)
    small = (of >= 2) & (of <= PAIRS_UP_TO)
    c, w = key[small], v[small]
    a, b = [], []
    for d in range(1, PAIRS_UP_TO):
        if len(c) <= d:
            break
        i = np.flatnonzero(c[d:] == c[:-d])
        if not len(i):
            break
        ok = i[near(w[i], w[i + d])]
        a.append(w[ok])
        b.append(w[ok + d])
    for k in np.flatnonzero(size > PAIRS_UP_TO):
        x, y = _spanning(v[at[k] : at[k + 1]])
        a += x
        b += y
    return a, b


def _linked(v: np.ndarray, dense: int) -> Iterator[tuple[list, list]]:
    """Links that connect all of a cell that near pairs connect.

    Scans take large groups of near copies apart quickly, but are quadratic in unlike points. What they leave of a dense cell
    is dealt out by 4 of 8 bytes, in all 70 ways: of 8, four at least are equal where 4 bits differ.
    """
    a, b, rest = _scan(v, None if len(v) <= dense else SCANS)
    yield a, b
    if len(rest):
        for some in itertools.combinations(range(8), 8 - MAX_BITS):
            key = rest & np.uint64(sum(255 << 8 * i for i in some))
            order = np.argsort(key)
            yield _pairs(key[order], rest[order])


def _runs(cell: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1], [True]]))


def _cell_links(batches: Iterator[pa.RecordBatch], dense: int = DENSE) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell -> links (kind 0: a, b), or for a cell beyond CELL_BLOCK its rows by block (kind 1: cell, fp, block)."""
    names = ["kind", "a", "b", "block"]

    def out(kind: int, a: np.ndarray, b: np.ndarray, block: np.ndarray | None = None) -> pa.RecordBatch:
        block = np.zeros(len(a), np.int32) if block is None else block
        cols = [pa.array(np.full(len(a), kind, np.int32)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(block)]
        return pa.RecordBatch.from_arrays(cols, names)

    def solve(cell: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Whole cells of CELL_BLOCK rows or fewer each."""
        if not len(cell):
            return
        size = np.diff(_runs(cell))
        of = np.repeat(size, size)
        small = of <= PAIRS_UP_TO
        found = itertools.chain([_pairs(cell[small], fp[small])], *(_linked(x, dense) for x in np.split(fp[~small], np.cumsum(size[size > PAIRS_UP_TO])[:-1])))
        for a, b in found:
            if a and (a := np.concatenate(a)).size:
                yield out(0, a, np.concatenate(b))

    c0, v0, big, sent = np.empty(0, np.int64), np.empty(0, np.uint64), None, 0
    for batch in batches:
        cell = np.concatenate([c0, batch.column(0).to_numpy(zero_copy_only=False)])
        fp = np.concatenate([v0, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
        if not len(cell):
            continue
        last = _runs(cell)[-2]
        if big is not None:  # a cell that already went beyond the limit goes on by blocks
            n = int(np.searchsorted(cell != big, True)) if (cell != big).any() else len(cell)
            if n:
                yield out(1, cell[:n], fp[:n], ((sent + np.arange(n)) // CELL_BLOCK).astype(np.int32))
            sent += n
            cell, fp = cell[n:], fp[n:]
            if not len(cell):
                c0, v0 = cell, fp
                continue
            big, last = None, _runs(cell)[-2]
        yield from _split(cell[:last], fp[:last], solve, out)
        c0, v0 = cell[last:], fp[last:]
        if len(c0) > CELL_BLOCK:
            big, sent = c0[0], len(c0)
            yield out(1, c0, v0, (np.arange(sent) // CELL_BLOCK).astype(np.int32))
            c0, v0 = c0[:0], v0[:0]
    yield from _split(c0, v0, solve, out)


def _split(cell: np.ndarray, fp: np.ndarray, solve, out) -> Iterator[pa.RecordBatch]:
    if not len(cell):
        return
    at = _runs(cell)
    size = np.diff(at)
    for k in np.flatnonzero(size > CELL_BLOCK):
        n = int(size[k])
        yield out(1, cell[at[k] : at[k + 1]], fp[at[k] : at[k + 1]], (np.arange(n) // CELL_BLOCK).astype(np.int32))
    keep = np.repeat(size, size) <= CELL_BLOCK
    yield from solve(cell[keep], fp[keep])


def links(fps: DataFrame, dense: int = DENSE) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints that connect all that differ in 4 bits or fewer.

    Fingerprints that meet in a cell of the grid are within range in half of the counts; the distance of all counts, then
    that of the bits decide. Every link is a true near pair. Cells of up to 16 give all their near pairs, larger ones
    spanning links, those beyond ``dense`` by parts; a cell beyond CELL_BLOCK is cut into blocks, and every pair of its
    blocks is solved on its own.
    """

    def of_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _cell_links(batches, dense)

    def of_blocks(key, rows: pa.Table) -> pa.Table:
        found = np.empty((0, 2), np.int64)
        for a, b in _linked(rows.column("fp").to_numpy().view(np.uint64), dense):
            if a:
                found = np.unique(np.concatenate([found, np.stack([np.concatenate(a), np.concatenate(b)], 1).view(np.int64)]), axis=0)
        return pa.table({"a": found[:, 0], "b": found[:, 1]})

    dealt = cells(fps)
    dealt = dealt.repartition(scratch.tasks(fps, POINTS), "cell").sortWithinPartitions("cell")
    found = scratch.table(dealt.mapInArrow(lean(of_cells), "kind int, a long, b long, block int"), "links")
    out = found.filter("kind = 0").select("a", "b").distinct()
    big = found.filter("kind = 1").select(F.col("a").alias("cell"), F.col("b").alias("fp"), "block")
    if not big.isEmpty():
        n = big.groupBy("cell").agg((F.max("block") + 1).alias("n"))
        each = big.join(n, "cell").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        each = each.select("cell", "fp", F.least("block", "j").alias("i"), F.greatest("block", "j").alias("j"))
        out = out.union(each.groupBy("cell", "i", "j").applyInArrow(of_blocks, "a long, b long")).distinct()
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: ``doc_id, t, fp, component_id, component``.

    Fingerprints of 4 or fewer differing bits are linked; ``component_id`` is the smallest doc_id of the connected
    component, ``component`` a hash that names it. Null text counts as empty; texts without a word have fingerprint zero and are linked like any other.
    Rows that repeat a doc_id each keep a row; null doc_ids are never the smallest unless a component has no other.
    Other columns are ignored. An empty table gives no rows.
    """
    rows = scratch.table(fingerprints(docs), "fingerprints")
    fps = scratch.table(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    of = components(links(fps.select("fp")))
    linked = fps.join(of, fps.fp == of.node).select("fp", "least", "root")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = scratch.table(linked.select("fp", "root").join(least, "root").select("fp", "root", "component_id"), "by_fp")
    group, smallest = F.coalesce("root", F.xxhash64("fp")), F.coalesce("component_id", "least")
    named = fps.join(by_fp, "fp", "left").select("fp", smallest.alias("component_id"), group.alias("component"))
    return rows.join(named, "fp", "left").select("doc_id", "t", "fp", "component_id", "component")


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each near-duplicate component: that of the smallest doc_id, then of the smallest text hash.

    A null doc_id is taken only where a component has no other. Columns are those of ``docs``.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "t"))
    kept = near_duplicates(docs).groupBy("component").agg(first.alias("k"))
    kept = kept.select(_key(F.col("k.doc_id")).alias("id"), F.col("k.t").alias("t")).distinct()
    rows = docs.select(F.struct("*").alias("row"), _key(F.col("doc_id")).alias("id"), F.xxhash64("text").alias("t"))
    return rows.join(kept, ["id", "t"], "left_semi").dropDuplicates(["id", "t"]).select("row.*")


def _key(doc_id):
    return F.coalesce(doc_id.cast("long"), F.lit(-(1 << 63)))
