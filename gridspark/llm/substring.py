"""Substring dedup: a De Bruijn graph of token k-mers, compacted to paths whose words are compared at their source.

A k-mer of 35 words is an edge between its first and its last 34 words.

1. Edges are dealt out by their minimizer, the smallest-hashed 8-gram in them, so that equal edges meet in one group
   whatever document they are from; neighbouring edges of a document with the same minimizer occurrence travel as one row,
   a piece of up to 28 edges. In a group the edges that occur again are found, and neighbours among them join to a segment
   where neither end of the join branches: wherever the one edge occurs the other one follows it, and the other way round.
2. Segments are the edges of the graph that is compacted through Spark joins: every segment's only successor and only
   predecessor come from an aggregate over the source coordinates, and two segments are one path where each is the other's
   only neighbour in every document.
3. A path's words at each of its source coordinates are digested where the text lies, and only occurrences that share all
   their words with another one count. Should two occurrences of a path differ (equal hashes of unlike words), its edges
   are compared one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch
from .hashing import Powers, mix, sums, word_hashes
from .workers import lean, release, small_batches

K = 35
SEED_WORDS = 8
#: A group of more pieces than this is not gathered in one task but counted edge by edge in Spark.
MAX_GROUP = 200_000
#: So many minimizers of such groups are known beforehand; the groups of others leave the streaming pass when they pass the limit.
MAX_HOT = 100_000
#: Pieces that others are known to equal are broadcast up to so many, of about 100 bytes each; beyond it the join has so many salts.
MAX_BROADCAST = 20_000
SALTS = 16
#: Texts are hashed together up to about so many bytes.
BATCH_BYTES = 1 << 19
#: So many bytes of a task's text are searched for equal pieces before they are dealt out.
COMBINE_BYTES = 32 << 20
#: Bytes of an edge's hash that are sent; what they take for equal is compared by its words afterwards.
EDGE_BYTES = 6

_WORDS, _SEEDS = Powers(0xD6E8FEB86659FD93), Powers(0xA0761D6478BD642F)


def _runs_of(h: np.ndarray, n: int, powers: Powers) -> np.ndarray:
    """A hash of every ``n`` following values."""
    total, down = sums(h, powers)
    return mix((total[n:] - total[:-n]) * down[: len(h) - n + 1])


def _sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    width, out = 1, x
    while 2 * width <= n:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    return np.minimum(out[: len(x) - n + 1], out[n - width : n - width + len(x) - n + 1])


def pieces(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes and their document's number, ascending -> pieces: first word, edges, minimizer; and all edges' hashes.

    The minimizer of a window is the leftmost of its 8-grams whose hash has the smallest 40 leading bits, a function of
    the window's words alone. Windows over two documents are left out.
    """
    empty = np.empty(0, np.int64)
    if len(h) < K:
        return empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    seeds, low = _runs_of(h, SEED_WORDS, _SEEDS), np.uint64((1 << 24) - 1)
    at = np.arange(len(seeds), dtype=np.uint64)
    least = (_sliding_min(seeds & ~low | at, K - SEED_WORDS + 1) & low).astype(np.int64)
    whole = doc[: len(h) - K + 1] == doc[K - 1 :]
    first = whole.copy()
    first[1:] &= (least[1:] != least[:-1]) | ~whole[:-1] | (doc[1 : len(whole)] != doc[: len(whole) - 1])
    edges = _runs_of(h, K, _WORDS)[whole]
    start = np.flatnonzero(first)
    count = np.diff(np.append(np.flatnonzero(first[whole]), len(edges)))
    return start, count, seeds[least[start]], edges


_SENT = ["key", "kind", "doc_id", "t", "s", "p", "m", "edges"]
_SENT_SCHEMA = "key long, kind int, doc_id long, t long, s int, p long, m long, edges binary"
#: Rows that are dealt out: a piece for its group; one of a group that is too large; one that is known to repeat piece ``p``.
NORMAL, HOT, SPARE, KNOWN = range(4)


def _portions(batches: Iterator[pa.RecordBatch], edge_bytes: int = 0) -> Iterator[dict]:
    """``(doc_id, t, text)`` -> the pieces of COMBINE_BYTES of text: row, first word, count and minimizer of each, and which copy it is.

    ``doc_id`` and ``t`` are by row. ``edges`` has ``edge_bytes`` of each edge's hash, in parts as they were hashed; part
    ``i`` is of the pieces from ``bounds[i]`` to ``bounds[i + 1]``. A portion is emptied before the next one is made.
    """
    found, ids, rows, size = [], [], 0, 0
    for b in batches:
        texts = b.column(2).cast(pa.binary())
        i = 0
        while i < len(texts):
            part, n, j = [], 0, i
            while j < len(texts) and n < BATCH_BYTES:
                part.append(texts[j].as_py() or b"")
                n += len(part[-1]) + 1
                j += 1
            found += _of_texts(part, rows, edge_bytes)
            ids.append([np.array(b.column(c).slice(i, j - i)) for c in (0, 1)])  # copies, which do not hold the batch
            i, rows, size = j, rows + j - i, size + n
            if size >= COMBINE_BYTES:
                yield from _portion(found, ids)
                rows = size = 0
    yield from _portion(found, ids)


def _portion(found: list[tuple[np.ndarray, ...]], ids: list[list[np.ndarray]]) -> Iterator[dict]:
    if found:
        doc_id, t = map(np.concatenate, zip(*ids, strict=True))
        x = _with_copies(found) | {"doc_id": doc_id, "t": t}
        yield x
        x.clear()
    ids.clear()
    release()


def _of_texts(part: list[bytes], i: int, edge_bytes: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Row, first word, edges, minimizer, first and last edge of every piece of the texts from row ``i`` on, and ``edge_bytes`` of all edges' hashes."""
    starts, _, h = word_hashes(b"\n".join(part))
    bounds = np.cumsum([0, *(len(x) + 1 for x in part)])
    doc = np.searchsorted(bounds, starts, side="right") - 1
    head = np.searchsorted(doc, np.arange(len(part)))
    step = 1 << 23  # positions fit the 24 low bits of a minimizer's key
    for a in range(0, max(len(h) - K + 1, 0), step):
        z = min(len(h), a + step + K - 1)
        start, count, m, edges = pieces(h[a:z], doc[a:z])
        if len(start):
            d, ends = doc[start + a], np.cumsum(count)
            short = np.ascontiguousarray(edges.view(np.uint8).reshape(-1, 8)[:, :edge_bytes])  # little-endian
            yield (d + i).astype(np.int32), (start + a - head[d]).astype(np.int32), count.astype(np.int32), m, edges[ends - count], edges[ends - 1], short


def _with_copies(found: list[tuple[np.ndarray, ...]]) -> dict:
    """``nth`` counts equal pieces from 0, ``n`` says how many there are, ``p`` names them: the first edge, the last and the number tell pieces apart.

    ``found`` is emptied.
    """
    edges = [x[-1] for x in found]
    bounds = np.cumsum([0, *(len(x[0]) for x in found)]).tolist()
    row, s, count, m, first, last = (np.concatenate([x[i] for x in found]) for i in range(6))
    found.clear()
    order = np.lexsort((np.arange(len(m)), last, first, count))
    f, z, c = first[order], last[order], count[order]
    at = np.flatnonzero(np.concatenate([[True], (f[1:] != f[:-1]) | (z[1:] != z[:-1]) | (c[1:] != c[:-1])]))
    del f, z, c
    size = np.diff(np.append(at, len(m)))
    nth, n = np.empty(len(m), np.int32), np.empty(len(m), np.int32)
    nth[order], n[order] = np.arange(len(m)) - np.repeat(at, size), np.repeat(size, size)
    p = mix(mix(first) + last + count.astype(np.uint64))
    return {"row": row, "s": s, "count": count, "m": m, "nth": nth, "n": n, "p": p, "edges": edges, "bounds": bounds}


def _crowded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Minimizers that more than two of the pieces have which a portion sends on, and how many do.

    A minimizer that no portion counts is in two pieces of each at most, a few hundred bytes for every 32 MB of text.
    """
    for x in _portions(batches):  # without edges
        m, n = np.unique(x["m"][x["nth"] < 2], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(m[n > 2].view(np.int64)), pa.array(n[n > 2])], ["m", "n"])


def _pieces(hot: np.ndarray, edge_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``(doc_id, t, text)`` -> rows of _SENT; ``edges`` has ``edge_bytes`` of each edge's hash.

    Of equal pieces in a portion two are sent on, which tells the group that their edges repeat; all others are known to
    repeat and only pass by, dealt out by their place. Pieces of hot minimizers are dealt out by their place too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _portions(batches, edge_bytes):
            kind = np.where(x["nth"] >= 2, SPARE, np.where(np.isin(x["m"], hot), HOT, NORMAL)).astype(np.int32)
            for i, (a, z) in enumerate(pairwise(x["bounds"])):
                yield from _sent({c: x[c][a:z] for c in ("row", "s", "count", "m", "n", "p")}, kind[a:z], x["edges"][i], x["doc_id"], x["t"])
                x["edges"][i] = None  # they are on their way

    return run


def _sent(x: dict[str, np.ndarray], kind: np.ndarray, edges: np.ndarray, doc_id: np.ndarray, t: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Pieces, their edges one after another, and ids by row -> rows of _SENT, each kind on its own."""
    row, count, m = x["row"], x["count"], x["m"]
    spread = mix(mix(row.astype(np.uint64)) + x["s"].astype(np.uint64) + m)
    key = np.where(kind == NORMAL, m, spread).view(np.int64)
    for of in (NORMAL, HOT, SPARE):
        k = np.flatnonzero(kind == of)
        if not len(k):
            continue
        cols = [pa.array(y) for y in (key[k], kind[k], doc_id[row[k]], t[row[k]], x["s"][k])]
        cols += [pa.array(x["p"][k].view(np.int64), mask=x["n"][k] < 3), pa.array(m[k].view(np.int64), mask=np.full(len(k), of != HOT))]
        cols.append(pa.nulls(len(k), pa.binary()) if of == SPARE else _binary(edges[np.repeat(kind == of, count)], count[k]))
        yield pa.RecordBatch.from_arrays(cols, _SENT)


def _binary(short: np.ndarray, count: np.ndarray) -> pa.Array:
    """The edges of each row, ``count`` of them, as one binary value."""
    offsets = np.concatenate([[0], np.cumsum(count) * short.shape[1]]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(count), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(short))])


_SEGMENTS = pa.list_(pa.struct([("o", pa.int32()), ("n", pa.int32()), ("id", pa.int64())]))
_OUT = ["kind", "doc_id", "t", "s", "p", "m", "edges", "segments"]
_OUT_SCHEMA = "kind int, doc_id long, t long, s int, p long, m long, edges binary, segments array<struct<o:int,n:int,id:long>>"


def _out(kind: int, rows: pa.Table, m: np.ndarray | None = None, edges: pa.Array | None = None, segments: pa.Array | None = None) -> pa.RecordBatch:
    n = rows.num_rows
    cols = [pa.array(np.full(n, kind, np.int32)), *(rows.column(c).combine_chunks() for c in ("doc_id", "t", "s", "p"))]
    cols.append(pa.nulls(n, pa.int64()) if m is None else pa.array(m.view(np.int64)))
    cols.append(pa.nulls(n, pa.binary()) if edges is None else edges)
    cols.append(pa.nulls(n, _SEGMENTS) if segments is None else segments)
    return pa.RecordBatch.from_arrays(cols, _OUT)


def _blobs(column: pa.ChunkedArray, edge_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """Binary values -> how many edges each holds, and the edges."""
    blob = column.combine_chunks()
    offsets = np.frombuffer(blob.buffers()[1], np.int32)[blob.offset : blob.offset + len(blob) + 1]
    raw = np.frombuffer(blob.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.empty(0, np.uint8)
    wide = np.zeros((len(raw) // edge_bytes, 8), np.uint8)
    wide[:, :edge_bytes] = raw.reshape(-1, edge_bytes)
    return np.diff(offsets) // edge_bytes, wide.view("<u8").ravel()


def _name(m: np.ndarray, edge: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A segment's id: its minimizer, its first edge and how many edges it has."""
    return mix(mix(m + edge) + n.astype(np.uint64)).view(np.int64)


def _lists(of: np.ndarray, rows: int, o: np.ndarray, n: np.ndarray, ids: np.ndarray) -> pa.Array:
    """Segments by their row, ascending, as a list for each row."""
    offsets = np.searchsorted(of, np.arange(rows + 1)).astype(np.int32)
    cols = [pa.array(o.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(ids)]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(cols, ["o", "n", "id"]))


def _edge_by_edge(rows: pa.Table, m: np.ndarray, count: np.ndarray, edge: np.ndarray) -> pa.Array:
    of = np.repeat(np.arange(rows.num_rows), count)
    return _lists(of, rows.num_rows, np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count), np.ones(len(of), np.int64), _name(m[of], edge, np.ones(len(of), np.int64)))


def _large(rows: pa.Table, m: np.ndarray, edge_bytes: int) -> Iterator[pa.RecordBatch]:
    """Pieces of a group that is too large: as they are, and for those that others are known to equal (KNOWN) as segments of one edge."""
    yield _out(HOT, rows, m, rows.column("edges").combine_chunks())
    named = ~rows.column("p").is_null().to_numpy()
    if named.any():
        some = rows.filter(pa.array(named))
        count, edge = _blobs(some.column("edges"), edge_bytes)
        yield _out(KNOWN, some, segments=_edge_by_edge(some, m[named], count, edge))


def _repeated(rows: pa.Table, edge_bytes: int) -> pa.RecordBatch | None:
    """Rows of whole groups, sorted by key -> those with an edge that occurs twice in its group, as segments that do not branch inside."""
    if not rows.num_rows:
        return None
    m = rows.column("key").to_numpy()
    group = np.cumsum(np.concatenate([[True], m[1:] != m[:-1]])) - 1
    keep = np.bincount(group)[group] > 1
    rows, group, m = rows.filter(pa.array(keep)), group[keep], m[keep]
    if not rows.num_rows:
        return None
    count, edge = _blobs(rows.column("edges"), edge_bytes)
    row = np.repeat(np.arange(len(count)), count)
    place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    order = np.lexsort((edge, group[row]))
    e, g = edge[order], group[row][order]
    at = np.flatnonzero(np.concatenate([[True], (e[1:] != e[:-1]) | (g[1:] != g[:-1])]))
    size = np.diff(np.append(at, len(e)))
    which = np.empty(len(e), np.int64)  # the number of each edge among the distinct ones
    which[order] = np.repeat(np.arange(len(at)), size)
    twice = size[which] > 1
    if not twice.any():
        return None
    beside = np.append((row[1:] == row[:-1]) & twice[1:] & twice[:-1], False)  # this edge and the next one of its piece repeat
    after = np.where(beside, np.roll(which, -1), -1)
    before = np.where(np.roll(beside, 1), np.roll(which, 1), -1)

    def only(x: np.ndarray) -> np.ndarray:
        """The one neighbour that an edge has wherever it occurs, else -1."""
        x = x[order]
        low = np.minimum.reduceat(x, at)
        return np.where(low == np.maximum.reduceat(x, at), low, -1)

    succ, pred = only(after), only(before)
    joined = beside & (succ[which] == after) & (pred[np.maximum(after, 0)] == which)
    first = twice & ~np.roll(joined, 1)
    start = np.flatnonzero(first)
    n = np.add.reduceat(twice.astype(np.int64), start)  # up to the next start, edges that occur once left out
    segments = _lists(row[start], len(count), place[start], n, _name(m.view(np.uint64)[row[start]], edge[start], n))
    some = np.zeros(len(count), bool)
    some[row[start]] = True
    return _out(NORMAL, rows.filter(pa.array(some)), segments=segments.filter(pa.array(some)))


def _groups(max_group: int, edge_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of _SENT sorted by kind and key -> repeated pieces with their segments, pieces of too large groups, and those known to repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, big = None, None
        for b in batches:
            rows = pa.Table.from_batches([b])
            kind = rows.column("kind").to_numpy()
            if (kind == HOT).any():
                hot = rows.filter(pa.array(kind == HOT))
                yield from _large(hot, hot.column("m").to_numpy().view(np.uint64), edge_bytes)
            if (kind == SPARE).any():
                yield _out(SPARE, rows.filter(pa.array(kind == SPARE)))
            rows = rows.filter(pa.array(kind == NORMAL))
            if big is not None and rows.num_rows:
                m = rows.column("key").to_numpy()
                n = len(m) if (m == big).all() else int(np.argmax(m != big))
                if n:
                    yield from _large(rows.slice(0, n), m[:n].view(np.uint64), edge_bytes)
                rows = rows.slice(n)
                big = big if not rows.num_rows else None
            if not rows.num_rows:
                continue
            rows = pa.concat_tables([held, rows]) if held is not None else rows
            m = rows.column("key").to_numpy()
            last = int(np.argmax(m == m[-1]))  # sorted: from here on it is the last group
            if last and (x := _repeated(rows.slice(0, last), edge_bytes)):
                yield x
            held = rows.slice(last).combine_chunks()
            if held.num_rows > max_group:
                big, held, x = m[-1], None, held
                yield from _large(x, np.full(x.num_rows, big).view(np.uint64), edge_bytes)
        if held is not None and (x := _repeated(held, edge_bytes)):
            yield x

    return run


def _one_by_one(edge_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pieces -> a row for each of their edges, named like a segment of it alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = pa.Table.from_batches([b])
            count, edge = _blobs(rows.column("edges"), edge_bytes)
            of = np.repeat(np.arange(len(count)), count)
            take = pa.array(of)
            place = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
            pos = rows.column("s").to_numpy()[of] + place
            ids = _name(rows.column("m").to_numpy().view(np.uint64)[of], edge, np.ones(len(of), np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(pos.astype(np.int32)), pa.array(ids)], ["doc_id", "t", "pos", "id"])

    return run


def _rows(docs: DataFrame) -> DataFrame:
    """``own`` is the doc_id as given. Null doc_ids take the least long for joins on the coordinates; ``t`` tells apart rows that share a doc_id."""
    doc_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    return docs.select(F.col("doc_id").cast("long").alias("own"), doc_id.alias("doc_id"), F.xxhash64("text").alias("t"), "text")


def hot_minimizers(docs: DataFrame, max_group: int = MAX_GROUP) -> np.ndarray:
    """The minimizers of the MAX_HOT largest groups beyond ``max_group`` pieces; a hot group's count has map-side partial sums."""
    found = _rows(docs).select("doc_id", "t", "text").mapInArrow(lean(_crowded), "m long, n long").groupBy("m").agg(F.sum("n").alias("n"))
    rows = found.filter(F.col("n") > max_group).orderBy(F.desc("n"), "m").limit(MAX_HOT).collect()
    return np.array(sorted(r["m"] for r in rows), np.int64).view(np.uint64)


def _with_models(spare: DataFrame, models: DataFrame) -> DataFrame:
    """``spare`` with the segments of the piece that it equals; thousands of documents may equal one, so a large join is salted."""
    if models.count() <= MAX_BROADCAST:
        return spare.join(F.broadcast(models), "p")
    salted = models.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return spare.withColumn("salt", F.pmod(F.xxhash64("doc_id", "t"), F.lit(SALTS)).cast("int")).join(salted, ["p", "salt"])


def segments(docs: DataFrame, max_group: int = MAX_GROUP, edge_bytes: int = EDGE_BYTES) -> DataFrame:
    """``(doc_id, t, segments)``: ``(pos, n, id)`` in order of the words: ``n`` edges from word ``pos`` on that occur elsewhere too.

    Wherever an edge occurs, the same segment starts at the same distance from it. Pieces known to equal another one take
    its segments through a join; edges of too large groups are counted in Spark and are segments of their own.
    """
    dealt = _rows(docs).select("doc_id", "t", "text").mapInArrow(lean(_pieces(hot_minimizers(docs, max_group), edge_bytes)), _SENT_SCHEMA)
    dealt = dealt.repartition(scratch.tasks(docs), "key").sortWithinPartitions("kind", "key")
    found = scratch.table(dealt.mapInArrow(lean(_groups(max_group, edge_bytes)), _OUT_SCHEMA), "pieces")
    placed = F.transform("segments", lambda x: F.struct((F.col("s") + x["o"]).alias("pos"), x["n"].alias("n"), x["id"].alias("id"))).alias("segments")
    models = found.filter(F.col("kind").isin(NORMAL, KNOWN) & F.col("p").isNotNull()).groupBy("p").agg(F.max("segments").alias("segments"))
    spare = _with_models(found.filter(F.col("kind") == SPARE).select("doc_id", "t", "s", "p"), scratch.table(models, "models"))
    out = found.filter(F.col("kind") == NORMAL).select("doc_id", "t", placed).union(spare.select("doc_id", "t", placed))
    big = found.filter(F.col("kind") == HOT).select("doc_id", "t", "s", "m", "edges")
    if not big.isEmpty():
        each = scratch.table(big.mapInArrow(lean(_one_by_one(edge_bytes)), "doc_id long, t long, pos int, id long"), "edges")
        twice = each.groupBy("id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("id")
        one = F.array(F.struct("pos", F.lit(1).alias("n"), "id"))
        out = out.union(each.join(twice, "id").select("doc_id", "t", one.alias("segments")))
    every = F.array_sort(F.flatten(F.collect_list("segments")))  # rows equal in all give every segment more than once
    out = out.groupBy("doc_id", "t").agg(every.alias("all"))
    once = F.filter("all", lambda x, i: (i == 0) | (x["pos"] > F.get("all", i - 1)["pos"]))
    return scratch.table(out.select("doc_id", "t", once.alias("segments")), "segments")


def _beside(a: Column, b: Column) -> Column:
    return a["pos"] + a["n"] == b["pos"]


def inner_segments(found: DataFrame) -> DataFrame:
    """``(id)`` of the segments that go on a path: their only predecessor, in every document, has them as its only successor."""

    def ends_of(x: Column, i: Column) -> Column:
        before, after = F.get("segments", i - 1), F.get("segments", i + 1)
        return F.struct(x["id"].alias("id"), F.when(_beside(before, x), before["id"]).alias("before"), F.when(_beside(x, after), after["id"]).alias("after"))

    each = found.select(F.explode(F.transform("segments", ends_of)).alias("x")).select("x.*")
    n = F.count(F.lit(1))
    only = lambda c: F.when((F.count(c) == n) & (F.min(c) == F.max(c)), F.min(c))
    ends = scratch.table(each.groupBy("id").agg(only("before").alias("pred"), only("after").alias("succ")), "degrees")
    left, right = ends.select(F.col("id").alias("pred"), "succ").filter("succ is not null"), ends.select("id", "pred").filter("pred is not null")
    return right.join(left, "pred").filter("succ = id").select("id")


def paths(docs: DataFrame, max_group: int = MAX_GROUP, edge_bytes: int = EDGE_BYTES) -> DataFrame:
    """``(doc_id, t, segments)`` as of :func:`segments`, each with ``inner``: whether it goes on the path of the one before it."""
    found = segments(docs, max_group, edge_bytes)
    inner = inner_segments(found).withColumn("inner", F.lit(True))
    each = found.select("doc_id", "t", F.explode("segments").alias("x")).select("doc_id", "t", "x.*").join(inner, "id", "left")
    one = F.struct("pos", "n", "id", F.coalesce("inner", F.lit(False)).alias("inner"))
    return each.groupBy("doc_id", "t").agg(F.collect_list(one).alias("segments"))


def _spans(found: pa.Scalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments of a document -> first word, edges and id of each path: a segment, and the inner ones that follow right behind."""
    if not found.is_valid or not len(found.values):
        return (np.empty(0, np.int64),) * 3
    pos, n, ids, inner = (found.values.field(c).to_numpy(zero_copy_only=False) for c in ("pos", "n", "id", "inner"))
    order = np.argsort(pos, kind="stable")
    pos, n, ids, inner = pos[order].astype(np.int64), n[order].astype(np.int64), ids[order], inner[order]
    head = np.concatenate([[True], ~inner[1:] | (pos[1:] != pos[:-1] + n[:-1])])
    at = np.flatnonzero(head)
    return pos[at], np.add.reduceat(n, at), ids[at]


def _digest(words: list[bytes]) -> bytes:
    return hashlib.sha256(b" ".join(words)).digest()


_CUT_SCHEMA = "own long, doc_id long, t long, n_words long, n_removed long, kept string, marks array<struct<path:long,digest:binary>>"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(own, doc_id, t, text, segments, wrong)`` -> the words outside its paths, and a digest of the words of each path.

    Edges that start at the words in ``wrong`` are left out of the paths.
    """
    mark = pa.list_(pa.struct([("path", pa.int64()), ("digest", pa.binary())]))
    for b in batches:
        n_words, n_removed, kept, marks = [], [], [], []
        for text, found, wrong in zip(b.column("text").cast(pa.binary()), b.column("segments"), b.column("wrong"), strict=True):
            words = (text.as_py() or b"").split()  # bytes: only \x20 \x09-\x0D separate
            n_words.append(len(words))
            pos, n, ids = _spans(found)
            marks.append([{"path": u, "digest": _digest(words[a : a + k + K - 1])} for a, k, u in zip(pos.tolist(), n.tolist(), ids.tolist(), strict=True)])
            if len(pos):
                edges = np.zeros(len(words) + 1, np.int64)
                np.add.at(edges, np.minimum(pos, len(words)), 1)
                np.add.at(edges, np.minimum(pos + n, len(words)), -1)
                starts = np.flatnonzero(np.cumsum(edges)[: max(len(words) - K + 1, 0)] > 0)
                if wrong.is_valid:
                    starts = np.setdiff1d(starts, wrong.values.to_numpy(zero_copy_only=False))
                cover = np.zeros(len(words) + 1, np.int64)
                np.add.at(cover, starts, 1)
                np.add.at(cover, starts + K, -1)
                words = [words[i] for i in np.flatnonzero(np.cumsum(cover)[: len(words)] == 0).tolist()]
            n_removed.append(n_words[-1] - len(words))
            kept.append(b" ".join(words))
        cols = [*(b.column(c) for c in ("own", "doc_id", "t")), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())]
        cols += [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(marks, mark)]
        yield pa.RecordBatch.from_arrays(cols, ["own", "doc_id", "t", "n_words", "n_removed", "kept", "marks"])


def _edge_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(doc_id, t, text, segments, unsure)`` -> a row for each edge of the paths named in ``unsure``: its place and a digest of its words."""
    for b in batches:
        out = []
        for doc_id, t, text, found, unsure in zip(*(b.column(c) for c in ("doc_id", "t", "text", "segments", "unsure")), strict=True):
            words, names = (text.as_py() or "").encode().split(), set(unsure.as_py())
            pos, n, ids = _spans(found)
            for a, k, u in zip(pos.tolist(), n.tolist(), ids.tolist(), strict=True):
                if u in names:
                    out += [(doc_id.as_py(), t.as_py(), i, _digest(words[i : i + K])) for i in range(a, a + k)]
        cols = list(zip(*out, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["doc_id", "t", "pos", "digest"])


def _wrong_edges(rows: DataFrame, cut: DataFrame, odd: DataFrame) -> DataFrame:
    """``(doc_id, t, wrong)``: the first words of edges that no other occurrence of their path has, word by word.

    ``odd`` names the paths of which some occurrence differs from all others. Equal edges are always on the same path.
    """
    unsure = cut.select("doc_id", "t", F.explode("marks.path").alias("path")).join(odd, "path", "left_semi")
    unsure = unsure.groupBy("doc_id", "t").agg(F.collect_set("path").alias("unsure"))
    each = rows.join(unsure, ["doc_id", "t"]).select("doc_id", "t", "text", "segments", "unsure")
    each = scratch.table(each.mapInArrow(lean(_edge_digests), "doc_id long, t long, pos int, digest binary"), "unsure")
    alone = each.groupBy("digest").agg(F.count(F.lit(1)).alias("c")).filter("c = 1").select("digest")
    return each.join(alone, "digest", "left_semi").groupBy("doc_id", "t").agg(F.collect_set("pos").alias("wrong"))


def remove_repeats(docs: DataFrame, max_group: int = MAX_GROUP, edge_bytes: int = EDGE_BYTES) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: ``doc_id, n_words, n_removed, kept``.

    Words are runs of anything but \\x20 and \\x09-\\x0D. A word goes if any window of 35 words around it starts
    anywhere else too, in the same document or another; all windows are judged on the input. ``kept`` joins the other
    words by one space. Null text has no words; texts of fewer than 35 words, and an empty table, lose nothing.
    Rows that repeat a doc_id, or have none, are documents of their own, and equal ones repeat each other. Other columns
    are ignored. ``max_group`` and ``edge_bytes`` change the way, not the result.
    """
    with small_batches(docs.sparkSession):
        found = paths(docs, max_group, edge_bytes)
        rows = _rows(docs).join(found, ["doc_id", "t"], "left")
        none = F.lit(None).cast("array<int>").alias("wrong")
        cut = scratch.table(rows.select("own", "doc_id", "t", "text", "segments", none).mapInArrow(lean(_cut), _CUT_SCHEMA), "cut")
        same = cut.select(F.explode("marks").alias("x")).groupBy("x.path", "x.digest").agg(F.count(F.lit(1)).alias("c"))
        odd = scratch.table(same.filter("c = 1").select("path").distinct(), "odd")
        out = cut
        if not odd.isEmpty():
            wrong = scratch.table(_wrong_edges(rows, cut, odd), "wrong")
            again = rows.join(wrong, ["doc_id", "t"]).select("own", "doc_id", "t", "text", "segments", "wrong").mapInArrow(lean(_cut), _CUT_SCHEMA)
            out = cut.join(wrong, ["doc_id", "t"], "left_anti").unionByName(again)
    return out.select(F.col("own").alias("doc_id"), "n_words", "n_removed", "kept")
