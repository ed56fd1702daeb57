"""Near-duplicates, contamination and repeated passages against brute force, and the odd inputs."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridspark.llm import components, decontaminate, simhash, substring, workers

from . import brute

DOCS = "doc_id long, text string"


def words(n, seed, size=400):
    r = random.Random(seed)
    return [f"w{r.randrange(size)}" for _ in range(n)]


def corpus(seed=1):
    """Unlike texts, copies, near copies, shared passages, short and odd texts."""
    r = random.Random(seed)
    base = [words(r.randrange(1, 200), i) for i in range(25)]
    passage = words(60, 777)
    out = [" ".join(b) for b in base] + [" ".join(base[3])] * 3
    for i in range(12):
        b = list(base[4] * 2)
        b[r.randrange(len(b))] = f"x{i}"
        out.append("  ".join(b) if i % 2 else "\n".join(b))
    for i in range(6):
        out.append(" ".join(words(i * 7, 50 + i) + passage[i : 60 - i] + words(5, 60 + i)))
    out += ["", " \t\n", "one", "Two words", "A b C", "é Ü ß ı", "same line\n" * 60, "\x0b\x1c\x85 x", "x" * 5000, None]
    return list(enumerate(out))


@pytest.fixture(scope="module")
def rows():
    return corpus()


def frame(spark, rows, more=True):
    df = spark.createDataFrame(rows, DOCS)
    if more:  # columns that clash with names inside the operators
        clash = "id t w h fp k n at u m s x row key e a b cell items found spans copies bits edges domain n_copies lang source hs p hit words".split()
        df = df.withColumns({c: F.lit(c) for c in clash})
    return df


def test_simhash_equals_brute_force(spark, rows):
    got = simhash.near_duplicates(frame(spark, rows)).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0"), "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(brute.simhash(rows))


def test_simhash_of_repeated_and_null_ids(spark):
    rows = [(7, "a b c d e"), (7, "a b c d e"), (None, "a b c d e"), (None, "zz yy xx ww vv uu"), (5, "q r s t u v w"), (5, "other text here it is now")]
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == 6
    assert [r.component_id for r in got if r.doc_id is None] in ([7, None], [None, 7])
    kept = simhash.deduplicate(frame(spark, rows)).select("doc_id", "text", "id").collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted([(7, rows[0][1]), (0, rows[3][1]), rows[4], rows[5]])
    assert {r.id for r in kept} == {"id"}


@pytest.mark.parametrize("n", [0, 1])
def test_empty_and_single_tables(spark, n):
    rows = [(1, "a b c d e f g h")][:n]
    df = frame(spark, rows)
    bench = spark.createDataFrame([], "item_id long, text string")
    assert simhash.near_duplicates(df).count() == simhash.deduplicate(df).count() == n
    assert decontaminate.contamination(df, bench).count() == decontaminate.remove_documents(df, bench).count() == n
    assert substring.remove_repeats(df).count() == n


def random_prints(n, seed):
    r = np.random.default_rng(seed)
    base = r.integers(0, 1 << 64, n, np.uint64)
    near = base[: n // 2].copy()
    for _ in range(4):
        near ^= np.uint64(1) << r.integers(0, 64, n // 2).astype(np.uint64)
    return np.unique(np.concatenate([base, near]))


def _groups(pairs, nodes):
    root = {v: v for v in nodes}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in pairs:
        root[find(a)] = find(b)
    out = {}
    for v in nodes:
        out.setdefault(find(v), set()).add(v)
    return sorted(map(sorted, out.values()))


@pytest.mark.parametrize("blocks", [6, 7, 9])
def test_no_link_is_missed_whatever_the_grid(spark, blocks):
    v = random_prints(400, blocks)
    true = [(int(a), int(b)) for i, a in enumerate(v) for b in v[i + 1 :][np.bitwise_count(v[i + 1 :] ^ a) <= 4]]
    signed = [int(x) for x in v.view(np.int64)]
    got = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), blocks).collect()
    pairs = [(r.a % (1 << 64), r.b % (1 << 64)) for r in got]
    assert set(map(frozenset, pairs)) <= set(map(frozenset, true))
    nodes = [int(x) for x in v]
    assert _groups(pairs, nodes) == _groups(true, nodes)


def test_near_prints_share_a_point_of_the_grid(spark):
    r = np.random.default_rng(8)
    a = r.integers(0, 1 << 64, 300, np.uint64)
    b = a.copy()
    for i in range(4):  # 1 to 4 bits, also two in one segment and all in one half
        at = r.integers(0, 64, 300) if i % 2 else r.integers(0, 32, 300) + 32 * r.integers(0, 2)
        b[i * 60 :] ^= np.uint64(1) << at[i * 60 :].astype(np.uint64)
    signed = [(int(x),) for x in np.unique(np.concatenate([a, b])).view(np.int64)]
    points = {}
    for x in simhash.cells(spark.createDataFrame(signed, "fp long")).collect():
        points.setdefault(x.fp % (1 << 64), set()).add(x.cell)
    assert all(points[int(x)] & points[int(y)] for x, y in zip(a, b, strict=True))
    assert max(map(len, points.values())) <= 66
    assert abs(sum(map(len, points.values())) / len(points) - simhash.POINTS) < 3


def test_dense_cells_lose_no_link():
    v = random_prints(3000, 11)
    pairs = [(int(x), int(y)) for a, b in simhash._linked(v, 100) for p, q in zip(a, b, strict=True) for x, y in zip(p, q, strict=True)]
    true = [(int(a), int(b)) for i, a in enumerate(v) for b in v[i + 1 :][np.bitwise_count(v[i + 1 :] ^ a) <= 4]]
    assert set(map(frozenset, pairs)) <= set(map(frozenset, true))
    assert _groups(pairs, [int(x) for x in v]) == _groups(true, [int(x) for x in v])


def test_large_cells_go_by_blocks(spark, monkeypatch):
    r = np.random.default_rng(3)
    v = np.unique(np.uint64(0x123456789ABCDEF0) ^ (np.uint64(1) << r.integers(0, 64, 300).astype(np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 300).astype(np.uint64)))
    for cut in (7, 50, 1 << 16):
        cell = np.repeat(np.array([5, 9], np.int64), [len(v), 3])
        fp = np.concatenate([v, v[:3]])
        import pyarrow as pa

        monkeypatch.setattr(simhash, "CELL_BLOCK", cut)
        batches = [pa.RecordBatch.from_arrays([pa.array(cell[i : i + 40]), pa.array(fp[i : i + 40].view(np.int64))], ["cell", "fp"]) for i in range(0, len(fp), 40)]
        out = pa.Table.from_batches(list(simhash._cell_links(iter(batches)))).to_pylist()
        pairs = [(x["a"] % (1 << 64), x["b"] % (1 << 64)) for x in out if x["kind"] == 0]
        big = [(x["block"], x["b"] % (1 << 64)) for x in out if x["kind"] == 1]
        if cut < len(v):
            assert len(big) == len(v) and max(sum(1 for b, _ in big if b == k) for k in {b for b, _ in big}) <= cut
            for i in {b for b, _ in big}:
                for j in {b for b, _ in big}:
                    a, b = simhash._spanning(np.array([x for k, x in big if k in (i, j)], np.uint64))
                    pairs += [(int(x), int(y)) for x, y in zip(np.concatenate(a), np.concatenate(b), strict=True)] if a else []
        assert len(_groups(pairs, [int(x) for x in v])) == 1


def test_manhattan_is_a_lower_bound():
    r = np.random.default_rng(0)
    a, b = r.integers(0, 1 << 64, 2000, np.uint64), r.integers(0, 1 << 64, 2000, np.uint64)
    b[:1000] = a[:1000] ^ (np.uint64(1) << r.integers(0, 64, 1000).astype(np.uint64)) ^ (np.uint64(3) << np.uint64(10))
    assert (simhash.near(a, b) == (np.bitwise_count(a ^ b) <= 4)).all()


def test_components_of_paths_and_stars(spark):
    pairs = [(i, i + 1) for i in range(1, 200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5000, 5000), (6000, None), (1000, 1001)]
    got = components.components(spark.createDataFrame(pairs, "a long, b long")).collect()
    by = {}
    for r in got:
        by.setdefault(r.root, set()).add(r.node)
    assert sorted(map(len, by.values())) == [50, 200] and len(got) == 250
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


BENCH = [(1, " ".join(words(40, 900))), (2, "Short ITEM, of five-words"), (3, ""), (4, None), (10, " ".join(words(40, 900)[5:30])), (None, "naïve café")]


def contaminated():
    b = words(40, 900)
    clean = words(300, 901, 5000)
    texts = [" ".join(b), " ".join(clean), " ".join(clean[:100] + b[3:16] + clean[100:]), " ".join(clean[:50] + b[3:15] + clean[50:80]), "short, item OF five words", "x short item of five words y " * 3,
             " ".join(clean + b[:13]), " ".join(w.upper() for w in b), "NAÏVE café naïve CAFÉ", "", None, "  ..  ", " ".join((b + clean) * 20)]
    return list(enumerate(texts))


@pytest.mark.parametrize("limit", [200_000, 0])
def test_contamination_equals_brute_force(spark, monkeypatch, limit):
    rows = [*contaminated(), (0, "again"), (0, "again"), (None, BENCH[0][1])]
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    if not limit:
        monkeypatch.setattr(decontaminate.hits, "__defaults__", (13, 0))
    got = decontaminate.contamination(frame(spark, rows), bench).select("doc_id", "n_words", "n_hit", F.size("items"), F.sha2(F.array_join("items", ","), 256), "contaminated").collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(brute.contamination(rows, BENCH), key=key)


def test_documents_and_spans_go(spark):
    rows = contaminated()
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    bad = {r[0] for r in brute.contamination(rows, BENCH) if r[5]}
    df = frame(spark, rows)
    assert {r.doc_id for r in decontaminate.remove_documents(df, bench).collect()} == {r[0] for r in rows} - bad
    left = {r.doc_id: r.text for r in decontaminate.remove_spans(df, bench).collect()}
    assert decontaminate.remove_spans(df, bench).columns == df.columns
    assert left[0] == "" and left[1] == rows[1][1] and left[10] is None
    assert left[5] == "x y x y x y" and not any(r[2] for r in brute.contamination(list(left.items()), BENCH) if r[0] in (0, 2, 3, 4, 5, 7, 8))


def test_repeats_equal_brute_force(spark, rows):
    rows = [*rows, (3, rows[3][1]), (None, rows[4][1]), (None, "nothing here")]
    got = substring.remove_repeats(frame(spark, rows)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(brute.substring(rows), key=key)


def test_the_least_long_is_a_doc_id(spark):
    got = substring.remove_repeats(frame(spark, [(-(1 << 63), "a b"), (None, "c d")])).collect()
    assert sorted(map(tuple, got), key=lambda r: r[0] is None) == [(-(1 << 63), 2, 0, "a b"), (None, 2, 0, "c d")]


@pytest.mark.parametrize("seed", range(3))
def test_repeats_in_texts_of_few_words(spark, seed):
    r = random.Random(seed)
    rows = [(i, " ".join(r.choice("ab") for _ in range(r.randrange(30, 120)))) for i in range(12)] + [(99, "a " * 200)]
    assert sorted(map(tuple, substring.remove_repeats(frame(spark, rows)).collect())) == sorted(brute.substring(rows))


@pytest.mark.parametrize("max_group", [0, 2])
def test_large_groups_are_counted_in_spark(spark, rows, max_group):
    """Groups beyond the limit leave the streaming pass; with 0 every group is known to be large beforehand or found to be."""
    rows = [*rows, *[(1000 + i, rows[3][1]) for i in range(5)], *[(2000 + i, " ".join([*words(40, 9000 + i), *words(60, 777)])) for i in range(6)]]
    assert len(substring.hot_minimizers(frame(spark, rows), max_group))
    got = substring.remove_repeats(frame(spark, rows).coalesce(2), max_group=max_group).collect()
    assert sorted(map(tuple, got)) == sorted(brute.substring(rows))


@pytest.mark.parametrize("max_group", [0, substring.MAX_GROUP])
def test_unlike_words_with_equal_hashes_stay(spark, rows, max_group):
    """With one byte of hash an edge many edges of a group pass for equal; the words at their source tell them apart."""
    common = words(8, 31)
    more = [(3000 + i, " ".join([*words(30, 5000 + i), *common, *words(30, 6000 + i)])) for i in range(120)]
    rows = [*rows, *more, (None, " ".join(words(41, 1))), (None, " ".join(words(41, 2))), (None, None)]
    got = substring.remove_repeats(frame(spark, rows), max_group=max_group, edge_bytes=1).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(brute.substring(rows), key=key)
    assert not substring.paths(frame(spark, rows), max_group, 1).isEmpty()


def test_paths_do_not_branch(spark):
    """Two copies and a text that shares their middle: three paths in the copies, one in the other text, each with one set of words."""
    a, b = words(200, 1, 10**6), words(300, 2, 10**6)
    b[50:150] = a[60:160]
    rows = [(1, " ".join(a)), (2, " ".join(a)), (3, " ".join(b))]
    import pyarrow as pa

    got = {}
    for r in substring.paths(frame(spark, rows)).select("doc_id", "segments").toArrow().to_pylist():
        pos, n, ids = substring._spans(pa.scalar(r["segments"], pa.list_(pa.struct([("pos", pa.int32()), ("n", pa.int32()), ("id", pa.int64()), ("inner", pa.bool_())]))))
        got[r["doc_id"]] = list(zip(pos.tolist(), n.tolist(), ids.tolist(), strict=True))
    assert [x[:2] for x in got[1]] == [(0, 60), (60, 66), (126, 40)] and got[1] == got[2]
    assert got[3] == [(50, 66, got[1][1][2])]


def test_long_text(spark):
    w = words(60_000, 5, 10**9)
    rows = [(1, " ".join(w)), (2, " ".join(w[30_000:30_050])), (3, "x" * 300_000)]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring.remove_repeats(frame(spark, rows)).collect()}
    assert got == {1: (60_000, 50), 2: (50, 50), 3: (1, 0)}


def text_batches(sizes):
    """Texts of 2000 words, every fourth of them the same, in Arrow batches of so many."""
    i = 0
    for n in sizes:
        ids = list(range(i, i + n))
        yield pa.RecordBatch.from_pydict({"doc_id": ids, "t": [7 * k for k in ids], "text": [" ".join(words(2000, 3 if k % 4 == 0 else 100 + k, 10**6)) for k in ids]})
        i += n


def test_equal_pieces_are_found_over_the_borders_of_batches(monkeypatch):
    monkeypatch.setattr(substring, "BATCH_BYTES", 30_000)
    task = substring._pieces(np.empty(0, np.uint64), substring.EDGE_BYTES)
    one, many = (pa.Table.from_batches(task(text_batches(sizes))) for sizes in ([40], [3, 1, 0, 20, 16]))
    assert many.num_rows == one.num_rows and sorted(map(str, many.drop(["key"]).to_pylist())) == sorted(map(str, one.drop(["key"]).to_pylist()))
    kind = many.column("kind").to_numpy()
    spare = many.filter(pa.array(kind == substring.SPARE)).select(["doc_id", "t"]).to_pylist()
    assert {r["doc_id"] for r in spare} == set(range(8, 40, 4)) and all(r["t"] == 7 * r["doc_id"] for r in spare)


def test_a_task_of_pieces_holds_little():
    """What numpy holds beside 8 MB of text, and what is sent on at a time."""
    batches = [pa.Table.from_batches(text_batches([600])).combine_chunks().to_batches()[0]]
    size = sum(b.column("text").nbytes for b in batches)
    for task in (substring._crowded, substring._pieces(np.empty(0, np.uint64), substring.EDGE_BYTES)):
        list(task(iter([batches[0].slice(0, 100)])))  # tables that stay
        tracemalloc.start()
        sent = max(b.nbytes for b in task(iter(batches)))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert sent < size / 4
        assert peak < 4 * size


def test_every_task_of_op3_is_lean_and_gets_small_batches(spark, rows, monkeypatch):
    seen, limit = [], "spark.sql.execution.arrow.maxBytesPerBatch"
    plain, before = type(spark.range(0)).mapInArrow, spark.conf.get(limit)
    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", lambda self, f, *a, **b: seen.append((f, spark.conf.get(limit))) or plain(self, f, *a, **b))
    substring.remove_repeats(frame(spark, rows), max_group=0, edge_bytes=1)
    assert len(seen) == 7 and all(hasattr(f, "__wrapped__") and int(n) == workers.BYTES_A_BATCH for f, n in seen)
    assert spark.conf.get(limit) == before


def test_small_batches_hold_rows_larger_than_themselves(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"rows": pa.array([b.num_rows], pa.int64()), "bytes": pa.array([b.nbytes], pa.int64())})

    docs = spark.range(0, 64, 1, 1).selectExpr("repeat('x', if(id = 20, 20, 1) * 1024 * 1024) as text")
    with workers.small_batches(spark):
        got = docs.mapInArrow(sizes, "rows long, bytes long").collect()
    assert sum(r.rows for r in got) == 64 and sum(r.bytes for r in got) >= 83 << 20
    assert sorted(r.bytes for r in got)[-2] <= workers.BYTES_A_BATCH + (2 << 20) and max(r.bytes for r in got) <= workers.BYTES_A_BATCH + (21 << 20)
