"""Operators against values worked out by hand."""

from __future__ import annotations

import hashlib
import random
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridspark import queries as Q
from gridspark.functions import geometry as G
from gridspark.functions import text as T
from gridspark.kernels import resample
from gridspark.operators import assemble, grid, meet, metrics, pages, runstats, verify, vote


def one(spark, *cols, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def box(*v):
    return G.bbox(*(float(x) for x in v))


def test_iou(spark):
    a = box(0, 0, 10, 10)
    r = one(spark, G.iou(a, a), G.iou(a, box(20, 20, 30, 30)), G.iou(a, box(5, 5, 15, 15)), G.iou(a, box(10, 0, 20, 10)), G.iou(box(0, 0, 0, 0), box(0, 0, 0, 0)), G.iou(a, F.lit(None).cast("struct<x0:double,y0:double,x1:double,y1:double>")))
    assert list(r) == pytest.approx([1.0, 0.0, 25 / 175, 0.0, 0.0, 0.0])


def test_pixels_and_normalised_boxes(spark):
    r = one(spark, G.to_pixels(box(0.1, 0.2, 0.5, 1.0), F.lit(200.0), F.lit(100.0)), G.to_pixels(box(-5.7, 3.9, 250, 50.5), F.lit(200.0), F.lit(100.0)))
    assert list(r[0]) == [20, 20, 100, 100] and list(r[1]) == [0, 3, 200, 50]


def test_confusable_and_similarity(spark):
    pairs = [("0", "O"), ("O", "0"), ("1", "l"), ("l", "1"), ("5", "S"), ("8", "B"), ("A", "B"), ("1", "2")]
    rows = spark.createDataFrame(pairs, ["a", "b"]).select(T.confusable_pair(F.col("a"), F.col("b")).alias("x")).collect()
    assert [r.x for r in rows] == [True] * 6 + [False] * 2
    texts = [("123", "123"), ("1O3", "103"), ("1OO", "100"), ("123", "456"), ("1 2 3", "123"), ("", "x"), (None, "x")]
    s = [r.x for r in spark.createDataFrame(texts, ["a", "b"]).select(T.similarity(F.col("a"), F.col("b")).alias("x")).collect()]
    assert s[0] == 1.0 and s[1] == pytest.approx(0.8333, abs=1e-4) and s[2] > 0.65 and s[3] < 0.5 and s[4] == 1.0 and s[5] == s[6] == 0.0


def test_error_rates(spark):
    rows = [("kitten", "sitting"), ("", ""), ("a", ""), (None, "ab"), ("a  b\tc", "a b d"), ("abcd", "a")]
    got = spark.createDataFrame(rows, "a string, b string").select(T.cer(F.col("a"), F.col("b")), T.wer_char(F.col("a"), F.col("b")), T.wer_word(F.col("a"), F.col("b"))).collect()
    assert [round(r[0], 4) for r in got] == [round(3 / 7, 4), 0, 1, 1, 0.6, 3]
    assert [round(r[1], 4) for r in got] == [round(3 / 7, 4), 0, 1, 1, 0.2, 3]
    assert [round(r[2], 4) for r in got] == [1, 0, 1, 1, round(1 / 3, 4), 1]


def _edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next(row, i, x, b)
    return row[-1]


def _next(row, i, x, b):
    out = [i]
    for j, y in enumerate(b, 1):
        out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
    return out


def test_word_error_rate_is_the_edit_distance_of_words(spark):
    rows = [("the cat sat", "the dog sat on"), ("a b c d", "b c d e"), ("x", "a b c"), ("a b", "a b")]
    got = spark.createDataFrame(rows, "a string, b string").select(T.wer_word(F.col("a"), F.col("b"))).collect()
    assert [round(r[0], 6) for r in got] == [round(_edit(a.split(), b.split()) / len(b.split()), 6) for a, b in rows]


@pytest.mark.parametrize("seed", range(3))
def test_long_texts_and_word_lists_have_the_plain_edit_distance(seed):
    r = random.Random(seed)
    for _ in range(60):
        a, b = ([r.choice("abcé") for _ in range(r.choice((0, 1, 7, 64, 65, 150)))] for _ in range(2))
        assert T._distance(a, b) == T._distance("".join(a), "".join(b)) == T._distance(np.array(b, object), np.array(a, object)) == _edit(a, b)


def test_error_rate_queries_take_whole_documents(spark, tmp_path):
    same = "x" * 70
    texts = [same + " well seen", same + " " + "the tree " * 40, "e", "", None, "\u00e9 e  e"]
    rows = [(i, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    plain = {i: (a := "".join(c if " " <= c <= "~" else "?" for c in t or ""), a.replace("e", " a ")) for i, t in rows}
    rate = lambda a, b: round(_edit(a, b) / len(b), 6) if b else float(bool(a))
    how = {"cer": lambda x: x, "wer_char": lambda x: " ".join(x.split()), "wer_word": str.split}
    for name, form in how.items():
        got = {r[0]: r[1] for r in Q.queries()[name](spark, str(tmp_path)).collect()}
        assert got == {i: rate(form(a), form(b)) for i, (a, b) in plain.items()}
        assert got[0] > 0 and got[1] > 0


FENCES = [("  {}  ", "{}"), ("```json\n{}\n```", "{}"), ("```\n{}\n```", "{}"), ("x ```json\n{}\n``` y", "{}"), ("```{}```", "{}"), ("no fence", "no fence")]


def test_fences(spark):
    got = spark.createDataFrame([(a,) for a, _ in FENCES], "a string").select(T.strip_fence(F.col("a")).alias("x")).collect()
    assert [r.x for r in got] == [b for _, b in FENCES]


def test_answers_that_are_no_json_are_null(spark):
    rows = [('{"tables": [{"table_id": "t", "columns": ["a"], "rows": [["1"]]}]}',), ("sorry",), ("[1]",), ('{"tables": [',), (None,), ('{"tables": []}',)]
    got = spark.createDataFrame(rows, "a string").select(T.parse_response(F.col("a")).alias("x")).collect()
    assert [None if r.x is None else len(r.x.tables) for r in got] == [1, None, None, None, None, 0]


PAGES = [("0,2,4", [0, 2, 4]), ("0-5", [0, 1, 2, 3, 4, 5]), ("0,2-4,10", [0, 2, 3, 4, 10]), ("invalid", None), ("0-5-10", None), ("5-1", None), (" 1 , 1", [1, 1]), ("", None)]


def test_page_lists(spark):
    got = spark.createDataFrame([(a,) for a, _ in PAGES], "a string").select(T.page_indices(F.col("a")).alias("x")).collect()
    assert [r.x for r in got] == [b for _, b in PAGES]


def test_page_selection(spark):
    p = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0)], "doc_id string, page_index int")
    w = spark.createDataFrame([("a", [0, 1, 5, 0]), ("b", [])], "doc_id string, indices array<int>")
    chosen, errors = pages.select_pages(p, w)
    assert sorted((r.ord, r.page_index) for r in chosen.collect()) == [(0, 0), (1, 1), (3, 0)]
    assert [r.error for r in errors.collect()] == ["Page index 5 out of range"]
    assert pages.select_pages(p, None)[0].count() == 3


def test_costs(spark):
    m = [("gemini-3.0-pro", 6.25), ("gpt-4o", 12.5), ("gemini-1.5-flash", 0.375), ("gemini-2.5-pro", 0.0), ("x", 4.0)]
    got = spark.createDataFrame([(a,) for a, _ in m], "a string").select(T.cost_usd(F.lit(1_000_000), F.lit(1_000_000), F.col("a")).alias("x")).collect()
    assert [r.x for r in got] == pytest.approx([b for _, b in m])


def test_merged_lines_and_clusters(spark):
    xs = F.array(*[F.lit(float(x)) for x in (0, 4, 8, 20, 30, 33)])
    r = one(spark, grid.merge_lines(xs, 5, 5), grid.merge_lines(F.array().cast("array<double>"), 5, 5), grid.cluster(F.array(*[F.lit(float(x)) for x in (10, 1, 2, 11, 30)]), 3.0))
    assert r[0] == [2.0, 8.0, 20.0, 31.5]
    assert r[1] == []
    assert [(c.center, c.n) for c in r[2]] == [(1.5, 2), (10.5, 2), (30.0, 1)]


def _first_match(xs, limit):
    clusters = []
    for x in sorted(xs):
        for c in clusters:
            if abs(x - c[0]) <= limit:
                c[1] += 1
                c[0] = (c[0] * (c[1] - 1) + x) / c[1]
                break
        else:
            clusters.append([x, 1])
    return [(pytest.approx(c), n) for c, n in clusters]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(0, 60), max_size=25), st.integers(1, 9))
def test_clusters_equal_the_first_match_rule(spark, xs, limit):
    got = spark.createDataFrame([([float(x) for x in xs],)], "xs array<double>").select(grid.cluster(F.col("xs"), float(limit)).alias("c")).first().c
    assert [(c.center, c.n) for c in got] == _first_match([float(x) for x in xs], limit)


def test_line_queries_take_every_line(spark, tmp_path):
    r = random.Random(4)
    rows = [(k % 7, k, 1 + k % 4, float(r.randrange(1, 51))) for k in range(900)]
    spark.createDataFrame(rows, "l_suppkey long, l_orderkey long, l_linenumber int, l_quantity double").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    xs = {s: sorted(q * 7 + n for k, _, n, q in rows if k == s) for s in range(7)}
    clusters = [(s, i, c, n) for s, x in xs.items() for i, (c, n) in enumerate(_first_match(x, 3.0))]
    assert sum(c[3] for c in clusters) == len(rows)
    assert sorted(map(tuple, Q.queries()["greedy_cluster"](spark, str(tmp_path)).collect())) == clusters
    want = []
    for s, x in xs.items():
        merged, kept = [], []
        for v in x:
            merged = [*merged[:-1], (merged[-1] + v) / 2] if merged and v - merged[-1] <= 2 else [*merged, v]
        for v in merged:
            kept += [v] if not kept or v - kept[-1] >= 4 else []
        want.append((s, len(kept), pytest.approx(sum(kept))))
    assert sorted(map(tuple, Q.queries()["line_merge"](spark, str(tmp_path)).collect())) == want


def _parts(spark, tmp_path, price):
    rows = [(k, f"Brand#{k % 5}", f"part {k}", price(k), (3 if k % 5 == 4 else 1 + k % 50)) for k in range(400) if k % 5 < 4 or k % 7 == 0]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_name string, p_retailprice double, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    return rows


def test_region_query_takes_boxes_of_every_price(spark, tmp_path):
    want = []
    rows = _parts(spark, tmp_path, lambda k: 900.0 + k % 100)
    for page in sorted({r[1] for r in rows}):
        boxes = [(k % 37 * 15.0, size * 12.0, k % 37 * 15.0 + 8 + k % 7, size * 12.0 + 9 + size % 3) for k, p, _, _, size in rows if p == page]
        large = [(max(0.0, x0 - 6), max(0.0, y0 - 6), min(600.0, x1 + 6), min(700.0, y1 + 6)) for x0, y0, x1, y1 in boxes if (x1 - x0) * (y1 - y0) >= 126]
        assert len(large) < len(boxes) and bool(large) == (page != "Brand#4")
        large.sort(key=lambda b: (b[1], b[0], b))
        want += [(page, i, *b, 0.8, f"section_{i + 1}") for i, b in enumerate(large)] or [(page, 0, 0.0, 0.0, 600.0, 700.0, 0.5, None)]
    got = Q.queries()["region_filter"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=lambda r: r[:2]) == want


def test_semi_join_keeps_the_pages_that_meet_the_condition(spark, tmp_path):
    rows = _parts(spark, tmp_path, lambda k: 1950.0 if k in (6, 11, 13) else 950.0)
    got = Q.queries()["region_semi"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted((r[1], r[0]) for r in rows if r[1] in ("Brand#1", "Brand#3"))


def test_relaxed_settings_round_halves_to_even():
    c = {"min_line_length": 41, "gap_tolerance": 5, "horizontal_kernel": (25, 1), "vertical_kernel": (1, 25), "morph_iterations": 2, "min_line_separation": 5}
    r = grid.relaxed(c)
    assert (r["min_line_length"], r["gap_tolerance"], r["horizontal_kernel"], r["vertical_kernel"], r["min_line_separation"]) == (20, 4, (15, 1), (1, 15), 4)


def test_even_grid_and_hints(spark):
    t = spark.createDataFrame([(1, 2, 3)], "k int, n_rows int, n_cols int").withColumn("bbox", box(0, 0, 400, 300))
    cells = grid.even_grid(t, ["k"])
    rows = {(r.row_index, r.col_index): tuple(r.bbox) for r in cells.collect()}
    assert len(rows) == 6 and rows[0, 0] == pytest.approx((0, 0, 400 / 3, 150)) and rows[1, 2] == pytest.approx((800 / 3, 150, 400, 300))
    hints = spark.createDataFrame([(1, 0, 0, 1, 2), (1, 0, 1, 0, 2), (1, 9, 9, 2, 2)], "k int, row_index int, col_index int, row_span int, col_span int")
    spans = {(r.row_index, r.col_index): (r.row_span, r.col_span) for r in grid.span_hints(cells, hints, ["k"]).collect()}
    assert spans[0, 0] == (1, 2) and set(v for k, v in spans.items() if k != (0, 0)) == {(1, 1)} and len(spans) == 6


def test_lines_to_cells_needs_two_each_way(spark):
    rows = [(1, [0.0, 10.0, 20.0, 99.0], [0.0, 30.0]), (2, [0.0], [0.0, 30.0]), (3, [], [])]
    t = spark.createDataFrame(rows, "k int, h_lines array<double>, v_lines array<double>").withColumn("bbox", box(0, 0, 30, 20))
    got = [(r.k, tuple(r.bbox)) for r in grid.grid_from_lines(t, ["k"]).orderBy("row_index").collect()]
    assert got == [(1, (0, 0, 30, 10)), (1, (0, 10, 30, 20))]


def cells_df(spark, rows):
    return spark.createDataFrame(rows, "k int, cell_ord int, row_index int, col_index int, row_span int, col_span int, text string, is_filler boolean")


def test_assembly_spreads_spans_and_keeps_the_first_text(spark):
    rows = [(1, 0, 0, 0, 1, 2, "HEADER", False), (1, 1, 0, 1, 1, 1, "late", False), (1, 2, 1, 0, 2, 1, "CAT", False), (1, 3, 1, 1, 9, 9, "far", False), (1, 4, 2, 0, 1, 1, None, False), (1, 5, 7, 7, 1, 1, "out", False), (1, 6, 0, 2, 1, 1, None, True)]
    dims = spark.createDataFrame([(1, 3, 3)], "k int, n_rows int, n_cols int")
    got = {(r.row_index, r.col_index): r.value for r in assemble.assemble(cells_df(spark, rows), dims, ["k"], "__").collect()}
    assert got == {(0, 0): "HEADER", (0, 1): "HEADER", (0, 2): "__", (1, 0): "CAT", (1, 1): "far", (1, 2): "far", (2, 0): "CAT", (2, 1): "far", (2, 2): "far"}
    plain = {(r.row_index, r.col_index): r.value for r in assemble.assemble(cells_df(spark, rows), dims, ["k"]).collect()}
    assert plain[0, 2] is None
    wide = assemble.to_rows(assemble.assemble(cells_df(spark, rows), dims, ["k"]), ["k"]).first()
    assert wide["columns"] == ["col_0", "col_1", "col_2"] and wide["rows"][0] == ["HEADER", "HEADER", None]


def test_fallback_keeps_text_after_an_error_and_never_the_confidence(spark):
    c = spark.createDataFrame([(1, 0, 0, "x", 0.3, "ocr"), (1, 0, 1, "y", 0.3, "ocr"), (1, 0, 2, "z", 0.99, "ocr")], "k int, row_index int, col_index int, text string, text_confidence double, text_source string")
    a = spark.createDataFrame([(1, 0, 0, "new", None), (1, 0, 1, None, "boom"), (1, 0, 2, "new", None)], "k int, row_index int, col_index int, answer string, error string")
    got = [(r.text, r.text_source, r.text_confidence) for r in assemble.llm_fallback(c, a, ["k"], 0.95).orderBy("col_index").collect()]
    assert got == [("new", "llm_fallback", 0.3), ("y", "ocr", 0.3), ("z", "ocr", 0.99)]


def test_votes(spark):
    rows = [(1, 0, [["1", "2"], ["3", "4"]]), (1, 1, [["1", "2"], ["3", "5"]]), (1, 2, [["1", "2"], ["3", "4"]]), (1, 3, [["1"]])]
    c = spark.createDataFrame(rows, "k int, attempt int, rows array<array<string>>").withColumns({"n_rows": F.size("rows"), "n_cols": F.lit(2), "columns": F.array(F.lit("A"), F.lit("B"))})
    valid = vote.agreeing(c, ["k"])
    got = {(r.row_index, r.col_index): (r.value, round(r.confidence, 4), r.agreed) for r in vote.vote_cells(valid, ["k"]).collect()}
    assert got[1, 1] == ("4", 0.6667, False) and got[0, 0] == ("1", 1.0, True) and len(got) == 4
    s = vote.summarise(vote.vote_cells(valid, ["k"]), ["k"]).first()
    assert s["irregularities"] == ["llm_extracted", "low_confidence_1_cells"] and s["cell_count"] == 4


def test_ties_go_to_the_first_seen_and_short_rows_vote_empty(spark):
    rows = [(1, 0, [["a"]]), (1, 1, [["b", "x", "beyond"]])]
    c = spark.createDataFrame(rows, "k int, attempt int, rows array<array<string>>").withColumns({"n_cols": F.lit(2)})
    got = {r.col_index: (r.value, r.confidence) for r in vote.vote_cells(c, ["k"]).collect()}
    assert got == {0: ("a", 0.5), 1: ("", 0.5)}


LADDER = [
    ("123", "123", 1, 1.0, 0.0, 1.0), ("N/A", "-", 1, 1.0, 0.0, 1.0), ("x", "", 0, None, 0.0, 0.5), ("", "", 0, None, 0.0, 1.0),
    ("103", "1O3", 1, 1.0, 0.83, 0.83), ("123", "999", 1, 1.0, 0.0, 0.4), ("123", "999", 1, 0.2, 0.0, 0.6),
]


def test_ladder(spark):
    df = spark.createDataFrame(LADDER, "v string, o string, n int, c double, s double, want double")
    got = df.select("want", verify.ladder(*[F.col(x) for x in "vonc"], F.col("s")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_table_verification(spark):
    boxes = [(r, c, str(2 * r + c + 1) if (r, c) != (1, 1) else "999") for r in range(2) for c in range(2)]
    cells = spark.createDataFrame([(1, 1, *b) for b in boxes], "page int, k int, row_index int, col_index int, value string")
    cells = cells.withColumn("bbox", G.bbox(F.col("col_index") * 5.0, F.col("row_index") * 5.0, F.col("col_index") * 5.0 + 5, F.col("row_index") * 5.0 + 5))
    tokens = spark.createDataFrame([(1, i, str(i + 1)) for i in range(4)], "page int, token_idx int, token string")
    x, y = F.col("token_idx") % 2 * 5.0, F.floor(F.col("token_idx") / 2) * 5.0
    tokens = tokens.withColumns({"tbox": G.bbox(x, y, x + 5, y + 5), "token_confidence": F.lit(1.0)})
    at = ["k", "row_index", "col_index"]
    for bucket in (None, 2.0):
        pairs = verify.match_tokens(cells, tokens, ["page"], at, bucket)
        assert pairs.count() == 4
        found = verify.match_cells(cells.select("page", *at, "value"), pairs, ["page", *at])
        v = verify.verdict(found, spark.createDataFrame([(1, 2, 2), (2, 0, 3)], "k int, n_rows int, n_cols int"), ["k"]).orderBy("k").collect()
        assert [tuple(m) for m in v[0].mismatched] == [(1, 1)] and v[0].position_confidence == pytest.approx(3.4 / 4)
        assert v[1].position_confidence is None


def test_boxes_meet_by_squares_as_by_page(spark):
    rng = random.Random(5)
    sizes = [0, 0.5, 3, 40, 400, 30_000, -6]

    def some(n):
        rows = []
        for i in range(n):
            x, y, w, h = rng.uniform(-300, 300), rng.uniform(-300, 300), rng.choice(sizes), rng.choice(sizes)
            rows.append((i % 2, i, (x, y, x + w, y + h)))
        return [*rows, (0, n, (8.0, 8.0, 16.0, 16.0)), (0, n + 1, (16.0, 8.0, 24.0, 16.0)), (0, n + 2, (float("nan"), 0.0, float("inf"), 9.0)), (1, n + 3, None), (None, n + 4, (0.0, 0.0, 9.0, 9.0))]

    at = "struct<x0:double,y0:double,x1:double,y1:double>"
    a, b = spark.createDataFrame(some(150), f"page int, i int, p {at}"), spark.createDataFrame(some(200), f"page int, j int, q {at}")
    want, *got = (sorted(map(tuple, meet.overlapping(a, b, ["page"], "p", "q", side).select("page", "i", "j").collect())) for side in (None, 8.0, 64.0))
    assert got == [want, want] and len(want) == len(set(want)) > 1000


def test_dense_pages_compare_only_boxes_that_lie_near(spark):
    place = spark.range(4000).select(F.lit(0).alias("page"), "id", (F.col("id") % 80 * 100.0).alias("x"), (F.floor(F.col("id") / 80) * 100.0).alias("y"))
    c = place.select("page", F.col("id").alias("i"), G.bbox(F.col("x"), F.col("y"), F.col("x") + 9, F.col("y") + 9).alias("p"))
    t = place.select("page", F.col("id").alias("j"), G.bbox(F.col("x"), F.col("y"), F.col("x") + 9, F.col("y") + 9).alias("q"))
    on = ["page", "_kind", "_x", "_y"]
    near = meet._dealt(c, "p", 64.0, True).join(meet._dealt(t, "q", 64.0, False), on)
    assert near.count() < 4 * 4000  # of 16,000,000 on the page
    pairs = meet.overlapping(c, t, ["page"], "p", "q", 64.0)
    assert pairs.count() == pairs.filter("i = j").count() == 4000
    assert "Broadcast" not in pairs._jdf.queryExecution().toString()


def test_tokens_fill_cells_by_squares_as_by_page(spark):
    t = Q.Tables(spark, "/root/testdata/sf0.001")
    cells = Q.D.boxes(t).select(F.col("page").alias("doc_id"), F.lit(0).alias("page_index"), "box_idx", F.lit(0).alias("row_index"), F.lit(0).alias("col_index"), "bbox")
    cells = cells.withColumns({"text": F.lit(None).cast("string"), "text_confidence": F.lit(None).cast("double"), "text_source": F.lit("")})
    tokens = Q.D.tokens(t).select(F.col("page").alias("doc_id"), F.lit(0).alias("page_index"), "token_idx", F.col("token").alias("text"), F.col("tbox").alias("bbox"), F.col("token_confidence").alias("confidence"))
    want, got = (sorted(map(tuple, assemble.fill_from_tokens(cells, tokens, ["doc_id", "page_index", "box_idx"], bucket=side).select("doc_id", "box_idx", "text", "text_confidence").collect())) for side in (None, 64.0))
    assert got == want and any(r[2] for r in got)


def _read_by_hand(spark, where):
    """Tokens of every part's box by a plain loop over its page."""
    iou = lambda a, b: (w := min(a[2], b[2]) - max(a[0], b[0])) > 0 and (h := min(a[3], b[3]) - max(a[1], b[1])) > 0 and w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h)
    parts, want = spark.read.parquet(f"{where}/part.parquet").collect(), {}
    boxes = [(r.p_brand, r.p_partkey, r.p_name, (x := r.p_partkey % 37 * 15.0, y := r.p_size * 12.0, x + 8.0 + r.p_partkey % 7, y + 9.0 + r.p_size % 3)) for r in parts]
    tokens = [(page, 2 * k + i, f"x{k}" if i else name, [v + k % 5 * 0.5 + i for v in box]) for page, k, name, box in boxes for i in (0, 1)]
    for page, k, name, box in boxes:
        found = sorted((j, text) for of, j, text, other in tokens if of == page and iou(box, other) > 0.1)
        want[page, k] = (name, " ".join(text for _, text in found), len(found))
    return want


def test_token_texts_of_a_whole_table(spark):
    want = _read_by_hand(spark, "/root/testdata/sf0.001")
    found = Q.queries()["token_concat"](spark, "/root/testdata/sf0.001")
    assert {(r.page, r.box_idx): (r.ocr_value, r.n_tokens) for r in found.collect()} == {k: v[1:] for k, v in want.items() if v[2]}
    assert "Broadcast" not in found._jdf.queryExecution().toString()  # one small file would be one task


def test_mean_confidence_does_not_depend_on_the_order_of_rows(spark):
    rows = [(1, i, "a", 0.1 * i if i else None) for i in range(4)]
    frames = (spark.createDataFrame(x, "k int, token_idx int, token string, token_confidence double").coalesce(1) for x in (rows, rows[::-1]))
    a, b = (verify.token_text(df, ["k"]).first() for df in frames)
    assert a == b and a["token_confidence"] == pytest.approx(0.2) and a["n_tokens"] == 4


def test_matches_of_a_whole_table(spark):
    want = _read_by_hand(spark, "/root/testdata/sf0.001")
    found = Q.queries()["match_cells"](spark, "/root/testdata/sf0.001")
    rows = found.collect()
    assert {(r.page, r.box_idx): (r.ocr_value, r.n_tokens) for r in rows} == {k: v[1:] for k, v in want.items()}
    assert all(r.is_exact == (want[r.page, r.box_idx][0] == r.ocr_value) for r in rows)
    pairs = Q._token_pairs(Q.Tables(spark, "/root/testdata/sf0.001"))
    assert pairs.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_matches_python_sequence_ratio(spark):
    rows = [("abcd", "bcde"), ("private", "provable"), ("x" * 300, "x" * 299 + "y")]
    got = spark.createDataFrame(rows, "a string, b string").select(T.sequence_ratio("a", "b").alias("x")).collect()
    assert [r.x for r in got] == [SequenceMatcher(None, a, b).ratio() for a, b in rows]


def test_run_metrics_and_interval(spark):
    rows = [(i, True, 0.5, 0.5, 0.25, 0.25, 0.5) for i in range(4)]
    t = spark.createDataFrame(rows, "ord long, grid_shape_match boolean, avg_cell_iou double, span_accuracy double, avg_cer double, avg_wer double, exact_match_rate double")
    r = metrics.run_metrics(t, F.lit(2)).first()
    assert (r["table_detection_precision"], r["table_detection_recall"]) == (0.5, 2.0)
    assert r["structural_f1"] == 0.5 and r["text_f1"] == pytest.approx(0.6) and r["overall_f1"] == pytest.approx(0.6 / 1.1)
    ci = metrics.bootstrap(t, 2, replicates=50, confidence=1.0).first()
    assert ci["lower"] == ci["upper"] == pytest.approx(0.6 / 1.1)
    assert tuple(metrics.bootstrap(t.limit(0), 2).first()) == (0.0, 0.0)
    empty = metrics.run_metrics(t.limit(0), F.lit(0)).first()
    assert empty["tables_detected"] == 0 and empty["overall_f1"] == 0


@pytest.mark.parametrize(("seed", "replicate", "n"), [(42, 0, 1), (42, 7, 9), (42, 999, 110), (-3, 5, 10_001), (1234567, 12, 25_037), (10**44, 3, 10_234), (10**46, 3, 20)])
def test_draws_are_those_of_md5(seed, replicate, n):
    want = [int(hashlib.md5(f"{seed}:{replicate}:{d}".encode()).hexdigest()[:8], 16) % n for d in range(n)]
    assert np.concatenate(list(resample.draws(seed, replicate, n))).tolist() == want


def test_no_draw_of_the_interval_is_a_row(spark):
    n = 5000
    t = spark.range(n).select(F.col("id").alias("ord"), *[(F.col("id") % 7 / 7).alias(c) for c in ("avg_cell_iou", "span_accuracy", "avg_cer", "avg_wer", "exact_match_rate")], (F.col("id") > 3).alias("grid_shape_match"))
    got = metrics.bootstrap(t, 1, replicates=40)
    assert got.first()["lower"] > 0
    assert "replicate" in got._jdf.queryExecution().toString() and "md5" not in got._jdf.queryExecution().toString()
    packed = list(metrics._weights(iter([pa.RecordBatch.from_arrays([pa.array(range(40))], ["id"])]), n, metrics.SMALL, 42))
    assert sum(b.num_rows for b in packed) == 40 and sum(b.nbytes for b in packed) < 40 * n / 2


def test_interval_with_nulls_windows_and_many_draws_of_a_table(spark, monkeypatch):
    values = [(0, 0.5, None, 0.25, 1.0), (1, None, 0.75, None, 0.5), (2, 0.125, 1.0, 0.5, None), (3, 1.0, 0.5, 0.0, 0.0), (4, 0.25, 0.25, 1.0, 1.0)]
    names = ["ord", "avg_cell_iou", "span_accuracy", "avg_cer", "exact_match_rate"]
    t = spark.createDataFrame(values, "ord long, avg_cell_iou double, span_accuracy double, avg_cer double, exact_match_rate double")
    mean = lambda a, b: 2 * a * b / (a + b) if a + b > 0 else 0.0
    f1 = []
    for r in range(60):
        rows = [values[int(hashlib.md5(f"42:{r}:{d}".encode()).hexdigest()[:8], 16) % 5] for d in range(5)]
        of = [[x[i] for x in rows if x[i] is not None] for i in range(1, len(names))]
        iou, span, cer, exact = (sum(x) / len(x) if x else d for x, d in zip(of, (0.0, 0.0, 1.0, 0.0), strict=True))
        f1.append(mean(mean(iou, span), mean(1 - cer, exact)))
    for small, window in ((2, 2), (2, 4), (1 << 17, 1 << 24)):
        monkeypatch.setattr(metrics, "SMALL", small)
        monkeypatch.setattr(metrics, "WINDOW", window)
        got = metrics.bootstrap(t, 1, replicates=60, confidence=1.0).first()
        assert tuple(got) == (pytest.approx(min(f1)), pytest.approx(max(f1)))
    x = pa.table({"ord": [0, 1], **{c: [0.5, float("nan")] for c in names[1:]}})
    drawn = pa.table({"replicate": [0, 1], "part": [0, 0], "wide": [True, False], "weights": [pa.compress(np.array([70_000, 0], np.uint32).tobytes(), codec="zstd", asbytes=True), pa.compress(bytes([1, 1]), codec="zstd", asbytes=True)]})
    got = metrics._part_sums(x, drawn, 2, 2).to_pylist()
    assert got[0]["s_avg_cer"] == 35_000 and got[0]["n_avg_cer"] == 70_000 and np.isnan(got[1]["s_avg_cer"])


@pytest.mark.parametrize("small", [metrics.SMALL, 0])
def test_interval_query_resamples_every_table_a_thousand_times(spark, monkeypatch, small):
    monkeypatch.setattr(metrics, "SMALL", small)
    where = "/root/testdata/sf0.001"
    rows = sorted(map(tuple, Q._table_metrics(Q.Tables(spark, where)).select("k", "avg_cell_iou", "span_accuracy", "avg_cer", "exact_match_rate").collect()))
    x, n, f1 = np.array([r[1:] for r in rows], float), len(rows), []
    mean = lambda a, b: 2 * a * b / (a + b) if a + b > 0 else 0.0
    for r in range(1000):
        iou, span, cer, exact = x[[int(hashlib.md5(f"42:{r}:{d}".encode()).hexdigest()[:8], 16) % n for d in range(n)]].mean(axis=0)
        f1.append(mean(mean(iou, span), mean(1 - cer, exact)))
    got = Q.queries()["bootstrap_ci"](spark, where).first()
    f1.sort()
    assert tuple(got) == (pytest.approx(f1[25], abs=2e-6), pytest.approx(f1[975], abs=2e-6))


def test_table_metrics_leave_out_cells_without_text(spark):
    c = spark.createDataFrame([(1, 1.0, True, 0.0, 0.0, True), (1, 0.5, False, 1.0, 1.0, False), (2, 0.0, False, 1.5, 1.0, True)], "k int, iou double, text_match boolean, cer double, wer double, span_match boolean")
    got = {r.k: r for r in metrics.table_metrics(c, ["k"]).collect()}
    assert (got[1].avg_cer, got[1].exact_match_rate, got[1].avg_cell_iou) == (0.0, 0.5, 0.75) and got[2].avg_cer == 1.0


def test_annotation_faults(spark):
    c = spark.createDataFrame([(0, 0, 2, 0, 1, 1, 2, 2), (0, 1, 0, 1, 0, 2, 2, 2), (0, 2, 0, 0, 1, 1, 2, 2)], "table_idx int, cell_ord int, row_index int, col_index int, row_span int, col_span int, n_rows int, n_cols int")
    c = c.withColumn("bbox", F.when(F.col("cell_ord") == 2, box(0.5, 0, 0.2, 1)))
    got = [r.error for r in metrics.cell_errors(c).collect()]
    assert got == [
        "Table 0, Cell 0: row 2 out of range [0, 2)", "Table 0, Cell 0: cell extends beyond table (row 2 + rowspan 1 > 2)", "Table 0, Cell 1: rowspan must be positive",
        "Table 0, Cell 1: cell extends beyond table (col 1 + colspan 2 > 2)", "Table 0, Cell 2: invalid bbox x coordinates",
    ]
    t = spark.createDataFrame([(0, 0, 3), (1, 1, 1)], "table_idx int, n_rows int, n_cols int")
    assert [r.error for r in metrics.table_errors(t).collect()] == ["Table 0: n_rows must be positive, got 0"]


def test_gates(spark):
    a = spark.createDataFrame([("f1", 0.86), ("cer", 0.13)], "metric string, actual double")
    t = spark.createDataFrame([("f1", 0.9, 0.05, None), ("cer", 0.1, 0.02, True), ("gone", 1.0, 0.0, False)], "metric string, target double, tolerance double, inverted boolean")
    assert {r.metric: r.passed for r in metrics.gates(a, t).collect()} == {"f1": True, "cer": False, "gone": None}


def test_manifest_diff(spark):
    schema = "git_commit string, config_digest string, package_versions map<string,string>, components array<struct<name:string,version:string>>"
    a = spark.createDataFrame([("c1", "d", {"x": "1", "y": "1"}, [("p", "1")])], schema)
    b = spark.createDataFrame([("c2", "d", {"x": "2", "y": "1", "z": "1"}, [("p", "1"), ("q", "1")])], schema)
    got = sorted(tuple(r) for r in runstats.manifest_diff(a, b).select("kind", "name", "first", "second").collect())
    assert got == [("component", "q", None, "1"), ("git_commit", "", "c1", "c2"), ("package", "x", "1", "2"), ("package", "z", None, "1")]
    assert runstats.manifest_diff(a, a).isEmpty()


@pytest.mark.parametrize("parts", [1, 8])
def test_results_do_not_depend_on_partitions(spark, parts):
    rows = [(i % 5, i // 5, [[str(i % 3)], [str(i % 2)]]) for i in range(60)]
    c = spark.createDataFrame(rows, "k int, attempt int, rows array<array<string>>").withColumn("n_cols", F.lit(1)).repartition(parts)
    got = sorted(map(tuple, vote.vote_cells(c, ["k"]).collect()))
    assert got == sorted(map(tuple, vote.vote_cells(c.coalesce(1), ["k"]).collect()))


@pytest.mark.parametrize("stretch", [50_000, 7, 300])
def test_numbering_does_not_depend_on_the_cuts(spark, monkeypatch, stretch):
    from gridspark.operators import order

    monkeypatch.setattr(order, "STRETCH", stretch)
    df = spark.range(2000).select((F.col("id") * 7919 % 2003).alias("a"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("s"), F.col("id") % 5)).alias("b"))
    got = [(r.b, r.a, r.ord) for r in order.number(df.repartition(5), "b", "a").collect()]
    want = sorted(((r.b, r.a) for r in df.collect()), key=lambda x: (x[0] is not None, x[0] or "", x[1]))
    assert sorted(got, key=lambda x: x[2]) == [(b, a, i) for i, (b, a) in enumerate(want)]
