"""From made-up PDF files to tables, by either strategy."""

from __future__ import annotations

import json

import numpy as np
import pytest

from gridspark.clients.llm import OpenAI, Google, Recorded, provider
from gridspark.config import PipelineConfig
from gridspark.kernels import pdf, raster
from gridspark.plans import extract as E
from gridspark.sources import inputs
from gridspark.sources import pdf as P
from gridspark.streaming import ingest

RULED = {
    "lines": [(50, y, 350, y) for y in (100, 130, 160, 190)] + [(x, 100, x, 190) for x in (50, 150, 250, 350)],
    "texts": [(60 + 100 * c, 120 + 30 * r, f"v{r}{c}") for r in range(3) for c in range(3)],
}
ANSWER = json.dumps({"tables": [{"table_id": "t", "columns": ["a", "b"], "rows": [["1", "2"], ["3", "4"]]}]})
OTHER = ANSWER.replace('"4"', '"5"')


def offline(**more):
    return PipelineConfig(extraction_preset="offline", dpi=72, **more)


def test_reader_returns_pages_words_and_rules():
    doc = pdf.Document(pdf.write([RULED, {}]))
    page = doc.page(0)
    assert len(doc.pages) == 2 and (page.width, page.height) == (612, 792)
    assert [w.text for w in page.words][:3] == ["v00", "v01", "v02"]
    assert (50.0, 100.0, 350.0, 100.0) in page.rules


def test_reader_takes_uncompressed_and_escaped_text():
    doc = pdf.Document(pdf.write([{"texts": [(10, 20, r"a(b)\c")]}], compress=False))
    assert [w.text for w in doc.page(0).words] == [r"a(b)\c"]


@pytest.mark.parametrize("data", [b"", b"hello", b"%PDF-1.4\n1 0 obj\n<< /Type /Catalog", b"%PDF-1.4 /Encrypt 3 0 R"])
def test_broken_files_raise_only_their_own_error(data):
    with pytest.raises(pdf.PdfError):
        pdf.Document(data)


def test_ruled_page_becomes_its_grid_with_its_words(spark):
    files = P.from_bytes(spark, {"a.pdf": pdf.write([RULED])})
    got = E.extract(files, offline())
    row = got.rows().first()
    assert row["table_id"] == "p0_t0"
    assert row["rows"] == [[f"v{r}{c}" for c in range(3)] for r in range(3)]
    stats = got.stats().first()
    assert (stats["pages"], stats["tables_extracted"], stats["cells_with_text"], stats["pages_skipped"]) == (1, 1, 9, 0)
    assert stats["average_confidence"] == pytest.approx(1.0)


def test_page_without_lines_is_divided_evenly(spark):
    files = P.from_bytes(spark, {"a.pdf": pdf.write([{}])})
    got = E.extract(files, offline(default_rows=2, default_cols=3))
    assert got.cells.count() == 6
    assert got.tables.first()["strategy"] == "even"


def test_chosen_pages_and_broken_files(spark):
    files = P.from_bytes(spark, {"a.pdf": pdf.write([{}, RULED, {}]), "b.pdf": b"broken"})
    got = E.extract(files, offline(page_indices=(1,)))
    assert [(r["doc_id"], r["page_index"]) for r in got.tables.collect()] == [("a.pdf", 1)]
    assert [r["doc_id"] for r in got.errors.collect()] == ["b.pdf"]
    assert got.stats().first()["pages_skipped"] == 1


def test_irregular_page_gets_fillers(spark):
    boxes = [(60, 60, "Januaryyyy"), (210, 60, "4242424242"), (60, 100, "Februaryyy"), (210, 100, "3939393939"), (360, 100, "1111111111"), (60, 140, "Marchhhhhh")]
    files = P.from_bytes(spark, {"a.pdf": pdf.write([{"texts": boxes}])})
    got = E.extract(files, offline(enable_irregular_structure_detection=True, enable_line_detection=False, ragged_mode="ragged", ragged_fill_value="__MISSING__"))
    table = got.tables.first()
    assert table["strategy"] == "irregular"
    assert table["irregularities"] == ["partial_borders", "ragged_columns"]
    assert (table["n_rows"], table["n_cols"]) == (3, 3) and 0 < table["structure_confidence"] < 1
    rows = got.rows().first()["rows"]
    assert rows[0] == ["Januaryyyy", "4242424242", "__MISSING__"]
    assert rows[2] == ["Marchhhhhh", "__MISSING__", "__MISSING__"]


def test_panels_become_regions_in_reading_order(spark):
    panel = lambda x, y: [(x + 5, y + 12 * i + 10, "wordwordwordwordword") for i in range(10)]
    files = P.from_bytes(spark, {"a.pdf": pdf.write([{"texts": panel(60, 100) + panel(350, 100)}])})
    got = E.extract(files, offline(enable_section_detection=True))
    labels = [(r["table_idx"], r["section_label"]) for r in got.tables.orderBy("table_idx").collect()]
    assert labels == [(0, "section_1"), (1, "section_2")]


def test_pictures_show_the_words():
    """Every dot of a word is in its box on the page, so the characters can be told apart; here they are read back."""
    from gridspark.kernels import font, raster

    page = raster.render(400, 120)
    words = [((10, 10, 10 + 12 * 7, 37), "Total 8B"[:7]), ((10, 60, 10 + 12 * 9, 87), "1,240.50%"), ((150, 10, 150 + 18 * 4, 46), "caf\u00e9")]
    raster.write_words(page, words)
    glyphs = {c: font.dots(c) for c in map(chr, range(32, 127))} | {"\u00e9": font.dots("\u00e9")}
    assert len({g.tobytes() for g in glyphs.values()}) == len(glyphs)
    for (x0, y0, x1, y1), text in words:
        part, got = page[y0:y1, x0:x1] == 0, ""
        for i in range(len(text)):
            cell = part[:, i * (x1 - x0) // len(text) : (i + 1) * (x1 - x0) // len(text)]
            small = cell[(np.arange(font.HIGH) * cell.shape[0]) // font.HIGH + 1][:, (np.arange(font.WIDE) * cell.shape[1]) // font.WIDE + 1]
            got += next(c for c, g in glyphs.items() if (g == small).all())
        assert got == text
    assert font.unknown("a\u00e9 \u4e2d") == {"\u4e2d"}
    assert (raster.unpng(raster.png(page)) == page).all()


def test_scans_are_painted_and_their_lines_found(spark):
    scan = np.full((60, 80), 255, np.uint8)
    scan[[5, 30, 55]] = 0
    scan[:, [5, 40, 75]] = 0
    data = pdf.write([{"images": [(100, 100, 400, 300, 80, 60, scan.tobytes())]}])
    source = P.read_pdf(P.from_bytes(spark, {"a.pdf": data}))
    image = source.primitives.first()["images"][0]
    assert (image.x0, image.y0, image.x1, image.y1, image.w, image.h) == (100, 100, 500, 400, 80, 60)
    from gridspark.kernels import raster

    row = E.see(source, offline(), True).first()
    page = raster.unpng(bytes(row["image"]))
    assert (page[100:400:5, 100:500:5] == scan).all() and (page[:99] == 255).all() and not row["undrawn"]
    got = E.extract(P.from_bytes(spark, {"a.pdf": data}), offline())
    assert got.tables.first()["n_rows"] == 2 and got.tables.first()["n_cols"] == 2


def test_pages_that_cannot_be_drawn_are_not_shown_to_the_model(spark, tmp_path):
    pages = [{"images": [(0, 0, 10, 10, 4, 4, b"\xff\xd8 not read", b"DCTDecode")]}, {"texts": [(10, 10, "fine")]}]
    client = Recorded({("m", -1): ANSWER})
    got = E.extract(P.from_bytes(spark, {"a.pdf": pdf.write(pages)}), PipelineConfig(llm_model="m", dpi=36), client, str(tmp_path / "attempts"), work_path=str(tmp_path / "work"))
    assert [r["page_index"] for r in got.tables.collect()] == [1]
    stats = got.stats().first()
    assert stats["calls_primary"] == 1 and stats["pages_skipped"] == 1
    assert stats["errors"] == ["page cannot be drawn: Image I0: stream filter DCTDecode is not supported"]


def test_files_are_parsed_and_drawn_once(spark, tmp_path):
    lines = [(50, y, 350, y) for y in (100, 130, 160)] + [(x, 100, x, 160) for x in (50, 150, 350)]
    files = P.from_bytes(spark, {"a.pdf": pdf.write([{"lines": lines, "texts": [(60, 120, "one")]}])})
    plain, once = E.extract(files, offline()), E.extract(files, offline(), work_path=str(tmp_path / "work"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for name in ("cells", "tables", "pages"):
        assert "MapInArrow" in plan(getattr(plain, name)) and "MapInArrow" not in plan(getattr(once, name))
        assert sorted(map(str, getattr(plain, name).collect())) == sorted(map(str, getattr(once, name).collect()))


def test_unsure_cells_are_shown_to_the_model(spark, tmp_path):
    lines = [(50, y, 350, y) for y in (100, 130, 160)] + [(x, 100, x, 160) for x in (50, 150, 350)]
    source = P.read_pdf(P.from_bytes(spark, {"a.pdf": pdf.write([{"lines": lines, "texts": [(60, 120, "one")]}])}))
    cfg = offline(ocr_confidence_threshold=0.95)
    object.__setattr__(cfg, "llm_fallback_enabled", True)
    got = E.heuristic(source, cfg, client=Recorded({("gemini-2.5-pro", -1): "read"}), path=str(tmp_path / "work"))
    values = {(r["row_index"], r["col_index"]): r["value"] for r in got.cells.collect()}
    assert values == {(0, 0): "one", (0, 1): "read", (1, 0): "read", (1, 1): "read"}
    assert got.stats().first()["llm_fallback_count"] == 3


def test_votes_over_attempts(spark, tmp_path):
    client = Recorded({("m", 0): f"```json\n{ANSWER}\n```", ("m", 1): OTHER, ("m", 2): ANSWER})
    cfg = PipelineConfig(llm_model="m", llm_consistency_attempts=3, dpi=36)
    got = E.extract(P.from_bytes(spark, {"a.pdf": pdf.write([{}])}), cfg, client, str(tmp_path / "attempts"))
    cells = {(r["row_index"], r["col_index"]): (r["value"], round(r["confidence"], 4)) for r in got.cells.collect()}
    assert cells == {(0, 0): ("1", 1.0), (0, 1): ("2", 1.0), (1, 0): ("3", 1.0), (1, 1): ("4", 0.6667)}
    table = got.tables.first()
    assert table["irregularities"] == ["llm_extracted", "low_confidence_1_cells"]
    assert table["columns"] == ["a", "b"] and table["table_id"] == "t"
    stats = got.stats().first()
    assert (stats["calls_primary"], stats["calls_escalation"], stats["tables_extracted"]) == (3, 0, 1)
    page = got.sizes.first()
    last = got.layout.filter("row_index = 1 and col_index = 1").first()["bbox"]
    assert got.layout.count() == 4 and (last["x1"], last["y1"]) == pytest.approx((page["img_w"], page["img_h"]), abs=1)


def test_escalation_only_after_failure(spark, tmp_path):
    client = Recorded({("m", -1): RuntimeError("bad key"), ("big", -1): ANSWER})
    cfg = PipelineConfig(llm_model="m", llm_model_escalation="big", enable_auto_escalation=True, dpi=36)
    got = E.extract(P.from_bytes(spark, {"a.pdf": pdf.write([{}])}), cfg, client, str(tmp_path / "attempts"))
    stats = got.stats().first()
    assert (stats["calls_primary"], stats["calls_escalation"], stats["models_used"]) == (1, 1, ["big"])


def test_all_attempts_failed_is_an_error_of_the_page(spark, tmp_path):
    client = Recorded({("m", -1): RuntimeError("bad key")})
    got = E.extract(P.from_bytes(spark, {"a.pdf": pdf.write([{}])}), PipelineConfig(llm_model="m", dpi=36), client, str(tmp_path / "attempts"))
    stats = got.stats().first()
    assert stats["tables_detected"] == 0 and stats["pages_skipped"] == 1 and "bad key" in stats["errors"][0]


def test_verification_lowers_cells_that_the_page_denies(spark, tmp_path):
    page = {"texts": [(5, 400 + 5, "1")]}
    client = Recorded({("m", -1): ANSWER})
    cfg = PipelineConfig(llm_model="m", dpi=36, enable_position_verification=True)
    got = E.extract(P.from_bytes(spark, {"a.pdf": pdf.write([page])}), cfg, client, str(tmp_path / "attempts"))
    assert {r["confidence"] for r in got.cells.collect()} == {0.75}  # no token: position 0.5 everywhere
    table = got.tables.first()
    assert table["position_confidence"] == 0.5 and "low_position_conf_0.50" in table["irregularities"]


def test_client_payloads_and_routing():
    assert isinstance(provider("google", "x", "k"), Google) and isinstance(provider(None, "Gemini-1", "k"), Google)
    assert isinstance(provider("openai", "gpt-4o", "k"), OpenAI)
    body = OpenAI("k").body("gpt-4o", "p", b"\x89PNG")
    assert body["max_tokens"] == 4000 and body["messages"][0]["content"][1]["image_url"]["url"].startswith("data:image/png;base64,")
    assert Google("k").body("p", b"")["generationConfig"] == {"temperature": 0.1}


def test_sources_check_their_arguments(spark, tmp_path):
    for kind, args in (("bytes", {}), ("file", {}), ("ftp", {"location": "x"})):
        with pytest.raises(ValueError):
            inputs.InputSource(kind, **args)
    (tmp_path / "a.pdf").write_bytes(pdf.write([{}]))
    assert inputs.InputSource("file", str(tmp_path / "a.pdf")).resolve(spark).count() == 1
    assert inputs.InputSource("bytes", data=b"x").resolve(spark).first()["path"] == "input.pdf"


def test_stream_takes_every_file_once(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    (folder / "a.pdf").write_bytes(pdf.write([RULED]))
    ingest.run(spark, str(folder), str(out), offline()).awaitTermination()
    (folder / "b.pdf").write_bytes(b"broken")
    ingest.run(spark, str(folder), str(out), offline()).awaitTermination()
    assert spark.read.parquet(f"{out}/tables").count() == 1
    counts = ingest.job_counts(spark, str(out)).first()
    assert (counts["completed"], counts["failed"], counts["total"]) == (1, 1, 2)


@pytest.mark.parametrize(("rows", "cols"), [(4, 3), (2, 6)])
def test_ruling_lines_are_found(rows, cols):
    ys, xs = np.linspace(50, 450, rows + 1), np.linspace(60, 640, cols + 1)
    gray = raster.render(700, 500, [(60, y, 640, y) for y in ys] + [(x, 50, x, 450) for x in xs])
    assert np.allclose(raster.horizontal_lines(gray), ys, atol=1.5)
    assert np.allclose(raster.vertical_lines(gray), xs, atol=1.5)


def test_blank_page_has_nothing():
    gray = np.full((80, 60), 255, np.uint8)
    assert raster.outer_boxes(raster.adaptive_threshold(gray, 15, 2)) == [] and raster.horizontal_lines(gray) == []


def test_components_inside_a_frame_are_not_outer():
    mask = np.zeros((30, 30), bool)
    mask[2:28, 2:28] = True
    mask[4:26, 4:26] = False
    mask[10:15, 10:15] = True
    assert raster.outer_boxes(mask) == [(2, 2, 26, 26)]


def test_morphology_matches_its_definition():
    rng = np.random.default_rng(0)
    mask = rng.random((20, 25)) < 0.2
    slow = np.zeros_like(mask)
    for y, x in zip(*np.nonzero(mask), strict=True):
        slow[max(0, y - 3) : y + 5, max(0, x - 2) : x + 3] = True
    assert (raster.dilate(mask, 5, 8) == slow).all()
    assert (raster.erode(~mask, 5, 7) == ~raster.dilate(mask, 5, 7)).all()
