"""Settings, manifests, sinks, logs, command line, registered queries."""

from __future__ import annotations

import csv
import io
import json
import logging
import zipfile
from xml.etree import ElementTree

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gridspark import cli, config, log, manifest
from gridspark import queries as Q
from gridspark.functions import geometry as G
from gridspark.kernels import pdf
from gridspark.plans import evaluate as V
from gridspark.sinks import files, report, xlsx
from gridspark.sources import annotations, inputs
from gridspark.sources import pdf as P

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def test_layers_win_in_order(tmp_path):
    (tmp_path / "c.yaml").write_text("dpi: 300\nlog_level: WARNING\n")
    env = {"GRIDSPARK_DPI": "250", "GRIDSPARK_DEFAULT_ROWS": "x", "GRIDSPARK_LLM_FALLBACK_ENABLED": "Yes", "GRIDSPARK_LLM_CONSISTENCY_ATTEMPTS": "3", "GRIDSPARK_PAGE_INDICES": "0,2-3"}
    c = config.load(tmp_path / "c.yaml", {"dpi": 400, "max_workers": None}, env)
    assert (c.dpi, c.log_level, c.default_rows, c.llm_fallback_enabled, c.llm_consistency_attempts, c.page_indices) == (400, "WARNING", 2, True, 3, (0, 2, 3))
    assert config.load(None, None, {}).dpi == 200 and config.load(None, None, env).dpi == 250
    (tmp_path / "e.yml").write_text("")
    assert config.from_file(tmp_path / "e.yml") == {}
    with pytest.raises(ValueError):
        config.from_file(tmp_path / "c.toml")


@pytest.mark.parametrize("bad", [{"ocr_confidence_threshold": 1.5}, {"max_workers": 0}, {"page_batch_size": 0}, {"llm_consistency_attempts": 0}, {"ragged_mode": "x"}, {"worker_type": "process"}, {"extraction_preset": "x"}, {"line_detection_min_separation": -1}, {"run_timeout_seconds": 0.0}])
def test_bad_settings(bad):
    with pytest.raises(ValueError):
        config.PipelineConfig(**bad)


def test_presets_overrule_the_strategy():
    assert config.PipelineConfig(extraction_strategy="heuristic").extraction_strategy == "llm_end_to_end"
    p = config.PipelineConfig(extraction_preset="premium", llm_model="x")
    assert (p.llm_model, p.llm_model_escalation) == ("gemini-3.0-pro", None)
    o = config.PipelineConfig(extraction_preset="offline", llm_fallback_enabled=True)
    assert (o.extraction_strategy, o.llm_fallback_enabled) == ("heuristic", False)


@pytest.mark.parametrize(("text", "want"), [("0,2,4", [0, 2, 4]), ("0-2", [0, 1, 2]), ("1,1", [1, 1])])
def test_pages(text, want):
    assert config.parse_pages(text) == want


@pytest.mark.parametrize("text", ["invalid", "0-5-10", "5-1", ""])
def test_bad_pages(text):
    with pytest.raises(ValueError):
        config.parse_pages(text)


def test_digest_leaves_out_secrets():
    a, b = config.PipelineConfig(llm_api_key="x"), config.PipelineConfig(llm_api_key="y")
    assert config.digest(a) == config.digest(b) != config.digest(config.PipelineConfig(dpi=300))


def test_manifest_round_trip(spark, tmp_path):
    m = manifest.create(config.PipelineConfig(), [{"name": "n", "version": "1", "type": "t"}])
    (tmp_path / "m.json").write_text(manifest.dumps(m))
    row = manifest.read(spark, str(tmp_path / "m.json")).first()
    assert row["run_id"] == m["run_id"] and row["package_versions"]["pyspark"] and row["components"][0]["name"] == "n"


def test_folder_sink(spark, tmp_path):
    t = spark.createDataFrame([(0, ["a", "b"], [["1", None], ['x"y', "2,3"]]), (1, ["c"], [["ü"]])], "table_no int, columns array<string>, rows array<array<string>>")
    where = files.OutputSink("filesystem", str(tmp_path)).write("run_1", {"m": 1}, {"s": 2}, t)
    rows = list(csv.reader(io.StringIO((tmp_path / "run_1/tables/table_0.csv").read_text())))
    assert rows == [["a", "b"], ["1", ""], ['x"y', "2,3"]] and json.loads((tmp_path / "run_1/run_stats.json").read_text()) == {"s": 2} and where.endswith("run_1")
    files.write_tables(t, str(tmp_path / "csv"))
    assert spark.read.text(str(tmp_path / "csv")).filter(F.col("table") == "table_1.csv").count() == 2
    files.OutputSink("spark", str(tmp_path)).write("run_2", {"m": 1}, {"s": 2}, t)
    assert spark.read.parquet(str(tmp_path / "run_2/tables")).count() == 2
    with pytest.raises(NotImplementedError):
        files.OutputSink("database", "x")


def test_workbook(tmp_path):
    long = "A table with a very long name that goes on"
    sheets = [xlsx.Sheet(long, ["a", "b"], [["1 < 2", None], ["x", "y"]], [[0.9, 0.75], [0.2, None]]), xlsx.Sheet(long, ["c"], [])]
    xlsx.write(tmp_path / "w.xlsx", sheets)
    with zipfile.ZipFile(tmp_path / "w.xlsx") as z:
        for n in z.namelist():
            ElementTree.fromstring(z.read(n))
        book, sheet = z.read("xl/workbook.xml").decode(), z.read("xl/worksheets/sheet1.xml").decode()
        assert "A table with a very long nam..." in book and "1 &lt; 2" in sheet
        assert 'ref="A3"' in z.read("xl/comments1.xml").decode()
    xlsx.write(tmp_path / "e.xlsx", [])
    with zipfile.ZipFile(tmp_path / "e.xlsx") as z:
        assert "NoTablesFound" in z.read("xl/workbook.xml").decode()


def test_html_escapes(spark, tmp_path):
    v = spark.createDataFrame([(1, 0, 0, "<b>&'\"", 0.2), (1, 0, 1, None, None)], "k int, row_index int, col_index int, value string, confidence double")
    html = report.table_html(v, ["k"]).first()["html"]
    assert html == "<table><tr><td class=\"low\">&lt;b&gt;&amp;&#x27;&quot;</td><td></td></tr></table>"
    page = report.run_report({"pages": 1}, [(1, "t<", html), (0, "s", "")], ["bad <x>"])
    assert page.index("Page 1") < page.index("Page 2") and "bad &lt;x&gt;" in page
    report.benchmark_report({"f1": 0.5}, (0.1, 0.9), tmp_path)
    assert json.loads((tmp_path / "report.json").read_text()) == {"f1": 0.5, "overall_f1_ci": [0.1, 0.9]} and "| f1 | 0.5000 |" in (tmp_path / "report.md").read_text()


def test_logs():
    r = logging.makeLogRecord({"msg": "hi %s", "args": ("you",), "levelname": "INFO", "name": "n", "pages": 3})
    assert json.loads(log.JsonFormatter().format(r))["pages"] == 3
    assert log.HumanFormatter().format(r).endswith("hi you | pages=3")


def test_evaluation_of_annotations(spark, tmp_path):
    cell = lambda r, c, t: {"row": r, "col": c, "rowspan": 1, "colspan": 1, "text": t, "bbox": {"x0": 0.1 * c, "y0": 0.1 * r, "x1": 0.1 * c + 0.1, "y1": 0.1 * r + 0.1}}
    table = {"table_id": "t1", "bbox": {"x0": 0, "y0": 0, "x1": 1, "y1": 1}, "n_rows": 1, "n_cols": 2, "cells": [cell(0, 0, "ab"), cell(0, 1, "cd")]}
    (tmp_path / "a.json").write_text(json.dumps({"pdf_file": "a.pdf", "page_index": 0, "metadata": {}, "tables": [table]}, indent=1))
    (tmp_path / "b.json").write_text("{}")
    (tmp_path / "a.pdf").write_bytes(pdf.write([{}]))
    from gridspark.operators import metrics

    truth = metrics.annotation_cells(annotations.required(annotations.read(spark, str(tmp_path / "a.json"))))
    got = V.evaluate(truth.withColumn("text", F.when(F.col("col_index") == 0, "ab").otherwise("cx")), truth, replicates=20)
    run = got.run.first()
    assert run["exact_match_rate"] == 0.5 and run["avg_cell_iou"] == pytest.approx(1.0) and run["avg_cer"] == 0.25
    assert got.interval.first()["lower"] == pytest.approx(run["overall_f1"])
    pairs, lonely = annotations.dataset(spark, str(tmp_path), str(tmp_path), "smoke")
    assert [r.stem for r in pairs.collect()] == ["a"] and [r.stem for r in lonely.collect()] == ["b"]
    with pytest.raises(ValueError):
        annotations.dataset(spark, str(tmp_path), str(tmp_path), "nothing")
    back = json.loads(annotations.to_json(truth, ["pdf_file"]).first()["json"])
    assert back["tables"][0]["cells"][1]["text"] == "cd"


def test_command_line(spark, tmp_path, capsys):
    lines = [(50, y, 350, y) for y in (100, 130, 160)] + [(x, 100, x, 160) for x in (50, 150, 350)]
    (tmp_path / "a.pdf").write_bytes(pdf.write([{"lines": lines, "texts": [(60, 120, "one")]}]))
    args = cli.parser().parse_args(["extract", str(tmp_path / "a.pdf"), "--output", str(tmp_path / "out"), "--excel", str(tmp_path / "o.xlsx"), "--extraction-preset", "offline", "--dpi", "72", "--enable-debug-artifacts", "--debug-output-dir", str(tmp_path / "debug")])
    assert cli.run(spark, args) == 0
    said = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    text = (tmp_path / "out" / said["run_id"] / "tables/table_0.csv").read_text()
    assert text.splitlines()[1].startswith("one") and "one" in (tmp_path / "debug/report.html").read_text()


    assert next((tmp_path / "debug/overlays").glob("*.png")).read_bytes().startswith(b"\x89PNG")
    with zipfile.ZipFile(tmp_path / "o.xlsx") as z:  # "one" is of confidence 1, the colour of the band
        sheet = z.read("xl/worksheets/sheet1.xml").decode()
    assert 's="2" t="inlineStr"><is><t xml:space="preserve">one</t>' in sheet and xlsx.LEGEND[0][1] in sheet


def test_benchmark_command(spark, tmp_path, capsys):
    lines = [(50, y, 350, y) for y in (100, 130, 160)] + [(x, 100, x, 160) for x in (50, 200, 350)]
    texts = [["one", "two"], ["three", "four"]]
    words = [(60 + 150 * c, 120 + 30 * r, texts[r][c]) for r in range(2) for c in range(2)]
    for name in ("annotations", "pdfs"):
        (tmp_path / name).mkdir()
    (tmp_path / "pdfs/a.pdf").write_bytes(pdf.write([{"lines": lines, "texts": words}]))
    rows = P.read_pdf(P.from_bytes(spark, {"a.pdf": (tmp_path / "pdfs/a.pdf").read_bytes()})).pages.first()
    box = lambda x0, y0, x1, y1: {"x0": x0 / rows["width"], "y0": y0 / rows["height"], "x1": x1 / rows["width"], "y1": y1 / rows["height"]}
    cells = [{"row": r, "col": c, "text": texts[r][c], "bbox": box(50 + 150 * c, 100 + 30 * r, 200 + 150 * c, 130 + 30 * r)} for r in range(2) for c in range(2)]
    table = {"table_id": "table_0", "bbox": box(50, 100, 350, 160), "n_rows": 2, "n_cols": 2, "cells": cells}
    for name in ("a", "b"):
        (tmp_path / f"annotations/{name}.json").write_text(json.dumps({"pdf_file": f"{name}.pdf", "page_index": 0, "metadata": {}, "tables": [table]}))
    (tmp_path / "base.json").write_text(json.dumps({"overall_f1": 0.9}))
    (tmp_path / "limits.yaml").write_text("thresholds:\n  avg_cer: {target: 0.0, tolerance: 0.01, inverted: true}\n  text_f1: {target: 1.0, tolerance: 0.0}\n  strange: {target: 1, tolerance: 0}\n")
    base = ["benchmark", str(tmp_path), "--output", str(tmp_path / "out"), "--extraction-preset", "offline", "--dpi", "72", "--baseline", str(tmp_path / "base.json"), "--thresholds", str(tmp_path / "limits.yaml")]
    assert cli.run(spark, cli.parser().parse_args(base)) == 0
    said = capsys.readouterr().out
    got = json.loads((tmp_path / "out/report.json").read_text())
    assert "no file: b" in said and got["tables_detected"] == got["tables_ground_truth"] == 1
    assert got["exact_match_rate"] == 1.0 and got["avg_cer"] == 0.0 and got["avg_cell_iou"] > 0.9
    gates = ["gates", "--results", str(tmp_path / "out/report.json"), "--thresholds"]
    assert cli.run(spark, cli.parser().parse_args([*gates, str(tmp_path / "limits.yaml")])) == 0
    (tmp_path / "hard.json").write_text(json.dumps({"thresholds": {"avg_cell_iou": {"target": 2.0, "tolerance": 0.5}}}))
    assert cli.run(spark, cli.parser().parse_args([*gates, str(tmp_path / "hard.json")])) == 1
    assert "failed: avg_cell_iou" in capsys.readouterr().out


def test_manifests_command(spark, tmp_path, capsys):
    for name, digest in (("a", "1"), ("b", "2")):
        (tmp_path / name).write_text(json.dumps(manifest.create(config.PipelineConfig()) | {"config_digest": digest}))
    say = lambda x, y: cli.run(spark, cli.parser().parse_args(["manifests", str(tmp_path / x), str(tmp_path / y)]))
    assert say("a", "a") == 0 and say("a", "b") == 1
    assert "config_digest : 1 -> 2" in capsys.readouterr().out


def test_cells_are_shown_to_the_model_where_there_is_a_key():
    cfg = config.PipelineConfig(extraction_preset="offline")
    assert cli._client(cfg) is None and cli._client(config.PipelineConfig()) is not None
    object.__setattr__(cfg, "llm_fallback_enabled", True)
    assert cli._client(cfg) is None
    object.__setattr__(cfg, "llm_api_key", "k")
    assert cli._client(cfg) is not None


def test_results_are_read_back(spark, tmp_path):
    for no, text in ((0, 'a,b\n1,"x\ny"\n'), (11, "c\n"), (2, "\n"), (3, "")):  # an empty file holds no table
        (tmp_path / f"table_{no}.csv").write_text(text)
    (tmp_path / "table_x.csv").write_text("z\n")
    got = {r["table_no"]: (r["columns"], r["rows"]) for r in inputs.result_tables(spark, str(tmp_path)).collect()}
    assert got == {0: (["a", "b"], [["1", "x\ny"]]), 11: (["c"], []), 2: ([], [])}


def test_registry_survives_a_missing_library(tmp_path):
    """Without a library that only the training-data operators need, all other queries are still there."""
    import subprocess
    import sys

    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; n = e.queries(); print('vote_cells' in n, 'op1_simhash' in n, 'pipeline' in n)"
    done = subprocess.run([sys.executable, "-W", "always", "-c", code], capture_output=True, text=True, timeout=120)
    assert done.stdout.split() == ["True", "False", "False"], done.stderr
    assert "training-data operators cannot be used" in done.stderr or "gridspark/llm" not in done.stderr


def test_registry_names_agree():
    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names and "vote_cells" in names and len(Q.queries()) >= 50


def _plain(rows):
    def value(v):
        return round(v, 6) + 0.0 if isinstance(v, float) else v

    return sorted(map(repr, [tuple(value(v) for v in r) for r in rows]))


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = Q.queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = con.sql(Q.oracle_sql()[name])
    assert columns == sorted(want.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert _plain(df.select(*columns).collect()) == _plain(want.project(quoted).fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_overlay_shapes(spark):
    r = spark.createDataFrame([(0, "section_1")], "page int, section_label string").withColumn("bbox", G.bbox(0.0, 0.0, 9.0, 9.0))
    c = spark.createDataFrame([(0, 1, 2, True)], "page int, row_index int, col_index int, is_filler boolean").withColumns({"bbox": G.bbox(0.0, 0.0, 1.0, 1.0), "structure_source": F.lit("filler")})
    assert sorted((x.kind, x.label) for x in report.overlay_shapes(r, c, ["page"]).collect()) == [("filler", "R1C2"), ("region", "section_1")]


def test_overlays_are_images(spark):
    shapes = spark.createDataFrame([(0, "region"), (0, "filler")], "page int, kind string").withColumn("bbox", G.bbox(1.0, 1.0, 8.0, 5.0))
    pages = spark.createDataFrame([(0, 10, 8), (1, 10, 8)], "page int, img_w int, img_h int")
    got = {r.page: bytes(r.png) for r in report.overlays(shapes, pages, ["page"]).collect()}
    assert all(x.startswith(b"\x89PNG") for x in got.values()) and got[0] != got[1]


def test_sql_functions_agree_with_the_columns(spark):
    from gridspark.functions import sql
    from gridspark.functions import text as T

    sql.register(spark)
    df = spark.createDataFrame([("kitten", "sitting"), ("", ""), (None, "a b"), ("a  b", "a b")], "a string, b string")
    got = df.select(F.expr("gs_cer(a, b)"), T.cer(F.col("a"), F.col("b")), F.expr("gs_wer_char(a, b)"), T.wer_char(F.col("a"), F.col("b"))).collect()
    assert all(r[0] == r[1] and r[2] == r[3] for r in got)
    boxes = spark.range(1).select(G.bbox(0.0, 0.0, 10.0, 10.0).alias("a"), G.bbox(5.0, 5.0, 15.0, 15.0).alias("b"))
    assert boxes.select(F.expr("gs_iou(a, b)")).first()[0] == pytest.approx(25 / 175)
    models = spark.createDataFrame([(m,) for m in ("gpt-4o", "x", "gemini-2.5", "y-flash", "z-3-pro")], "m string")
    both = models.select(F.expr("gs_cost_usd(1000000, 500000, m)"), T.cost_usd(F.lit(1_000_000), F.lit(500_000), F.col("m"))).collect()
    assert all(r[0] == pytest.approx(r[1]) for r in both)


def test_cell_calls(spark):
    import numpy as np

    from gridspark.clients import llm

    gray = np.full((40, 60), 255, np.uint8)
    assert llm.crop(gray, (0, 0, 10, 10)) != llm.crop(gray, None) == llm.crop(gray, (100, 100, 120, 120))
    cells = spark.createDataFrame([(1, 0, 0, bytearray(b"x")), (1, 0, 1, None)], "k int, row_index int, col_index int, image binary")
    good = llm.call_cells(cells, llm.Recorded({("m", -1): " text "}), "m", ["k"]).collect()
    assert [(r.k, r.answer, r.error) for r in good] == [(1, "text", None)] * 2
    assert "LookupError" in llm.call_cells(cells, llm.Recorded(), "m", ["k"]).first()["error"]
