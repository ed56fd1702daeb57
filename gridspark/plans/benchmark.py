"""A folder of annotated files: extract them, compare, report, and hold the result against a baseline and thresholds."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.functions import geometry as G
from gridspark.operators import metrics
from gridspark.plans.evaluate import evaluate
from gridspark.plans.extract import Extraction
from gridspark.schemas import TABLE_KEY, THRESHOLDS
from gridspark.sinks import report
from gridspark.sources import annotations


@dataclass
class Outcome:
    """``failures`` name the baseline or the thresholds that the metrics miss."""

    metrics: dict[str, Any]
    interval: tuple[float, float]
    failures: list[str]
    #: Annotations without a file.
    lonely: list[str]


def _named(stem: str, page: str, place: str):
    return F.concat(F.col(stem), F.format_string("/p%d_t%d", page, place))


def truth_cells(spark: SparkSession, folder: str, pairs: DataFrame) -> DataFrame:
    """Long cells of the annotations in ``pairs``; ``table_id`` is the file with the table's page and place on it."""
    found = annotations.read(spark, f"{folder.rstrip('/')}/*.json").withColumn("stem", F.regexp_extract("path", r"([^/]+)\.json$", 1))
    found = annotations.required(found.join(pairs.select("stem"), "stem", "left_semi"))
    cells = metrics.annotation_cells(found.withColumn("pdf_file", F.struct("stem", F.coalesce("page_index", F.lit(0)).alias("page"))))
    return cells.withColumn("table_id", _named("pdf_file.stem", "pdf_file.page", "table_idx")).drop("pdf_file", "table_idx")


def predicted_cells(got: Extraction) -> DataFrame:
    """An extraction's cells in the same form, boxes as parts of the page."""
    b, at = F.col("bbox"), [*TABLE_KEY, "row_index", "col_index"]
    boxes = got.layout.join(got.sizes, TABLE_KEY[:2]).select(*at, G.bbox(b["x0"] / F.col("img_w"), b["y0"] / F.col("img_h"), b["x1"] / F.col("img_w"), b["y1"] / F.col("img_h")).alias("bbox"))
    cells = got.cells.join(got.tables.select(*TABLE_KEY, "n_rows", "n_cols"), TABLE_KEY).join(boxes, at, "left")
    cells = cells.withColumns({"stem": F.regexp_extract("doc_id", r"([^/]+)\.pdf$", 1), "cell_ord": F.col("row_index").cast("long") * (1 << 31) + F.col("col_index")})
    return cells.select(
        _named("stem", "page_index", "table_idx").alias("table_id"), "n_rows", "n_cols", "cell_ord", "row_index", "col_index",
        F.lit(1).alias("row_span"), F.lit(1).alias("col_span"), F.coalesce("value", F.lit("")).alias("text"), "bbox",
    )


def missed(found: DataFrame, thresholds: Mapping[str, Mapping[str, Any]]) -> list[str]:
    """Thresholds, such as ``{"avg_cer": {"target": 0.1, "tolerance": 0.02, "inverted": true}}``, that a row of metrics does not pass.

    A metric that the row lacks is left out.
    """
    rows = [(k, float(v["target"]), float(v["tolerance"]), bool(v.get("inverted", False)), v.get("description", k)) for k, v in thresholds.items()]
    limits = found.sparkSession.createDataFrame(rows, THRESHOLDS)
    known = [f for f, kind in found.dtypes if kind not in ("string", "boolean")]
    failed = metrics.gates(metrics.unpivot(found, known), limits).filter("passed = false").orderBy("metric").collect()
    return [f"{r['metric']}: {r['actual']:.4f} {'above' if r['inverted'] else 'below'} {r['threshold']:.4f}" for r in failed]


def run(spark: SparkSession, folder: str, extract: Callable[[DataFrame], Extraction], output: str, subset: str | None = None, baseline: Mapping[str, Any] | None = None, thresholds: Mapping[str, Any] | None = None, replicates: int = 1000) -> Outcome:
    """``folder`` holds ``annotations`` and ``pdfs`` of the same names; ``extract`` makes an extraction of ``(path, content)``.

    Writes the reports to ``output`` in the driver's file system. ValueError if no annotation has a file. The overall F1 may
    fall short of that of ``baseline`` by 0.05.
    """
    where = folder.rstrip("/")
    pairs, lonely = annotations.dataset(spark, f"{where}/annotations", f"{where}/pdfs", subset)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", True).load(f"{where}/pdfs")
    files = files.withColumn("stem", F.regexp_extract("path", r"([^/]+)\.pdf$", 1)).join(pairs.select("stem"), "stem", "left_semi")
    result = evaluate(predicted_cells(extract(files.select("path", "content"))), truth_cells(spark, f"{where}/annotations", pairs), replicates)
    row = result.run.first()
    found = spark.createDataFrame([row], result.run.schema)
    interval = tuple(result.interval.first())
    failures = missed(found, (thresholds or {}).get("thresholds", thresholds or {}))
    if baseline is not None:
        was = spark.createDataFrame([(float(baseline["overall_f1"]),)], "overall_f1 double")
        change = metrics.regression(found, was).first()
        if change["failed"]:
            failures.append(f"overall_f1: {change['delta']:+.4f} against the baseline")
    report.benchmark_report(row.asDict(), interval, output)
    return Outcome(row.asDict(), interval, failures, [r["stem"] for r in lonely.orderBy("stem").collect()])


def settings(path: str | Path) -> dict[str, Any]:
    """A YAML or JSON file of thresholds or metrics."""
    if Path(path).suffix == ".json":
        return json.loads(Path(path).read_text(encoding="utf-8"))
    import yaml

    return yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
