"""HTML run reports, page overlays, and benchmark reports as JSON, Markdown and HTML."""

from __future__ import annotations

import json
from collections.abc import Mapping
from html import escape
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.functions import text as T

_STYLE = "body{font-family:sans-serif;margin:2em}table{border-collapse:collapse}td,th{border:1px solid #999;padding:2px 8px}.low{background:#ffc7ce}.medium{background:#ffeb9c}.high{background:#c6efce}"


def table_html(values: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, row_index, col_index, value, confidence`` -> ``keys, html``: escaped and coloured by band, built by the executors."""
    band = F.when(F.col("confidence").isNotNull(), F.format_string(' class="%s"', T.confidence_band(F.col("confidence")))).otherwise("")
    cell = F.concat(F.lit("<td"), band, F.lit(">"), T.html_escape(F.coalesce("value", F.lit(""))), F.lit("</td>"))
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col_index", cell.alias("c")))), lambda x: x["c"]), "")
    rows = values.groupBy(*keys, "row_index").agg(line.alias("line"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_index", "line"))), lambda x: F.concat(F.lit("<tr>"), x["line"], F.lit("</tr>"))), "\n")
    return rows.groupBy(*keys).agg(F.concat(F.lit("<table>"), body, F.lit("</table>")).alias("html"))


def confidences(values: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, confidences``: those of each table's cells, row by row, for a workbook's colours."""
    line = F.transform(F.array_sort(F.collect_list(F.struct("col_index", "confidence"))), lambda x: x["confidence"])
    rows = values.groupBy(*keys, "row_index").agg(line.alias("line"))
    return rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("row_index", "line"))), lambda x: x["line"]).alias("confidences"))


def run_report(stats: Mapping[str, Any], tables: list[tuple[int, str, str]], errors: list[str]) -> str:
    """A page of metrics, tables ``(page, id, html)`` by page, and errors."""
    metrics = "".join(f"<tr><th>{escape(str(k))}</th><td>{escape(str(v))}</td></tr>" for k, v in stats.items())
    pages: dict[int, list[str]] = {}
    for page, name, html in sorted(tables):
        pages.setdefault(page, []).append(f"<h3>{escape(name)}</h3>{html}")
    body = "".join(f"<h2>Page {page + 1}</h2>{''.join(parts)}" for page, parts in pages.items())
    faults = "".join(f"<li>{escape(e)}</li>" for e in errors)
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>Run report</title><style>{_STYLE}</style></head><body><h1>Run report</h1><table>{metrics}</table>{body}<h2>Errors</h2><ul>{faults}</ul></body></html>"


def overlay_shapes(regions: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, kind, bbox, label`` of everything to draw on a page."""
    kind = F.when(F.col("is_filler"), "filler").otherwise(F.coalesce("structure_source", F.lit("explicit")))
    label = F.format_string("R%dC%d", "row_index", "col_index")
    r = regions.select(*keys, F.lit("region").alias("kind"), "bbox", F.col("section_label").alias("label"))
    return r.union(cells.select(*keys, kind, "bbox", label))


def overlays(shapes: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """Shapes in pixels and ``pages(keys, img_w, img_h)`` -> ``keys, png``: the outlines of a page's regions and cells.

    One page's shapes meet in one row; the drawing is an Arrow function.
    """
    import pyarrow as pa

    one = F.struct("kind", *[F.col(f"bbox.{s}").alias(s) for s in ("x0", "y0", "x1", "y1")])
    rows = pages.select(*keys, "img_w", "img_h").join(shapes.groupBy(*keys).agg(F.collect_list(one).alias("shapes")), keys, "left")
    kinds = dict(rows.dtypes)

    def run(batches):
        import numpy as np

        from gridspark.kernels import raster

        for b in batches:
            images = []
            for w, h, found in zip(*(b.column(c).to_pylist() for c in ("img_w", "img_h", "shapes")), strict=True):
                page = np.full((h, w), 255, np.uint8)
                images.append(raster.png(raster.draw(page, [tuple(x.values()) for x in found or ()])))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array(images, pa.binary())], [*keys, "png"])

    return rows.mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", png binary")


def benchmark_report(metrics: Mapping[str, Any], interval: tuple[float, float] | None, folder: str | Path) -> None:
    """``report.json``, ``report.md`` and ``report.html`` of one run's metrics."""
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    all_ = dict(metrics) | ({"overall_f1_ci": list(interval)} if interval else {})
    (folder / "report.json").write_text(json.dumps(all_, indent=2, default=str), encoding="utf-8")
    show = lambda v: f"{v:.4f}" if isinstance(v, float) else str(v)
    lines = ["# Benchmark", "", "| metric | value |", "|---|---|", *(f"| {k} | {show(v)} |" for k, v in all_.items())]
    (folder / "report.md").write_text("\n".join(lines) + "\n", encoding="utf-8")
    rows = "".join(f"<tr><th>{escape(k)}</th><td>{escape(show(v))}</td></tr>" for k, v in all_.items())
    (folder / "report.html").write_text(f"<!DOCTYPE html><html><head><meta charset='utf-8'><style>{_STYLE}</style></head><body><table>{rows}</table></body></html>", encoding="utf-8")
