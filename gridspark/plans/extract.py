"""From PDF files to tables with confidences: one lazy plan from page primitives to run statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.clients.llm import Client, call_cells, call_pages, crop
from gridspark.config import PipelineConfig
from gridspark.functions import geometry as G
from gridspark.functions import text as T
from gridspark.operators import assemble, grid, runstats, verify, vote
from gridspark.schemas import PAGE_KEY, TABLE_KEY
from gridspark.sources.pdf import PRIMITIVES, PdfFrames, frames, read_pdf

_BOX = "array<struct<x0:double,y0:double,x1:double,y1:double>>"
_SEEN = f"doc_id string, page_index int, img_w int, img_h int, panels {_BOX}, text_boxes {_BOX}, h_lines array<double>, v_lines array<double>, image binary, undrawn array<string>"


@dataclass
class Extraction:
    """Lazy results; ``cells`` have ``row_index, col_index, value, confidence``, ``tables`` one row per table, ``pages`` partial sums."""

    cells: DataFrame
    tables: DataFrame
    pages: DataFrame
    errors: DataFrame
    #: Cells with their boxes in pixels, and the sizes of the pages, where there is a layout to draw.
    layout: DataFrame | None = None
    sizes: DataFrame | None = None

    def stats(self, by_document: bool = False) -> DataFrame:
        return runstats.run_stats(self.pages, ["doc_id"] if by_document else None)

    def rows(self) -> DataFrame:
        """``TABLE_KEY, table_id, columns, rows``: every table of its own width."""
        return assemble.to_rows(self.cells, TABLE_KEY).join(self.tables.select(*TABLE_KEY, "table_id"), TABLE_KEY)


def _rasterise(config: PipelineConfig, with_image: bool):
    """Renders a page from its primitives at the wanted resolution and looks for panels, text boxes and lines in it.

    For the search words are filled boxes; the image that a model gets shows their characters, and ``undrawn`` names what it does not.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from gridspark.kernels import font
        from gridspark.kernels import raster as R

        boxes = pa.list_(pa.struct([(s, pa.float64()) for s in G.SIDES]))
        schema = pa.schema([
            ("doc_id", pa.string()), ("page_index", pa.int32()), ("img_w", pa.int32()), ("img_h", pa.int32()), ("panels", boxes), ("text_boxes", boxes),
            ("h_lines", pa.list_(pa.float64())), ("v_lines", pa.list_(pa.float64())), ("image", pa.binary()), ("undrawn", pa.list_(pa.string())),
        ])
        k = (config.dpi or 200) / 72
        sides = lambda found: [dict(zip(G.SIDES, (float(x), float(y), float(x + w), float(y + h)), strict=True)) for x, y, w, h in found]
        settings = {
            "min_line_length": config.line_detection_min_length, "gap_tolerance": config.line_detection_gap_tolerance, "horizontal_kernel": (25, 1),
            "vertical_kernel": (1, 25), "morph_iterations": config.line_detection_morph_iterations, "min_line_separation": config.line_detection_min_separation,
        }

        def lines(gray: np.ndarray, s: dict) -> tuple[list[float], list[float]]:
            common = s["min_line_length"], s["gap_tolerance"]
            return R.horizontal_lines(gray, *common, s["horizontal_kernel"][0], s["morph_iterations"]), R.vertical_lines(gray, *common, s["vertical_kernel"][1], s["morph_iterations"])

        for b in batches:
            for p in b.to_pylist():
                w, h = max(1, round(p["width"] * k)), max(1, round(p["height"] * k))
                rules = [[r[s] * k for s in G.SIDES] for r in p["rules"]]
                words = [[x[s] * k for s in G.SIDES] for x in p["words"]]
                images = [([x[s] * k for s in G.SIDES], np.frombuffer(x["gray"], np.uint8).reshape(x["h"], x["w"])) for x in p["images"] or ()]
                gray = R.render(w, h, rules, words, images=images)
                row = {"doc_id": p["doc_id"], "page_index": p["page_index"], "img_w": w, "img_h": h, "panels": [], "text_boxes": [], "h_lines": [], "v_lines": []}
                if config.enable_section_detection:
                    row["panels"] = sides(R.panels(gray))
                if config.enable_irregular_structure_detection:
                    row["text_boxes"] = sides(R.text_boxes(gray))
                if config.enable_line_detection:
                    ruled = R.render(w, h, rules, images=images)  # words would hide short rules between them
                    found = lines(ruled, settings)
                    if min(map(len, found)) < 2:
                        found = lines(ruled, grid.relaxed(settings))
                    row["h_lines"], row["v_lines"] = found
                if with_image:
                    picture = R.render(w, h, rules, images=images)
                    R.write_words(picture, zip(words, (x["text"] for x in p["words"]), strict=True))
                    row["image"] = R.png(picture)
                    strange = sorted({c for x in p["words"] for c in font.unknown(x["text"])})
                    row["undrawn"] = [*(p["undrawn"] or ()), *([f"characters {' '.join(strange)}"] if strange else ())]
                yield pa.RecordBatch.from_pylist([row], schema)

    return run


class Strategy(Protocol):
    """Anything that makes an extraction of page primitives; give one to :func:`extract` in place of the built-in ones."""

    def __call__(self, source: PdfFrames, config: PipelineConfig) -> Extraction: ...


def see(source: PdfFrames, config: PipelineConfig, with_image: bool = False) -> DataFrame:
    good = source.primitives.filter("error is null and page_index is not null")
    return good.select(*[c.split()[0] for c in PRIMITIVES.split(", ") if c.split()[0] in ("doc_id", "page_index", "width", "height", "words", "rules", "images", "undrawn")]).mapInArrow(_rasterise(config, with_image), _SEEN)


def _page_results(pages: DataFrame, tables: DataFrame, errors: DataFrame, extra: dict) -> DataFrame:
    """One row per page that was read or failed, with the partial sums that a run adds up."""
    sums = tables.groupBy(*PAGE_KEY).agg(
        F.count(F.lit(1)).cast("int").alias("tables_detected"),
        F.count_if(F.col("status") == "success").cast("int").alias("tables_extracted"),
        F.count_if(F.col("status") != "success").cast("int").alias("tables_failed"),
        *[F.sum(c).cast("int").alias(c) for c in ("cells_with_text", "llm_fallback_count", "confidence_count")],
        F.sum("cell_count").cast("int").alias("total_cells"),
        F.sum("confidence_sum").alias("confidence_sum"),
    )
    faults = errors.groupBy("doc_id", F.coalesce("page_index", F.lit(-1)).alias("page_index")).agg(F.sort_array(F.collect_list("error")).alias("errors"))
    out = pages.select(*PAGE_KEY).join(sums, PAGE_KEY, "left").join(faults, PAGE_KEY, "full_outer")
    ints = ("tables_detected", "tables_extracted", "tables_failed", "cells_with_text", "total_cells", "llm_fallback_count", "confidence_count")
    out = out.fillna(0, [*ints, "confidence_sum"])
    fixed = {"duration_ms": F.lit(0.0), "calls_primary": F.lit(0), "calls_escalation": F.lit(0), "tokens_in": F.lit(0).cast("bigint"), "tokens_out": F.lit(0).cast("bigint"), "model": F.lit(None).cast("string")}
    out = out.withColumns({"skipped": F.col("errors").isNotNull() & (F.col("tables_detected") == 0), "errors": F.coalesce("errors", F.array().cast("array<string>"))})
    if extra:
        out = out.join(extra["calls"], PAGE_KEY, "left").fillna(0, ["calls_primary", "calls_escalation", "tokens_in", "tokens_out"])
        fixed = {k: v for k, v in fixed.items() if k == "duration_ms"}
    return out.withColumns(fixed)


def _kept(df: DataFrame, path: str | None, name: str) -> DataFrame:
    """``df``, written once under ``path`` and read back if there is one, so that what uses it does not make it anew."""
    if path is None:
        return df
    df.write.mode("overwrite").parquet(f"{path}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/{name}")


def crops(cells: DataFrame, seen: DataFrame) -> DataFrame:
    """Cells ``TABLE_KEY, row_index, col_index, bbox`` -> the same with ``image``, their part of the page's picture; one page's cells meet in one row."""
    one = F.struct("table_idx", "row_index", "col_index", *[F.col(f"bbox.{s}").alias(s) for s in G.SIDES])
    pages = cells.groupBy(*PAGE_KEY).agg(F.collect_list(one).alias("cells")).join(seen.select(*PAGE_KEY, "image"), PAGE_KEY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from gridspark.kernels import raster as R

        schema = pa.schema([("doc_id", pa.string()), ("page_index", pa.int32()), ("table_idx", pa.int32()), ("row_index", pa.int32()), ("col_index", pa.int32()), ("image", pa.binary())])
        for b in batches:
            for p in b.to_pylist():
                gray = R.unpng(p["image"])
                place = {k: p[k] for k in PAGE_KEY}
                rows = [place | {k: c[k] for k in ("table_idx", "row_index", "col_index")} | {"image": crop(gray, None if c["x0"] is None else [c[s] for s in G.SIDES])} for c in p["cells"]]
                yield pa.RecordBatch.from_pylist(rows, schema)

    return pages.mapInArrow(run, "doc_id string, page_index int, table_idx int, row_index int, col_index int, image binary")


def heuristic(source: PdfFrames, config: PipelineConfig, answers: DataFrame | None = None, client: Client | None = None, path: str | None = None) -> Extraction:
    """Regions, the first grid of ragged, ruled and even that is there, text of the page's tokens or placeholders.

    With a client and where the settings ask for it, cells whose text is less sure than the threshold are shown to the
    model one by one; ``answers`` takes the place of its calls. ``path`` keeps what is made once.
    """
    ask = client is not None and answers is None and config.llm_fallback_enabled
    seen = _kept(see(source, config, ask), path, "seen")
    pages = seen.select(*PAGE_KEY, F.col("img_w").cast("double").alias("width"), F.col("img_h").cast("double").alias("height"))
    panels = seen.select(*PAGE_KEY, F.explode("panels").alias("bbox"))
    regions = grid.panel_regions(panels, pages) if config.enable_section_detection else grid.full_page_regions(pages)
    regions = regions.withColumnRenamed("region_idx", "table_idx")
    on = regions.join(seen.select(*PAGE_KEY, "h_lines", "v_lines", "text_boxes"), PAGE_KEY)
    merged = lambda c: grid.merge_lines(F.col(c), config.line_detection_gap_tolerance, config.line_detection_min_separation)
    ruled = grid.grid_from_lines(on.select(*TABLE_KEY, "bbox", merged("h_lines").alias("h_lines"), merged("v_lines").alias("v_lines")), TABLE_KEY)
    even = grid.even_grid(regions.select(*TABLE_KEY, "bbox", F.lit(config.default_rows).alias("n_rows"), F.lit(config.default_cols).alias("n_cols")), TABLE_KEY)
    found = {"lines": ruled, "even": even}
    notes = None
    if config.enable_irregular_structure_detection:
        b = F.col("bbox")
        inside = on.select(*TABLE_KEY, "bbox", F.posexplode("text_boxes").alias("box_idx", "tb")).filter((F.col("tb.x0") >= b["x0"]) & (F.col("tb.x1") <= b["x1"]) & (F.col("tb.y0") >= b["y0"]) & (F.col("tb.y1") <= b["y1"]))
        size = (b["x1"] - b["x0"]).alias("width"), (b["y1"] - b["y0"]).alias("height")
        moved = G.bbox(F.col("tb.x0") - b["x0"], F.col("tb.y0") - b["y0"], F.col("tb.x1") - b["x0"], F.col("tb.y1") - b["y0"])
        ragged, notes = grid.ragged_grid(inside.select(*TABLE_KEY, "box_idx", moved.alias("bbox"), *size), TABLE_KEY, config.ragged_mode)
        origin = regions.select(*TABLE_KEY, F.col("bbox.x0").alias("ox"), F.col("bbox.y0").alias("oy"))
        shifted = G.bbox(F.col("bbox.x0") + F.col("ox"), F.col("bbox.y0") + F.col("oy"), F.col("bbox.x1") + F.col("ox"), F.col("bbox.y1") + F.col("oy"))
        ragged = ragged.join(origin, TABLE_KEY).withColumn("bbox", shifted).drop("ox", "oy", "structure_source", "structure_confidence")
        found = {"irregular": ragged} | found
    cells = grid.first_available(found, TABLE_KEY)
    filler = F.coalesce("is_filler", F.lit(False)) if "is_filler" in cells.columns else F.lit(False)
    cells = cells.withColumns(
        {"is_filler": filler, "row_span": F.lit(1), "col_span": F.lit(1), "text": F.lit(None).cast("string"), "text_confidence": F.lit(None).cast("double"), "text_source": F.lit(None).cast("string")}
    ).withColumn("cell_ord", F.col("row_index") * 100_000 + F.col("col_index"))
    k = F.lit(float(config.dpi or 200))
    tokens = source.tokens.withColumn("bbox", G.points_to_pixels(F.col("bbox"), k))
    cells = assemble.fill_from_tokens(cells, tokens, TABLE_KEY)
    if (ask or answers is not None) and config.llm_fallback_enabled:
        cells = assemble.fill_placeholder(cells)
        if ask:
            unsure = _kept(cells, path, "cells").filter(F.col("text_confidence") < config.ocr_confidence_threshold)
            calls = call_cells(crops(unsure.select(*TABLE_KEY, "row_index", "col_index", "bbox"), seen), client, config.llm_model or "gemini-2.5-pro", TABLE_KEY)
            answers = _kept(calls, path, "cell_answers")
        cells = assemble.llm_fallback(cells, answers, TABLE_KEY, config.ocr_confidence_threshold)
    dims = cells.groupBy(*TABLE_KEY, "strategy").agg((F.max("row_index") + 1).alias("n_rows"), (F.max("col_index") + 1).alias("n_cols"))
    stats = assemble.table_stats(cells, TABLE_KEY)
    tables = regions.select(*TABLE_KEY, "bbox", "section_label").join(dims, TABLE_KEY, "left").join(stats, TABLE_KEY, "left")
    name = F.format_string("p%d_t%d", "page_index", "table_idx")
    status = F.when(F.col("n_rows").isNull(), "extraction_failed").otherwise("success")
    irregular = F.array().cast("array<string>")
    if notes is not None:
        tables = tables.join(notes.select(*TABLE_KEY, F.col("irregularities").alias("_notes"), F.col("structure_confidence").alias("_sc")), TABLE_KEY, "left")
        used = F.col("strategy") == "irregular"
        tables = tables.withColumns({"irregularities": F.when(used, F.col("_notes")).otherwise(irregular), "structure_confidence": F.when(used, F.col("_sc")).otherwise(1.0)}).drop("_notes", "_sc")
    else:
        tables = tables.withColumns({"irregularities": irregular, "structure_confidence": F.lit(1.0)})
    tables = tables.withColumns({"table_id": name, "status": status})
    values = assemble.assemble(cells, dims, TABLE_KEY, config.ragged_fill_value)
    values = values.join(cells.select(*TABLE_KEY, "row_index", "col_index", F.col("text_confidence").alias("confidence")), [*TABLE_KEY, "row_index", "col_index"], "left")
    layout = cells.select(*TABLE_KEY, "row_index", "col_index", "bbox", "is_filler", F.lit(None).cast("string").alias("structure_source"))
    return Extraction(values, tables, _page_results(pages, tables, source.errors, {}), source.errors, layout, seen.select(*PAGE_KEY, "img_w", "img_h"))


def from_attempts(source: PdfFrames, attempts: DataFrame, config: PipelineConfig) -> Extraction:
    """Consensus over a model's attempts, checked against the page's tokens where that is asked for.

    ``attempts`` should be a written table: it is read for the votes and for the counts.
    """
    tables, columns, cells = vote.consensus(attempts, PAGE_KEY, config.llm_consistency_threshold)
    n = tables.groupBy(*PAGE_KEY).agg(F.count(F.lit(1)).alias("n"))
    place = tables.join(n, PAGE_KEY).join(source.pages, PAGE_KEY)
    place = place.select(*TABLE_KEY, "n_rows", "n_cols", G.band(F.col("width"), F.col("height"), F.col("table_idx"), F.col("n")).alias("bbox"))
    boxes = grid.even_grid(place, TABLE_KEY)
    if config.enable_position_verification:
        t = source.tokens.select(*PAGE_KEY, "token_idx", F.col("text").alias("token"), F.col("bbox").alias("tbox"), F.col("confidence").alias("token_confidence"))
        at = ["table_idx", "row_index", "col_index"]
        pairs = verify.match_tokens(boxes, t, PAGE_KEY, at)
        matches = verify.match_cells(cells.select(*PAGE_KEY, *at, "value"), pairs, [*PAGE_KEY, *at], config.ocr_confidence_threshold)
        cells = vote.combine(cells, matches, TABLE_KEY)
        position = verify.verdict(matches, place, TABLE_KEY).select(*TABLE_KEY, "position_confidence")
        tables = tables.join(position, TABLE_KEY, "left")
        p = F.col("position_confidence")
        low = F.when((p > 0) & (p < vote.LOW), F.format_string("low_position_conf_%.2f", p))
        both = (F.col("consensus_confidence") + p) / 2
        tables = tables.withColumns({"average_confidence": F.coalesce(both, "consensus_confidence"), "irregularities": F.array_compact(F.concat("irregularities", F.array(low)))})
    else:
        tables = tables.withColumns({"average_confidence": F.col("consensus_confidence"), "position_confidence": F.lit(None).cast("double")})
    tables = tables.withColumns({"llm_fallback_count": F.lit(0), "confidence_count": F.col("cell_count"), "confidence_sum": F.col("consensus_confidence") * F.col("cell_count")})
    calls = attempts.groupBy(*PAGE_KEY).agg(
        F.count_if(F.col("tier") == "primary").cast("int").alias("calls_primary"),
        F.count_if(F.col("tier") != "primary").cast("int").alias("calls_escalation"),
        F.sum("tokens_in").alias("tokens_in"),
        F.sum("tokens_out").alias("tokens_out"),
        F.max_by("model", F.struct(F.col("error").isNull(), "attempt")).alias("model"),
    )
    failed = attempts.groupBy(*PAGE_KEY).agg(F.count_if(F.col("error").isNull()).alias("good"), F.max_by("error", "attempt").alias("error")).filter("good = 0")
    errors = source.errors.unionByName(failed.select(*PAGE_KEY, "error"))
    names = columns.groupBy(*TABLE_KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("col_index", "name"))), lambda x: x["name"]).alias("columns"))
    dpi = config.dpi or 200
    pixels = G.points_to_pixels(F.col("bbox"), F.lit(float(dpi))).alias("bbox")
    tables = tables.join(names, TABLE_KEY, "left").join(place.select(*TABLE_KEY, pixels, F.lit(None).cast("string").alias("section_label")), TABLE_KEY, "left")
    layout = boxes.select(*TABLE_KEY, "row_index", "col_index", pixels, F.lit(False).alias("is_filler"), F.lit(None).cast("string").alias("structure_source"))
    sizes = source.pages.select(*PAGE_KEY, *[F.greatest(F.lit(1), F.round(F.col(side) * dpi / 72).cast("int")).alias(to) for side, to in (("width", "img_w"), ("height", "img_h"))])
    return Extraction(cells, tables, _page_results(source.pages, tables, errors, {"calls": calls}), errors, layout, sizes)


def extract(files: DataFrame, config: PipelineConfig, client: Client | None = None, attempts_path: str | None = None, strategy: Strategy | None = None, work_path: str | None = None) -> Extraction:
    """``files(path, content)`` -> tables, by the strategy of ``config``.

    The model strategy needs a client and a path for its attempts, which are written once and read back, so that a
    retried task does not call the model again. A page with something that cannot be drawn is not shown to the model but
    an error. With ``work_path`` the pages' primitives and what is seen on them are written there once and read back.
    """
    wanted = None
    if config.page_indices is not None:
        wanted = files.select(F.col("path").alias("doc_id")).withColumn("indices", F.array(*[F.lit(i) for i in config.page_indices]).cast("array<int>"))
    source = read_pdf(files, wanted)
    if work_path is not None:
        source = frames(_kept(source.primitives, work_path, "primitives"))
    if strategy is not None:
        return strategy(source, config)
    if config.extraction_strategy == "heuristic":
        return heuristic(source, config, client=client if config.llm_fallback_enabled else None, path=work_path)
    if client is None or attempts_path is None:
        raise ValueError("the model strategy needs a client and a path for its attempts")
    escalation = config.llm_model_escalation if config.enable_auto_escalation else None
    seen = _kept(see(source, config, True), work_path, "seen")
    refused = seen.filter(F.size("undrawn") > 0).select(*PAGE_KEY, F.concat(F.lit("page cannot be drawn: "), F.array_join("undrawn", "; ")).alias("error"))
    source = replace(source, errors=source.errors.unionByName(refused))
    calls = call_pages(seen.filter(F.coalesce(F.size("undrawn"), F.lit(0)) <= 0), client, config.llm_model or "gemini-2.5-pro", escalation, config.llm_consistency_attempts)
    calls.write.mode("overwrite").parquet(attempts_path)
    return from_attempts(source, files.sparkSession.read.parquet(attempts_path), config)


def parse_only(responses: DataFrame) -> DataFrame:
    """``response`` -> its parsed tables, for looking at single answers."""
    return responses.withColumn("tables", T.parse_response(F.col("response"))["tables"])
