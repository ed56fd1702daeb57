"""Filling cells with text, and spreading merged cells over the grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.functions import geometry as G
from gridspark.operators.meet import overlapping

PLACEHOLDER_CONFIDENCE = 0.9


def fill_placeholder(cells: DataFrame) -> DataFrame:
    """``r{row}c{col}`` with confidence 0.9 in cells without text."""
    empty = F.coalesce("text", F.lit("")) == ""
    text = F.format_string("r%dc%d", "row_index", "col_index")
    return cells.withColumns(
        {
            "text": F.when(empty, text).otherwise(F.col("text")),
            "text_confidence": F.when(empty, PLACEHOLDER_CONFIDENCE).otherwise(F.col("text_confidence")),
            "text_source": F.when(empty, "ocr").otherwise(F.col("text_source")),
        }
    )


def fill_from_tokens(cells: DataFrame, tokens: DataFrame, keys: list[str], min_share: float = 0.5, bucket: float | None = None) -> DataFrame:
    """Text of the page's tokens that lie in a cell by at least ``min_share``, in token order, where the cell has none.

    With ``bucket``, cells and tokens of a page are dealt out by squares of that side.
    """
    at = [*keys, "row_index", "col_index"]
    c = cells.filter(F.coalesce("text", F.lit("")) == "").select("doc_id", "page_index", *[k for k in at if k not in ("doc_id", "page_index")], "bbox")
    t = tokens.select("doc_id", "page_index", "token_idx", F.col("text").alias("token"), F.col("bbox").alias("tbox"), "confidence")
    hit = overlapping(c, t, ["doc_id", "page_index"], "bbox", "tbox", bucket).filter(G.containment(F.col("tbox"), F.col("bbox")) >= min_share)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("token_idx", "token"))), lambda x: x["token"]), " ")
    found = hit.groupBy(*at).agg(joined.alias("_text"), F.avg("confidence").alias("_conf"))
    out = cells.join(found, at, "left")
    new = F.col("_text").isNotNull()
    return out.withColumns(
        {
            "text": F.coalesce("_text", "text"),
            "text_confidence": F.when(new, F.col("_conf")).otherwise(F.col("text_confidence")),
            "text_source": F.when(new, "embedded").otherwise(F.col("text_source")),
        }
    ).drop("_text", "_conf")


def llm_fallback(cells: DataFrame, answers: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """Answers ``(keys, row_index, col_index, answer, error)`` for cells below the threshold; the confidence stays.

    A failed or missing answer leaves the text as it is.
    """
    at = [*keys, "row_index", "col_index"]
    out = cells.join(answers.select(*at, "answer", "error"), at, "left")
    use = (F.col("text_confidence") < threshold) & F.col("error").isNull() & F.col("answer").isNotNull()
    use = F.coalesce(use, F.lit(False))
    return out.withColumns({"text": F.when(use, F.col("answer")).otherwise(F.col("text")), "text_source": F.when(use, "llm_fallback").otherwise(F.col("text_source"))}).drop("answer", "error")


def assemble(cells: DataFrame, dims: DataFrame, keys: list[str], filler: str | None = None) -> DataFrame:
    """``keys, row_index, col_index, value`` for every position of ``dims``.

    A cell writes its text to all positions that it spans inside the grid; the first text by ``cell_ord`` stays. Filler
    cells write ``filler`` if given.
    """
    value = F.when(F.col("is_filler") & F.lit(filler is not None), F.lit(filler)).otherwise(F.col("text"))
    at = [*keys, "row_index", "col_index"]
    spread = cells.withColumn("value", value).filter("value is not null").join(dims.select(*keys, "n_rows", "n_cols"), keys)
    last = lambda start, span, n: F.least(F.col(start) + F.col(span), F.col(n)) - 1
    spread = spread.filter("row_index < n_rows and col_index < n_cols and row_span > 0 and col_span > 0")
    spread = spread.select(*keys, "cell_ord", "value", F.explode(F.sequence(F.col("row_index"), last("row_index", "row_span", "n_rows"))).alias("row_index"), "col_index", "col_span", "n_cols")
    spread = spread.select(*keys, "cell_ord", "value", "row_index", F.explode(F.sequence(F.col("col_index"), last("col_index", "col_span", "n_cols"))).alias("col_index"))
    won = spread.groupBy(*at).agg(F.min_by("value", "cell_ord").alias("value"))
    grid = dims.filter("n_rows > 0 and n_cols > 0").withColumn("row_index", F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1)))
    grid = grid.withColumn("col_index", F.explode(F.sequence(F.lit(0), F.col("n_cols") - 1))).select(*at)
    return grid.join(won, at, "left")


def to_rows(values: DataFrame, keys: list[str]) -> DataFrame:
    """Long cells -> ``keys, columns, rows``: one array of rows per table, columns ``col_{i}``."""
    line = F.transform(F.array_sort(F.collect_list(F.struct("col_index", "value"))), lambda x: x["value"])
    rows = values.groupBy(*keys, "row_index").agg(line.alias("line"))
    table = F.transform(F.array_sort(F.collect_list(F.struct("row_index", "line"))), lambda x: x["line"])
    out = rows.groupBy(*keys).agg(table.alias("rows"))
    width = F.size(F.element_at("rows", 1))
    return out.select(*keys, F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.concat(F.lit("col_"), i)).alias("columns"), "rows")


def table_stats(cells: DataFrame, keys: list[str]) -> DataFrame:
    has_text: Column = F.coalesce("text", F.lit("")) != ""
    return cells.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("cell_count"),
        F.count_if(has_text).alias("cells_with_text"),
        F.coalesce(F.avg("text_confidence"), F.lit(0.0)).alias("average_confidence"),
        F.count_if(F.col("text_source") == "llm_fallback").alias("llm_fallback_count"),
        F.coalesce(F.sum("text_confidence"), F.lit(0.0)).alias("confidence_sum"),
        F.count("text_confidence").alias("confidence_count"),
    )
