"""Choosing pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def select_pages(pages: DataFrame, wanted: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """``pages(doc_id, page_index, ...)`` and ``wanted(doc_id, indices array<int>)`` -> (chosen pages with ``ord``, errors).

    No ``wanted`` takes all pages; repeats are kept and order is that of the list; an index without a page becomes an
    error. A document with an empty list has no page.
    """
    if wanted is None:
        return pages.withColumn("ord", F.col("page_index")), pages.select("doc_id", F.lit("").alias("error")).limit(0)
    each = wanted.select("doc_id", F.posexplode("indices").alias("ord", "page_index"))
    joined = each.join(pages.withColumn("_there", F.lit(True)), ["doc_id", "page_index"], "left")
    chosen = joined.filter("_there").drop("_there")
    errors = joined.filter("_there is null").select("doc_id", "ord", F.format_string("Page index %d out of range", "page_index").alias("error"))
    return chosen, errors
