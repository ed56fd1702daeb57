"""Checking cell values against the page's tokens at the same place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.functions import geometry as G
from gridspark.functions import text as T
from gridspark.operators.meet import overlapping

MIN_IOU = 0.1
FUZZY = 0.8
LOW = 0.7


def match_tokens(cells: DataFrame, tokens: DataFrame, page: list[str], cell_keys: list[str], bucket: float | None = None) -> DataFrame:
    """Pairs of cells and tokens of a page whose boxes meet with an IoU above MIN_IOU.

    ``cells(page, cell_keys, bbox)``, ``tokens(page, token_idx, token, tbox, token_confidence)``. With ``bucket``, both
    sides are also dealt out by squares of that side, so that dense pages split over tasks.
    """
    pairs = overlapping(cells.select(*page, *cell_keys, "bbox"), tokens, page, "bbox", "tbox", bucket)
    return pairs.withColumn("iou", G.iou(F.col("tbox"), F.col("bbox"))).filter(F.col("iou") > MIN_IOU)


def token_text(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Tokens of a cell joined by spaces in token order, their number and mean confidence, summed in that order too so that it is the same in every run."""
    row = F.array_sort(F.collect_list(F.struct("token_idx", "token", "token_confidence")))
    out = pairs.groupBy(*keys).agg(row.alias("_row"), F.count(F.lit(1)).alias("n_tokens"))
    text = T.strip(F.array_join(F.transform("_row", lambda x: x["token"]), " "))
    known = F.filter(F.transform("_row", lambda x: x["token_confidence"].cast("double")), lambda c: c.isNotNull())
    mean = F.try_divide(F.aggregate(known, F.lit(0.0), lambda s, c: s + c), F.size(known))
    return out.select(*keys, text.alias("ocr_value"), "n_tokens", mean.alias("token_confidence"))


def ladder(value: Column, ocr: Column, n_tokens: Column, token_confidence: Column, similarity: Column, ocr_threshold: float = 0.5) -> Column:
    """The position confidence of a cell, by the first rule that fits, then the floor for pages read with low confidence."""
    v, o = F.coalesce(value, F.lit("")), F.coalesce(ocr, F.lit(""))
    blank = T.is_placeholder(v) & T.is_placeholder(o)
    rule = F.when(blank, 1.0).when(n_tokens == 0, 0.5).when(v == o, 1.0).when(similarity >= FUZZY, similarity).otherwise(0.4)
    return F.when((n_tokens > 0) & (token_confidence < ocr_threshold), F.greatest(rule, F.lit(0.6))).otherwise(rule)


def match_cells(cells: DataFrame, pairs: DataFrame, keys: list[str], ocr_threshold: float = 0.5) -> DataFrame:
    """``cells(keys, value)`` -> the match of each: value read, flags, similarity and confidence.

    The sequence ratio is a Python function, so it only sees the cells that need it: both sides there and different.
    """
    joined = cells.join(token_text(pairs, keys), keys, "left").fillna({"n_tokens": 0})
    v, o = F.coalesce("value", F.lit("")), F.coalesce("ocr_value", F.lit(""))
    joined = joined.withColumns({"value": v, "ocr_value": o})
    hard = (F.col("value") != F.col("ocr_value")) & (F.col("value") != "") & (F.col("ocr_value") != "")
    scored = joined.filter(hard).withColumn("similarity", T.similarity(F.col("value"), F.col("ocr_value")))
    all_ = joined.filter(~hard).withColumn("similarity", F.lit(0.0)).unionByName(scored)
    blank = T.is_placeholder(F.col("value")) & T.is_placeholder(F.col("ocr_value"))
    confidence = ladder(F.col("value"), F.col("ocr_value"), F.col("n_tokens"), F.col("token_confidence"), F.col("similarity"), ocr_threshold)
    exact = (F.col("value") == F.col("ocr_value")) | blank
    fuzzy = F.col("similarity") >= FUZZY
    return all_.withColumns({"is_exact": exact, "is_fuzzy": fuzzy, "is_position_match": blank | ((F.col("n_tokens") > 0) & (exact | fuzzy)), "confidence": confidence}).drop("token_confidence")


def verdict(matches: DataFrame, dims: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, position_confidence, mismatched``: the mean over all positions, missing cells as 0; null for an empty grid."""
    size = F.col("n_rows") * F.col("n_cols")
    low = F.when(F.col("confidence") < LOW, F.struct("row_index", "col_index"))
    found = matches.groupBy(*keys).agg(F.sum("confidence").alias("_sum"), F.array_sort(F.collect_list(low)).alias("mismatched"))
    out = dims.select(*keys, "n_rows", "n_cols").join(found, keys, "left")
    empty = F.array().cast("array<struct<row_index:int,col_index:int>>")
    return out.select(*keys, F.try_divide(F.coalesce("_sum", F.lit(0.0)), size).alias("position_confidence"), F.coalesce("mismatched", empty).alias("mismatched"))
