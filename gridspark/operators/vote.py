"""Majority voting over repeated extraction attempts, all by first-seen tie-break."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.functions import text as T

LOW = 0.7


def mode_first_seen(df: DataFrame, keys: list[str], value: Column, order: Column) -> DataFrame:
    """``keys, value, n, of``: the commonest value, the first seen among equals, its votes and all votes.

    Two aggregations with map-side partial sums; the second stays in the partitioning of ``keys`` where Spark can reuse it.
    """
    votes = df.groupBy(*keys, value.alias("value")).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("seen"))
    best = F.struct(F.col("n"), (-F.col("seen")).alias("early"))
    return votes.groupBy(*keys).agg(F.max_by(F.struct("value", "n"), best).alias("best"), F.sum("n").alias("of")).select(*keys, "best.value", "best.n", "of")


def tiers(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """Escalation attempts only count where no primary one succeeded; failed ones never do."""
    good = attempts.filter(F.col("error").isNull() & F.col("response").isNotNull())
    primary = good.filter("tier = 'primary'")
    return primary.unionByName(good.filter("tier <> 'primary'").join(primary.select(*keys).distinct(), keys, "left_anti"))


def candidates(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, attempt, table_idx, table_id, columns, rows, n_rows, n_cols``: the tables of the first successful attempt by place, in all attempts."""
    parsed = attempts.withColumn("r", T.parse_response(F.col("response"))).filter("r is not null")
    first = parsed.groupBy(*keys).agg(F.min_by(F.coalesce(F.size("r.tables"), F.lit(0)), "attempt").alias("n_tables"))
    each = parsed.select(*keys, "attempt", F.posexplode("r.tables").alias("table_idx", "t"))
    each = each.join(first, keys).filter("table_idx < n_tables")
    empty_rows, empty_columns = F.array().cast("array<array<string>>"), F.array().cast("array<string>")
    each = each.withColumns({"rows": F.coalesce("t.rows", empty_rows), "columns": F.coalesce("t.columns", empty_columns)})
    name = F.coalesce("t.table_id", F.concat(F.lit("table_"), F.col("table_idx")))
    return each.select(*keys, "attempt", "table_idx", name.alias("table_id"), "columns", "rows", F.size("rows").alias("n_rows"), F.size("columns").alias("n_cols"))


def vote_shape(found: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, n_rows, n_cols, n, of``."""
    best = mode_first_seen(found, keys, F.struct("n_rows", "n_cols"), F.col("attempt"))
    return best.select(*keys, "value.n_rows", "value.n_cols", "n", "of")


def agreeing(found: DataFrame, keys: list[str]) -> DataFrame:
    """The candidates of the winning shape."""
    return found.join(vote_shape(found, keys).select(*keys, "n_rows", "n_cols"), [*keys, "n_rows", "n_cols"])


def vote_cells(valid: DataFrame, keys: list[str], threshold: float = 0.8) -> DataFrame:
    """``keys, row_index, col_index, value, confidence, agreed`` from ``keys, attempt, rows, n_cols``.

    Short rows vote with empty strings and so do nulls; cells beyond the last column have no vote.
    """
    rows = valid.select(*keys, "attempt", "n_cols", F.posexplode("rows").alias("row_index", "r"))
    cells = rows.select(*keys, "attempt", "row_index", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("n_cols") - 1), lambda i: F.coalesce(F.get("r", i), F.lit("")))).alias("col_index", "v"))
    best = mode_first_seen(cells, [*keys, "row_index", "col_index"], F.col("v"), F.col("attempt"))
    confidence = F.col("n") / F.col("of")
    return best.select(*keys, "row_index", "col_index", "value", confidence.alias("confidence"), (confidence >= threshold).alias("agreed"))


def vote_columns(valid: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, col_index, name, n, of``."""
    each = valid.select(*keys, "attempt", F.posexplode("columns").alias("col_index", "name"))
    return mode_first_seen(each, [*keys, "col_index"], F.coalesce("name", F.lit("")), F.col("attempt")).withColumnRenamed("value", "name")


def summarise(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Consensus of a table: mean confidence, texts, low cells and the irregularities that they make."""
    low = F.count_if(F.col("confidence") < LOW)
    out = cells.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("cell_count"),
        F.count_if(F.coalesce("value", F.lit("")) != "").alias("cells_with_text"),
        F.avg("confidence").alias("consensus_confidence"),
        low.alias("low_cells"),
    )
    note = F.when(F.col("low_cells") > 0, F.format_string("low_confidence_%d_cells", "low_cells"))
    return out.withColumn("irregularities", F.array_compact(F.array(F.lit("llm_extracted"), note)))


def combine(consensus: DataFrame, position: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of consensus and position confidence by cell; the union of the cells that either finds low."""
    at = [*keys, "row_index", "col_index"]
    both = consensus.join(position.select(*at, F.col("confidence").alias("position")), at, "left")
    mixed = F.coalesce((F.col("confidence") + F.col("position")) / 2, F.col("confidence"))
    low = (F.col("confidence") < LOW) | F.coalesce(F.col("position") < LOW, F.lit(False))
    return both.select(*at, "value", F.col("confidence").alias("consensus"), "position", mixed.alias("confidence"), low.alias("mismatched"))


def consensus(attempts: DataFrame, keys: list[str], threshold: float = 0.8) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Attempts -> (tables, columns, cells) of the consensus; one attempt agrees with itself."""
    table = [*keys, "table_idx"]
    found = candidates(tiers(attempts, keys), keys)
    valid = agreeing(found, table)
    names = valid.groupBy(*table).agg(F.min_by("table_id", "attempt").alias("table_id"), F.first("n_rows").alias("n_rows"), F.first("n_cols").alias("n_cols"), F.count(F.lit(1)).alias("n_attempts"))
    cells = vote_cells(valid.filter("n_cols > 0"), table, threshold)
    tables = names.join(summarise(cells, table), table, "left").withColumn("status", F.lit("success"))
    tables = tables.fillna({"cell_count": 0, "cells_with_text": 0, "consensus_confidence": 1.0, "low_cells": 0})
    tables = tables.withColumn("irregularities", F.coalesce("irregularities", F.array(F.lit("llm_extracted"))))
    return tables, vote_columns(valid, table), cells
