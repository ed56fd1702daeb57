"""Extracted cells against annotations: cell, table and run metrics, an interval, gates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.operators import metrics, order


@dataclass
class Evaluation:
    cells: DataFrame
    tables: DataFrame
    run: DataFrame
    interval: DataFrame
    unmatched: DataFrame


def evaluate(predicted: DataFrame, truth: DataFrame, replicates: int = 1000, confidence: float = 0.95, seed: int = 42) -> Evaluation:
    """Long cells ``table_id, n_rows, n_cols, cell_ord, row_index, col_index, row_span, col_span, text, bbox`` of both sides.

    Tables meet on their id; those that no annotation names are in ``unmatched``. One shuffle for each grain: cells by
    table and place, tables by id, the run.
    """
    shape = lambda df: df.groupBy("table_id").agg(F.max("n_rows").alias("n_rows"), F.max("n_cols").alias("n_cols"))
    p, t = shape(predicted), shape(truth)
    both = p.join(t.withColumnsRenamed({"n_rows": "t_rows", "n_cols": "t_cols"}), "table_id")
    match = both.select("table_id", ((F.col("n_rows") == F.col("t_rows")) & (F.col("n_cols") == F.col("t_cols"))).alias("grid_shape_match"))
    truth = metrics.last_of(truth.select("table_id", "cell_ord", *metrics.AT, "row_span", "col_span", "text", "bbox"), ["table_id", *metrics.AT], "cell_ord")
    cells = metrics.cell_metrics(predicted, truth, ["table_id"])
    tables = match.join(metrics.table_metrics(cells, ["table_id"]), "table_id", "left")
    tables = tables.fillna({"avg_cell_iou": 0.0, "exact_match_rate": 0.0, "span_accuracy": 0.0, "avg_cer": 1.0, "avg_wer": 1.0, "n_cells": 0})
    n_truth = t.count()
    run = metrics.run_metrics(tables, F.lit(n_truth))
    return Evaluation(cells, tables, run, metrics.bootstrap(order.number(tables, "table_id"), n_truth, replicates, confidence, seed), p.join(t, "table_id", "left_anti"))
