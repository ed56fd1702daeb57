"""Accuracy against ground truth: cells, tables, runs, confidence intervals, gates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.functions import geometry as G
from gridspark.functions import text as T
from gridspark.kernels.resample import draws

AT = ["row_index", "col_index"]
F1_TOLERANCE = 0.05
#: Tables of a part of the bootstrap, those whose draws are counted in one pass, and draws of a task, about.
SMALL = 1 << 17
WINDOW = 1 << 24
TASK_DRAWS = 50_000_000


def match_tables(predicted: DataFrame, truth: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables on ``table_id``, the last truth of an id (by ``ord``); and the predicted ones that no truth names."""
    last = truth.groupBy("table_id").agg(F.max_by(F.struct(*[c for c in truth.columns if c not in ("table_id", "ord")]), "ord").alias("gt"))
    return predicted.join(last, "table_id"), predicted.join(last, "table_id", "left_anti")


def last_of(truth: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row by ``order`` of each key."""
    rest = [c for c in truth.columns if c not in (*keys, order)]
    return truth.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_x")).select(*keys, "_x.*")


def cell_metrics(predicted: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Predicted cells joined to the truth's cells of the same place: IoU, exact match, error rates and span match."""
    at = [*keys, *AT]
    p = predicted.select(*at, F.col("text").alias("p_text"), F.col("bbox").alias("p_box"), F.col("row_span").alias("p_rs"), F.col("col_span").alias("p_cs"))
    t = truth.select(*at, F.col("text").alias("t_text"), F.col("bbox").alias("t_box"), F.col("row_span").alias("t_rs"), F.col("col_span").alias("t_cs"))
    a, b = F.coalesce("p_text", F.lit("")), F.coalesce("t_text", F.lit(""))
    return p.join(t, at).select(
        *at,
        G.iou(F.col("p_box"), F.col("t_box")).alias("iou"),
        (a == b).alias("text_match"),
        T.cer(a, b).alias("cer"),
        T.wer_char(a, b).alias("wer"),
        ((F.col("p_rs") == F.col("t_rs")) & (F.col("p_cs") == F.col("t_cs"))).alias("span_match"),
    )


def _rate(flag: str) -> Column:
    return F.avg(F.col(flag).cast("double"))


def table_metrics(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Means by table; error rates only over cells with one below 1, and 1 where there is none."""
    counts = (F.col("cer") < 1) | (F.col("wer") < 1)
    return cells.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_cells"),
        F.avg("iou").alias("avg_cell_iou"),
        _rate("text_match").alias("exact_match_rate"),
        _rate("span_match").alias("span_accuracy"),
        F.coalesce(F.avg(F.when(counts, F.col("cer"))), F.lit(1.0)).alias("avg_cer"),
        F.coalesce(F.avg(F.when(counts, F.col("wer"))), F.lit(1.0)).alias("avg_wer"),
    )


def harmonic(a: Column, b: Column) -> Column:
    return F.when(a + b > 0, 2 * a * b / (a + b)).otherwise(0.0)


_MEANS = {"avg_grid_shape_accuracy": "grid_shape_match", "avg_cell_iou": "avg_cell_iou", "avg_span_accuracy": "span_accuracy", "avg_cer": "avg_cer", "avg_wer": "avg_wer", "exact_match_rate": "exact_match_rate"}
_WITHOUT = {"avg_cer": 1.0, "avg_wer": 1.0}


def run_metrics(tables: DataFrame, n_truth: Column, keys: list[str] | None = None) -> DataFrame:
    """One row per ``keys`` (one in all without): counts, macro means and F1 scores over ``tables``.

    Recall may pass 1, and text accuracy may fall below 0, as the count-based definitions allow.
    """
    n = F.count(F.lit(1))
    aggs = [n.alias("tables_detected"), F.max(n_truth).alias("tables_ground_truth")]
    aggs += [F.coalesce(F.avg(F.col(c).cast("double")), F.lit(_WITHOUT.get(name, 0.0))).alias(name) for name, c in _MEANS.items()]
    out = tables.groupBy(*(keys or [])).agg(*aggs)
    d, t = F.col("tables_detected"), F.col("tables_ground_truth")
    out = out.withColumns(
        {
            "table_detection_precision": F.when(d > 0, F.least(F.lit(1.0), t / F.greatest(d, F.lit(1)))).otherwise(0.0),
            "table_detection_recall": F.when(t > 0, d / F.greatest(t, F.lit(1))).otherwise(0.0),
            "structural_f1": harmonic(F.col("avg_cell_iou"), F.col("avg_span_accuracy")),
            "text_f1": harmonic(1.0 - F.col("avg_cer"), F.col("exact_match_rate")),
        }
    )
    return out.withColumns(
        {
            "table_detection_f1": harmonic(F.col("table_detection_precision"), F.col("table_detection_recall")),
            "overall_f1": harmonic(F.col("structural_f1"), F.col("text_f1")),
        }
    )


_RESAMPLED = ("avg_cell_iou", "span_accuracy", "avg_cer", "exact_match_rate")


def _weights(batches: Iterator[pa.RecordBatch], n: int, size: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Replicates -> ``replicate, part, weights``: how often each table of a part is drawn, packed."""
    window = max(size, WINDOW // size * size)
    for replicate in (r for b in batches for r in b.column(0).to_pylist()):
        for low in range(0, n, window):
            times = np.zeros(min(window, n - low), np.uint32)
            for at in draws(seed, replicate, n):
                if n > window:
                    at = at[(at >= low) & (at < low + window)] - low
                np.add.at(times, at, np.uint32(1))
            parts = [times[i : i + size] for i in range(0, len(times), size)]
            for i in range(0, len(parts), 64):
                packed = [pa.compress((x.astype(np.uint8) if x.max() < 256 else x).tobytes(), codec="zstd", asbytes=True) for x in parts[i : i + 64]]
                wide = [bool(x.max() > 255) for x in parts[i : i + 64]]
                ids = low // size + i + np.arange(len(packed))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(packed), replicate)), pa.array(ids), pa.array(wide), pa.array(packed, pa.binary())], ["replicate", "part", "wide", "weights"])


def _part_sums(tables: pa.Table, drawn: pa.Table, n: int, size: int) -> pa.Table:
    """Sums and counts of a part's values in each replicate, without nulls."""
    names = [f"{kind}_{c}" for kind in "sn" for c in _RESAMPLED]
    rows = drawn.num_rows
    out = np.zeros((rows, len(names)))
    if rows and tables.num_rows:
        low = drawn.column("part")[0].as_py() * size
        x = np.zeros((min(size, n - low), len(names)))
        at = tables.column("ord").to_numpy() - low
        for i, c in enumerate(_RESAMPLED):
            there = tables.column(c).is_valid().to_numpy()
            x[at[there], i] = tables.column(c).drop_null().to_numpy()
            x[at[there], len(_RESAMPLED) + i] = 1
        odd = np.flatnonzero(~np.isfinite(x).all(axis=1))
        odd_x, x[odd] = x[odd], 0  # a table that is not drawn adds nothing, not even where it is NaN
        weights, wide = drawn.column("weights"), drawn.column("wide").to_pylist()
        for i in range(0, rows, 16):
            w = np.empty((min(16, rows - i), len(x)))
            for j in range(len(w)):
                kind = np.dtype(np.uint32 if wide[i + j] else np.uint8)
                w[j] = np.frombuffer(pa.decompress(weights[i + j].as_py(), len(x) * kind.itemsize, "zstd"), kind)
            out[i : i + len(w)] = w @ x
            for k, row in zip(odd, odd_x, strict=True):
                hit = w[:, k] > 0
                out[i : i + len(w)][hit] += w[hit, k, None] * row
    return pa.table([drawn.column("replicate"), *out.T.copy()], ["replicate", *names])


def bootstrap(tables: DataFrame, n_truth: int, replicates: int = 1000, confidence: float = 0.95, seed: int = 42) -> DataFrame:
    """``lower, upper`` of the overall F1 over resamples of the tables with replacement; 0 and 0 without tables.

    ``tables`` is a table per document table and must have a total order in ``ord`` (0, 1, ...). A draw is the first 32 bits
    of an MD5, the same in any SQL engine. How often a replicate draws each table is counted where it is drawn; these
    counts, about a third of a byte a draw, meet the values by parts of SMALL tables, so that no draw is a row.
    """
    spark = tables.sparkSession
    n, size = tables.count(), max(1, SMALL)
    if not n:
        return spark.createDataFrame([(0.0, 0.0)], "lower double, upper double")
    tasks = min(replicates, max(4 * spark.sparkContext.defaultParallelism, replicates * n // TASK_DRAWS))
    drawn = spark.range(0, replicates, numPartitions=tasks).mapInArrow(lambda x: _weights(x, n, size, seed), "replicate long, part long, wide boolean, weights binary")
    values = tables.select(F.floor(F.col("ord") / size).alias("part"), F.col("ord").cast("long").alias("ord"), *[F.col(c).cast("double").alias(c) for c in _RESAMPLED])
    sums = [f"{kind}_{c}" for kind in "sn" for c in _RESAMPLED]
    parts = values.groupBy("part").cogroup(drawn.groupBy("part")).applyInArrow(lambda x, y: _part_sums(x, y, n, size), f"replicate long, {', '.join(f'{c} double' for c in sums)}")
    runs = parts.groupBy("replicate").agg(*[F.sum(c).alias(c) for c in sums])
    iou, span, cer, exact = (F.coalesce(F.try_divide(f"s_{c}", f"n_{c}"), F.lit(_WITHOUT.get(c, 0.0))) for c in _RESAMPLED)
    runs = runs.select(harmonic(harmonic(iou, span), harmonic(1.0 - cer, exact)).alias("overall_f1"))
    low = min(int((1.0 - confidence) / 2 * replicates), replicates - 1)
    high = min(int((1.0 - (1.0 - confidence) / 2) * replicates), replicates - 1)
    all_ = F.array_sort(F.collect_list("overall_f1"))
    return runs.agg(all_.alias("x")).select(F.get("x", F.lit(low)).alias("lower"), F.get("x", F.lit(high)).alias("upper"))


def annotation_cells(annotations: DataFrame) -> DataFrame:
    """Ground truth as long cells; a cell's place in the file is ``cell_ord``."""
    t = annotations.select("pdf_file", F.posexplode("tables").alias("table_idx", "t"))
    c = t.select("pdf_file", "table_idx", "t.table_id", "t.n_rows", "t.n_cols", F.posexplode("t.cells").alias("cell_ord", "c"))
    return c.select(
        "pdf_file", "table_idx", "table_id", "n_rows", "n_cols", "cell_ord", F.col("c.row").alias("row_index"), F.col("c.col").alias("col_index"),
        F.coalesce("c.rowspan", F.lit(1)).alias("row_span"), F.coalesce("c.colspan", F.lit(1)).alias("col_span"), F.col("c.text").alias("text"), F.col("c.bbox").alias("bbox"),
    )


def table_errors(tables: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``table_idx, n_rows, n_cols`` -> one row per fault of the dimensions."""
    def bad(side: str) -> Column:
        return F.when(F.col(side) <= 0, F.format_string(f"Table %d: {side} must be positive, got %d", "table_idx", side))

    return tables.select(*(keys or []), "table_idx", F.explode(F.array_compact(F.array(bad("n_rows"), bad("n_cols")))).alias("error"))


def cell_errors(cells: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Cells with ``table_idx, cell_ord, n_rows, n_cols`` -> one row per fault of place, span or box."""
    where = "Table %d, Cell %d: "

    def off(name: str, pos: str, n: str) -> Column:
        return F.when((F.col(pos) < 0) | (F.col(pos) >= F.col(n)), F.format_string(where + name + " %d out of range [0, %d)", "table_idx", "cell_ord", pos, n))

    def flat(name: str, span: str) -> Column:
        return F.when(F.col(span) <= 0, F.format_string(where + name + " must be positive", "table_idx", "cell_ord"))

    def beyond(name: str, pos: str, span: str, n: str) -> Column:
        message = f"{where}cell extends beyond table ({name} %d + {name}span %d > %d)"
        return F.when(F.col(pos) + F.col(span) > F.col(n), F.format_string(message, "table_idx", "cell_ord", pos, span, n))

    def box(axis: str) -> Column:
        a, b = F.col(f"bbox.{axis}0"), F.col(f"bbox.{axis}1")
        good = (a >= 0) & (a <= b) & (b <= 1)
        return F.when(F.col("bbox").isNotNull() & ~good, F.format_string(where + f"invalid bbox {axis} coordinates", "table_idx", "cell_ord"))

    faults = F.array(
        off("row", "row_index", "n_rows"), off("col", "col_index", "n_cols"), flat("rowspan", "row_span"), flat("colspan", "col_span"),
        beyond("row", "row_index", "row_span", "n_rows"), beyond("col", "col_index", "col_span", "n_cols"), box("x"), box("y"),
    )
    return cells.select(*(keys or []), "table_idx", "cell_ord", F.explode(F.array_compact(faults)).alias("error"))


def unpivot(metrics: DataFrame, names: list[str]) -> DataFrame:
    """A row of metrics -> ``metric, actual``."""
    pairs = ", ".join(f"'{n}', cast({n} as double)" for n in names)
    return metrics.selectExpr(f"stack({len(names)}, {pairs}) as (metric, actual)")


def gates(actual: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Every threshold with its limit and whether the metric passes; ``passed`` is null for a metric that is missing."""
    up = F.coalesce("inverted", F.lit(False))
    limit = F.when(up, F.col("target") + F.col("tolerance")).otherwise(F.col("target") - F.col("tolerance"))
    out = thresholds.join(F.broadcast(actual), "metric", "left").withColumn("threshold", limit)
    return out.withColumn("passed", F.when(up, F.col("actual") <= F.col("threshold")).otherwise(F.col("actual") >= F.col("threshold")))


def regression(current: DataFrame, baseline: DataFrame, tolerance: float = F1_TOLERANCE) -> DataFrame:
    """``delta, failed``: whether the overall F1 fell by more than the tolerance."""
    both = current.select(F.col("overall_f1").alias("now")).crossJoin(F.broadcast(baseline.select(F.col("overall_f1").alias("was"))))
    return both.select("now", "was", (F.col("now") - F.col("was")).alias("delta"), (F.col("was") - F.col("now") > tolerance).alias("failed"))
