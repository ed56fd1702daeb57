"""Ground truth: annotation files, and the pairing of a benchmark folder's annotations with its PDF files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.schemas import ANNOTATION

SMOKE = 5


def read(spark: SparkSession, path: str) -> DataFrame:
    """Annotations as nested rows; a file that is not JSON fails the read, a table without its id or shape fails :func:`required`."""
    rows = spark.read.schema(ANNOTATION).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return rows.withColumn("path", F.col("_metadata.file_path"))


def required(annotations: DataFrame) -> DataFrame:
    """The same rows; the job fails at a table without id, box, rows or columns."""
    whole = F.forall("tables", lambda t: t["table_id"].isNotNull() & t["bbox"].isNotNull() & t["n_rows"].isNotNull() & t["n_cols"].isNotNull())
    return annotations.filter(F.when(whole, F.lit(True)).otherwise(F.raise_error(F.lit("a table lacks table_id, bbox, n_rows or n_cols")).cast("boolean")))


def _stems(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{suffix}").option("recursiveFileLookup", True).load(folder).select("path")
    return files.withColumn("stem", F.regexp_extract("path", rf"([^/]+)\.{suffix}$", 1))


def dataset(spark: SparkSession, annotations: str, pdfs: str, subset: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(pairs ``stem, annotation, pdf``, annotations without a file).

    ``smoke`` takes the first five annotations by name, ``full`` or none all, anything else those whose stem holds it.
    ValueError if no pair is left.
    """
    a = _stems(spark, annotations, "json").withColumnRenamed("path", "annotation")
    if subset == "smoke":
        a = a.orderBy("stem").limit(SMOKE)
    elif subset and subset != "full":
        a = a.filter(F.contains("stem", F.lit(subset)))
    p = _stems(spark, pdfs, "pdf").withColumnRenamed("path", "pdf")
    pairs = a.join(p, "stem")
    if pairs.isEmpty():
        raise ValueError(f"no annotated files for subset {subset!r}")
    return pairs, a.join(p, "stem", "left_anti")


def to_json(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Long truth cells -> ``(pdf_file, json)``."""
    cell = F.struct(F.col("row_index").alias("row"), F.col("col_index").alias("col"), F.col("row_span").alias("rowspan"), F.col("col_span").alias("colspan"), "text", "bbox")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("cell_ord", cell.alias("c")))), lambda x: x["c"])
    tables = cells.groupBy(*keys, "table_idx", "table_id", "n_rows", "n_cols").agg(ordered.alias("cells"))
    table = F.struct("table_id", "n_rows", "n_cols", "cells")
    all_ = F.transform(F.array_sort(F.collect_list(F.struct("table_idx", table.alias("t")))), lambda x: x["t"])
    return tables.groupBy(*keys).agg(all_.alias("tables")).select(*keys, F.to_json(F.struct(*keys, "tables")).alias("json"))
