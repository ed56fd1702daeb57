"""Where files come from: paths on any file system that Spark has a connector for, or bytes in hand."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.sources import pdf

KINDS = ("file", "bytes", "url", "s3", "gcs", "hdfs")


@dataclass
class InputSource:
    kind: str
    location: str | None = None
    data: bytes | None = None
    options: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"unknown source: {self.kind}")
        if self.kind == "bytes" and self.data is None:
            raise ValueError("a bytes source needs data")
        if self.kind != "bytes" and not self.location:
            raise ValueError(f"a {self.kind} source needs a location")

    def resolve(self, spark: SparkSession) -> DataFrame:
        """``(path, content)``. Object stores need their Hadoop connector on the class path, http its file system."""
        if self.kind == "bytes":
            return pdf.from_bytes(spark, {self.location or "input.pdf": self.data or b""})
        where = self.location or ""
        if self.kind in ("s3", "gcs"):
            where = where.replace("s3://", "s3a://", 1)
        return spark.read.format("binaryFile").options(**self.options).load(where).select("path", "content")


def result_tables(spark: SparkSession, folder: str) -> DataFrame:
    """``(table_no, path, columns, rows)`` of the ``table_<n>.csv`` files of a run: the first record and the others, of any width; an empty file holds none."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "table_*.csv").load(folder)
    number = F.regexp_extract("path", r"table_(\d+)\.csv$", 1)
    files = files.select(F.when(number != "", number.cast("int")).alias("table_no"), "path", F.decode("content", "UTF-8").alias("value"))
    return files.filter("table_no is not null").mapInArrow(_parsed, "table_no int, path string, columns array<string>, rows array<array<string>>")


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    strings = pa.list_(pa.string())
    for b in batches:
        tables = [list(csv.reader(io.StringIO(text, newline=""))) or [[]] for text in b.column("value").to_pylist()]
        cols = pa.array([t[0] for t in tables], strings), pa.array([t[1:] for t in tables], pa.list_(strings))
        yield pa.RecordBatch.from_arrays([b.column("table_no"), b.column("path"), *cols], ["table_no", "path", "columns", "rows"])
