"""A run's folder: manifest, statistics, and a CSV file per table."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def csv_text(columns: list[str], rows: list[list[str | None]]) -> str:
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(columns)
    writer.writerows([["" if v is None else v for v in row] for row in rows])
    return out.getvalue()


def _as_csv(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        text = [csv_text(c, r) for c, r in zip(b.column("columns").to_pylist(), b.column("rows").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("table_no"), pa.array(text, pa.string())], ["table_no", "csv"])


def tables_as_csv(tables: DataFrame) -> DataFrame:
    """``table_no, columns, rows`` -> ``table_no, csv``; every table keeps its own width."""
    return tables.select("table_no", "columns", "rows").mapInArrow(_as_csv, "table_no int, csv string")


def write_tables(tables: DataFrame, folder: str) -> None:
    """CSV text of all tables on any file system that Spark writes: a folder per table, one file in each."""
    rows = tables_as_csv(tables).withColumn("value", F.expr("trim(TRAILING '\n' FROM csv)"))
    rows.select(F.format_string("table_%d.csv", "table_no").alias("table"), "value").write.mode("overwrite").partitionBy("table").text(folder)


@dataclass
class OutputSink:
    """``filesystem`` writes ``<location>/<run_id>/``; ``spark`` writes Parquet with the same names on any file system."""

    kind: str
    location: str

    def __post_init__(self) -> None:
        if self.kind not in ("filesystem", "spark"):
            raise NotImplementedError(f"no sink of kind {self.kind}; give spark a path of that store")

    def write(self, run_id: str, manifest: Mapping[str, Any], stats: Mapping[str, Any], tables: DataFrame) -> str:
        where = f"{self.location.rstrip('/')}/{run_id}"
        if self.kind == "spark":
            tables.write.parquet(f"{where}/tables")
            spark = tables.sparkSession
            meta = [("manifest", json.dumps(manifest, default=str)), ("run_stats", json.dumps(stats, default=str))]
            spark.createDataFrame(meta, "name string, json string").write.parquet(f"{where}/meta")
            return where
        folder = Path(where)
        (folder / "tables").mkdir(parents=True, exist_ok=True)
        (folder / "manifest.json").write_text(json.dumps(manifest, indent=2, default=str), encoding="utf-8")
        (folder / "run_stats.json").write_text(json.dumps(stats, indent=2, default=str), encoding="utf-8")
        for r in tables_as_csv(tables).toLocalIterator():  # one table in the driver at a time
            (folder / "tables" / f"table_{r['table_no']}.csv").write_text(r["csv"], encoding="utf-8")
        return where
