"""PDF files that keep arriving: a file stream whose micro-batches are extracted and written once each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridspark.config import PipelineConfig
from gridspark.plans import extract as E

BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def watch(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """New ``*.pdf`` files of a folder, each once by its path and time."""
    reader = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("pathGlobFilter", "*.pdf")
    return reader.option("maxFilesPerTrigger", files_per_batch).load(folder)


def run(spark: SparkSession, folder: str, out: str, config: PipelineConfig, client=None, once: bool = True, on_batch: Callable[[int, E.Extraction], None] | None = None) -> StreamingQuery:
    """Writes ``cells``, ``tables`` and ``jobs`` under ``out``, a folder per micro-batch.

    A batch that is run again after a failure overwrites its own folders, so every file counts once. ``jobs`` has a row
    per file with its status.
    """

    def handle(files: DataFrame, batch: int) -> None:
        got = E.extract(files.select("path", "content"), config, client, f"{out}/attempts/batch={batch}", work_path=f"{out}/work/batch={batch}")
        got.cells.write.mode("overwrite").parquet(f"{out}/cells/batch={batch}")
        got.tables.write.mode("overwrite").parquet(f"{out}/tables/batch={batch}")
        pages = got.pages.groupBy("doc_id").agg(F.max(F.when(F.col("tables_extracted") > 0, 1).otherwise(0)).alias("any"), F.flatten(F.collect_list("errors")).alias("errors"))
        jobs = files.select(F.col("path").alias("doc_id"), F.col("modificationTime").alias("created_at")).join(pages, "doc_id", "left")
        status = F.when(F.coalesce("any", F.lit(0)) > 0, "completed").when(F.size(F.coalesce("errors", F.array().cast("array<string>"))) > 0, "failed").otherwise("completed")
        jobs.select(F.sha2("doc_id", 256).alias("job_id"), F.col("doc_id").alias("path"), status.alias("status"), "created_at", F.array_join("errors", "; ").alias("error")).write.mode("overwrite").parquet(f"{out}/jobs/batch={batch}")
        if on_batch:
            on_batch(batch, got)

    writer = watch(spark, folder).writeStream.foreachBatch(handle).option("checkpointLocation", f"{out}/_checkpoint")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


def job_counts(spark: SparkSession, out: str) -> DataFrame:
    from gridspark.operators.runstats import status_counts
    from gridspark.schemas import JOB_STATUSES

    return status_counts(spark.read.parquet(f"{out}/jobs"), JOB_STATUSES)
