"""Intermediate tables in the folder that driver and executors share (``spark.checkpoint.dir``)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def root(spark: SparkSession) -> str:
    """The shared folder. Where the session names none, a local master gets a temporary one; a cluster must name it."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='gridspark-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{root(spark)}/gridspark/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def table(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once and read it back: cuts the lineage and survives the loss of an executor."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of the tables read, as stored, for a task of a shuffle; and tasks at most.
TASK_BYTES = 64 << 20
MAX_TASKS = 50_000


def tasks(df: DataFrame, times: int = 1) -> int:
    """Tasks for a shuffle of all of ``df``, or of ``times`` as much: as the session asks for, more if the tables that it reads are large."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = (int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    size = sum(x for x in sizes if x < 1 << 60)  # beyond it nothing is known of a table
    asked = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, asked, min(MAX_TASKS, size * times // TASK_BYTES))


def drop(df: DataFrame) -> None:
    """Delete the files behind a result of :func:`table` that nothing reads any more."""
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        drop_path(df.sparkSession, f)


def drop_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
