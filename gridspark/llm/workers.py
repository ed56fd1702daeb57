"""What Python workers keep. A worker outlives its tasks and counts towards its executor's memory while others run."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache, wraps

import pyarrow as pa
from pyspark.sql import SparkSession

Task = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def lean(task: Task) -> Task:
    """``task`` for mapInArrow; at its end, what was freed goes back to the system instead of staying with the worker."""

    @wraps(task)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            release()

    return run


#: Bytes of an Arrow batch under :func:`small_batches`. A worker holds two, and the JVM one that grows by doubling beside each.
BYTES_A_BATCH = 8 << 20
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs meanwhile hands rows to Python workers in batches of BYTES_A_BATCH; then the session's limit holds again."""
    before = spark.conf.get(_LIMIT, None)
    spark.conf.set(_LIMIT, BYTES_A_BATCH)
    try:
        yield
    finally:
        spark.conf.unset(_LIMIT) if before is None else spark.conf.set(_LIMIT, before)


def release() -> None:
    """Give free memory of Arrow's pool and, where the C library is glibc, of the heap back."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


@lru_cache(1)
def _trim():
    try:
        return getattr(ctypes.CDLL(None), "malloc_trim", None)
    except (OSError, TypeError):
        return None
