"""A global row number without a single-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows between cuts, about, and cuts at most.
STRETCH = 50_000
MAX_CUTS = 4000
_STEP = 32


def _below(cuts: Column, n: int, key: Column) -> Column:
    """How many of the sorted cuts lie below ``key``: among every _STEP-th one first, then in the stretch found."""
    coarse = F.size(F.filter(F.transform(F.sequence(F.lit(1), F.lit(n // _STEP)), lambda i: F.get(cuts, i * _STEP - 1)), lambda c: c < key)) if n >= _STEP else F.lit(0)
    return coarse * _STEP + F.size(F.filter(F.slice(cuts, coarse * _STEP + 1, _STEP), lambda c: c < key))


def number(df: DataFrame, *by: str, name: str = "ord") -> DataFrame:
    """``df`` with a bigint from 0 in the order of ``by``, which must be total for the numbers to be the same in every run.

    Keys whose hash is a multiple of the stretch are cuts, so which range a row falls in depends on the data alone,
    however often or where a task runs. Rows are numbered within their range, and the ranges' sizes, a row for each,
    give the number that theirs starts from.
    """
    n = df.count()
    key = F.struct(*by)
    every = max(STRETCH, n // MAX_CUTS)
    found = df.select(*by).filter(F.pmod(F.xxhash64(*by), F.lit(every)) == 0).distinct().orderBy(*by).collect() if n > STRETCH else []
    part = F.lit(0)
    if found:
        kinds = dict(df.dtypes)
        cuts = F.array(*[F.struct(*[F.lit(r[c]).cast(kinds[c]).alias(c) for c in by]) for r in found])
        part = _below(cuts, len(found), key)
    placed = df.withColumn("_part", part)
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", before.alias("_start"))
    at = F.row_number().over(Window.partitionBy("_part").orderBy(*by)) - 1
    return placed.withColumn("_at", at).join(F.broadcast(starts), "_part").withColumn(name, F.col("_at") + F.col("_start")).drop("_part", "_at", "_start")
