"""Pairs of boxes that overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.functions import geometry as G

#: Squares that a box is dealt out to at most; larger ones meet all boxes of their page.
WIDE = 64
#: Tasks that the boxes of a page share where they meet a large one.
SHARES = 16


def overlapping(a: DataFrame, b: DataFrame, on: list[str], a_box: str, b_box: str, side: float | None = None) -> DataFrame:
    """Rows of ``a`` and ``b`` that are equal in ``on`` and whose boxes overlap, every pair once.

    With ``side`` the boxes are dealt out by squares of that side, so that a dense page compares only what lies near and
    splits over tasks; a pair is kept in the square where its overlap starts. The pairs may be far more than the rows, so
    the number of tasks is the session's, whatever the rows' size, and no side is broadcast.
    """
    if not side:
        return a.join(b, on).filter(G.overlaps(F.col(a_box), F.col(b_box)))
    n = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*on, "_kind", "_x", "_y"]
    a, b = (_dealt(df, box, side, first).repartition(n, *keys) for df, box, first in ((a, a_box, True), (b, b_box, False)))
    p, q = ({s: F.col(f"_{name}_{s}") for s in G.SIDES} for name in "ab")
    pairs = a.hint("merge").join(b, keys).filter(G.overlaps(p, q))
    starts = [F.col(k) == F.floor(F.greatest(p[s], q[s]) / side) for k, s in (("_x", "x0"), ("_y", "y0"))]
    return pairs.filter((F.col("_kind") > 0) | (starts[0] & starts[1])).drop("_kind", "_x", "_y", *[f"_{name}_{s}" for name in "ab" for s in G.SIDES])


def _dealt(df: DataFrame, box: str, side: float, first: bool) -> DataFrame:
    """Every box in its squares (kind 0). Large ones of the first side meet all of the second in kind 1, and small ones of the first meet large ones of the second in kind 2."""
    b, host = F.col(box), 1 if first else 2
    crossed = (F.abs(b["x1"] - b["x0"]) / side + 1) * (F.abs(b["y1"] - b["y0"]) / side + 1)
    small, large = ([0, 3 - host], [1]) if first else ([0, 3 - host], [1, 2])
    kinds = F.when(crossed <= WIDE, F.array(*map(F.lit, small))).otherwise(F.array(*map(F.lit, large)))
    sides = [b[s].alias(f"_{'a' if first else 'b'}_{s}") for s in G.SIDES]  # plain columns are read faster for every pair than fields
    k, share = F.col("_kind"), F.pmod(F.xxhash64(b), F.lit(SHARES)).cast("long")

    def at(v: Column) -> Column:
        return F.floor(v / side).cast("long")

    def span(start: Column, end: Column) -> Column:
        return F.explode(F.sequence(start, end))

    x0, x1 = (F.when(k == 0, at(b[s])).when(k == host, F.lit(last).cast("long")).otherwise(share) for s, last in (("x0", 0), ("x1", SHARES - 1)))
    y0, y1 = (F.when(k == 0, at(b[s])).otherwise(F.lit(0).cast("long")) for s in ("y0", "y1"))
    out = df.select(*df.columns, *sides, F.explode(kinds).alias("_kind"))
    return out.withColumn("_x", span(x0, x1)).withColumn("_y", span(y0, y1))
