"""Connected components of a link table by repeated contraction, in Spark only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch


def components(links: DataFrame) -> DataFrame:
    """``links(a long, b long)`` -> ``(node long, root long)``, one row per linked node.

    Each round points every node at its least neighbour, follows the pointers twice more, and replaces
    the ends of every edge by what they point at; equal edges and loops vanish, so the rounds end after
    about the logarithm of the longest path. Nodes are ordered by XXH64 of their value, which is one to one
    on longs, so pointer chains stay short whatever the values are. ``root`` is that hash of one node of
    the component. A hub's edges meet its single pointer row in sort-merge joins, which AQE can split.
    Self links and repeated links are harmless; nulls are dropped; no links give no rows.
    """
    links = links.dropna().filter("a <> b")
    e = links.select(F.xxhash64("a").alias("x"), F.xxhash64("b").alias("y"))
    edges, maps = scratch.table(_ordered(e), "edges"), []
    while not edges.isEmpty():
        near = scratch.table(edges.groupBy("u").agg(F.min("v").alias("p")), "near")
        to = scratch.table(_follow(_follow(near, near), near), "pointers")
        maps.append(to)
        moved = edges.join(_named(to, "u", "pu"), "u", "left").join(_named(to, "v", "pv"), "v", "left")
        moved = moved.select(F.coalesce("pu", "u").alias("x"), F.coalesce("pv", "v").alias("y"))
        done, edges = [edges, near], scratch.table(_ordered(moved), "edges")
        for x in done:
            scratch.drop(x)
    nodes = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    out = nodes.withColumn("root", F.xxhash64("node"))
    for to in maps:
        out = out.join(_named(to, "root", "next"), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return scratch.table(out, "components")


def _ordered(pairs: DataFrame) -> DataFrame:
    big, small = F.greatest("x", "y"), F.least("x", "y")
    return pairs.filter("x <> y").select(big.alias("u"), small.alias("v")).distinct()


def _named(to: DataFrame, key: str, value: str) -> DataFrame:
    return to.select(F.col("u").alias(key), F.col("p").alias(value))


def _follow(to: DataFrame, base: DataFrame) -> DataFrame:
    """One step further along the pointers of ``base``."""
    return to.join(_named(base, "p", "q"), "p", "left").select("u", F.coalesce("q", "p").alias("p"))
