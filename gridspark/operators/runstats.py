"""Run-level statistics from page results, and comparison of manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.functions import text as T


_SUMS = ("tables_detected", "tables_extracted", "tables_failed", "cells_with_text", "total_cells", "llm_fallback_count", "calls_primary", "calls_escalation", "tokens_in", "tokens_out")


def run_stats(pages: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per ``keys`` (one in all without): sums, weighted mean confidence, durations over those above 0,
    errors in page order and models in order of first use.

    Pages are added up by model first, with partial sums, so that a run's row gathers its models and the pages with
    errors but not every page.
    """
    keys = keys or []
    busy = F.when(F.col("duration_ms") > 0, F.col("duration_ms"))
    of = F.when(F.col("confidence_count") > 0, F.col("confidence_sum"))
    part = pages.groupBy(*keys, F.coalesce("model", F.lit("")).alias("_model")).agg(
        F.count(F.lit(1)).alias("_pages"),
        F.count_if("skipped").alias("_skipped"),
        *[F.sum(c).alias(c) for c in _SUMS],
        F.sum(of).alias("_of"),
        F.sum("confidence_count").alias("_count"),
        F.min(busy).alias("_min"),
        F.max(busy).alias("_max"),
        F.sum(busy).alias("_busy"),
        F.count(busy).alias("_n"),
        F.min("page_index").alias("_first"),
        F.collect_list(F.when(F.size("errors") > 0, F.struct("page_index", "errors"))).alias("_errors"),
    )
    faults = F.array_sort(F.flatten(F.collect_list("_errors")))
    models = F.array_sort(F.collect_list(F.when(F.col("_model") != "", F.struct("_first", "_model"))))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    none = F.lit(0).cast("bigint")
    out = part.groupBy(*keys).agg(
        F.coalesce(F.sum("_pages"), none).alias("pages"),
        F.coalesce(F.sum("_skipped"), none).alias("pages_skipped"),
        *[F.sum(c).alias(c) for c in _SUMS[:6]],
        zero(F.try_divide(F.sum("_of"), F.sum("_count"))).alias("average_confidence"),
        zero(F.min("_min")).alias("min_page_duration_ms"),
        zero(F.max("_max")).alias("max_page_duration_ms"),
        zero(F.try_divide(F.sum("_busy"), F.sum("_n"))).alias("average_page_duration_ms"),
        zero(F.sum("_busy")).alias("busy_ms"),
        *[F.sum(c).alias(c) for c in _SUMS[6:]],
        F.flatten(F.transform(faults, lambda x: x["errors"])).alias("errors"),
        F.transform(models, lambda x: x["_model"]).alias("models_used"),
    )
    return out


def split_cost(stats: DataFrame, primary: str, escalation: str) -> DataFrame:
    """Adds ``estimated_cost_usd``: tokens by the share of calls, cut to whole tokens, the rest to the escalation model."""
    calls = F.col("calls_primary") + F.col("calls_escalation")
    share = F.coalesce(F.try_divide(F.col("calls_primary"), calls), F.lit(1.0))
    share = F.when(F.col("calls_escalation") > 0, share).otherwise(1.0)
    p_in, p_out = F.floor(F.col("tokens_in") * share), F.floor(F.col("tokens_out") * share)
    cost = T.cost_usd(p_in, p_out, F.lit(primary)) + T.cost_usd(F.col("tokens_in") - p_in, F.col("tokens_out") - p_out, F.lit(escalation))
    return stats.withColumns({"primary_tokens_in": p_in, "primary_tokens_out": p_out, "estimated_cost_usd": cost})


def worker_utilization(stats: DataFrame, total_ms: float, workers: int) -> DataFrame:
    use = F.least(F.lit(1.0), F.col("busy_ms") / (total_ms * workers)) if total_ms > 0 and workers > 1 else F.lit(0.0)
    return stats.withColumn("worker_utilization", use)


def status_counts(jobs: DataFrame, statuses: tuple[str, ...]) -> DataFrame:
    return jobs.agg(*[F.count_if(F.col("status") == s).alias(s) for s in statuses], F.count(F.lit(1)).alias("total"))


def tables_by_page(tables: DataFrame, keys: list[str]) -> DataFrame:
    """Successful tables of each page in order."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("table_idx", "table_id"))), lambda x: x["table_id"])
    return tables.filter("status = 'success'").groupBy(*keys).agg(ids.alias("tables"))


def batch_summary(docs: DataFrame) -> DataFrame:
    """``doc_id, tables, error`` of a batch -> counts of documents."""
    return docs.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("error").isNull()).alias("successful"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.coalesce(F.sum("tables"), F.lit(0)).alias("tables"))


def _entries(manifest: DataFrame) -> DataFrame:
    """A manifest as ``kind, name, value`` rows."""
    one = manifest.select(F.explode(F.array(F.struct(F.lit("git_commit").alias("kind"), F.lit("").alias("name"), F.col("git_commit").alias("value")), F.struct(F.lit("config_digest").alias("kind"), F.lit("").alias("name"), F.col("config_digest").alias("value")))).alias("x")).select("x.*")
    packages = manifest.select(F.lit("package").alias("kind"), F.explode("package_versions").alias("name", "value"))
    parts = manifest.select(F.posexplode("components").alias("i", "c")).groupBy("c.name").agg(F.max_by("c.version", "i").alias("value"))
    return one.union(packages).union(parts.select(F.lit("component").alias("kind"), "name", "value"))


def entries_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Entries ``kind, name, value`` of two manifests, of any number -> ``kind, name, first, second`` of those that differ, missing ones as null."""
    x, y = a.withColumnRenamed("value", "first"), b.withColumnRenamed("value", "second")
    return x.join(y, ["kind", "name"], "full_outer").filter(~F.col("first").eqNullSafe(F.col("second")))


def manifest_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """``kind, name, first, second`` of everything that differs between two manifests, missing entries as null."""
    return entries_diff(_entries(a), _entries(b))


def merged_config(layers: DataFrame, order: list[str]) -> DataFrame:
    """``key`` and one value column per layer -> ``key, value, layer`` of the last layer in ``order`` that sets it."""
    last = list(reversed(order))
    which = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in last])
    return layers.select("key", F.coalesce(*last).alias("value"), which.alias("layer"))


def meaningful(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Whether a table's confidences say anything (more than one value, or none of 1), and whether to colour its cells."""
    c = F.col("confidence")
    out = cells.groupBy(*keys).agg((F.count_distinct(c) > 1).alias("_many"), F.bool_or(c == 1.0).alias("_one"), F.avg(c).alias("consensus"))
    says = F.coalesce(F.col("_many") | ~F.col("_one"), F.lit(False))
    return out.select(*keys, says.alias("meaningful"), (says | (F.col("consensus") < 1.0)).alias("highlight"))
