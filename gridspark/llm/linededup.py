"""Line dedup by site-relative frequency: lines that too many of a host's pages have are boilerplate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch, urls

#: Lines (or hosts) that are broadcast at most, of about 10 (100) bytes each; beyond it pages are shuffled by host and salt.
MAX_BROADCAST = 1_000_000
SALTS = 64
#: Boilerplate: in more than RATIO of the host's pages, and in MIN_PAGES of them at least. Tenths, for exact comparison.
#: On a host of one or two pages every line is on half of them or more, which says nothing of its being repeated.
RATIO_TENTHS = 3
MIN_PAGES = 3
# Fixed patterns of HTML: what is not shown (to the end, where it is not closed), tags inside a line, all other tags.
HIDDEN = r"(?is)<script\b.*?(?:</script>|\z)|<style\b.*?(?:</style>|\z)|<!--.*?(?:-->|\z)"
INLINE = r"(?i)</?(?:a|abbr|b|big|cite|code|em|font|i|mark|q|s|small|span|strong|sub|sup|u)\b[^>]*>"
TAG = r"<[^>]*>"
BLANK = " \t\n\x0b\x0c\r"


def lines(html: Column) -> Column:
    """The lines that a page shows: text between other than inline tags, and between line ends, trimmed; none are empty."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, "\n")
    text = F.regexp_replace(F.regexp_replace(text, INLINE, ""), TAG, "\n")
    return F.array_remove(F.transform(F.split(text, r"[\x0A-\x0D][\x20\x09-\x0D]*"), lambda x: F.btrim(x, F.lit(BLANK))), "")


def _rows(pages: DataFrame) -> DataFrame:
    """explode() of one element: the lines are made once for all that use them."""
    return pages.select("page_id", urls.host(F.col("url")).alias("host"), F.explode(F.array(lines(F.col("html")))).alias("lines"))


def boilerplate(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """``(host, hashes)``: the XXH64 of the boilerplate lines of each host that has any.

    Lines are counted once a page, by host and hash with partial sums before the shuffle; no host's lines ever meet in
    one task. What is left for a host is bounded by its mean number of lines a page over the ratio.
    """
    rows = _rows(pages).filter("host <> ''")
    hashes = F.array_distinct(F.transform("lines", lambda x: F.xxhash64(x)))
    count = rows.select("host", F.explode(hashes).alias("h")).groupBy("host", "h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_pages)
    total = pages.select(urls.host(F.col("url")).alias("host")).filter("host <> ''").groupBy("host").agg(F.count(F.lit(1)).alias("total"))
    total = scratch.table(total, "hosts")  # both sides of the join are plain exchanges then, which AQE can split
    common = count.join(_small(total, total.count()), "host").filter(10 * F.col("n") > RATIO_TENTHS * F.col("total"))
    return common.groupBy("host").agg(F.collect_list("h").alias("hashes"))


def _small(side: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(side) if rows <= MAX_BROADCAST else side


def drop_boilerplate(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """One row per row of ``pages(page_id, url, html, ...)``: ``page_id, host, n_lines, n_dropped, kept``.

    ``kept`` joins the other lines by line feeds. Every row is a page, repeated ones too; pages without a host lose
    nothing; null html has no lines. Other columns are ignored. A line goes by its ratio if ``min_pages`` pages have it.
    """
    common = scratch.table(boilerplate(pages, min_pages), "boilerplate")
    size = common.agg(F.coalesce(F.sum(F.size("hashes") + 8), F.lit(0))).first()[0]
    rows, key = _rows(pages), ["host"]
    if size > MAX_BROADCAST:  # every host's pages are dealt over SALTS tasks, and its lines go to each of them
        rows, key = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "lines"), F.lit(SALTS)).cast("int")), ["host", "salt"]
        common = common.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.join(_small(common, size), key, "left")
    kept = F.when(F.col("hashes").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains(F.col("hashes"), F.xxhash64(x))))
    rows = rows.select("page_id", "host", F.size("lines").cast("long").alias("n_lines"), F.explode(F.array(kept)).alias("kept"))
    return rows.select("page_id", "host", "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_dropped"), F.array_join("kept", "\n").alias("kept"))
