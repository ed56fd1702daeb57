"""Benchmark decontamination: a hash set of normalised test n-grams, scanned over every document's windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import ascii_lower, split_words

N = 13
#: Contaminated from one twentieth of the words on.
RATIO = 20
#: The set of windows is broadcast up to so many rows (about 150 bytes each); a larger one is joined by a shuffle.
MAX_BROADCAST = 200_000


#: Separators before lower-casing; the words that they leave are lower-cased only where they are compared.
CASED_NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _words(rows: DataFrame, *columns: Column) -> DataFrame:
    """``columns``, the words ``w`` of ``text`` in their own case, and a hash ``hs`` of each, caseless.

    explode() of one element: what it makes is made once, not anew in every lambda that the optimizer moves it to.
    """
    out = rows.select(*columns, F.explode(F.array(split_words(F.col("text"), CASED_NOT_WORD))).alias("w"))
    return out.withColumn("hs", F.explode(F.array(F.transform("w", lambda x: F.xxhash64(F.lower(x))))))


def _sample(n: int) -> list[int]:
    return sorted({0, n // 3, 2 * n // 3, n - 1})


def _hashes(n: int) -> Column:
    """A hash of four words of every window of ``n``, in order; what meets the set by it is then compared in full."""
    last = F.size("hs") - n
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*[F.get("hs", i + k) for k in _sample(n)]))


def _gram(at: Column, n: Column) -> Column:
    return ascii_lower(F.array_join(F.slice("w", at + 1, n), " "))


def benchmark_windows(bench: DataFrame, n: int = N) -> DataFrame:
    """``(h, n, gram, items)``: each distinct window of the items, with its words and the item_ids that hold it.

    An item of fewer than ``n`` words is one window; an item without words, or null, has none. A null item_id
    counts as the item named by the empty string.
    """
    items = _words(bench, F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item")).filter(F.size("w") > 0)
    items = items.withColumn("n", F.least(F.size("w"), F.lit(n)))
    at = items.withColumn("at", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("n"))))
    h = F.lit(None).cast("long")
    for k in range(1, n + 1):
        h = F.when(F.col("n") == k, F.xxhash64(*[F.get("hs", F.col("at") + i) for i in _sample(k)])).otherwise(h)
    grams = at.select(h.alias("h"), "n", _gram(F.col("at"), F.col("n")).alias("gram"), "item")
    return grams.groupBy("h", "n", "gram").agg(F.collect_set("item").alias("items"))


def hits(docs: DataFrame, bench: DataFrame, n: int = N, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """One row per distinct (doc_id, text): ``doc_id, t, copies, n_words, found``.

    ``found`` holds ``(at, n, items)`` of every window of the document that the benchmark has, checked word by
    word. Up to ``max_broadcast`` windows: one scan, and one exchange of a row per document and its hits; the windows
    meet the broadcast set and are compared inside the scan's stage, and a marker row keeps documents without hits.
    Beyond it, hashes are joined by a shuffle and what they find goes back to the texts for the comparison.
    """
    grams = benchmark_windows(bench, n)
    sizes = {r[0]: r[1] for r in grams.groupBy("n").count().collect()}  # n rows at most
    key = F.col("doc_id"), F.xxhash64("text").alias("t")
    texts = _words(docs, *key)
    marker = F.array(F.xxhash64("doc_id", "t"))  # meets no window, as its n is 0; unlike ones spread over the tasks of a shuffle
    rows = texts.select("doc_id", "t", "w", F.posexplode(F.concat(marker, *[_hashes(k) for k in sorted(sizes)])).alias("p", "h"))
    at, of, first = F.lit(-1), F.lit(0), F.lit(1)
    for k in sorted(sizes):  # the windows of each length follow one another
        at = F.when(F.col("p") >= first, F.col("p") - first).otherwise(at)
        of = F.when(F.col("p") >= first, F.lit(k)).otherwise(of)
        first = first + F.greatest(F.size("w") - (k - 1), F.lit(0))
    words = F.when(F.col("p") == 0, F.size("w"))
    side = grams.select(F.col("h").alias("gh"), F.col("n").alias("gn"), "gram", "items")
    is_pair = (F.col("h") == F.col("gh")) & (F.col("n") == F.col("gn"))
    if sum(sizes.values()) <= max_broadcast:
        rows = rows.select("doc_id", "t", "w", "h", at.alias("at"), of.alias("n"), words.alias("words"))
        found = rows.join(F.broadcast(side), is_pair, "left")
        found = found.filter((F.col("at") < 0) | (F.col("gram") == _gram(F.col("at"), F.col("n"))))
        return _by_document(found, F.struct("at", "n", "items"))
    rows = rows.select("doc_id", "t", "h", at.alias("at"), of.alias("n"), words.alias("words"))
    found = rows.join(side, is_pair, "left").filter((F.col("at") < 0) | F.col("gram").isNotNull())
    found = _by_document(found, F.struct("at", "n", "items", "gram"))
    same = texts.select("doc_id", "t", "w").dropDuplicates(["doc_id", "t"]).withColumnsRenamed({"doc_id": "i", "t": "u"})
    found = found.join(same, found.doc_id.eqNullSafe(same.i) & (found.t == same.u))
    checked = F.filter("found", lambda x: x["gram"] == _gram(x["at"], x["n"]))
    only = F.transform(checked, lambda x: F.struct(x["at"].alias("at"), x["n"].alias("n"), x["items"].alias("items")))
    return found.select("doc_id", "t", "copies", "n_words", only.alias("found"))


def _by_document(found: DataFrame, one: Column) -> DataFrame:
    return found.groupBy("doc_id", "t").agg(
        F.count("words").alias("copies"),
        F.max("words").cast("long").alias("n_words"),
        F.collect_set(F.when(F.col("at") >= 0, one)).alias("found"),
    )


def _covered(found: Column) -> Column:
    """How many words the windows cover together."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def step(acc: Column, x: Column) -> Column:
        end = x["at"] + x["n"]
        new = F.greatest(end - F.greatest(acc["end"], x["at"]), F.lit(0))
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + new).alias("n"))

    return F.aggregate(F.array_sort(F.transform(found, lambda x: F.struct(x["at"].alias("at"), x["n"].alias("n")))), start, step)["n"]


def contamination(docs: DataFrame, bench: DataFrame, n: int = N) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: ``doc_id, t, n_words, n_hit, items, contaminated``.

    Null text has no words and is clean, as is every document of an empty benchmark. Repeated rows each keep a row,
    other columns are ignored. ``items`` are the item_ids as sorted strings.
    """
    rows = hits(docs, bench, n).withColumn("n_hit", _covered(F.col("found")))
    rows = rows.withColumn("items", F.array_sort(F.array_distinct(F.flatten("found.items"))))
    bad = (F.col("n_hit") > 0) & (RATIO * F.col("n_hit") >= F.col("n_words"))
    rows = rows.withColumn("contaminated", bad).withColumn("_", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    return rows.select("doc_id", "t", "n_words", "n_hit", "items", "contaminated")


def _key(c: Column) -> Column:
    return F.coalesce(c.cast("long"), F.lit(-(1 << 63)))


def remove_documents(docs: DataFrame, bench: DataFrame, n: int = N) -> DataFrame:
    """``docs`` without the contaminated documents, all columns kept."""
    bad = contamination(docs, bench, n).filter("contaminated").select(_key(F.col("doc_id")).alias("id"), "t").distinct()
    return _keyed(docs).join(bad, ["id", "t"], "left_anti").select("row.*")


def _keyed(docs: DataFrame) -> DataFrame:
    """Every column in ``row``, out of the way of the names used here."""
    return docs.select(F.struct("*").alias("row"), _key(F.col("doc_id")).alias("id"), F.xxhash64("text").alias("t"))


def remove_spans(docs: DataFrame, bench: DataFrame, n: int = N) -> DataFrame:
    """``docs`` with the hit words taken out of the texts that have any; the words left are joined by one space.

    Words are those of the contamination rule, but keep their case; texts without a hit stay as they are.
    """
    spans = F.transform("found", lambda x: F.struct(x["at"].alias("at"), (x["at"] + x["n"]).alias("end")))
    found = hits(docs, bench, n).filter(F.size("found") > 0).select(_key(F.col("doc_id")).alias("id"), "t", spans.alias("spans"))
    rows = _keyed(docs).join(found, ["id", "t"], "left")
    words = split_words(F.col("row.text"), CASED_NOT_WORD)
    kept = F.filter(words, lambda w, i: ~F.exists("spans", lambda s: (s["at"] <= i) & (i < s["end"])))
    text = F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(F.array_join(kept, " "))
    return rows.select(*[text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
