"""Mixing sources to target weights: budgets handed down a domain-language-source tree, then seeded prefixes of each leaf."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch
from .words import SPACE, split_words

LEVELS = ("domain", "lang", "source")
#: Hex digits of a document's key that the cut of a leaf is narrowed to before rows are sorted.
DIGITS = 4
#: The table of leaves is broadcast up to so many rows (about 100 bytes each); beyond it Spark joins as it sees fit.
MAX_BROADCAST = 50_000


@dataclass(frozen=True)
class Mix:
    """Integer weights by name for each level (1 for names not given), the budget as a share of all tokens, epochs of a leaf at most."""

    domain: dict[str, int] = field(default_factory=dict)
    lang: dict[str, int] = field(default_factory=dict)
    source: dict[str, int] = field(default_factory=dict)
    share: tuple[int, int] = (1, 2)
    epochs: int = 2
    seed: int = 17


PRODUCTION = Mix(domain={"web": 5, "forum": 2, "books": 2, "code": 1}, lang={"en": 6, "de": 2, "fr": 2, "es": 2}, source={"src0": 3})
#: The domain of a source is the rest of its number by four.
DOMAINS = ("web", "forum", "books", "code")


def domain_of(source: Column) -> Column:
    number = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]{1,9})$", 1)
    k = F.when(number != "", number.cast("int") % len(DOMAINS))
    name = F.lit("other")
    for i, d in enumerate(DOMAINS):
        name = F.when(k == i, F.lit(d)).otherwise(name)
    return name


def n_tokens(text: Column) -> Column:
    return F.size(split_words(text, SPACE)).cast("long")


def _weight(level: str, mix: Mix) -> Column:
    out = F.lit(1)
    for name, w in getattr(mix, level).items():
        out = F.when(F.col(level) == name, F.lit(w)).otherwise(out)
    return out.cast("decimal(10,0)")


def _share_out(nodes: DataFrame, level: str, above: list[str], mix: Mix) -> DataFrame:
    """Budgets of siblings from their parent's: by weight, none beyond its capacity, what one cannot take to the others.

    Sorted by capacity over weight, the saturated ones come first: child i is, if all before it are and its fair share of
    what they leave reaches its capacity. The rest share the remainder by weight, rounded down. Integers throughout.
    """
    w = F.col("w")
    nodes = nodes.withColumn("w", _weight(level, mix)).withColumn("c", F.col("capacity").cast("decimal(18,0)"))
    siblings = Window.partitionBy(*above, "budget")
    order = siblings.orderBy(F.col("capacity") / w.cast("double"), level)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("budget").cast("decimal(18,0)") - F.coalesce(F.sum("c").over(before), F.lit(0))
    weights = F.sum("w").over(siblings) - F.coalesce(F.sum("w").over(before), F.lit(0))
    out = nodes.withColumn("full", (F.col("c") * weights.cast("decimal(18,0)") <= w * left.cast("decimal(18,0)")).cast("int"))
    out = out.withColumn("full", F.min("full").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rest = F.col("budget") - F.sum(F.col("full") * F.col("capacity")).over(siblings)
    open_w = F.sum((1 - F.col("full")) * w).over(siblings)
    out = out.withColumns({"rest": rest.cast("decimal(18,0)"), "open_w": open_w.cast("decimal(18,0)")})
    share = F.expr("cast(floor((w * rest - (w * rest) % open_w) / open_w) as bigint)")
    return out.withColumn("mine", F.when(F.col("full") == 1, F.col("capacity")).otherwise(share)).select(*above, level, "capacity", F.col("mine").alias("budget"))


def budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """``(domain, lang, source, tokens)`` -> the same and ``budget``, from the root down.

    A node's capacity is the sum of its leaves' tokens times the epochs, so a shortage goes to siblings first and
    leaves a subtree only when all of it is used up.
    """
    num, den = mix.share
    sized = leaves.withColumn("capacity", F.col("tokens") * mix.epochs)
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("all")).select(F.expr(f"least(all * {num} div {den}, all * {mix.epochs})").alias("budget"))
    have = None
    for i, level in enumerate(LEVELS):
        keys = list(LEVELS[: i + 1])
        nodes = sized.groupBy(*keys).agg(F.sum("capacity").alias("capacity"))
        nodes = nodes.crossJoin(F.broadcast(total)) if have is None else nodes.join(have.select(*keys[:-1], "budget"), keys[:-1])
        have = _share_out(nodes, level, keys[:-1], mix)
    return sized.drop("capacity").join(have.select(*LEVELS, "budget"), list(LEVELS))


def _placed(rows: DataFrame, leaves: DataFrame, mix: Mix) -> DataFrame:
    """Rows with ``doc_id`` and the tree's keys, their leaf's columns, and their ``key`` in the epoch that is cut."""
    side = F.broadcast(leaves) if leaves.count() <= MAX_BROADCAST else leaves
    number = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("t"), F.col("t").cast("string")))  # null ones are not all in one bucket
    key = F.md5(F.concat_ws(":", F.lit(str(mix.seed)), F.col("whole").cast("string"), number))
    return rows.join(side, list(LEVELS)).withColumn("key", key)


def _keys(docs: DataFrame) -> list[Column]:
    """The tree's keys, never null."""
    return [domain_of(F.col("source")).alias("domain"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")]


def _id(c: Column) -> Column:
    return F.coalesce(c.cast("long"), F.lit(-(1 << 63))).alias("id")


def _narrow(cuts: DataFrame, placed: DataFrame, digits: int) -> DataFrame:
    """The first bucket of each leaf in which the tokens pass the room, among the rows of the bucket cut so far."""
    rows = placed.join(cuts, list(LEVELS)).filter(F.startswith("key", F.col("cut")))
    sums = rows.groupBy(*LEVELS, "room", F.substring("key", 1, digits).alias("bucket")).agg(F.sum("n").alias("n"))
    sums = sums.withColumn("upto", F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("bucket")))  # a row for each bucket
    left = F.col("room") - F.col("upto") + F.col("n")
    first = F.min_by(F.struct(F.col("bucket").alias("cut"), left.alias("room")), "bucket")
    return scratch.table(sums.filter("upto > room").groupBy(*LEVELS).agg(first.alias("x")).select(*LEVELS, "x.cut", "x.room"), "cuts")


def copies(docs: DataFrame, mix: Mix = PRODUCTION) -> DataFrame:
    """``docs(doc_id, text, lang, source, ...)`` -> ``row`` (all its columns), ``domain`` and ``n_copies``, one row per row.

    A leaf whose budget is e whole passes over its tokens and a rest gives every document e times, and once more the
    longest run of documents from the start of epoch e's order whose tokens fit the rest. The order is that of
    md5(seed:epoch:doc_id), with the text's hash for a null doc_id, then doc_id, then the text's hash; rows equal in all three stand or fall together. It is
    cut by radix: tokens by leaf and two hex digits show which of 256 buckets the cut falls in, two more which part of
    it, and only the rows of that part are sorted. Null lang and source are leaves named by the empty string; a null or
    wordless text has no tokens; documents of a leaf without tokens are taken once; an empty table gives no rows.
    """
    rows = docs.select("doc_id", *_keys(docs), n_tokens(F.col("text")).alias("n"), F.xxhash64("text").alias("t"))
    rows = scratch.table(rows, "mixing")
    given = budgets(scratch.table(rows.groupBy(*LEVELS).agg(F.sum("n").alias("tokens")), "leaves"), mix)
    given = given.withColumn("whole", F.expr("if(tokens > 0, budget div tokens, 0L)"))
    given = scratch.table(given.withColumn("rest", F.col("budget") - F.col("whole") * F.col("tokens")), "budgets")
    placed = _placed(rows, given, mix)
    cuts = given.filter("rest > 0").select(*LEVELS, F.lit("").alias("cut"), F.col("rest").alias("room"))
    for digits in range(2, DIGITS + 1, 2):
        cuts = _narrow(cuts, placed, digits)
    inside = placed.join(cuts, list(LEVELS)).filter(F.startswith("key", F.col("cut")))
    order = Window.partitionBy(*LEVELS).orderBy("key", F.col("doc_id").asc_nulls_first(), "t")
    chosen = inside.withColumn("upto", F.sum("n").over(order)).filter("upto <= room")
    chosen = scratch.table(chosen.select(_id(F.col("doc_id")), "t", F.lit(1).alias("chosen")).distinct(), "chosen")
    leaves = scratch.table(given.join(cuts.drop("room"), list(LEVELS), "left").select(*LEVELS, "tokens", "rest", "whole", "cut"), "cut_budgets")
    all_ = docs.select(F.struct("*").alias("row"), "doc_id", _id(F.col("doc_id")), F.xxhash64("text").alias("t"), *_keys(docs))
    out = _placed(all_, leaves, mix).join(chosen, ["id", "t"], "left")
    bucket = F.substring("key", 1, DIGITS)
    last = F.when(F.col("tokens") == 0, 1).when(F.col("rest") == 0, 0).when(bucket < F.col("cut"), 1).when(bucket == F.col("cut"), F.coalesce("chosen", F.lit(0))).otherwise(0)
    return out.select("row", "domain", (F.col("whole") + last).cast("int").alias("n_copies"))


def mix_documents(docs: DataFrame, mix: Mix = PRODUCTION) -> DataFrame:
    """``docs`` mixed to ``mix``: each row as often as :func:`copies` says, all columns kept."""
    out = copies(docs, mix).filter("n_copies > 0")
    return out.select("row", F.explode(F.array_repeat(F.lit(0), F.col("n_copies")))).select("row.*")
