"""URL filter: rules first, then trust and distrust carried over the host graph by personalised PageRank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch, urls
from .words import ascii_lower

#: (verdict, host and path); the longest that fits decides.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
DAMPING = 0.85
CUT_EVERY = 4
#: Scores that still may grow by no more than this are final; only ties need so many rounds.
LEAST = 1e-12
#: Share of blocked pages from which a host without links is blocked; with links, the distrust that such a share gives.
FLOOR = 0.5
LINK = r"""(?i)href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""


def _fits(rule: str) -> Column:
    name, _, rest = rule.partition("/")
    at = (F.col("host") == name) | F.endswith(F.col("host"), F.lit("." + name))
    return at & F.startswith(F.col("path"), F.lit("/" + rest))


def with_rules(pages: DataFrame, rules=RULES) -> DataFrame:
    """Adds ``host, path, rule, ruled`` to ``page_id, url, html``; ``rule`` and ``ruled`` are null where no rule fits."""
    out = pages.withColumns({"host": urls.host(F.col("url")), "path": urls.path(F.col("url"))})
    rule = ruled = F.lit(None).cast("string")
    for verdict, r in sorted(rules, key=lambda x: (len(x[1]), x[0] == "block")):  # the last one asked first
        rule, ruled = F.when(_fits(r), F.lit(r)).otherwise(rule), F.when(_fits(r), F.lit(verdict)).otherwise(ruled)
    return out.withColumns({"rule": rule, "ruled": ruled})


def host_edges(pages: DataFrame) -> DataFrame:
    """``(a, b, n)``: pages of host ``a`` with a link to another host ``b``. Links without a host stay on theirs and count for nothing."""
    found = F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)), ascii_lower))
    each = pages.select(urls.host(F.col("url")).alias("a"), F.explode(found).alias("b"))
    return each.filter("a <> b and a <> ''").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def _by_host(score: DataFrame) -> DataFrame:
    trust, distrust = (F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("s"))), F.lit(0.0)) for k in "td")
    return score.groupBy("host").agg(trust.alias("trust"), distrust.alias("distrust"))


def _sums(score: DataFrame) -> dict[str, float]:
    return {"t": 0.0, "d": 0.0} | {r["kind"]: r["s"] for r in score.groupBy("kind").agg(F.sum("s").alias("s")).collect()}


def _final(score: DataFrame, left: dict[str, float], damping: float) -> bool:
    """Whether no host's verdict can change, where a score may grow by ``left`` at most and never falls."""
    floor = FLOOR * (1 - damping)
    if max(left.values()) <= LEAST:
        return True
    t, d = F.col("trust"), F.col("distrust")
    block, allow = (d > t + left["t"]) & (d > floor), d + left["d"] <= F.greatest(t, F.lit(floor))
    return left["d"] <= floor and _by_host(score).filter(~(block | allow)).isEmpty()


def host_scores(ruled: DataFrame, edges: DataFrame, rounds: int | None = None, damping: float = DAMPING) -> DataFrame:
    """``(host, trust, distrust)`` of every host that has a seed or is reached from one.

    A host's seeds are the shares of its pages that a rule allows or blocks. Trust follows links, distrust follows them
    backwards; both walk in the same joins, as rows of two kinds, and each round is an aggregate of the seeds and what
    the neighbours pass on. The lineage is cut every few rounds. Without ``rounds`` the walk goes on until no verdict
    can change: a round passes on at most ``damping`` of what the round before added.

    The scores solve y = (1 - damping) s + damping W y. Personalised PageRank, with the seeds s scaled to a sum of one
    and the rank of hosts without a way out given back to the seeds, is the same y over its sum (:func:`ranks`). Verdicts
    compare trust and distrust of one host, so they take y, whose unit is a host's own pages for both kinds.
    """
    host = ruled.filter("host <> ''").groupBy("host")
    share = host.agg((F.count_if(F.col("ruled") == "allow") / F.count(F.lit(1))).alias("t"), (F.count_if(F.col("ruled") == "block") / F.count(F.lit(1))).alias("d"))
    seeds = share.selectExpr("host", "stack(2, 't', t, 'd', d) as (kind, s)").filter("s > 0")
    seeds = scratch.table(seeds.select("kind", "host", (F.col("s") * (1 - damping)).alias("s")), "seeds")
    edges = scratch.table(edges, "host_edges")
    way = edges.selectExpr("stack(2, 't', a, b, 'd', b, a) as (kind, host, to)", "n")
    total = way.groupBy("kind", "host").agg(F.sum("n").alias("all"))
    way = way.join(total, ["kind", "host"]).select("kind", "host", "to", (F.col("n") / F.col("all")).alias("w"))
    way = scratch.table(way, "host_ways")
    score, k, sums = seeds, 0, _sums(seeds)
    while rounds is None or k < rounds:
        passed = score.join(way, ["kind", "host"]).groupBy("kind", F.col("to").alias("host")).agg((damping * F.sum(F.col("s") * F.col("w"))).alias("s"))
        score = seeds.union(passed).groupBy("kind", "host").agg(F.sum("s").alias("s"))
        k += 1
        if k % CUT_EVERY == 0:
            score = scratch.table(score, "host_scores")
            if rounds is None:
                before, sums, shrunk = sums, _sums(score), damping**CUT_EVERY
                if _final(score, {x: max(0.0, sums[x] - before[x]) * shrunk / (1 - shrunk) for x in "td"}, damping):
                    break
    return _by_host(score)


def ranks(scores: DataFrame) -> DataFrame:
    """``(host, trust, distrust)`` as probabilities: the personalised PageRank of either kind sums to one, or to zero without seeds."""
    total = scores.agg(F.sum("trust").alias("_t"), F.sum("distrust").alias("_d"))
    both = scores.crossJoin(F.broadcast(total))  # one row
    return both.select("host", *[F.coalesce(F.try_divide(c, t), F.lit(0.0)).alias(c) for c, t in (("trust", "_t"), ("distrust", "_d"))])


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """One row per row of ``pages(page_id, url, html, ...)``: ``page_id, host, path, rule, verdict``.

    The longest rule that fits decides. Any other page is blocked if its host's distrust is above its trust and above
    what a share FLOOR of blocked pages gives, else allowed; so are pages without a host. Null urls have neither host
    nor path, null html no links; repeated rows each keep a row, other columns are ignored.
    """
    ruled = with_rules(pages.select("page_id", "url"), rules)
    scores = host_scores(ruled, host_edges(pages))
    bad = scores.filter((F.col("distrust") > F.col("trust")) & (F.col("distrust") > FLOOR * (1 - DAMPING)))
    bad = scratch.table(bad.select("host", F.lit("block").alias("by_host")), "blocked_hosts")
    return ruled.join(bad, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("ruled", "by_host", F.lit("allow")).alias("verdict"))
