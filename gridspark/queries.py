"""Registered queries over the driver's tables and their SQL twins, in the order of the operator inventory."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.functions import geometry as G
from gridspark.functions import sql
from gridspark.functions import text as T
from gridspark.operators import assemble, grid, metrics, order, pages, runstats, verify, vote
from gridspark.plans import derived as D
from gridspark.plans.derived import Tables
from gridspark.schemas import JOB_STATUSES

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None, doubles: str = ""):
    """Registers a query and its SQL; ``doubles`` names columns that DuckDB would make decimals."""
    if doubles:
        sql = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in doubles.split())}) FROM ({sql})"

    def add(f: Callable[[Tables], DataFrame]):
        name = f.__name__
        _QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            _SQL[name] = sql
        return f

    return add


def _r(c, digits: int = 6):
    return F.round(c, digits)


def _sql_list(texts: list[str]) -> str:
    """A DuckDB list of strings, line ends and tabs spelt out."""
    quoted = ("'" + x.replace("'", "''").replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '") + "'" for x in texts)
    return f"[{', '.join(quoted)}]"


# --- voting over attempts -------------------------------------------------------------------------------------------

_SHAPES = """, shapes AS (SELECT k, n_rows, n, of FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, seen) AS rank, sum(n) OVER (PARTITION BY k) AS of
  FROM (SELECT k, n_rows, count(*) AS n, min(attempt) AS seen FROM candidates GROUP BY 1, 2)) WHERE rank = 1),
valid AS (SELECT c.* FROM candidates c JOIN shapes s ON c.k = s.k AND c.n_rows = s.n_rows)"""
_VOTED = """, ballots AS (SELECT k, attempt, i - 1 AS row_index, j - 1 AS col_index, coalesce(rows[i][j], '') AS v
  FROM (SELECT *, unnest(range(1, n_rows + 1)) AS i FROM valid), (VALUES (1), (2), (3)) AS c(j)),
voted AS MATERIALIZED (SELECT k, row_index, col_index, v AS value, n / of AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY k, row_index, col_index ORDER BY n DESC, seen) AS rank,
  sum(n) OVER (PARTITION BY k, row_index, col_index) AS of FROM (SELECT k, row_index, col_index, v, count(*) AS n, min(attempt) AS seen FROM ballots GROUP BY ALL)) WHERE rank = 1)"""


@_query(f"WITH {D.CANDIDATES}{_SHAPES} SELECT k, n_rows, 3 AS n_cols, n, CAST(of AS BIGINT) AS \"of\" FROM shapes")
def vote_dims(t: Tables) -> DataFrame:
    return vote.vote_shape(D.candidates(t), ["k"])


@_query(
    f"""WITH {D.CANDIDATES}{_SHAPES}, names AS (SELECT k, attempt, i - 1 AS col_index, columns[i] AS name FROM valid, (VALUES (1), (2), (3)) AS c(i))
SELECT k, col_index, name, n, CAST(of AS BIGINT) AS "of" FROM (SELECT *, row_number() OVER (PARTITION BY k, col_index ORDER BY n DESC, seen) AS rank, sum(n) OVER (PARTITION BY k, col_index) AS of
  FROM (SELECT k, col_index, name, count(*) AS n, min(attempt) AS seen FROM names GROUP BY ALL)) WHERE rank = 1"""
)
def vote_header(t: Tables) -> DataFrame:
    return vote.vote_columns(vote.agreeing(D.candidates(t), ["k"]), ["k"])


@_query(f"WITH {D.CANDIDATES}{_SHAPES}{_VOTED} SELECT k, CAST(row_index AS INT) AS row_index, col_index, value, round(confidence, 6) AS confidence, confidence >= 0.8 AS agreed FROM voted")
def vote_cells(t: Tables) -> DataFrame:
    found = vote.vote_cells(vote.agreeing(D.candidates(t), ["k"]), ["k"])
    return found.withColumn("confidence", _r(F.col("confidence")))


@_query(
    f"""WITH {D.CANDIDATES}{_SHAPES}{_VOTED} SELECT k, count(*) AS cell_count, count(*) FILTER (value <> '') AS cells_with_text, round(avg(confidence), 6) AS consensus_confidence,
  count(*) FILTER (confidence < 0.7) AS low_cells, CASE WHEN count(*) FILTER (confidence < 0.7) > 0 THEN 'llm_extracted,low_confidence_' || count(*) FILTER (confidence < 0.7) || '_cells'
  ELSE 'llm_extracted' END AS irregularities FROM voted GROUP BY 1"""
)
def low_conf(t: Tables) -> DataFrame:
    cells = vote.vote_cells(vote.agreeing(D.candidates(t), ["k"]), ["k"])
    out = vote.summarise(cells, ["k"])
    return out.withColumns({"consensus_confidence": _r(F.col("consensus_confidence")), "irregularities": F.array_join("irregularities", ",")})


@_query(
    f"""WITH {D.CANDIDATES}{_SHAPES}{_VOTED}, position AS (SELECT k, row_index, col_index, (k % 10) / 10 AS position FROM voted WHERE col_index < 2)
SELECT k, CAST(row_index AS INT) AS row_index, col_index, value, round(confidence, 6) AS consensus, position, round(coalesce((confidence + position) / 2, confidence), 6) AS confidence,
  confidence < 0.7 OR coalesce(position < 0.7, false) AS mismatched FROM voted LEFT JOIN position USING (k, row_index, col_index)"""
)
def combine_confidence(t: Tables) -> DataFrame:
    cells = vote.vote_cells(vote.agreeing(D.candidates(t), ["k"]), ["k"])
    position = cells.filter("col_index < 2").withColumn("confidence", F.col("k") % 10 / 10)
    out = vote.combine(cells, position, ["k"])
    return out.withColumns({"consensus": _r(F.col("consensus")), "confidence": _r(F.col("confidence"))})


@_query(
    f"""WITH {D.READINGS}, a AS (SELECT k, ln, attempt, CASE WHEN attempt < 2 THEN 'primary' ELSE 'escalation' END AS tier, discount > 0.04 AS failed FROM readings),
p AS (SELECT DISTINCT k, ln FROM a WHERE tier = 'primary' AND NOT failed) SELECT k, ln, attempt, tier FROM a WHERE NOT failed AND (tier = 'primary' OR NOT EXISTS (SELECT 1 FROM p WHERE p.k = a.k AND p.ln = a.ln))"""
)
def escalation(t: Tables) -> DataFrame:
    a = D.readings(t).withColumns(
        {"tier": F.when(F.col("attempt") < 2, "primary").otherwise("escalation"), "error": F.when(F.col("discount") > 0.04, "503 timeout"), "response": F.lit("{}")}
    )
    return vote.tiers(a, ["k", "ln"]).select("k", "ln", "attempt", "tier")


#: Around an event's properties: tagged and bare fences, one with words before it, one that is never closed, one on a single line, none.
_BEFORE = ["```json\n", "```\n", "Here it is:\n```json\n", "```json\n", "```", "  "]
_AFTER = ["\n```  ", "\n```", "\n\t\n```\nthat is all", "\n", "```", " \n"]
_INSIDE = "regexp_extract(answer, '```[^\n]*\n((?s:.*))', 1)"


@_query(
    f"""WITH a AS (SELECT event_id, event_id % 6 AS kind, trim({_sql_list(_BEFORE)}[event_id % 6 + 1] || props || {_sql_list(_AFTER)}[event_id % 6 + 1], ' ' || chr(9) || chr(10)) AS answer FROM events),
i AS (SELECT *, CASE kind WHEN 5 THEN answer WHEN 4 THEN substr(answer, 4) ELSE {_INSIDE} END AS inside FROM a)
SELECT event_id, CASE WHEN kind < 5 AND contains(inside, '```') THEN rtrim(regexp_replace(inside, '```(?s:[^`]*)$', ''), ' ' || chr(9) || chr(10)) ELSE inside END AS body FROM i"""
)
def strip_fence(t: Tables) -> DataFrame:
    kind = (F.col("event_id") % 6).cast("int")
    before, after = (F.get(F.array(*[F.lit(x) for x in marks]), kind) for marks in (_BEFORE, _AFTER))
    return t("events").select("event_id", T.strip_fence(F.concat(before, "props", after)).alias("body"))


@_query(
    """SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE 't' || event_id END AS table_id, CASE WHEN event_id % 4 = 3 THEN 0 ELSE 2 END AS n_columns,
  CASE WHEN event_id % 4 = 3 THEN NULL ELSE event_type END AS "first" FROM events"""
)
def parse_json(t: Tables) -> DataFrame:
    table = F.struct(F.concat(F.lit("t"), F.col("event_id")).alias("table_id"), F.array(F.lit("a"), F.lit("b")).alias("columns"), F.array(F.array(F.col("event_type"), F.lit("1"))).alias("rows"))
    body = F.to_json(F.struct(F.array(table).alias("tables")))
    body = F.when(F.col("event_id") % 4 == 0, body).when(F.col("event_id") % 4 == 3, F.lit("no table here")).otherwise(F.concat(F.lit("```json\n"), body, F.lit("\n```")))
    one = T.parse_response(body)["tables"][0]
    return t("events").select("event_id", one["table_id"].alias("table_id"), F.when(one.isNotNull(), F.size(one["columns"])).otherwise(0).alias("n_columns"), one["rows"][0][0].alias("first"))


#: An error for most events: a status code that moves with the event, or a message in one case or another.
_ERRORS = """CASE WHEN event_id % 7 = 6 THEN NULL WHEN event_id % 7 < 3 THEN concat('HTTP ', cast(400 + event_id % 110 AS string), ' at ', event_type) WHEN event_id % 7 = 3 THEN concat(upper(event_type), ': DEADLINE Exceeded')
  WHEN event_id % 7 = 4 THEN concat('internal ', CASE WHEN event_id % 2 = 0 THEN 'Error' ELSE 'state' END, ' of ', props) ELSE concat('no key for user ', cast(user_id AS string)) END"""
_RETRY = """coalesce(regexp_matches(error, '500|503|429') OR regexp_matches(lower(error), 'internal error|timeout|deadline exceeded'), false)"""
_FAILED = f"(SELECT event_id, {_ERRORS} AS error FROM events)"


def _errors(t: Tables) -> DataFrame:
    return t("events").select("event_id", F.expr(_ERRORS).alias("error"))


@_query(f"SELECT event_id, {_RETRY} AS retry FROM {_FAILED}")
def retryable(t: Tables) -> DataFrame:
    return _errors(t).select("event_id", T.retryable(F.col("error")).alias("retry"))


@_query(f"SELECT event_id, CASE WHEN {_RETRY} AND event_id // 7 % 7 < 5 THEN least(pow(2.0, event_id // 7 % 7), 10.0) END AS wait FROM {_FAILED}")
def backoff(t: Tables) -> DataFrame:
    return _errors(t).select("event_id", T.backoff_seconds(F.expr("event_id div 7 % 7"), F.col("error"), F.lit(6)).alias("wait"))


_MODELS = "['gemini-2.5-pro', 'gemini-3.0-pro', 'gpt-4o', 'gemini-1.5-flash', 'other']"


@_query(
    f"""SELECT event_id, model, CASE WHEN model LIKE '%gemini%' THEN 'google' ELSE 'openai' END AS provider, round(event_id / 1000000 * pi + (event_id % 977) / 1000000 * po, 9) AS cost FROM
  (SELECT event_id, {_MODELS}[event_id % 5 + 1] AS model, [0.0, 1.25, 2.5, 0.075, 1.0][event_id % 5 + 1] AS pi, [0.0, 5.0, 10.0, 0.3, 3.0][event_id % 5 + 1] AS po FROM events)"""
)
def cost_estimate(t: Tables) -> DataFrame:
    models = F.array(*[F.lit(m) for m in json.loads(_MODELS.replace("'", '"'))])
    e = t("events").withColumn("model", F.get(models, (F.col("event_id") % 5).cast("int")))
    cost = T.cost_usd(F.col("event_id"), F.col("event_id") % 977, F.col("model"))
    return e.select("event_id", "model", T.provider(F.lit("other"), F.col("model")).alias("provider"), _r(cost, 9).alias("cost"))


@_query(
    f"""WITH {D.PAGE_RESULTS}, s AS (SELECT doc_id, sum(calls_primary) AS p, sum(calls_escalation) AS e, sum(tokens_in) AS i, sum(tokens_out) AS o FROM page_results GROUP BY 1),
f AS (SELECT *, CASE WHEN e > 0 THEN p / (p + e) ELSE 1.0 END AS share FROM s), g AS (SELECT *, CAST(floor(i * share) AS BIGINT) AS pi, CAST(floor(o * share) AS BIGINT) AS po FROM f)
SELECT doc_id, pi AS primary_tokens_in, po AS primary_tokens_out, round((i - pi) / 1000000 * 1.25 + (o - po) / 1000000 * 5.0, 9) AS estimated_cost_usd FROM g"""
)
def cost_split(t: Tables) -> DataFrame:
    stats = runstats.split_cost(runstats.run_stats(D.page_results(t), ["doc_id"]), "gemini-2.5-pro", "gemini-3.0-pro")
    return stats.select("doc_id", "primary_tokens_in", "primary_tokens_out", _r(F.col("estimated_cost_usd"), 9).alias("estimated_cost_usd"))


@_query(
    """SELECT p_partkey, 100.0 * (p_partkey % 4) AS y0, 100.0 * (p_partkey % 4) + 100.0 AS y1 FROM part""", doubles="y0 y1")
def estimated_bands(t: Tables) -> DataFrame:
    b = G.band(F.lit(612.0), F.lit(400.0), F.col("p_partkey") % 4, F.lit(4))
    return t("part").select("p_partkey", b["y0"].alias("y0"), b["y1"].alias("y1"))


# --- pages, regions and grids ---------------------------------------------------------------------------------------

_WANTED = "CASE WHEN o_orderkey % 3 = 0 THEN '0,2-4,9' WHEN o_orderkey % 3 = 1 THEN '1 - 2, 2' ELSE '5-1' END"
_ASKED = """, wanted AS (SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN [0, 2, 3, 4, 9] WHEN 1 THEN [1, 2, 2] END AS l FROM orders),
asked AS (SELECT k, unnest(l) AS page_index, unnest(range(len(l))) AS ord FROM wanted WHERE l IS NOT NULL),
there AS (SELECT DISTINCT l_orderkey AS k, l_linenumber - 1 AS page_index FROM lineitem)"""


def _selected(t: Tables) -> tuple[DataFrame, DataFrame]:
    there = t("lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") - 1).alias("page_index")).distinct()
    wanted = t("orders").select(F.col("o_orderkey").alias("doc_id"), T.page_indices(F.expr(_WANTED)).alias("indices"))
    return pages.select_pages(there, wanted)


@_query(f"WITH x AS (SELECT 1){_ASKED} SELECT k AS doc_id, CAST(ord AS INT) AS ord, page_index FROM asked SEMI JOIN there USING (k, page_index)")
def page_select(t: Tables) -> DataFrame:
    return _selected(t)[0].select("doc_id", "ord", "page_index")


@_query(f"WITH x AS (SELECT 1){_ASKED} SELECT k AS doc_id, CAST(ord AS INT) AS ord, 'Page index ' || page_index || ' out of range' AS error FROM asked ANTI JOIN there USING (k, page_index)")
def page_errors(t: Tables) -> DataFrame:
    return _selected(t)[1]


#: A page list of numbers from the row, with spaces, ranges that rise and ranges that do not, and faulty ones.
_PAGE_LISTS = """CASE WHEN o_orderkey % 9 = 8 THEN concat('p', cast(o_custkey AS string)) WHEN o_orderkey % 9 = 7 THEN concat(cast(o_orderkey % 5 AS string), '-', cast(o_custkey % 9 AS string), '-2')
  ELSE concat(cast(o_custkey % 40 AS string), ', ', cast(o_orderkey % 13 AS string), ' - ', cast(o_custkey % 17 AS string), CASE WHEN o_orderkey % 2 = 0 THEN concat(',', cast(o_orderkey % 7 AS string)) ELSE '' END) END"""


@_query(
    """WITH o AS (SELECT *, o_orderkey % 13 AS a, o_custkey % 17 AS b FROM orders WHERE o_orderkey % 9 < 7),
l AS (SELECT o_orderkey, [o_custkey % 40] || range(a, b + 1) || CASE WHEN o_orderkey % 2 = 0 THEN [o_orderkey % 7] ELSE [] END AS x FROM o WHERE a <= b)
SELECT o_orderkey, '[' || array_to_string(x, ', ') || ']' AS indices FROM l"""
)
def parse_pages(t: Tables) -> DataFrame:
    out = t("orders").select("o_orderkey", T.page_indices(F.expr(_PAGE_LISTS)).alias("x")).filter("x is not null")
    return out.select("o_orderkey", F.concat(F.lit("["), F.array_join("x", ", "), F.lit("]")).alias("indices"))


@_query(
    f"""WITH {D.BOXES}, big AS (SELECT page, greatest(0, x0 - 6) AS x0, greatest(0, y0 - 6) AS y0, least(600.0, x1 + 6) AS x1, least(700.0, y1 + 6) AS y1, (x1 - x0) * (y1 - y0) AS a FROM boxes),
kept AS (SELECT * FROM big WHERE a >= 0.0003 * 600 * 700), n AS (SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY y0, x0, x1, y1) AS INT) AS i, x0, y0, x1, y1 FROM kept),
p AS (SELECT DISTINCT page FROM boxes)
SELECT page, i - 1 AS region_idx, x0, y0, x1, y1, 0.8 AS confidence, 'section_' || i AS section_label FROM n
UNION ALL SELECT page, 0, 0.0, 0.0, 600.0, 700.0, 0.5, NULL FROM p ANTI JOIN n USING (page)""", doubles="x0 y0 x1 y1 confidence")
def region_filter(t: Tables) -> DataFrame:
    b = D.boxes(t)
    all_pages = b.select(F.col("page").alias("doc_id"), F.lit(0).alias("page_index"), F.lit(600.0).alias("width"), F.lit(700.0).alias("height")).distinct()
    raw = b.select(F.col("page").alias("doc_id"), F.lit(0).alias("page_index"), "bbox")
    out = grid.panel_regions(raw, all_pages, 0.0003)
    return out.select(F.col("doc_id").alias("page"), "region_idx", "bbox.x0", "bbox.y0", "bbox.x1", "bbox.y1", "confidence", "section_label")


@_query(
    """SELECT p_partkey, CAST(greatest(0, least(x0, 100)) AS INT) AS x0, CAST(greatest(0, least(x1, 100)) AS INT) AS x1 FROM (SELECT p_partkey,
  CAST(trunc(CASE WHEN p_partkey % 2 = 0 THEN (p_partkey % 10) / 10 * 100 ELSE p_partkey % 130 - 10.5 END) AS BIGINT) AS x0,
  CAST(trunc(CASE WHEN p_partkey % 2 = 0 THEN (p_partkey % 10 + 0.5) / 10.5 * 100 ELSE p_partkey % 130 + 20.5 END) AS BIGINT) AS x1 FROM part)"""
)
def bbox_pixels(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    x0 = F.when(k % 2 == 0, k % 10 / 10).otherwise(k % 130 - 10.5)
    x1 = F.when(k % 2 == 0, (k % 10 + 0.5) / 10.5).otherwise(k % 130 + 20.5)
    px = G.to_pixels(G.bbox(x0, F.lit(0.0), x1, F.lit(0.5)), F.lit(100.0), F.lit(100.0))
    return t("part").select("p_partkey", px["x0"].alias("x0"), px["x1"].alias("x1"))


@_query(
    """SELECT k, CAST(r AS INT) AS row_index, CAST(c AS INT) AS col_index, round(c * (100.0 / n_cols), 6) AS x0, round(r * (60.0 / n_rows), 6) AS y0 FROM
  (SELECT p_partkey AS k, p_size % 5 AS n_rows, p_size % 4 AS n_cols, unnest(range(p_size % 5)) AS r FROM part), LATERAL (SELECT unnest(range(n_cols)) AS c)"""
)
def even_grid(t: Tables) -> DataFrame:
    p = t("part").select(F.col("p_partkey").alias("k"), (F.col("p_size") % 5).alias("n_rows"), (F.col("p_size") % 4).alias("n_cols"), G.bbox(0.0, 0.0, 100.0, 60.0).alias("bbox"))
    out = grid.even_grid(p, ["k"])
    return out.select("k", "row_index", "col_index", _r(F.col("bbox.x0")).alias("x0"), _r(F.col("bbox.y0")).alias("y0"))


_LINES = """, lines AS (SELECT l_suppkey AS k, list(l_quantity * 7 + l_linenumber ORDER BY l_quantity * 7 + l_linenumber) AS xs FROM lineitem GROUP BY 1)"""


def _lines(t: Tables) -> DataFrame:
    return t("lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.collect_list(F.col("l_quantity") * 7 + F.col("l_linenumber")).alias("xs"))


@_query(
    f"""WITH RECURSIVE x AS (SELECT 1){_LINES}, m(k, i, xs, merged) AS (SELECT k, 1, xs, CAST([] AS DOUBLE[]) FROM lines UNION ALL
  SELECT k, i + 1, xs, CASE WHEN len(merged) > 0 AND xs[i] - merged[-1] <= 2 THEN list_append(merged[:-2], (merged[-1] + xs[i]) / 2) ELSE list_append(merged, xs[i]) END FROM m WHERE i <= len(xs)),
s(k, i, xs, kept) AS (SELECT k, 1, merged, CAST([] AS DOUBLE[]) FROM m WHERE i = len(xs) + 1 UNION ALL
  SELECT k, i + 1, xs, CASE WHEN len(kept) > 0 AND xs[i] - kept[-1] < 4 THEN kept ELSE list_append(kept, xs[i]) END FROM s WHERE i <= len(xs))
SELECT k, len(kept) AS n, round(list_sum(kept), 6) AS total FROM s WHERE i = len(xs) + 1"""
)
def line_merge(t: Tables) -> DataFrame:
    merged = _lines(t).select("k", F.explode(F.array(grid.merge_lines(F.col("xs"), 2, 4))).alias("m"))
    return merged.select("k", F.size("m").cast("bigint").alias("n"), _r(F.aggregate("m", F.lit(0.0), lambda s, x: s + x)).alias("total"))


_CLUSTERS = f"""WITH RECURSIVE x AS (SELECT 1){_LINES}, c(k, i, xs, cs) AS (SELECT k, 1, xs, CAST([] AS STRUCT(center DOUBLE, n INT)[]) FROM lines UNION ALL
  SELECT k, i + 1, xs, CASE WHEN len(cs) > 0 AND abs(xs[i] - cs[-1].center) <= 3 THEN list_append(cs[:-2], {{'center': (cs[-1].center * cs[-1].n + xs[i]) / (cs[-1].n + 1), 'n': cs[-1].n + 1}})
  ELSE list_append(cs, {{'center': xs[i], 'n': 1}}) END FROM c WHERE i <= len(xs))"""


@_query(f"{_CLUSTERS}, d AS (SELECT k, cs FROM c WHERE i = len(xs) + 1), e AS (SELECT k, unnest(cs) AS x, unnest(range(len(cs))) AS i FROM d) SELECT k, CAST(i AS INT) AS i, round(x.center, 6) AS center, x.n AS n FROM e")
def greedy_cluster(t: Tables) -> DataFrame:
    out = _lines(t).select("k", F.posexplode(grid.cluster(F.col("xs"), 3.0)).alias("i", "x"))
    return out.select("k", "i", _r(F.col("x.center")).alias("center"), "x.n")


@_query(
    f"""WITH {D.BOXES} SELECT box_idx, CAST((SELECT arg_min(i, {{'d': abs((x0 + x1) / 2 - c), 'i': i}}) FROM (VALUES (0, 100.0), (1, 250.0), (2, 250.0), (3, 500.0)) AS v(i, c)) AS INT) AS column_index FROM boxes"""
)
def nearest_col(t: Tables) -> DataFrame:
    centers = F.array(*[F.lit(x) for x in (100.0, 250.0, 250.0, 500.0)])
    return D.boxes(t).select("box_idx", grid.nearest((F.col("bbox.x0") + F.col("bbox.x1")) / 2, centers).alias("column_index"))


_DIMS = ", dims AS (SELECT k, max(ln) AS n_rows FROM readings GROUP BY 1)"


@_query(
    f"""WITH {D.READINGS}{_DIMS}, pos AS (SELECT k, CAST(unnest(range(n_rows)) AS INT) AS row_index FROM dims), c AS (SELECT DISTINCT k, ln - 1 AS row_index FROM readings WHERE attempt = 0)
SELECT k, row_index, 0 AS col_index, c.k IS NULL AS is_filler, CASE WHEN c.k IS NULL THEN 'filler' ELSE 'explicit' END AS structure_source, CASE WHEN c.k IS NULL THEN 0.2 ELSE 0.95 END AS structure_confidence
FROM pos LEFT JOIN c USING (k, row_index)""".replace("c.k IS NULL", "c.row_index IS NULL"), doubles="structure_confidence")
def densify(t: Tables) -> DataFrame:
    r = D.readings(t)
    dims = r.groupBy("k").agg(F.max("ln").alias("n_rows")).withColumn("n_cols", F.lit(1))
    cells = r.filter("attempt = 0").select("k", (F.col("ln") - 1).alias("row_index"), F.lit(0).alias("col_index"))
    return grid.densify(cells, dims, ["k"])


@_query(
    f"""WITH {D.READINGS}, h AS (SELECT k, list_sort(list_distinct(list(ln * 10.0))) AS h, list_sort(list_distinct(list(floor(price / 1000)))) AS v FROM readings GROUP BY 1),
g AS (SELECT k, list_filter(h, lambda x: x BETWEEN 0 AND 60) AS h, list_filter(v, lambda x: x BETWEEN 0 AND 40) AS v FROM h)
SELECT k, CAST(r AS INT) AS row_index, CAST(c AS INT) AS col_index, v[c + 1] AS x0, h[r + 1] AS y0, v[c + 2] AS x1, h[r + 2] AS y1 FROM
  (SELECT *, unnest(range(len(h) - 1)) AS r FROM g WHERE len(h) >= 2 AND len(v) >= 2), LATERAL (SELECT unnest(range(len(v) - 1)) AS c)""", doubles="y0 y1")
def grid_lines(t: Tables) -> DataFrame:
    r = D.readings(t).groupBy("k").agg(F.collect_list(F.col("ln") * 10.0).alias("h_lines"), F.collect_list(F.floor(F.col("price") / 1000).cast("double")).alias("v_lines"))
    out = grid.grid_from_lines(r.withColumn("bbox", G.bbox(0.0, 0.0, 40.0, 60.0)), ["k"])
    return out.select("k", "row_index", "col_index", "bbox.*")


@_query(
    f"""WITH {D.READINGS}, {D.cells_sql('c', 0)} SELECT k, row_index, col_index, CASE WHEN col_index = 0 AND row_index % 2 = 0 THEN 1 ELSE row_span END AS row_span,
  CASE WHEN col_index = 0 AND row_index % 2 = 0 THEN 2 ELSE col_span END AS col_span FROM c"""
)
def span_hints(t: Tables) -> DataFrame:
    cells = D.grid_cells(t, 0)
    hints = cells.filter("col_index < 2 and row_index % 2 = 0").select("k", "row_index", "col_index", F.lit(1).alias("row_span"), F.when(F.col("col_index") == 0, 2).otherwise(-1).alias("col_span"))
    return grid.span_hints(cells, hints, ["k"]).select("k", "row_index", "col_index", "row_span", "col_span")


@_query(
    f"""WITH {D.READINGS}, r AS (SELECT k, max(ln) AS n, count(DISTINCT attempt) AS m, list_sort(list_distinct(list(ln * 10.0))) AS h, list_sort(list_distinct(list(floor(price / 1000)))) AS v FROM readings GROUP BY 1),
g AS (SELECT k, list_filter(h, lambda x: x BETWEEN 0 AND 40) AS h, list_filter(v, lambda x: x BETWEEN 0 AND 30) AS v FROM r),
lined AS (SELECT k, (len(h) - 1) * (len(v) - 1) AS n FROM g WHERE len(h) >= 2 AND len(v) >= 2)
SELECT k, 'lines' AS strategy, n FROM lined UNION ALL SELECT k, 'even', n * m FROM r ANTI JOIN lined USING (k)"""
)
def grid_cascade(t: Tables) -> DataFrame:
    r = D.readings(t).groupBy("k").agg(
        F.collect_list(F.col("ln") * 10.0).alias("h_lines"), F.collect_list(F.floor(F.col("price") / 1000).cast("double")).alias("v_lines"),
        F.max("ln").alias("n_rows"), F.count_distinct("attempt").cast("int").alias("n_cols"),
    )
    r = r.withColumn("bbox", G.bbox(0.0, 0.0, 30.0, 40.0))
    out = grid.first_available({"lines": grid.grid_from_lines(r, ["k"]), "even": grid.even_grid(r, ["k"])}, ["k"])
    return out.groupBy("k", "strategy").agg(F.count(F.lit(1)).alias("n"))


@_query(
    f"""WITH {D.BOXES}, b AS (SELECT page, box_idx, x0, y0, x1, y1, (x0 + x1) / 2 AS cx FROM boxes WHERE x1 - x0 >= 8 AND y1 - y0 >= 8)
SELECT page, count(*) AS n_boxes, round(sum(cx), 6) AS sum_x FROM b GROUP BY 1"""
)
def box_filter(t: Tables) -> DataFrame:
    b = D.boxes(t).filter((F.col("bbox.x1") - F.col("bbox.x0") >= 8) & (F.col("bbox.y1") - F.col("bbox.y0") >= 8))
    return b.groupBy("page").agg(F.count(F.lit(1)).alias("n_boxes"), _r(F.sum((F.col("bbox.x0") + F.col("bbox.x1")) / 2)).alias("sum_x"))


@_query()
def ragged_grid(t: Tables) -> DataFrame:
    b = D.boxes(t).withColumns({"width": F.lit(600.0), "height": F.lit(700.0)})
    return grid.ragged_grid(b, ["page"], "ragged")[1]


# --- text and assembly ----------------------------------------------------------------------------------------------


@_query(
    f"""WITH {D.READINGS}, {D.cells_sql('c', 0)}{_DIMS}, w AS (SELECT c.k, row_index + i AS row_index, col_index, text, row_index AS ord FROM c JOIN dims USING (k), (VALUES (0), (1)) AS s(i)
  WHERE i < row_span AND row_index + i < n_rows), best AS (SELECT k, row_index, col_index, arg_min(text, ord) AS value FROM w GROUP BY ALL),
pos AS (SELECT k, CAST(unnest(range(n_rows)) AS INT) AS row_index, j AS col_index FROM dims, (VALUES (0), (1), (2)) AS v(j))
SELECT k, row_index, col_index, value FROM pos LEFT JOIN best USING (k, row_index, col_index)"""
)
def span_assemble(t: Tables) -> DataFrame:
    dims = D.readings(t).groupBy("k").agg(F.max("ln").alias("n_rows")).withColumn("n_cols", F.lit(3))
    cells = D.grid_cells(t, 0).withColumns({"is_filler": F.lit(False), "cell_ord": F.col("row_index") * 3 + F.col("col_index")})
    return assemble.assemble(cells, dims, ["k"])


@_query(
    f"""WITH {D.READINGS}, {D.cells_sql('c', 0)} SELECT k, count(*) AS cell_count, count(*) FILTER (col_index > 0) AS cells_with_text, round(coalesce(avg(CASE WHEN col_index > 0 THEN 0.9 END), 0), 6) AS average_confidence,
  count(*) FILTER (col_index = 2) AS llm_fallback_count FROM c GROUP BY 1"""
)
def table_stats(t: Tables) -> DataFrame:
    c = D.grid_cells(t, 0).withColumns(
        {
            "text": F.when(F.col("col_index") > 0, F.col("text")),
            "text_confidence": F.when(F.col("col_index") > 0, 0.9),
            "text_source": F.when(F.col("col_index") == 2, "llm_fallback").otherwise("ocr"),
        }
    )
    return assemble.table_stats(c, ["k"]).select("k", "cell_count", "cells_with_text", _r(F.col("average_confidence")).alias("average_confidence"), "llm_fallback_count")


@_query(
    f"""WITH {D.READINGS}, {D.cells_sql('c', 0)} SELECT k, row_index, col_index, CASE WHEN col_index = 0 THEN 'r' || row_index || 'c0' WHEN col_index = 1 AND k % 2 = 0 THEN 'answer' ELSE text END AS text,
  CASE WHEN col_index = 0 THEN 'ocr' WHEN col_index = 1 AND k % 2 = 0 THEN 'llm_fallback' ELSE 'mock' END AS text_source, CASE WHEN col_index = 0 THEN 0.9 ELSE 0.3 END AS text_confidence FROM c""", doubles="text_confidence")
def text_fill(t: Tables) -> DataFrame:
    c = D.grid_cells(t, 0).withColumns({"text": F.when(F.col("col_index") > 0, F.col("text")), "text_confidence": F.lit(0.3), "text_source": F.lit("mock")})
    answers = c.select("k", "row_index", "col_index", F.lit("answer").alias("answer"), F.when((F.col("k") % 2 == 1) | (F.col("col_index") != 1), "failed").alias("error"))
    out = assemble.llm_fallback(assemble.fill_placeholder(c), answers, ["k"], 0.5)
    return out.select("k", "row_index", "col_index", "text", "text_source", "text_confidence")


@_query(
    f"""WITH {D.BOXES}, {D.TOKENS}, h AS (SELECT b.page, b.box_idx, t.token_idx, t.token, greatest(0, least(b.x1, t.x1) - greatest(b.x0, t.x0)) * greatest(0, least(b.y1, t.y1) - greatest(b.y0, t.y0)) AS i,
  (t.x1 - t.x0) * (t.y1 - t.y0) AS a FROM boxes b JOIN tokens t ON b.page = t.page), g AS (SELECT page, box_idx, string_agg(token, ' ' ORDER BY token_idx) AS text FROM h WHERE i > 0 AND i / a >= 0.5 GROUP BY 1, 2)
SELECT page, box_idx, g.text FROM boxes LEFT JOIN g USING (page, box_idx)"""
)
def token_fill(t: Tables) -> DataFrame:
    none = {"text": F.lit(None).cast("string"), "text_confidence": F.lit(None).cast("double"), "text_source": F.lit("mock"), "page_index": F.lit(0), "row_index": F.lit(0), "col_index": F.lit(0)}
    cells = D.boxes(t).withColumnRenamed("page", "doc_id").withColumns(none)
    tokens = D.tokens(t).select(F.col("page").alias("doc_id"), F.lit(0).alias("page_index"), "token_idx", F.col("token").alias("text"), F.col("tbox").alias("bbox"), F.col("token_confidence").alias("confidence"))
    out = assemble.fill_from_tokens(cells, tokens, ["doc_id", "page_index", "box_idx"], bucket=64.0)
    return out.select(F.col("doc_id").alias("page"), "box_idx", "text")


@_query(f"WITH {D.BOXES} SELECT page, box_idx FROM boxes SEMI JOIN (SELECT page FROM boxes WHERE price > 999) USING (page)")
def region_semi(t: Tables) -> DataFrame:
    b = D.boxes(t)
    return b.join(b.filter("price > 999").select("page"), "page", "left_semi").select("page", "box_idx")


# --- position verification ------------------------------------------------------------------------------------------

_IOU = """(greatest(0, least(b.x1, t.x1) - greatest(b.x0, t.x0)) * greatest(0, least(b.y1, t.y1) - greatest(b.y0, t.y0)))"""
_PAIRS = f""", pairs AS (SELECT *, i / (a1 + a2 - i) AS iou FROM (SELECT b.page, b.box_idx, b.name, t.token_idx, t.token, t.token_confidence, {_IOU} AS i,
  (b.x1 - b.x0) * (b.y1 - b.y0) AS a1, (t.x1 - t.x0) * (t.y1 - t.y0) AS a2 FROM boxes b JOIN tokens t ON b.page = t.page AND b.x0 < t.x1 AND t.x0 < b.x1 AND b.y0 < t.y1 AND t.y0 < b.y1)
  WHERE i / (a1 + a2 - i) > 0.1)"""
_POSITION = f"WITH {D.BOXES}, {D.TOKENS}{_PAIRS}"


def _token_pairs(t: Tables) -> DataFrame:
    return verify.match_tokens(D.boxes(t), D.tokens(t), ["page"], ["box_idx"], bucket=64.0)


@_query(f"{_POSITION} SELECT page, box_idx, token_idx, round(iou, 6) AS iou FROM pairs")
def iou_join(t: Tables) -> DataFrame:
    return _token_pairs(t).select("page", "box_idx", "token_idx", _r(F.col("iou")).alias("iou"))


@_query(f"{_POSITION} SELECT page, box_idx, string_agg(token, ' ' ORDER BY token_idx) AS ocr_value, count(*) AS n_tokens, round(avg(token_confidence), 6) AS token_confidence FROM pairs GROUP BY 1, 2")
def token_concat(t: Tables) -> DataFrame:
    return verify.token_text(_token_pairs(t), ["page", "box_idx"]).withColumn("token_confidence", _r(F.col("token_confidence")))


_LADDER = f""", v AS (SELECT box_idx, CASE box_idx % 4 WHEN 0 THEN 'N/A' WHEN 1 THEN name WHEN 2 THEN '12' ELSE '' END AS value, CASE box_idx % 5 WHEN 0 THEN '-' WHEN 1 THEN '12' ELSE name END AS ocr,
  CASE WHEN box_idx % 6 = 0 THEN 0 ELSE 1 END AS n, (box_idx % 10) / 10 AS conf, CASE WHEN box_idx % 3 = 0 THEN 0.85 ELSE 0.2 END AS sim FROM boxes),
r AS (SELECT *, lower(value) IN ('', '..', '-', 'n/a', '—', 'na', 'n.a.') AND lower(ocr) IN ('', '..', '-', 'n/a', '—', 'na', 'n.a.') AS blank FROM v),
l AS (SELECT *, CASE WHEN blank THEN 1.0 WHEN n = 0 THEN 0.5 WHEN value = ocr THEN 1.0 WHEN sim >= 0.8 THEN sim ELSE 0.4 END AS rule FROM r)"""


@_query(f"WITH {D.BOXES}{_LADDER} SELECT box_idx, CASE WHEN n > 0 AND conf < 0.5 THEN greatest(rule, 0.6) ELSE rule END AS confidence FROM l", doubles="confidence")
def confidence_ladder(t: Tables) -> DataFrame:
    k, name = F.col("box_idx"), F.col("name")
    value = F.when(k % 4 == 0, "N/A").when(k % 4 == 1, name).when(k % 4 == 2, "12").otherwise("")
    ocr = F.when(k % 5 == 0, "-").when(k % 5 == 1, "12").otherwise(name)
    c = verify.ladder(value, ocr, F.when(k % 6 == 0, 0).otherwise(1), k % 10 / 10, F.when(k % 3 == 0, 0.85).otherwise(0.2))
    return D.boxes(t).select("box_idx", c.alias("confidence"))


_PAIR_SQL = "[" + ", ".join("'" + p + "'" for p in T._PAIRS) + "]"


@_query(
    f"""WITH p AS (SELECT p_partkey, lower(p_name) AS a, translate(lower(p_name), 'oilsbg', '011589') AS b FROM part),
c AS (SELECT p_partkey, a, b, unnest(range(1, length(a) + 1)) AS i FROM p), d AS (SELECT p_partkey, a[i] AS x, b[i] AS y FROM c)
SELECT p_partkey, CASE WHEN count(*) FILTER (x <> y) > 0 THEN round(count(*) FILTER (x <> y AND (list_contains({_PAIR_SQL}, x || y) OR list_contains({_PAIR_SQL}, upper(x) || upper(y)))) / count(*) FILTER (x <> y), 6) END AS share FROM d GROUP BY 1"""
)
def confusable_ratio(t: Tables) -> DataFrame:
    a = F.lower("p_name")
    return t("part").select("p_partkey", _r(T.confusable_share(a, F.translate(a, "oilsbg", "011589"))).alias("share"))


@_query()
def seq_ratio(t: Tables) -> DataFrame:
    p = t("part").select("p_partkey", F.col("p_name").alias("a"), F.concat(F.reverse("p_name"), F.col("p_brand")).alias("b"))
    return p.select("p_partkey", _r(T.similarity(F.col("a"), F.col("b"))).alias("similarity"))


@_query(
    f"""WITH {D.READINGS}{_DIMS}, m AS (SELECT k, ln - 1 AS row_index, 0 AS col_index, CASE WHEN discount > 0.05 THEN 0.4 ELSE 1.0 END AS confidence FROM readings WHERE attempt = 0)
SELECT k, round(coalesce(sum(confidence), 0) / (any_value(n_rows) * 3), 6) AS position_confidence, count(*) FILTER (confidence < 0.7) AS n_mismatched FROM dims LEFT JOIN m USING (k) GROUP BY 1"""
)
def verify_table(t: Tables) -> DataFrame:
    r = D.readings(t)
    dims = r.groupBy("k").agg(F.max("ln").alias("n_rows")).withColumn("n_cols", F.lit(3))
    m = r.filter("attempt = 0").select("k", (F.col("ln") - 1).alias("row_index"), F.lit(0).alias("col_index"), F.when(F.col("discount") > 0.05, 0.4).otherwise(1.0).alias("confidence"))
    out = verify.verdict(m, dims, ["k"])
    return out.select("k", _r(F.col("position_confidence")).alias("position_confidence"), F.size("mismatched").cast("bigint").alias("n_mismatched"))


@_query()
def match_cells(t: Tables) -> DataFrame:
    out = verify.match_cells(D.boxes(t).select("page", "box_idx", F.col("name").alias("value")), _token_pairs(t), ["page", "box_idx"])
    return out.select("page", "box_idx", "ocr_value", "n_tokens", "is_exact", "is_fuzzy", "is_position_match", _r(F.col("similarity")).alias("similarity"), _r(F.col("confidence")).alias("confidence"))


# --- metrics --------------------------------------------------------------------------------------------------------

def _texts(t: Tables) -> DataFrame:
    """Whole documents and what is left of them after an edit; the quadratic distance of DuckDB is too slow for these, so no SQL is registered."""
    return t("documents").select("doc_id", F.col("text").alias("a"), F.replace("text", F.lit("e"), F.lit(" a ")).alias("b"))


@_query()
def cer(t: Tables) -> DataFrame:
    return _texts(t).select("doc_id", _r(T.cer(F.col("a"), F.col("b"), T.edit_distance)).alias("cer"))


@_query()
def wer_char(t: Tables) -> DataFrame:
    return _texts(t).select("doc_id", _r(T.wer_char(F.col("a"), F.col("b"), T.edit_distance)).alias("wer"))


_CELLS = f"""WITH {D.READINGS}, {D.cells_sql('p', 1)}, {D.cells_sql('t', 0)}, m AS (SELECT k, row_index, col_index, p.text AS a, t.text AS b, p.row_span = t.row_span AS span_match,
  greatest(0, least(p.x1, t.x1) - greatest(p.x0, t.x0)) * 5.0 AS i FROM p JOIN t USING (k, row_index, col_index)),
cells AS (SELECT k, row_index, col_index, i / (100.0 - i) AS iou, a = b AS text_match, levenshtein(a, b) / length(b) AS cer, span_match FROM m),
tables AS (SELECT k, count(*) AS n_cells, avg(iou) AS avg_cell_iou, avg(text_match::INT) AS exact_match_rate, avg(span_match::INT) AS span_accuracy, coalesce(avg(cer) FILTER (cer < 1), 1.0) AS avg_cer,
  coalesce(avg(cer) FILTER (cer < 1), 1.0) AS avg_wer, k % 3 > 0 AS grid_shape_match FROM cells GROUP BY 1)"""


def _cell_metrics(t: Tables) -> DataFrame:
    return metrics.cell_metrics(D.grid_cells(t, 1), D.grid_cells(t, 0, followed=True), ["k"])


def _table_metrics(t: Tables) -> DataFrame:
    return metrics.table_metrics(_cell_metrics(t), ["k"]).withColumn("grid_shape_match", F.col("k") % 3 > 0)


@_query()
def wer_word(t: Tables) -> DataFrame:
    return _texts(t).select("doc_id", _r(T.wer_word(F.col("a"), F.col("b"))).alias("wer"))


@_query("SELECT p_partkey, 'Table ' || p_partkey || ': ' || n || ' must be positive, got ' || v AS error FROM (SELECT p_partkey, unnest(['n_rows', 'n_cols']) AS n, unnest([p_size % 4 - 1, p_size % 3]) AS v FROM part) WHERE v <= 0")
def table_errors(t: Tables) -> DataFrame:
    p = t("part").select("p_partkey", F.col("p_partkey").alias("table_idx"), (F.col("p_size") % 4 - 1).alias("n_rows"), (F.col("p_size") % 3).alias("n_cols"))
    return metrics.table_errors(p, ["p_partkey"]).select("p_partkey", "error")


@_query(f"{_CELLS} SELECT k, row_index, col_index, round(iou, 6) AS iou, text_match, round(cer, 6) AS cer, round(cer, 6) AS wer, span_match FROM cells")
def cell_metrics(t: Tables) -> DataFrame:
    return _cell_metrics(t).withColumns({c: _r(F.col(c)) for c in ("iou", "cer", "wer")})


_MEANS = ("avg_cell_iou", "exact_match_rate", "span_accuracy", "avg_cer", "avg_wer")


@_query(f"{_CELLS} SELECT k, n_cells, {', '.join(f'round({c}, 6) AS {c}' for c in _MEANS)}, grid_shape_match FROM tables")
def table_metrics(t: Tables) -> DataFrame:
    return _table_metrics(t).withColumns({c: _r(F.col(c)) for c in _MEANS})


def _h(a: str, b: str) -> str:
    return f"CASE WHEN {a} + {b} > 0 THEN 2 * ({a}) * ({b}) / ({a} + {b}) ELSE 0.0 END"


_RUN = f""", means AS (SELECT count(*) AS d, (SELECT count(*) FROM orders) AS t, avg(grid_shape_match::INT) AS shape, avg(avg_cell_iou) AS iou, avg(span_accuracy) AS span, avg(avg_cer) AS cer,
  avg(avg_wer) AS wer, avg(exact_match_rate) AS exact FROM tables), f AS (SELECT *, least(1.0, t / d) AS p, d / t AS r, {_h('iou', 'span')} AS sf, {_h('1 - cer', 'exact')} AS tf FROM means)"""


@_query(
    f"""{_CELLS}{_RUN} SELECT d AS tables_detected, t AS tables_ground_truth, round(p, 6) AS table_detection_precision, round(r, 6) AS table_detection_recall, round({_h('p', 'r')}, 6) AS table_detection_f1,
  round(shape, 6) AS avg_grid_shape_accuracy, round(iou, 6) AS avg_cell_iou, round(span, 6) AS avg_span_accuracy, round(cer, 6) AS avg_cer, round(wer, 6) AS avg_wer, round(exact, 6) AS exact_match_rate,
  round(sf, 6) AS structural_f1, round(tf, 6) AS text_f1, round({_h('sf', 'tf')}, 6) AS overall_f1 FROM f"""
)
def run_metrics(t: Tables) -> DataFrame:
    n = t("orders").count()
    out = metrics.run_metrics(_table_metrics(t), F.lit(n).cast("bigint"))
    return out.select(*[_r(F.col(c)).alias(c) if kind == "double" else F.col(c) for c, kind in out.dtypes])


_BOOT = f"""{_CELLS}, chosen AS (SELECT *, row_number() OVER (ORDER BY k) - 1 AS ord FROM tables), n AS (SELECT count(*) AS n FROM chosen),
draws AS (SELECT r, ('0x' || substr(md5('42:' || r || ':' || d), 1, 8))::BIGINT % n AS ord FROM (SELECT unnest(range(1000)) AS r), (SELECT n, unnest(range(n)) AS d FROM n)),
means AS (SELECT r, avg(avg_cell_iou) AS iou, avg(span_accuracy) AS span, avg(avg_cer) AS cer, avg(exact_match_rate) AS exact FROM draws JOIN chosen USING (ord) GROUP BY 1),
f AS (SELECT r, {_h('iou', 'span')} AS sf, {_h('1 - cer', 'exact')} AS tf FROM means), o AS (SELECT list_sort(list({_h('sf', 'tf')})) AS x FROM f)"""


@_query(f"{_BOOT} SELECT round(x[26], 6) AS lower, round(x[976], 6) AS upper FROM o")
def bootstrap_ci(t: Tables) -> DataFrame:
    tables = _table_metrics(t).persist()  # read for its size, its cuts, its ranges and its values
    out = metrics.bootstrap(order.number(tables, "k"), 1)
    return out.select(_r(F.col("lower")).alias("lower"), _r(F.col("upper")).alias("upper"))


_GATES = "VALUES ('overall_f1', 0.9, 0.05, false), ('avg_cer', 0.1, 0.02, true), ('avg_cell_iou', 0.3, 0.1, false), ('missing', 0.5, 0.0, false)"


@_query(
    f"""{_CELLS}{_RUN}, a AS (SELECT unnest(['overall_f1', 'avg_cer', 'avg_cell_iou']) AS metric, unnest([{_h('sf', 'tf')}, cer, iou]) AS actual FROM f), g(metric, target, tolerance, inverted) AS ({_GATES}),
l AS (SELECT g.*, actual, CASE WHEN inverted THEN target + tolerance ELSE target - tolerance END AS threshold FROM g LEFT JOIN a USING (metric))
SELECT metric, round(actual, 6) AS actual, round(CAST(threshold AS DOUBLE), 6) AS threshold, CASE WHEN inverted THEN actual <= threshold ELSE actual >= threshold END AS passed FROM l"""
)
def gates(t: Tables) -> DataFrame:
    run = metrics.run_metrics(_table_metrics(t), F.lit(1))
    limits = t.spark.sql(f"SELECT col1 AS metric, cast(col2 AS double) AS target, cast(col3 AS double) AS tolerance, col4 AS inverted FROM {_GATES}")
    out = metrics.gates(metrics.unpivot(run, ["overall_f1", "avg_cer", "avg_cell_iou"]), limits)
    return out.select("metric", _r(F.col("actual")).alias("actual"), _r(F.col("threshold")).alias("threshold"), "passed")


@_query(f"{_CELLS}{_RUN} SELECT round(x, 6) AS now, CAST(0.99 AS DOUBLE) AS was, round(x - 0.99, 6) AS delta, 0.99 - x > 0.05 AS failed FROM (SELECT {_h('sf', 'tf')} AS x FROM f)")
def baseline_delta(t: Tables) -> DataFrame:
    run = metrics.run_metrics(_table_metrics(t), F.lit(1))
    out = metrics.regression(run, t.spark.sql("SELECT 0.99D AS overall_f1"))
    return out.select(_r(F.col("now")).alias("now"), "was", _r(F.col("delta")).alias("delta"), "failed")


@_query(
    f"""WITH {D.READINGS}, {D.cells_sql('c', 0)}, e AS (SELECT k, row_index, col_index, row_span, row_index + col_index AS ord, k % 5 AS n_rows, 2 AS n_cols FROM c)
SELECT k, ord, 'Table 0, Cell ' || ord || ': ' || m AS error FROM (SELECT k, ord, unnest([CASE WHEN row_index >= n_rows THEN 'row ' || row_index || ' out of range [0, ' || n_rows || ')' END,
  CASE WHEN col_index >= 2 THEN 'col ' || col_index || ' out of range [0, 2)' END, CASE WHEN row_index + row_span > n_rows THEN 'cell extends beyond table (row ' || row_index || ' + rowspan ' || row_span || ' > ' || n_rows || ')' END,
  CASE WHEN col_index + 1 > 2 THEN 'cell extends beyond table (col ' || col_index || ' + colspan 1 > 2)' END, 'invalid bbox x coordinates', CASE WHEN row_index >= 0 THEN 'invalid bbox y coordinates' END]) AS m FROM e) WHERE m IS NOT NULL"""
)
def annotation_errors(t: Tables) -> DataFrame:
    c = D.grid_cells(t, 0).withColumns({"table_idx": F.lit(0), "cell_ord": (F.col("row_index") + F.col("col_index")).cast("int"), "n_rows": (F.col("k") % 5).cast("int"), "n_cols": F.lit(2)})
    return metrics.cell_errors(c, ["k"]).select("k", F.col("cell_ord").alias("ord"), "error")


@_query(
    """WITH p AS (SELECT o_orderkey AS table_id, o_custkey AS v FROM orders), g AS (SELECT l_orderkey AS table_id, max(l_partkey) AS w FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY 1)
SELECT table_id, v, w, 'matched' AS kind FROM p JOIN g USING (table_id) UNION ALL SELECT table_id, v, -1, 'unmatched' FROM p ANTI JOIN g USING (table_id)"""
)
def table_match(t: Tables) -> DataFrame:
    p = t("orders").select(F.col("o_orderkey").alias("table_id"), F.col("o_custkey").alias("v"))
    g = t("lineitem").filter("l_orderkey % 2 = 0").select(F.col("l_orderkey").alias("table_id"), F.col("l_partkey").alias("w"), F.col("l_partkey").alias("ord"))
    found, rest = metrics.match_tables(p, g)
    return found.select("table_id", "v", "gt.w", F.lit("matched").alias("kind")).union(rest.select("table_id", "v", F.lit(-1).cast("bigint"), F.lit("unmatched")))


@_query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS place FROM orders")
def table_order(t: Tables) -> DataFrame:
    return order.number(t("orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", name="place").select("o_orderkey", "place")


# --- runs, manifests, formats ---------------------------------------------------------------------------------------


@_query(
    f"""WITH {D.PAGE_RESULTS}, m AS (SELECT doc_id, model, min(page_index) AS f FROM page_results WHERE model IS NOT NULL GROUP BY 1, 2), n AS (SELECT doc_id, string_agg(model, ',' ORDER BY f) AS models FROM m GROUP BY 1)
SELECT doc_id, count(*) AS pages, count(*) FILTER (skipped) AS pages_skipped, CAST(sum(tables_detected) AS BIGINT) AS tables_detected, CAST(sum(cells_with_text) AS BIGINT) AS cells_with_text,
  round(coalesce(sum(confidence_sum) FILTER (confidence_count > 0) / nullif(sum(confidence_count), 0), 0), 6) AS average_confidence, coalesce(string_agg(errors[1], '|' ORDER BY page_index) FILTER (len(errors) > 0), '') AS errors, coalesce(any_value(models), '') AS models
FROM page_results LEFT JOIN n USING (doc_id) GROUP BY 1"""
)
def run_stats(t: Tables) -> DataFrame:
    s = runstats.run_stats(D.page_results(t), ["doc_id"])
    return s.select("doc_id", "pages", "pages_skipped", "tables_detected", "cells_with_text", _r(F.col("average_confidence")).alias("average_confidence"), F.array_join("errors", "|").alias("errors"), F.array_join("models_used", ",").alias("models"))


@_query(
    f"""WITH {D.PAGE_RESULTS}, d AS (SELECT doc_id, duration_ms FROM page_results WHERE duration_ms > 0), g AS (SELECT doc_id, min(duration_ms) AS a, max(duration_ms) AS b, avg(duration_ms) AS c, sum(duration_ms) AS s FROM d GROUP BY 1)
SELECT doc_id, coalesce(a, 0.0) AS min_ms, coalesce(b, 0.0) AS max_ms, round(coalesce(c, 0.0), 6) AS average_ms, round(least(1.0, coalesce(s, 0.0) / 40000.0), 6) AS utilization
FROM (SELECT DISTINCT doc_id FROM page_results) LEFT JOIN g USING (doc_id)"""
)
def page_durations(t: Tables) -> DataFrame:
    s = runstats.worker_utilization(runstats.run_stats(D.page_results(t), ["doc_id"]), 10000.0, 4)
    c = {"min_ms": "min_page_duration_ms", "max_ms": "max_page_duration_ms"}
    return s.select("doc_id", *[F.col(v).alias(k) for k, v in c.items()], _r(F.col("average_page_duration_ms")).alias("average_ms"), _r(F.col("worker_utilization")).alias("utilization"))


@_query("SELECT count(*) FILTER (event_id % 4 = 0) AS queued, count(*) FILTER (event_id % 4 = 1) AS processing, count(*) FILTER (event_id % 4 = 2) AS completed, count(*) FILTER (event_id % 4 = 3) AS failed, count(*) AS total FROM events")
def status_counts(t: Tables) -> DataFrame:
    names = F.array(*[F.lit(s) for s in JOB_STATUSES])
    return runstats.status_counts(t("events").select(F.get(names, (F.col("event_id") % 4).cast("int")).alias("status")), JOB_STATUSES)


@_query("SELECT user_id, string_agg('t' || event_id, ',' ORDER BY event_id) AS tables FROM events WHERE event_id % 3 = 0 GROUP BY 1")
def tables_by_page(t: Tables) -> DataFrame:
    e = t("events").select("user_id", F.col("event_id").alias("table_idx"), F.concat(F.lit("t"), F.col("event_id")).alias("table_id"), F.when(F.col("event_id") % 3 == 0, "success").otherwise("extraction_failed").alias("status"))
    return runstats.tables_by_page(e, ["user_id"]).withColumn("tables", F.array_join("tables", ","))


@_query("SELECT count(*) AS total, count(*) FILTER (o_orderstatus <> 'F') AS successful, count(*) FILTER (o_orderstatus = 'F') AS failed, CAST(sum(o_orderkey % 5) AS BIGINT) AS tables FROM orders")
def batch_summary(t: Tables) -> DataFrame:
    return runstats.batch_summary(t("orders").select((F.col("o_orderkey") % 5).alias("tables"), F.when(F.col("o_orderstatus") == "F", "broken").alias("error")))


@_query(
    """WITH a AS (SELECT s_name AS name, CAST(s_nationkey AS VARCHAR) AS v FROM supplier WHERE s_suppkey % 3 > 0), b AS (SELECT s_name AS name, CAST(s_nationkey + s_suppkey % 2 AS VARCHAR) AS v FROM supplier WHERE s_suppkey % 4 > 0)
SELECT 'git_commit' AS kind, '' AS name, 'a' AS "first", 'b' AS "second" UNION ALL SELECT 'package', name, a.v, b.v FROM a FULL JOIN b USING (name) WHERE a.v IS DISTINCT FROM b.v"""
)
def manifest_diff(t: Tables) -> DataFrame:
    def entries(commit: str, rows: DataFrame) -> DataFrame:
        packages = rows.select(F.lit("package").alias("kind"), "name", "v")
        return t.spark.sql(f"SELECT 'git_commit' AS kind, '' AS name, '{commit}' AS value UNION ALL SELECT 'config_digest', '', 'same'").union(packages)

    s = t("supplier")
    a = s.filter("s_suppkey % 3 > 0").select(F.col("s_name").alias("name"), F.col("s_nationkey").cast("string").alias("v"))
    b = s.filter("s_suppkey % 4 > 0").select(F.col("s_name").alias("name"), (F.col("s_nationkey") + F.col("s_suppkey") % 2).cast("string").alias("v"))
    return runstats.entries_diff(entries("a", a), entries("b", b))


@_query(
    """SELECT c_name AS key, coalesce(cli, file, env, def) AS value, CASE WHEN cli IS NOT NULL THEN 'cli' WHEN file IS NOT NULL THEN 'file' WHEN env IS NOT NULL THEN 'env' ELSE 'def' END AS layer FROM
  (SELECT c_name, 'd' AS def, CASE WHEN c_custkey % 2 = 0 THEN 'e' END AS env, CASE WHEN c_custkey % 3 = 0 THEN 'f' END AS file, CASE WHEN c_custkey % 5 = 0 THEN 'c' END AS cli FROM customer)"""
)
def config_coalesce(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    layers = t("customer").select(F.col("c_name").alias("key"), F.lit("d").alias("def"), *[F.when(k % m == 0, v).alias(c) for c, m, v in (("env", 2, "e"), ("file", 3, "f"), ("cli", 5, "c"))])
    return runstats.merged_config(layers, ["def", "env", "file", "cli"])


@_query("SELECT c_custkey, sha256('name=' || c_name || chr(10) || 'segment=' || c_mktsegment) AS digest FROM customer")
def config_digest(t: Tables) -> DataFrame:
    config = F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("name"), F.col("c_name"))
    return t("customer").select("c_custkey", T.sha256_of_map(config).alias("digest"))


@_query("SELECT l_orderkey, l_linenumber, 1 - l_discount * 5 AS c, CASE WHEN 1 - l_discount * 5 >= 0.85 THEN 'high' WHEN 1 - l_discount * 5 >= 0.70 THEN 'medium' ELSE 'low' END AS band FROM lineitem".replace("1 - l_discount * 5 AS c, ", ""))
def conf_band(t: Tables) -> DataFrame:
    return t("lineitem").select("l_orderkey", "l_linenumber", T.confidence_band(1 - F.col("l_discount") * 5).alias("band"))


@_query("SELECT p_partkey, CASE WHEN length(n) > 31 THEN substr(n, 1, 28) || '...' ELSE n END AS sheet FROM (SELECT p_partkey, p_name || ' ' || p_type || ' ' || p_brand AS n FROM part)")
def sheet_name(t: Tables) -> DataFrame:
    return t("part").select("p_partkey", T.sheet_name(F.concat_ws(" ", "p_name", "p_type", "p_brand")).alias("sheet"))


@_query("SELECT p_partkey, CASE WHEN p_retailprice >= 1500 THEN 'high' WHEN p_retailprice >= 1200 THEN 'medium' ELSE 'low' END AS band, p_name || ' &amp;' AS escaped, least(pow(2.0, p_size % 6), 10.0) AS wait FROM part")
def sql_functions(t: Tables) -> DataFrame:
    sql.register(t.spark)
    band = F.expr("gs_confidence_band(if(p_retailprice >= 1500, 0.85, if(p_retailprice >= 1200, 0.7, 0.1)))")
    return t("part").select("p_partkey", band.alias("band"), F.expr("gs_html_escape(p_name || ' &')").alias("escaped"), F.expr("gs_backoff(cast(p_size % 6 as int))").alias("wait"))


@_query("SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')) AS escaped FROM pages")
def html_escape(t: Tables) -> DataFrame:
    return t("pages").select("page_id", F.md5(T.html_escape(F.col("html"))).alias("escaped"))


@_query(
    f"""WITH {D.READINGS}, c AS (SELECT k, CASE WHEN discount < 0.08 THEN 1.0 ELSE 0.5 END AS c FROM readings)
SELECT k, count(DISTINCT c) > 1 OR NOT bool_or(c = 1.0) AS meaningful, count(DISTINCT c) > 1 OR NOT bool_or(c = 1.0) OR avg(c) < 1 AS highlight FROM c GROUP BY 1"""
)
def meaningful_conf(t: Tables) -> DataFrame:
    return runstats.meaningful(D.readings(t).select("k", F.when(F.col("discount") < 0.08, 1.0).otherwise(0.5).alias("confidence")), ["k"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
