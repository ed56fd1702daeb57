"""The operators of this package as registered queries, with their SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, language, linededup, mixing, piecewise, simhash, substring, tokens, toxicity, urlfilter


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_read(spark, sf_dir, "documents"))
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")


OP2_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bg AS (SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bg),
dg AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS i FROM w, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, n, item FROM dg JOIN bg USING (n, g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS l FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY 1)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w.w) AS contaminated
FROM w LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.remove_repeats(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 34], ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, CAST(len(w) - 33 AS BIGINT))) AS i FROM w WHERE len(w) >= 35)),
r AS (SELECT g FROM g GROUP BY 1 HAVING count(*) > 1),
p AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM g SEMI JOIN r USING (g)),
k AS (SELECT doc_id, count(*) AS n FROM p GROUP BY 1),
t AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS kept FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, CAST(len(w) + 1 AS BIGINT))) AS i FROM w) t
  WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.doc_id = t.doc_id AND p.p = t.i) GROUP BY 1)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(k.n, 0) AS n_removed, sha256(coalesce(t.kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id) LEFT JOIN t USING (doc_id)
"""


def op4_piecewise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piecewise.fingerprints(_read(spark, sf_dir, "documents"))


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_files(_read(spark, sf_dir, "documents"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predict(_read(spark, sf_dir, "documents")).drop("t")


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(_read(spark, sf_dir, "pages"))


#: Rounds of the SQL twin: what is left after them is below 1e-8 of the seeds.
_ROUNDS = 128


OP7_SQL = rf"""
WITH RECURSIVE p AS (SELECT page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
rules(verdict, rule) AS (VALUES ('block', 'net/'), ('allow', 'example.net/en/'), ('block', 'example.com/de/'), ('allow', 'org/fr/')),
parts AS (SELECT verdict, rule, split_part(rule, '/', 1) AS rh, substr(rule, strpos(rule, '/')) AS rp FROM rules),
r AS (SELECT page_id, html, host, path, (SELECT {{'rule': rule, 'verdict': verdict}} FROM parts
  WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) ORDER BY length(rule) DESC LIMIT 1) AS x FROM h),
e AS (SELECT host AS a, b, count(*) AS n FROM (SELECT DISTINCT page_id, host, lower(unnest(regexp_extract_all(html,
  '(?i)href\s*=\s*["'']?\s*(?:https?:)?//([^/?#"''\s>]+)', 1))) AS b FROM h) WHERE host <> b AND host <> '' GROUP BY 1, 2),
ends AS (SELECT 't' AS kind, a AS host, b, n FROM e UNION ALL SELECT 'd', b, a, n FROM e),
ways AS (SELECT kind, host, b, n / sum(n) OVER (PARTITION BY kind, host) AS w FROM ends),
share AS (SELECT host, count(*) FILTER (x.verdict = 'allow') / count(*) AS t, count(*) FILTER (x.verdict = 'block') / count(*) AS d FROM r WHERE host <> '' GROUP BY 1),
s0 AS (SELECT 't' AS kind, host, t * {{0}} AS s FROM share WHERE t > 0 UNION ALL SELECT 'd', host, d * {{0}} FROM share WHERE d > 0),
added(k, kind, host, s) AS (SELECT 0, kind, host, s FROM s0 UNION ALL
  SELECT k + 1, kind, b, {urlfilter.DAMPING} * sum(s * w) FROM added JOIN ways USING (kind, host) WHERE k < {_ROUNDS} GROUP BY k, kind, b),
f AS (SELECT host, coalesce(sum(s) FILTER (kind = 't'), 0) AS t, coalesce(sum(s) FILTER (kind = 'd'), 0) AS d FROM added GROUP BY 1)
SELECT page_id, r.host, path, x.rule AS rule, coalesce(x.verdict, CASE WHEN d > t AND d > {{1}} THEN 'block' END, 'allow') AS verdict
FROM r LEFT JOIN f ON r.host = f.host
""".replace("{0}", repr(1 - urlfilter.DAMPING)).replace("{1}", repr(urlfilter.FLOOR * (1 - urlfilter.DAMPING)))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.drop_boilerplate(_read(spark, sf_dir, "pages"))
    return found.select("page_id", "host", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP9_SQL = rf"""
WITH p AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*'),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
  regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '{linededup.HIDDEN}', chr(10), 'g'), '{linededup.INLINE}', '', 'g'), '{linededup.TAG}', chr(10), 'g') AS text FROM pages),
l AS (SELECT page_id, host, list_filter(list_transform(regexp_split_to_array(text, '[\x0A-\x0D]'),
  lambda x: trim(x, chr(32) || chr(9) || chr(11) || chr(12))), lambda x: x <> '') AS lines FROM p),
c AS (SELECT host, x, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS x FROM l WHERE host <> '') GROUP BY 1, 2),
t AS (SELECT host, count(*) AS total FROM p GROUP BY 1),
b AS (SELECT host, list(x) AS xs FROM c JOIN t USING (host) WHERE n >= {linededup.MIN_PAGES} AND 10 * n > {linededup.RATIO_TENTHS} * total GROUP BY 1),
k AS (SELECT page_id, host, lines, list_filter(lines, lambda x: NOT list_contains(coalesce(xs, []), x)) AS kept FROM l LEFT JOIN b USING (host))
SELECT page_id, host, len(lines) AS n_lines, len(lines) - len(kept) AS n_dropped, sha256(array_to_string(kept, chr(10))) AS kept_sha256 FROM k
"""


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.copies(_read(spark, sf_dir, "documents"))
    return found.select("row.doc_id", "domain", mixing.n_tokens(F.col("row.text")).alias("n_tokens"), "n_copies")


def _weights_sql(level: str) -> str:
    given = getattr(mixing.PRODUCTION, level)
    return "CASE " + level + "".join(f" WHEN '{k}' THEN {v}" for k, v in given.items()) + " ELSE 1 END"


def _level_sql(i: int) -> str:
    """Budgets of one level of the tree from those of the level above."""
    keys, above = ", ".join(mixing.LEVELS[: i + 1]), ", ".join(mixing.LEVELS[:i])
    by, level = f"PARTITION BY {above}" if above else "", mixing.LEVELS[i]
    parent = f"JOIN b{i - 1} USING ({above})" if above else ", total"
    order = f"{by} ORDER BY c / CAST(w AS DOUBLE), {level}"
    return f"""
n{i} AS (SELECT {keys}, CAST(sum(capacity) AS HUGEINT) AS c, CAST({_weights_sql(level)} AS HUGEINT) AS w FROM leaf GROUP BY {keys}),
f{i} AS (SELECT *, CASE WHEN c * (sum(w) OVER ({by}) - coalesce(sum(w) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  <= w * (budget - coalesce(sum(c) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) THEN 1 ELSE 0 END AS ok FROM n{i} {parent}),
g{i} AS (SELECT *, min(ok) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sat FROM f{i}),
b{i} AS (SELECT {keys}, CAST(CASE WHEN sat = 1 THEN c ELSE (w * (budget - sum(sat * c) OVER ({by}))) // sum((1 - sat) * w) OVER ({by}) END AS HUGEINT) AS budget FROM g{i})"""


OP10_SQL = rf"""
WITH d AS (SELECT doc_id, CASE WHEN regexp_extract(coalesce(source, ''), '[0-9]{{1,9}}$') = '' THEN 'other'
  ELSE ['{"', '".join(mixing.DOMAINS)}'][CAST(regexp_extract(source, '[0-9]{{1,9}}$') AS INT) % {len(mixing.DOMAINS)} + 1] END AS domain,
  coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ 	-
]+'), lambda x: x <> '')) AS n FROM documents),
leaf AS (SELECT domain, lang, source, sum(n) AS tokens, sum(n) * {mixing.PRODUCTION.epochs} AS capacity FROM d GROUP BY ALL),
total AS (SELECT CAST(least(sum(tokens) * {mixing.PRODUCTION.share[0]} // {mixing.PRODUCTION.share[1]}, sum(capacity)) AS HUGEINT) AS budget FROM leaf),
{",".join(_level_sql(i) for i in range(3))},
e AS (SELECT domain, lang, source, tokens, budget, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS whole FROM leaf JOIN b2 USING (domain, lang, source)),
o AS (SELECT *, sum(n) OVER (PARTITION BY domain, lang, source ORDER BY md5('{mixing.PRODUCTION.seed}:' || whole || ':' || doc_id), doc_id) AS upto FROM d JOIN e USING (domain, lang, source))
SELECT doc_id, domain, CAST(n AS BIGINT) AS n_tokens,
  CAST(whole + CASE WHEN tokens = 0 OR budget > whole * tokens AND upto <= budget - whole * tokens THEN 1 ELSE 0 END AS INT) AS n_copies FROM o
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every operator over its whole table, with the settings that it ships with."""
    ops = op1_simhash, op2_decontaminate, op3_substring, op4_piecewise, op5_tokens, op6_language, op7_urls, op8_toxicity, op9_lines, op10_mixing
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op2_decontaminate": OP2_SQL, "op3_substring": OP3_SQL, "op7_urls": OP7_SQL, "op9_lines": OP9_SQL, "op10_mixing": OP10_SQL}
