"""The engine's relations, derived from the driver's star schema: Spark frames and the SQL of the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridspark.functions import geometry as G

_ORDER = ["l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice"]


class Tables:
    """Reads the driver's tables by name."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def readings(t: Tables) -> DataFrame:
    """Repeated readings of a cell: the rows that share an order and a line number, in a total order."""
    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy(*_ORDER)
    ord_, last = F.row_number().over(w) - 1, F.lead(F.lit(False), 1, True).over(w)
    return t("lineitem").select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("ln"), ord_.alias("attempt"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"),
        F.floor("l_quantity").cast("string").alias("qty"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"),
        last.alias("last"),
    )


READINGS = f"""readings AS (SELECT l_orderkey AS k, l_linenumber AS ln, CAST(row_number() OVER (PARTITION BY l_orderkey, l_linenumber
  ORDER BY {', '.join(_ORDER)}) AS INT) - 1 AS attempt, l_returnflag AS flag, l_linestatus AS status, CAST(CAST(floor(l_quantity) AS BIGINT) AS VARCHAR) AS qty,
  l_extendedprice AS price, l_discount AS discount FROM lineitem)"""


def candidates(t: Tables) -> DataFrame:
    """An order as a table, an attempt of it from the readings of the same ordinal: rows by line number, three columns."""
    row = F.struct("ln", F.array("flag", "status", "qty").alias("r"))
    rows = F.transform(F.array_sort(F.collect_list(row)), lambda x: x["r"])
    out = readings(t).groupBy("k", "attempt").agg(rows.alias("rows"))
    columns = F.array(F.lit("flag"), F.lit("status"), F.when(F.col("attempt") % 2 == 0, "qty").otherwise("quantity"))
    return out.select("k", "attempt", columns.alias("columns"), "rows", F.size("rows").alias("n_rows"), F.lit(3).alias("n_cols"))


CANDIDATES = (
    READINGS
    + """, candidates AS (SELECT k, attempt, ['flag', 'status', CASE WHEN attempt % 2 = 0 THEN 'qty' ELSE 'quantity' END] AS columns,
  list([flag, status, qty] ORDER BY ln) AS rows, CAST(count(*) AS INT) AS n_rows, 3 AS n_cols FROM readings GROUP BY 1, 2)"""
)


def grid_cells(t: Tables, attempt: int, followed: bool = False) -> DataFrame:
    """An attempt of every cell as a grid cell: three columns a row, a box that moves with the attempt's price.

    With ``followed`` only cells of which there is the next attempt too: no other meets one of that attempt in a join.
    """
    r = readings(t).filter((F.col("attempt") == attempt) & (~F.col("last") if followed else F.lit(True))).withColumn("row_index", F.col("ln") - 1)
    value = F.posexplode(F.array("flag", "status", "qty")).alias("col_index", "text")
    c = r.select("k", "row_index", "price", "discount", value)
    x0, y0 = F.col("col_index") * 10.0, F.col("row_index") * 5.0
    shift = F.floor(F.col("price") % 4).cast("double")
    span = F.when(F.col("discount") > 0.05, 2).otherwise(1)
    return c.select("k", "row_index", "col_index", "text", G.bbox(x0 + shift, y0, x0 + shift + 10.0, y0 + 5.0).alias("bbox"), span.alias("row_span"), F.lit(1).alias("col_span"))


def cells_sql(name: str, attempt: int) -> str:
    return f"""{name} AS (SELECT k, ln - 1 AS row_index, col_index, text, col_index * 10.0 + floor(price % 4) AS x0, (ln - 1) * 5.0 AS y0,
  col_index * 10.0 + floor(price % 4) + 10.0 AS x1, (ln - 1) * 5.0 + 5.0 AS y1, CASE WHEN discount > 0.05 THEN 2 ELSE 1 END AS row_span, 1 AS col_span
  FROM (SELECT *, unnest([flag, status, qty]) AS text, unnest([0, 1, 2]) AS col_index FROM readings WHERE attempt = {attempt}))"""


def boxes(t: Tables) -> DataFrame:
    """Parts as boxes on a page per brand."""
    p = t("part")
    x0, y0 = (F.col("p_partkey") % 37) * 15.0, F.col("p_size") * 12.0
    box = G.bbox(x0, y0, x0 + 8.0 + F.col("p_partkey") % 7, y0 + 9.0 + F.col("p_size") % 3)
    return p.select(F.col("p_brand").alias("page"), F.col("p_partkey").alias("box_idx"), box.alias("bbox"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("price"))


BOXES = """boxes AS (SELECT p_brand AS page, p_partkey AS box_idx, p_name AS name, p_retailprice AS price, (p_partkey % 37) * 15.0 AS x0, p_size * 12.0 AS y0,
  (p_partkey % 37) * 15.0 + 8.0 + p_partkey % 7 AS x1, p_size * 12.0 + 9.0 + p_size % 3 AS y1 FROM part)"""


def tokens(t: Tables) -> DataFrame:
    """Suppliers' line items as tokens on the pages of :func:`boxes`: two of each part, a little off its box."""
    p = boxes(t)
    off = F.explode(F.array(F.lit(0), F.lit(1))).alias("i")
    q = p.select("page", "box_idx", "bbox", "name", off)
    d = (F.col("box_idx") % 5) * 0.5 + F.col("i")
    box = G.bbox(F.col("bbox.x0") + d, F.col("bbox.y0") + d, F.col("bbox.x1") + d, F.col("bbox.y1") + d)
    text = F.when(F.col("i") == 0, F.col("name")).otherwise(F.concat(F.lit("x"), F.col("box_idx")))
    return q.select("page", (F.col("box_idx") * 2 + F.col("i")).alias("token_idx"), text.alias("token"), box.alias("tbox"), (0.3 + (F.col("box_idx") % 8) / 10).alias("token_confidence"))


TOKENS = """tokens AS (SELECT page, box_idx * 2 + i AS token_idx, CASE WHEN i = 0 THEN name ELSE 'x' || box_idx END AS token,
  x0 + (box_idx % 5) * 0.5 + i AS x0, y0 + (box_idx % 5) * 0.5 + i AS y0, x1 + (box_idx % 5) * 0.5 + i AS x1, y1 + (box_idx % 5) * 0.5 + i AS y1,
  0.3 + (box_idx % 8) / 10 AS token_confidence FROM boxes, (VALUES (0), (1)) AS v(i))"""


def page_results(t: Tables) -> DataFrame:
    """Events as page results of a document per user."""
    e = t("events")
    v = F.coalesce("value", F.lit(0.0))
    k = F.col("event_id")
    errors = F.when(k % 17 == 0, F.array(F.concat(F.lit("page "), k.cast("string"), F.lit(" failed")))).otherwise(F.array().cast("array<string>"))
    model = F.when(k % 3 == 0, "gemini-2.5-pro").when(k % 3 == 1, "gpt-4o")
    return e.select(
        F.col("user_id").cast("string").alias("doc_id"), k.cast("int").alias("page_index"), (k % 11 == 0).alias("skipped"), (k % 4).cast("int").alias("tables_detected"),
        (k % 3).cast("int").alias("tables_extracted"), (k % 2).cast("int").alias("tables_failed"), (k % 50).cast("int").alias("cells_with_text"), (k % 60).cast("int").alias("total_cells"),
        (k % 5).cast("int").alias("llm_fallback_count"), F.floor(v).cast("double").alias("confidence_sum"), (k % 7).cast("int").alias("confidence_count"),
        F.floor(v * 10).cast("double").alias("duration_ms"), (k % 2).cast("int").alias("calls_primary"), (k % 5 == 0).cast("int").alias("calls_escalation"),
        (k % 1000).cast("bigint").alias("tokens_in"), (k % 300).cast("bigint").alias("tokens_out"), model.alias("model"), errors.alias("errors"),
    )


PAGE_RESULTS = """page_results AS (SELECT CAST(user_id AS VARCHAR) AS doc_id, CAST(event_id AS INT) AS page_index, event_id % 11 = 0 AS skipped, event_id % 4 AS tables_detected,
  event_id % 3 AS tables_extracted, event_id % 2 AS tables_failed, event_id % 50 AS cells_with_text, event_id % 60 AS total_cells, event_id % 5 AS llm_fallback_count,
  floor(coalesce(value, 0)) AS confidence_sum, event_id % 7 AS confidence_count, floor(coalesce(value, 0) * 10) AS duration_ms, event_id % 2 AS calls_primary,
  CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END AS calls_escalation, event_id % 1000 AS tokens_in, event_id % 300 AS tokens_out,
  CASE event_id % 3 WHEN 0 THEN 'gemini-2.5-pro' WHEN 1 THEN 'gpt-4o' END AS model, CASE WHEN event_id % 17 = 0 THEN ['page ' || event_id || ' failed'] ELSE [] END AS errors FROM events)"""
