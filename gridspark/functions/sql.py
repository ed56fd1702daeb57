"""The scalar functions as SQL functions, which Catalyst inlines: no Python runs for them."""

from __future__ import annotations

from pyspark.sql import SparkSession

# name, parameters, type, body
_FUNCTIONS = [
    ("gs_cer", "predicted STRING, truth STRING", "DOUBLE", "CASE WHEN coalesce(truth, '') = '' THEN IF(coalesce(predicted, '') = '', 0D, 1D) ELSE levenshtein(coalesce(predicted, ''), truth) / length(truth) END"),
    ("gs_words", "txt STRING", "STRING", r"array_join(filter(split(coalesce(txt, ''), r'\s+'), x -> x <> ''), ' ')"),
    ("gs_wer_char", "predicted STRING, truth STRING", "DOUBLE", "gs_cer(gs_words(predicted), gs_words(truth))"),
    (
        "gs_iou",
        "a STRUCT<x0: DOUBLE, y0: DOUBLE, x1: DOUBLE, y1: DOUBLE>, b STRUCT<x0: DOUBLE, y0: DOUBLE, x1: DOUBLE, y1: DOUBLE>",
        "DOUBLE",
        """coalesce(try_divide(greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0D) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0D),
           (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0)
           - greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0D) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0D)), 0D)""",
    ),
    ("gs_confidence_band", "confidence DOUBLE", "STRING", "CASE WHEN confidence >= 0.85 THEN 'high' WHEN confidence >= 0.70 THEN 'medium' ELSE 'low' END"),
    ("gs_sheet_name", "name STRING", "STRING", "IF(length(name) > 31, substr(name, 1, 28) || '...', name)"),
    ("gs_html_escape", "txt STRING", "STRING", """replace(replace(replace(replace(replace(txt, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), "'", '&#x27;')"""),
    ("gs_backoff", "attempt INT", "DOUBLE", "least(pow(2D, attempt), 10D)"),
    (
        "gs_cost_usd",
        "tokens_in BIGINT, tokens_out BIGINT, model STRING",
        "DOUBLE",
        """CASE WHEN contains(lower(model), '2.5') THEN 0D WHEN contains(lower(model), '3.0-pro') OR contains(lower(model), '3-pro') THEN tokens_in / 1e6D * 1.25D + tokens_out / 1e6D * 5D
           WHEN contains(lower(model), 'gpt-4o') THEN tokens_in / 1e6D * 2.5D + tokens_out / 1e6D * 10D WHEN contains(lower(model), 'flash') THEN tokens_in / 1e6D * 0.075D + tokens_out / 1e6D * 0.3D
           ELSE tokens_in / 1e6D * 1D + tokens_out / 1e6D * 3D END""",
    ),
]


def register(spark: SparkSession) -> list[str]:
    """Creates the functions in the session and returns their names."""
    for name, params, kind, body in _FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {kind} RETURN {body}")
    return [f[0] for f in _FUNCTIONS]
