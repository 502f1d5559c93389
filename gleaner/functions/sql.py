"""The text functions for SQL, as temporary SQL functions that the planner inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

_FUNCTIONS = {
    "gl_tokens(t STRING) RETURNS ARRAY<STRING>": r"regexp_extract_all(lower(coalesce(t, '')), r'([\p{L}\p{N}_]+)', 1)",
    "gl_collapse(t STRING) RETURNS STRING": r"replace(lower(trim(regexp_replace(coalesce(t, ''), r'(?U)\s+', ' '))), 'ß', 'ss')",
    "gl_published(d STRING) RETURNS DATE": r"if(substring(trim(d), 1, 10) rlike r'^\d{4}-\d{2}-\d{2}$', try_to_date(substring(trim(d), 1, 10), 'yyyy-MM-dd'), NULL)",
    "gl_snippet(t STRING) RETURNS STRING": "substring(t, 1, 400)",
    "gl_cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": (
        "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, v) -> s + v) / nullif(sqrt(aggregate(a, 0D, (s, v) -> s + v * v)) * sqrt(aggregate(b, 0D, (s, v) -> s + v * v)), 0D)"
    ),
}


def register(spark: SparkSession) -> list[str]:
    """Create the functions in this session; returns their names."""
    for head, body in _FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [head.partition("(")[0] for head in _FUNCTIONS]
