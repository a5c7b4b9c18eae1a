"""The functions of this library for SQL: temporary functions that Catalyst inlines, and table functions."""

from __future__ import annotations

from pyspark.sql import SparkSession

from gleaner.functions.text import CRITICAL, LEVEL, LOG_MASKS, TOKEN
from gleaner.operators.ir import ParseSections
from gleaner.operators.lessons import ParseLesson


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def register(spark: SparkSession) -> None:
    """token_estimate, log_template, log_level, is_critical, text_lines, parse_ir, parse_lesson."""
    template = "line"
    for pattern, mask in LOG_MASKS:
        template = f"regexp_replace({template}, {_literal(pattern)}, {_literal(mask)})"
    bodies = {
        "token_estimate(text STRING) RETURNS BIGINT": f"CAST(regexp_count(coalesce(text, ''), {_literal(TOKEN)}) AS BIGINT)",
        "log_template(line STRING) RETURNS STRING": f"trim({template})",
        "log_level(line STRING) RETURNS STRING": f"nullif(upper(regexp_extract(line, {_literal('(?i)' + LEVEL)}, 1)), '')",
        "is_critical(line STRING) RETURNS BOOLEAN": f"line RLIKE {_literal('(?i)' + CRITICAL)}",
        "text_lines(text STRING) RETURNS ARRAY<STRING>": "CASE WHEN element_at(split(text, '\\r?\\n', -1), -1) = '' THEN slice(split(text, '\\r?\\n', -1), 1, size(split(text, '\\r?\\n', -1)) - 1) ELSE split(text, '\\r?\\n', -1) END".replace("\\", "\\\\"),
    }
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.udtf.register("parse_ir", ParseSections)
    spark.udtf.register("parse_lesson", ParseLesson)
