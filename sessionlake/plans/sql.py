"""The shared rules as SQL functions and views, so a typed-in statement follows them too."""

from __future__ import annotations

from pyspark.sql import SparkSession

from sessionlake.functions.pricing import MODELS
from sessionlake.operators.relations import Tables
from sessionlake.schema import COUNTED


def install_functions(spark: SparkSession) -> None:
    windows = ", ".join(f"'{m}', {w}L" for m, (_, _, w) in MODELS.items() if w is not None)
    functions = {
        "signature_line(line_text STRING) RETURNS STRING": (
            r"regexp_replace(regexp_replace(trim(split_part(line_text, '\n', 1)), r'\s+', ' '), "
            r"r'(^|\s)/[^\s]*[^\s.,;:]', '$1<path>')"
        ),
        "rebuilt_context(creation BIGINT, cached BIGINT, min_tokens BIGINT, min_pct BIGINT) "
        "RETURNS BOOLEAN": "creation >= min_tokens AND creation * 100 >= min_pct * (creation + cached)",
        "context_window(model_name STRING) RETURNS BIGINT": f"try_element_at(map({windows}), model_name)",
        "cut_text(whole STRING, chars INT) RETURNS STRING": "substring(whole, 1, chars + 1)",
        "tool_asked(asked STRING, field STRING, chars INT) RETURNS STRING": (
            "substring(try_element_at(from_json(asked, 'MAP<STRING, STRING>', "
            "map('maxStringLen', '2147483647', 'allowSingleQuotes', 'false')), field), 1, chars + 1)"
        ),
        "context_fill(cache_read BIGINT, creation BIGINT, asked BIGINT, answered BIGINT) "
        "RETURNS BIGINT": "cache_read + creation + asked + answered",
        "context_added(creation BIGINT, asked BIGINT, answered BIGINT) RETURNS BIGINT": (
            "creation + asked + answered"
        ),
    }
    for head, body in functions.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")


def install_views(t: Tables) -> None:
    """`live_*`, `corpus_*` and the two rollups as temporary views."""
    for name in COUNTED:
        t.live(name).createOrReplaceTempView(f"live_{name}")
        t.corpus(name).createOrReplaceTempView(f"corpus_{name}")
    t.rollups("live").createOrReplaceTempView("session_rollups")
    t.rollups("corpus").createOrReplaceTempView("corpus_rollups")
    t["sessions"].createOrReplaceTempView("sessions")
