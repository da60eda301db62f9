"""Session SQL functions for ad-hoc queries.

``strftime(ts, fmt)`` takes a C-style format, as advertised for ad-hoc SQL,
and is defined as a SQL function over the built-in ``date_format``, so it
runs JVM-side like any built-in.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from tablelens.functions.columns import STRFTIME_TO_JAVA


def _pattern_sql(arg: str) -> str:
    """SQL text turning a C format held in ``arg`` into a Java pattern: known
    directives are looked up, everything between them is quoted."""
    known = "".join(sorted(d[1] for d in STRFTIME_TO_JAVA))
    tokens = f"regexp_extract_all({arg}, '%[{known}]|(?:[^%]|%(?![{known}]))+', 0)"
    pairs = ", ".join(f"'{c}', '{java}'" for c, java in STRFTIME_TO_JAVA.items())
    quoted = "concat('\\'', replace(x, '\\'', '\\'\\''), '\\'')"
    return f"array_join(transform({tokens}, x -> coalesce(try_element_at(map({pairs}), x), {quoted})), '')"


def register_sql_functions(spark: SparkSession) -> None:
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION strftime(ts TIMESTAMP, fmt STRING) "
        f"RETURNS STRING RETURN date_format(ts, {_pattern_sql('fmt')})"
    )
