"""Ad-hoc SQL, result preview, query log and chart-ready extracts (Q1-Q4)."""

from __future__ import annotations

import re
import time
import uuid

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tablelens.functions.columns import is_numeric_type, qcol
from tablelens.functions.sql import register_sql_functions
from tablelens.session import shared_dir

CHART_BAR_MAX_ROWS = 30

# First words of statements that only show something.
SHOWING = re.compile(r"\s*(describe|desc|show|explain)\b", re.IGNORECASE)


def refuse_writes(spark: SparkSession, sql: str) -> None:
    """Raise ``ValueError`` unless the statement is a query or only shows
    something: a query can stand as a subquery, other statements cannot.  The
    subquery is analysed, never run."""
    if SHOWING.match(sql):
        return
    try:
        spark.sql(f"SELECT * FROM (\n{sql.strip().rstrip(';')}\n)")
    except ParseException as e:
        raise ValueError(f"only queries are accepted: {e}") from e


def run_sql(spark: SparkSession, sql: str, limit: int | None = None) -> DataFrame:
    """Q1: run a query, DESCRIBE, SHOW or EXPLAIN over the registered tables;
    any statement whose plan writes or changes something is refused first."""
    register_sql_functions(spark)  # the check analyses the statement
    refuse_writes(spark, sql)
    df = spark.sql(sql)
    return df.limit(int(limit)) if limit is not None else df


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    """Q2: the first ``n`` rows (the order the query defines, if any)."""
    return df.limit(int(n))


def log_query(spark: SparkSession, question: str, sql: str, result: DataFrame,
              log_path: str | None = None, result_root: str | None = None) -> int:
    """Q3: save the result, count its rows while it is written, append a log row.

    The count comes from an ``Observation`` on the write itself, so the
    result is computed once.  Returns the row count.
    """
    log_path = log_path or shared_dir(spark, "query_log")
    result_root = result_root or shared_dir(spark, "query_results")
    seq = time.time_ns()
    path = f"{result_root.rstrip('/')}/{seq}-{uuid.uuid4().hex[:8]}"
    obs = Observation(f"rows_{uuid.uuid4().hex[:8]}")
    result.observe(obs, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(path)
    rows = int(obs.get.get("rows", 0))
    entry = spark.createDataFrame(
        [(seq, question, sql, rows, path)],
        "seq bigint, question string, sql string, rows bigint, result_path string",
    ).select("seq", F.current_timestamp().alias("logged_at"), "question", "sql", "rows", "result_path")
    entry.write.mode("append").parquet(log_path)
    return rows


def recent_queries(spark: SparkSession, log_path: str | None = None, n: int = 10) -> DataFrame:
    """The last ``n`` logged queries, newest first."""
    log_path = log_path or shared_dir(spark, "query_log")
    return spark.read.parquet(log_path).orderBy(F.col("seq").desc()).limit(int(n))


def chart_data(df: DataFrame) -> tuple[str, DataFrame] | None:
    """Q4: ``(kind, frame(x, y))`` for a result, or ``None``.

    y is the first numeric column; x the first non-numeric column, else the
    first column.  ``bar`` for at most 30 rows, else ``line``.  Nothing for
    an empty result, fewer than two columns or no numeric column.
    """
    fields = df.schema.fields
    if len(fields) < 2:
        return None
    num = [f.name for f in fields if is_numeric_type(f.dataType)]
    if not num:
        return None
    other = [f.name for f in fields if not is_numeric_type(f.dataType)]
    y = num[0]
    x = other[0] if other else fields[0].name
    n = df.limit(CHART_BAR_MAX_ROWS + 1).count()
    if n == 0:
        return None
    kind = "bar" if n <= CHART_BAR_MAX_ROWS else "line"
    return kind, df.select(qcol(x).alias("x"), qcol(y).alias("y"))
