"""Data-quality checks and the anomaly report.

A table's report is one lazy plan; building it runs only the passes of the
exact quartiles and the row hashes.  Six to eight scans a table, whatever the
number of columns:

1. ``column_stats``: null counts and constancy of every column in one
   aggregate, from which both column checks are read;
2. ``exact_quantiles``: exact quartiles of all numeric columns together, by two
   to four passes of radix selection (kept: one row per numeric column);
   approximate or stored quartiles need none;
3. one aggregate counting values outside the IQR fences of every numeric
   column; the fences reach it as one scalar subquery (an array with a struct
   a column);
4. row hashes counted for duplicate rows, then the rows with a repeated hash
   grouped by all columns.
"""

from __future__ import annotations

from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens.session import local_frame
from tablelens.functions.columns import (
    normalized_sql,
    numeric_columns,
    union_all_names,
)
from tablelens.operators.quantiles import SKETCH_K, approx_quantiles, exact_quantiles
from tablelens.operators.rows import row_summary
from tablelens.operators.stats import column_stats

ANOMALY_FIELDS = (
    "table string, column string, anomaly_type string, severity string, "
    "description string, value double"
)
_RANKED_FIELDS = ANOMALY_FIELDS + ", check_no int, col_pos int"

# Thresholds of the checks (percentages), the IQR multiplier,
# the minimum number of values for the outlier check, the labels and the
# description templates.
NULL_HIGH_PCT = 50.0
NULL_MEDIUM_PCT = 20.0
DUPLICATE_PCT = 5.0
IQR_MULTIPLIER = 3.0
OUTLIER_FLAG_PCT = 1.0
MIN_OUTLIER_VALUES = 20
NULL_RATE = "High Null Rate"
DUPLICATE_ROWS = "Duplicate Rows"
OUTLIERS = "Outliers Detected"
ZERO_VARIANCE = "Zero Variance"
ENTIRE_ROW = "(entire row)"
SEVERITIES = ("high", "medium", "low")
NULL_TEXT = "%.1f%% of values are null (%d rows)"
DUPLICATE_TEXT = "%.1f%% of rows are exact duplicates (%d rows)"
OUTLIER_TEXT = "%.1f%% outliers (IQR x%s). Expected range: [%.2f, %.2f]"
ZERO_VARIANCE_TEXT = "All non-null values are identical: "

QUARTILES = (0.25, 0.75)


def _ranked(table: str, column: Column, kind: str, severity: Column, description: Column,
            value: Column, check_no: int, col_pos: Column) -> list[Column]:
    return [
        F.lit(table).alias("table"),
        column.alias("column"),
        F.lit(kind).alias("anomaly_type"),
        severity.alias("severity"),
        description.alias("description"),
        value.cast("double").alias("value"),
        F.lit(check_no).alias("check_no"),
        col_pos.cast("int").alias("col_pos"),
    ]


# --------------------------------------------------------------------------
# individual checks (each returns the ranked anomaly schema)
# --------------------------------------------------------------------------

def null_finding(table: str) -> tuple[Column, list[Column]]:
    """D1 over a row of ``column_stats``: when it holds, and what is reported."""
    nulls = F.col("rows") - F.col("non_null")
    pct = F.try_divide(nulls, F.col("rows")) * 100.0
    return pct >= NULL_MEDIUM_PCT, _ranked(
        table, F.col("column"), NULL_RATE, F.when(pct >= NULL_HIGH_PCT, "high").otherwise("medium"),
        F.format_string(NULL_TEXT, pct, nulls), pct, 1, F.col("pos"))


def zero_variance_finding(table: str, columns: list[str]) -> tuple[Column, list[Column]]:
    """D4 over a row of ``column_stats`` (as ``null_finding``): ``min = max`` in
    the column's own type over at least one value; all-null columns are not
    flagged."""
    return F.col("column").isin(columns) & (F.col("non_null") > 0) & F.col("constant"), _ranked(
        table, F.col("column"), ZERO_VARIANCE, F.lit("low"),
        F.concat(F.lit(ZERO_VARIANCE_TEXT), F.col("min_text")), F.lit(0.0), 4, F.col("pos"))


def check_columns(stats: DataFrame, findings: list[tuple[Column, list[Column]]]) -> DataFrame:
    """The findings that hold, all from one pass over the column statistics."""
    found = F.array(*[F.when(holds, F.struct(*fields)) for holds, fields in findings])
    return stats.select(F.inline(F.array_compact(found)))


def check_nulls(stats: DataFrame, table: str) -> DataFrame:
    """Per column, missing >= 20 % -> medium, >= 50 % -> high."""
    return check_columns(stats, [null_finding(table)])


def check_zero_variance(stats: DataFrame, table: str, columns: list[str]) -> DataFrame:
    """Numeric column whose non-null values are all equal -> low."""
    return check_columns(stats, [zero_variance_finding(table, columns)])


def duplicate_summary(df: DataFrame) -> DataFrame:
    """One row ``(rows, duplicate_rows)``; nulls (and NaNs) compare equal."""
    return row_summary(df).select("rows", "duplicate_rows")


def check_duplicates(df: DataFrame, table: str) -> DataFrame:
    """Duplicate rows (beyond the first of each group) >= 5 % -> medium."""
    d = duplicate_summary(df).withColumn(
        "__pct", F.try_divide(F.col("duplicate_rows"), F.col("rows")) * 100.0
    )
    return d.filter(F.col("__pct") >= DUPLICATE_PCT).select(
        *_ranked(
            table, F.lit(ENTIRE_ROW), DUPLICATE_ROWS, F.lit("medium"),
            F.format_string(DUPLICATE_TEXT, F.col("__pct"), F.col("duplicate_rows")),
            F.col("__pct"), 2, F.lit(-1),
        )
    )


def outlier_counts(df: DataFrame, quartiles: DataFrame, columns: list[str]) -> DataFrame:
    """Per numeric column: ``pos, column, n, q1, q3, iqr, lower, upper,
    outliers`` (one scan); columns without a row in ``quartiles``, and all columns
    of a table without rows, have nulls.

    The fences reach the scan as one scalar subquery over the quartile frame,
    an array in the order of ``columns``, so nothing is gathered on the driver.
    The count is strict: values below ``lower`` or above ``upper``.
    """
    fields = ("n", "q1", "q3", "iqr", "lower", "upper")
    if not columns:
        return local_frame(df.sparkSession, [], "pos int, column string, n bigint, " + ", ".join(
            f"{f} double" for f in fields[1:]) + ", outliers bigint")
    q1, q3 = F.col("q")[0], F.col("q")[1]
    iqr = q3 - q1
    fence = F.struct(F.col("n"), q1.alias("q1"), q3.alias("q3"), iqr.alias("iqr"),
                     (q1 - IQR_MULTIPLIER * iqr).alias("lower"), (q3 + IQR_MULTIPLIER * iqr).alias("upper"))
    fences = quartiles.agg(F.array(*[F.max(F.when(F.col("column") == c, fence)) for c in columns]).alias("fences"))
    x, own = F.col, lambda k: F.col("__f")[k]
    counted = df.select(
        *[F.expr(f"CAST({normalized_sql(df, c)} AS DOUBLE)").alias(f"__c{k}") for k, c in enumerate(columns)],
        fences.scalar().alias("__f"),
    ).agg(F.first("__f").alias("__f"), *[
        F.count_if((x(f"__c{k}") < own(k)["lower"]) | (x(f"__c{k}") > own(k)["upper"])).alias(f"__o{k}")
        for k in range(len(columns))])
    return counted.select(F.inline(F.array(*[
        F.struct(F.lit(df.columns.index(c)).alias("pos"), F.lit(c).alias("column"), *[own(k)[f].alias(f) for f in fields],
                 F.when(own(k)["lower"].isNotNull(), x(f"__o{k}")).alias("outliers"))
        for k, c in enumerate(columns)])))


def check_outliers(df: DataFrame, table: str, quartiles: DataFrame, columns: list[str]) -> DataFrame:
    """D3: >= 1 % of the non-null values outside ``[Q1 - 3 IQR, Q3 + 3 IQR]``
    -> low.  Columns with fewer than 20 values or IQR = 0 are skipped."""
    oc = outlier_counts(df, quartiles, columns)
    pct = F.try_divide(F.col("outliers"), F.col("n")) * 100.0
    return (
        oc.filter((F.col("n") >= MIN_OUTLIER_VALUES) & (F.col("iqr") != 0))
        .withColumn("__pct", pct)
        .filter(F.col("__pct") >= OUTLIER_FLAG_PCT)
        .select(
            *_ranked(
                table, F.col("column"), OUTLIERS, F.lit("low"),
                F.format_string(
                    OUTLIER_TEXT, F.col("__pct"), F.lit(str(IQR_MULTIPLIER)), F.col("lower"), F.col("upper"),
                ),
                F.col("__pct"), 3, F.col("pos"),
            )
        )
    )


# --------------------------------------------------------------------------
# D5-D7
# --------------------------------------------------------------------------

def detect_ranked(
    df: DataFrame,
    table: str,
    *,
    method: str = "exact",
    accuracy: int = SKETCH_K,
    quartiles: DataFrame | None = None,
    checks: tuple[str, ...] = ("nulls", "duplicates", "outliers", "zero_variance"),
) -> DataFrame:
    """All checks of one table with ordering keys ``check_no, col_pos``, as one
    lazy plan.

    ``quartiles`` (``column, n, q``) replaces the quartiles of ``method``, for
    instance those of stored sketches (``operators/sketches.py``).
    """
    if method not in ("exact", "approx"):
        raise ValueError("method must be 'exact' or 'approx'")
    num = numeric_columns(df)
    parts = []
    findings = ([null_finding(table)] if "nulls" in checks else []) + (
        [zero_variance_finding(table, num)] if "zero_variance" in checks and num else [])
    if findings:
        parts.append(check_columns(column_stats(df, distinct=None, sample=False), findings))
    # the row hashes do not depend on the quartiles: both run at the same time
    with ThreadPoolExecutor(max_workers=1) as pool:
        duplicates = pool.submit(check_duplicates, df, table) if "duplicates" in checks else None
        if "outliers" in checks and num:
            if quartiles is None:
                quartiles = (exact_quantiles(df, num, QUARTILES) if method == "exact"
                             else approx_quantiles(df, num, QUARTILES, accuracy))
            parts.append(check_outliers(df, table, quartiles, num))
        if duplicates:
            parts.append(duplicates.result())
    if not parts:
        return local_frame(df.sparkSession, [], _RANKED_FIELDS)
    return union_all_names(parts)


def detect(df: DataFrame, table: str, **kw) -> DataFrame:
    """Every check on one table, in check order then column order."""
    return detect_ranked(df, table, **kw).orderBy("check_no", "col_pos").drop("check_no", "col_pos")


def severity_rank(c: Column) -> Column:
    return F.when(c == "high", 0).when(c == "medium", 1).when(c == "low", 2).otherwise(3)


def detect_many(tables: Mapping[str, DataFrame], **kw) -> list[DataFrame]:
    """``detect_ranked`` for several tables, each table's jobs submitted from
    its own thread so that independent tables share the cluster."""
    items = list(tables.items())
    if len(items) <= 1:
        return [detect_ranked(df, name, **kw) for name, df in items]
    with ThreadPoolExecutor(max_workers=min(len(items), 8)) as pool:
        return list(pool.map(lambda it: detect_ranked(it[1], it[0], **kw), items))


def anomaly_report(tables: Mapping[str, DataFrame], **kw) -> DataFrame:
    """D5 for every table, sorted high -> medium -> low, then table name,
    check order and column position (a stable order)."""
    tables = dict(sorted(tables.items()))
    parts = [p.withColumn("__t", F.lit(i)) for i, p in enumerate(detect_many(tables, **kw))]
    if not parts:
        return _empty_report()
    rep = union_all_names(parts)
    return rep.orderBy(severity_rank(F.col("severity")), "__t", "check_no", "col_pos").drop(
        "__t", "check_no", "col_pos"
    )


def _empty_report():
    from pyspark.sql import SparkSession

    return local_frame(SparkSession.getActiveSession(), [], ANOMALY_FIELDS)


def severity_summary(report: DataFrame) -> DataFrame:
    """Anomaly count per severity, zero included, high -> low."""
    spark = report.sparkSession
    levels = local_frame(spark, [(s, i) for i, s in enumerate(SEVERITIES)], "severity string, rank int")
    counts = report.groupBy("severity").agg(F.count(F.lit(1)).alias("count"))
    return (
        levels.join(counts, "severity", "left")
        .select("severity", F.coalesce("count", F.lit(0)).cast("long").alias("count"), "rank")
        .orderBy("rank")
        .drop("rank")
    )


def type_counts(report: DataFrame) -> DataFrame:
    """Anomaly count per type."""
    return report.groupBy("anomaly_type").agg(F.count(F.lit(1)).alias("count"))
