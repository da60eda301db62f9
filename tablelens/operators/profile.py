"""Table overview, column profile, Spark-style profile and histograms.

All operators return DataFrames whose size is bounded by the number of
columns (or columns x bins); no table content reaches the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.session import local_frame
from tablelens.functions.columns import (
    is_missing,
    normalized,
    numeric_columns,
    qcol,
)
from tablelens.operators.rows import row_summary
from tablelens.operators.stats import DISTINCT_GROUP, column_stats, distinct_key_sql

PROFILE_FIELDS = (
    "column string, type string, non_null bigint, null_pct double, unique bigint, "
    "sample_value string, min double, max double, mean double"
)


def table_overview(df: DataFrame) -> DataFrame:
    """One row: ``rows, columns, null_cells, duplicate_rows`` (T1), by row
    hashes; only rows whose hash repeats are compared in full."""
    n_cols = len(df.columns)
    if n_cols == 0:
        return local_frame(df.sparkSession, [], "rows bigint, columns int, null_cells bigint, duplicate_rows bigint")
    return row_summary(df).select("rows", F.lit(n_cols).alias("columns"), "null_cells", "duplicate_rows")


def profile_table(
    df: DataFrame,
    *,
    order_by: str | Sequence[str] | None = None,
    exact: bool = True,
    stats: DataFrame | None = None,
) -> DataFrame:
    """One row per column, in table order (T2), from one aggregate.

    ``order_by`` fixes which value is the "first" non-null sample;
    ``exact=False`` uses HyperLogLog++ distinct counts for very wide tables.
    """
    st = stats if stats is not None else column_stats(
        df, distinct="exact" if exact else "approx", order_by=order_by
    )
    return st.orderBy("pos").select(
        "column",
        "type",
        "non_null",
        F.round(F.try_divide(F.col("rows") - F.col("non_null"), F.col("rows")) * 100.0, 1).alias("null_pct"),
        "unique",
        F.coalesce("sample_value", F.lit("N/A")).alias("sample_value"),
        F.round("min", 2).alias("min"),
        F.round("max", 2).alias("max"),
        F.round("mean", 2).alias("mean"),
    )


# --------------------------------------------------------------------------
# The Spark-notebook profile (wide rows and a typed numeric summary)
# --------------------------------------------------------------------------

def null_rates(df: DataFrame, digits: int = 2) -> DataFrame:
    """One wide row: percent missing per column, same column names (A4)."""
    rows = F.count(F.lit(1))
    return df.agg(
        *[
            F.round(F.try_divide(F.count_if(is_missing(df, c)), rows) * 100.0, digits).alias(c)
            for c in df.columns
        ]
    )


def distinct_counts(df: DataFrame, exact: bool = True) -> DataFrame:
    """One wide row: distinct non-null values per column (A3)."""
    from tablelens.operators.stats import groupable

    if not exact:
        return df.agg(*[F.approx_count_distinct(groupable(df, c)).alias(c) for c in df.columns])
    # groups of columns, as in column_stats: an expanded row has a slot a column
    out = None
    for a in range(0, len(df.columns), DISTINCT_GROUP):
        part = df.agg(*[F.expr(f"count(DISTINCT {distinct_key_sql(df, c)})").alias(c) if c in df.columns[a:a + DISTINCT_GROUP]
                        else F.lit(None).cast("bigint").alias(c) for c in df.columns])
        out = part if out is None else out.unionByName(part)
    return out.agg(*[F.max(qcol(c)).alias(c) for c in df.columns])  # one row a group


def numeric_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Typed ``count, mean, stddev, min, max`` per numeric column (A10).

    ``describe()`` returns strings; this is one aggregate unpivoted to one
    typed row per column.
    """
    cols = list(columns) if columns is not None else numeric_columns(df)
    if not cols:
        return local_frame(df.sparkSession, 
            [], "column string, count bigint, mean double, stddev double, min double, max double"
        )
    structs = []
    for name in cols:
        d = normalized(df, name).cast("double")
        structs.append(
            F.struct(
                F.lit(name).alias("column"),
                F.count(d).alias("count"),
                F.avg(d).alias("mean"),
                F.stddev_samp(d).alias("stddev"),
                F.min(d).alias("min"),
                F.max(d).alias("max"),
            )
        )
    return df.agg(F.array(*structs).alias("__a")).select(F.inline("__a"))


# --------------------------------------------------------------------------
# Equi-width histograms
# --------------------------------------------------------------------------

def histograms(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    bins: int = 30,
    max_cols: int | None = None,
) -> DataFrame:
    """Rows ``(column, bin, lo, hi, count)`` with exactly ``bins`` bins per column,
    for ``columns`` or all numeric ones (``max_cols``: only the first so many).

    Two scans for all columns together: a min/max aggregate, whose result
    (two numbers per column) is inlined as literals, and a grouped count on
    ``(column, bin)`` after unpivoting, which the map-side partial aggregate
    reduces to at most ``columns x bins`` rows per task.  The maximum falls
    in the last bin; a constant column has all values in bin 0.  Empty bins
    are reported with count 0.
    """
    cols = list(columns) if columns is not None else numeric_columns(df)[:max_cols]
    spark = df.sparkSession
    schema = "column string, bin int, lo double, hi double, count bigint"
    if not cols:
        return local_frame(spark, [], schema)
    bins = int(bins)
    values = [normalized(df, c).cast("double").alias(f"__c{k}") for k, c in enumerate(cols)]
    projected = df.select(*values)
    r = projected.agg(
        *[F.min(f"__c{k}").alias(f"lo{k}") for k in range(len(cols))],
        *[F.max(f"__c{k}").alias(f"hi{k}") for k in range(len(cols))],
    ).collect()[0]
    entries = []
    frame_rows = []
    for k, c in enumerate(cols):
        lo, hi = r[f"lo{k}"], r[f"hi{k}"]
        if lo is None:
            continue
        x = F.col(f"__c{k}")
        if hi == lo:
            b = F.lit(0)
        else:
            b = F.least(F.floor((x - F.lit(lo)) / F.lit(hi - lo) * bins), F.lit(bins - 1))
        entries.append(F.when(x.isNotNull(), F.struct(F.lit(k).alias("k"), b.cast("int").alias("bin"))))
        frame_rows.append((k, c, float(lo), float(hi)))
    if not entries:
        return local_frame(spark, [], schema)
    counts = (
        projected.select(F.explode(F.array(*entries)).alias("e"))
        .filter(F.col("e").isNotNull())
        .groupBy("e.k", "e.bin")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    # columns x bins rows, built from the measured ranges
    frame = local_frame(spark, frame_rows, "k int, column string, rlo double, rhi double").select(
        "k", "column", "rlo", "rhi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    )
    width = (F.col("rhi") - F.col("rlo")) / bins
    out = frame.join(F.broadcast(counts), ["k", "bin"], "left")
    return out.select(
        "column",
        "bin",
        (F.col("rlo") + F.col("bin") * width).alias("lo"),
        (F.col("rlo") + (F.col("bin") + 1) * width).alias("hi"),
        F.coalesce("count", F.lit(0)).cast("long").alias("count"),
    ).orderBy("column", "bin")
