"""Quantiles of many numeric columns: exact (interpolated) and approximate.

``exact_quantiles`` finds order statistics by radix selection
(``operators/selection.py``): two to four scans of the numeric columns, in
which only counts are shuffled, at most 65 536 a task and target.  The two
values around ``h = (n - 1) * p`` are interpolated linearly (the same rule as
DuckDB ``quantile_cont`` and pandas ``quantile``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.functions.columns import normalized_sql
from tablelens.operators.selection import interpolated
from tablelens.session import local_frame

QUANTILE_FIELDS = "pos int, column string, n bigint, q array<double>"
# Groups in which the tasks' sketches are merged before the last merge, and
# columns of one such aggregate.
SKETCH_GROUPS = 64
SKETCH_COLUMNS = 16
# KLL sketches of size k have a rank error of about 2.3 / k ** 0.9.
SKETCH_K = 4000


def rank_error(k: int = SKETCH_K) -> float:
    """Bound on a KLL sketch's error, as a share of the values."""
    return 2.3 / k ** 0.9


def approx_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], k: int = SKETCH_K) -> DataFrame:
    """Quantiles from KLL sketches (A9): true ranks are within ``rank_error(k)``.

    Sketches (some 15 bytes a ``k``) are merged in two levels, the tasks' into
    groups and one per group at last, for ``SKETCH_COLUMNS`` columns at a time,
    so no task merges the sketches of all tasks or of all columns.
    """
    cols = list(columns)
    plist = ", ".join(f"{float(p)!r}D" for p in probs)
    out = None
    for a in range(0, len(cols), SKETCH_COLUMNS):
        part = list(enumerate(cols))[a:a + SKETCH_COLUMNS]
        merged = (
            df.groupBy(F.pmod(F.spark_partition_id(), F.lit(SKETCH_GROUPS)).alias("__group"))
            .agg(*[F.expr(f"kll_sketch_agg_double(CAST({normalized_sql(df, c)} AS DOUBLE), {k})").alias(f"k{i}") for i, c in part])
            .agg(*[F.expr(f"kll_merge_agg_double(k{i}, {k})").alias(f"k{i}") for i, _ in part]))
        n = lambda i: f"coalesce(kll_sketch_get_n_double(k{i}), 0)"
        items = [F.struct(
            F.lit(df.columns.index(c)).alias("pos"), F.lit(c).alias("column"), F.expr(n(i)).cast("long").alias("n"),
            F.expr(f"CASE WHEN {n(i)} > 0 THEN kll_sketch_get_quantile_double(k{i}, array({plist})) END").alias("q"))
            for i, c in part]
        rows = merged.select(F.inline(F.array(*items)))
        out = rows if out is None else out.unionByName(rows)
    return local_frame(df.sparkSession, [], QUANTILE_FIELDS) if out is None else out


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Exact interpolated quantiles of the numeric ``columns``: one row per
    column, in a local relation (``q`` is null for a column without values)."""
    cols = list(columns)
    found = interpolated(df, [f"CAST({normalized_sql(df, c)} AS DOUBLE)" for c in cols], [float(p) for p in probs])
    rows = [(df.columns.index(c), c, n, q) for c, (n, q) in zip(cols, found)]
    return local_frame(df.sparkSession, rows, QUANTILE_FIELDS)
