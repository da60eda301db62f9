"""Generic relational building blocks (joins, aggregates, windows, sorts).

All of these are compositions of DataFrame operators.  Two scale rules apply
throughout:

* a "whole result" aggregate (share of total) is a distributed global
  aggregate attached as a scalar subquery, never a whole-frame window;
* ranking windows are always partitioned by a key, and top-k uses
  ``orderBy().limit()`` which Spark plans as a per-partition top-k plus a
  merge (TakeOrderedAndProject) instead of a full sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablelens.functions.columns import qcol


def _cols(names: Sequence[str] | str) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def share_of_total(
    df: DataFrame,
    measure: str,
    alias: str = "share_pct",
    digits: int = 2,
) -> DataFrame:
    """Add ``round(measure / sum(measure) * 100, digits)``.

    The total is a distributed global aggregate attached as a scalar subquery,
    so no row moves to a single task whatever the number of groups.  The input
    is evaluated twice; write it first (``materialize``) if it is costly.
    """
    total = df.agg(F.sum(qcol(measure)).alias("__total")).scalar()
    return df.withColumn(
        alias, F.round(F.try_divide(qcol(measure), total) * F.lit(100.0), digits)
    )


def top_k(df: DataFrame, order: Sequence[Column] | Column, k: int) -> DataFrame:
    """First ``k`` rows by ``order`` (O6); put the key last as tie-break."""
    order = [order] if isinstance(order, Column) else list(order)
    return df.orderBy(*order).limit(int(k))


def keep_first(df: DataFrame, key: Sequence[str] | str, order: Sequence[Column] | Column) -> DataFrame:
    """Keep the first row of each ``key`` group by ``order``."""
    order = [order] if isinstance(order, Column) else list(order)
    w = Window.partitionBy(*[qcol(k) for k in _cols(key)]).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") == 1).drop("__rn")


def with_group_total(
    df: DataFrame,
    items: DataFrame,
    key: str,
    measure: str,
    alias: str = "total_amount",
    items_key: str | None = None,
    digits: int | None = 2,
) -> DataFrame:
    """``df`` left-joined to per-key totals of ``items``.

    The items are aggregated to one row per key *before* the join, so the join
    moves one row per key instead of every item; keys without items get null.
    """
    ik = items_key or key
    total = F.sum(qcol(measure))
    if digits is not None:
        total = F.round(total, digits)
    totals = items.groupBy(qcol(ik).alias(key)).agg(total.alias(alias))
    return df.join(totals, on=key, how="left")


def group_summary(
    df: DataFrame,
    key: str,
    count_alias: str = "headcount",
    floor_mean: dict[str, str] | None = None,
    round_mean: dict[str, str] | None = None,
    digits: int = 2,
) -> DataFrame:
    """Per-group headcount, truncated means and rounded means.

    ``floor_mean`` / ``round_mean`` map output alias -> input column.
    """
    aggs = [F.count(F.lit(1)).alias(count_alias)]
    for alias, c in (floor_mean or {}).items():
        aggs.append(F.floor(F.avg(qcol(c))).cast("long").alias(alias))
    for alias, c in (round_mean or {}).items():
        aggs.append(F.round(F.avg(qcol(c)), digits).alias(alias))
    return df.groupBy(qcol(key)).agg(*aggs)


def union_reports(*frames: DataFrame) -> DataFrame:
    """Concatenate result frames by column name."""
    frames = [f for f in frames if f is not None]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def skew_safe_left_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """``left LEFT JOIN right ON left_key = right_key``, robust to a hot key
    on the right side.

    AQE can split a skewed partition only on the preserved side of an outer
    join, so a right-side key holding a third of all rows would land in one
    task.  The same result is built as the inner join (both sides
    splittable) plus the left rows without a match, found by an anti join
    against the right side's distinct keys (pre-aggregated map-side, so the
    hot key becomes one row).  Right columns of unmatched rows are null.
    """
    inner = left.join(right, qcol(left_key) == qcol(right_key), "inner")
    keys = right.select(qcol(right_key).alias("__rk")).distinct()
    unmatched = left.join(keys, qcol(left_key) == F.col("__rk"), "left_anti")
    for f in right.schema.fields:
        if f.name not in unmatched.columns:
            unmatched = unmatched.withColumn(f.name, F.lit(None).cast(f.dataType))
    return inner.unionByName(unmatched.select(*inner.columns))
