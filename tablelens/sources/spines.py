"""Calendar spines and deterministic samples.

Spines are generated from a one-row frame of bounds with ``sequence`` +
``explode``: their size is the number of days in the range, independent of
the data volume.  Bounds usually come from the data itself (min / max of a
date column), so the spine stays a Spark plan end to end.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.operators.selection import smallest
from tablelens.functions.columns import qcol


def _lit_or_col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def date_spine(bounds: DataFrame, start: str = "start", end: str = "end", name: str = "day") -> DataFrame:
    """One row per calendar day from ``start`` to ``end`` (both included), for
    each row of ``bounds`` (a frame holding the two dates)."""
    return bounds.select(
        F.explode(
            F.sequence(qcol(start).cast("date"), qcol(end).cast("date"), F.expr("interval 1 day"))
        ).alias(name)
    )


def date_spine_between(spark: SparkSession, start, end, name: str = "day") -> DataFrame:
    """``date_spine`` over literal or Column bounds."""
    b = spark.range(1).select(_lit_or_col(start).cast("date").alias("start"),
                              _lit_or_col(end).cast("date").alias("end"))
    return date_spine(b, name=name)


def timestamp_spine(spark: SparkSession, start, end, periods: int, name: str = "ts") -> DataFrame:
    """``periods`` evenly spaced timestamps including both ends (linear
    interpolation over ``spark.range``)."""
    s = _lit_or_col(start).cast("timestamp")
    e = _lit_or_col(end).cast("timestamp")
    n = int(periods)
    step = (F.unix_micros(e) - F.unix_micros(s)) / F.lit(max(n - 1, 1))
    return spark.range(n).select(
        F.timestamp_micros((F.unix_micros(s) + F.round(F.col("id") * step)).cast("long")).alias(name)
    )


def business_days(bounds: DataFrame, start: str = "start", end: str = "end", name: str = "day") -> DataFrame:
    """Monday to Friday of the spine (no holiday calendar)."""
    return date_spine(bounds, start, end, name).filter(F.weekday(qcol(name)) < 5)


def data_bounds(df: DataFrame, column: str) -> DataFrame:
    """One row ``(start, end)`` with the min and max date of ``column``."""
    c = qcol(column).cast("date")
    return df.agg(F.min(c).alias("start"), F.max(c).alias("end"))


def sample_n(df: DataFrame, keys: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement, reproducible for a seed.

    Rows are ordered by a seeded 64-bit hash of the keys as text, and the rank
    threshold of the ``n``-th is found by radix selection, so the sample is a
    filter: no task holds it, however large.  It comes in the order of the hash
    (sorted by ranges).
    """
    text = F.concat_ws("|", F.lit(str(int(seed))), *[qcol(k).cast("string") for k in keys])
    h = F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")
    return smallest(df.withColumn("__h", h), "__h", int(n)).orderBy("__h", *[qcol(k) for k in keys]).drop("__h")
