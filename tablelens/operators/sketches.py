"""Stored quantile sketches of a table's parts (A9, D3 without a scan for quartiles).

A KLL sketch per part (a day, a load, a partition key's value) and numeric
column is kept as binary in a stored table.  New parts add rows, a part that was
loaded again replaces its rows, and quantiles of any set of parts come from
merging their sketches, so the table itself is not read again.

* Nulls and NaN are not values.  A column without values has ``n`` 0 and null
  quantiles; an empty table has no parts.  Rows whose part is null form one part.
* A hot part is aggregated in every task first: sketches move, never values.
* Merging goes through ``SKETCH_GROUPS`` groups of parts, so that no task merges
  the sketches of all parts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.functions.columns import normalized_sql, numeric_columns, sql_str
from tablelens.operators.quantiles import SKETCH_COLUMNS, SKETCH_GROUPS, SKETCH_K, rank_error
from tablelens.session import local_frame
from tablelens.sources.catalog import read_lake, write_lake

SKETCH_FIELDS = "part string, column string, pos int, n bigint, sketch binary"
# A quantile's rank is off by more than rank_error() in about one case of a
# hundred; twice that is more than five standard deviations.
ERROR_FACTOR = 2.0


def rank_margin(k: int = SKETCH_K) -> float:
    """Half width of the rank interval, as a share of the values."""
    return ERROR_FACTOR * rank_error(k)


def part_sketches(df: DataFrame, part: Column, columns: Sequence[str] | None = None, k: int = SKETCH_K) -> DataFrame:
    """One row per part and numeric column, with the fields of ``SKETCH_FIELDS``;
    ``SKETCH_COLUMNS`` columns an aggregate."""
    cols = list(columns) if columns is not None else numeric_columns(df)
    out = local_frame(df.sparkSession, [], SKETCH_FIELDS)
    for a in range(0, len(cols), SKETCH_COLUMNS):
        own = list(enumerate(cols))[a:a + SKETCH_COLUMNS]
        values = df.select(part.cast("string").alias("part"), *[
            F.expr(f"CAST({normalized_sql(df, c)} AS DOUBLE)").alias(f"c{i}") for i, c in own])
        wide = values.groupBy("part").agg(*[F.expr(
            f"named_struct('column', {sql_str(c)}, 'pos', {df.columns.index(c)}, 'n', count(c{i}), "
            f"'sketch', kll_sketch_agg_double(c{i}, {k}))").alias(f"s{i}") for i, c in own])
        out = out.unionByName(wide.select("part", F.inline(F.array(*[f"s{i}" for i, _ in own]))))
    return out


def store_sketches(spark: SparkSession, base: str, name: str, fresh: DataFrame) -> str:
    """Add part sketches to the stored table ``name``: its other parts stay,
    parts that are in ``fresh`` are replaced.  Readers see the old sketches
    until the new version is complete."""
    try:
        stored = read_lake(spark, base, name)
    except AnalysisException:  # nothing stored yet
        return write_lake(fresh, base, name)
    again = fresh.select(F.col("part").alias("__part")).distinct()
    kept = stored.join(again, F.col("part").eqNullSafe(F.col("__part")), "left_anti")
    return write_lake(kept.unionByName(fresh), base, name)


def merged_quantiles(sketches: DataFrame, probs: Sequence[float], k: int = SKETCH_K) -> DataFrame:
    """Quantiles over all given part sketches, one row per column: ``pos,
    column, parts, n, q`` and the ranks between which each true place lies
    (``rank_low``, ``rank_high``: at most ``rank_high`` values are smaller than
    the quantile, at least ``rank_low`` are not larger)."""
    group = F.pmod(F.xxhash64("part"), F.lit(SKETCH_GROUPS))
    merge = F.expr(f"kll_merge_agg_double(sketch, {k})").alias("sketch")
    total = lambda df, parts: df.agg(F.min("pos").alias("pos"), parts.alias("parts"), F.sum("n").alias("n"), merge)
    merged = total(total(sketches.groupBy("column", group.alias("g")), F.count("*")).groupBy("column"), F.sum("parts"))
    plist = ", ".join(f"{float(p)!r}D" for p in probs)
    margin = rank_margin(k)
    low = [F.greatest(F.lit(0.0), F.ceil((F.lit(float(p)) - margin) * F.col("n"))).cast("long") for p in probs]
    high = [F.least(F.col("n"), F.floor((F.lit(float(p)) + margin) * F.col("n"))).cast("long") for p in probs]
    return merged.select(
        "pos", "column", "parts", "n",
        F.expr(f"CASE WHEN n > 0 THEN kll_sketch_get_quantile_double(sketch, array({plist})) END").alias("q"),
        F.array(*low).alias("rank_low"), F.array(*high).alias("rank_high"))
