"""Whole rows by hash: counts, null cells and duplicates of a table.

Rows are counted by a 128-bit hash, and the aggregate's buffer carries the
rows' null cells along, so a row moves as 32 bytes.  Only rows whose hash
repeats are then grouped by all their columns, which makes the number of
duplicates exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.functions.columns import qcol
from tablelens.operators.stats import groupable_columns
from tablelens.session import materialize


def hash_input(field: T.StructField) -> Column:
    """A column as input of the hash functions: nested values as their JSON
    text, since those functions skip nulls inside arrays and structs."""
    if isinstance(field.dataType, (T.ArrayType, T.StructType)):
        return F.to_json(F.struct(qcol(field.name).alias("v")), {"ignoreNullFields": "false"})
    return qcol(field.name)


def with_row_hashes(df: DataFrame) -> DataFrame:
    """Groupable columns of ``df``, two independent 64-bit hashes of the row
    (the null pattern goes along) and its number of null cells."""
    flat = df.select(*groupable_columns(df))
    keys = [hash_input(f) for f in flat.schema.fields]
    mask = F.array(*[qcol(c).isNull() for c in flat.columns])
    nulls = sum((qcol(c).isNull().cast("long") for c in flat.columns), F.lit(0).cast("long"))
    return flat.withColumns({"__h1": F.xxhash64(mask, *keys), "__h2": F.xxhash64(F.lit(1), *keys[::-1], mask),
                             "__nulls": nulls})


def row_summary(df: DataFrame) -> DataFrame:
    """One row ``(rows, null_cells, duplicate_rows)``; nulls (and NaNs) compare equal."""
    full = with_row_hashes(df)
    hashed = full.groupBy("__h1", "__h2").agg(F.count(F.lit(1)).alias("__n"), F.sum("__nulls").alias("__nulls"))
    # one row for all unique hashes together, one for every repeated hash
    hashed = materialize(hashed.groupBy(F.when(F.col("__n") > 1, F.struct("__h1", "__h2")).alias("__h"))
                         .agg(F.sum("__n").alias("__n"), F.sum("__nulls").alias("__nulls")))
    again = hashed.where("__h is not null").select("__h.*")
    keys = [qcol(c) for c in full.columns if c not in ("__h1", "__h2", "__nulls")]
    groups = full.join(again, ["__h1", "__h2"], "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    zero = F.lit(0).cast("long")
    names = ("rows", "null_cells", "duplicate_rows")
    parts = hashed.select(F.col("__n").alias("rows"), F.col("__nulls").alias("null_cells"), zero.alias("duplicate_rows")).union(
        groups.select(zero, zero, F.col("__n") - 1))
    return parts.agg(*[F.coalesce(F.sum(c), zero).cast("long").alias(c) for c in names])
