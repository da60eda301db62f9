"""Schema drift between two versions or batches of a table."""

from __future__ import annotations

from tablelens.session import local_frame
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DRIFT_FIELDS = "change string, column string"
DRIFT_TYPED_FIELDS = "change string, column string, old_type string, new_type string"


def schema_frame(spark: SparkSession, schema: T.StructType | DataFrame) -> DataFrame:
    """One row ``(position, column, type)`` per field of a schema."""
    st = schema.schema if isinstance(schema, DataFrame) else schema
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(st.fields)]
    return local_frame(spark, rows, "position int, column string, type string")


def schema_drift(old: T.StructType | DataFrame, new: T.StructType | DataFrame,
                 spark: SparkSession | None = None, with_types: bool = False) -> DataFrame:
    """Columns ``added`` to / ``removed`` from ``new`` relative to ``old``.

    The two schemas become small ``(column)`` frames and are compared with
    anti joins both ways.  ``with_types=True`` also reports columns present
    in both whose type changed (``type_changed``).
    """
    spark = spark or (old.sparkSession if isinstance(old, DataFrame) else
                      new.sparkSession if isinstance(new, DataFrame) else
                      SparkSession.getActiveSession())
    a = schema_frame(spark, old)
    b = schema_frame(spark, new)
    added = b.join(a.select("column"), "column", "left_anti").select(
        F.lit("added").alias("change"), "column", F.lit(None).cast("string").alias("old_type"),
        F.col("type").alias("new_type"), F.col("position"))
    removed = a.join(b.select("column"), "column", "left_anti").select(
        F.lit("removed").alias("change"), "column", F.col("type").alias("old_type"),
        F.lit(None).cast("string").alias("new_type"), F.col("position"))
    parts = added.unionByName(removed)
    if with_types:
        changed = a.alias("a").join(b.alias("b"), "column").filter(F.col("a.type") != F.col("b.type")).select(
            F.lit("type_changed").alias("change"), "column", F.col("a.type").alias("old_type"),
            F.col("b.type").alias("new_type"), F.col("b.position").alias("position"))
        parts = parts.unionByName(changed)
        return parts.orderBy("change", "position").select("change", "column", "old_type", "new_type")
    return parts.orderBy("change", "position").select("change", "column")


def batch_drift(spark: SparkSession, batches: list[tuple[str, DataFrame]], with_types: bool = False) -> DataFrame:
    """Drift between consecutive batches ``[(label, frame), ...]``.

    Rows ``(from_batch, to_batch, change, column[, old_type, new_type])``;
    only schemas are compared (metadata, no data is read).
    """
    fields = DRIFT_TYPED_FIELDS if with_types else DRIFT_FIELDS
    parts = []
    for (a_name, a), (b_name, b) in zip(batches, batches[1:]):
        d = schema_drift(a, b, spark, with_types)
        parts.append(d.select(F.lit(a_name).alias("from_batch"), F.lit(b_name).alias("to_batch"), "*"))
    if not parts:
        return local_frame(spark, [], "from_batch string, to_batch string, " + fields)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_batches(spark: SparkSession, paths: list[str], fmt: str = "parquet") -> list[tuple[str, DataFrame]]:
    """Each stored batch folder as ``(folder name, lazy frame)``."""
    import os

    return [(os.path.basename(p.rstrip("/")), spark.read.format(fmt).load(p)) for p in paths]
