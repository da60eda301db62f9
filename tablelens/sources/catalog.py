"""Catalog, lake tables and sinks.

Tables are registered as temporary views (interactive use) or as catalog
tables over stored files (lake use).  Writers always replace whole tables, so
a clean run never leaves an old report behind: a stored table is a folder of
versions (``data/<version>``) and a list of the complete ones (``versions``),
to which a writer adds its own last.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.session import local_frame, remove_paths
from tablelens.functions.columns import qcol


def safe_table_name(name: str) -> str:
    """``-`` and spaces become ``_``; lower-cased."""
    return name.replace("-", "_").replace(" ", "_").lower()


def register(df: DataFrame, name: str) -> str:
    """Register ``df`` under its cleaned name, replacing any old one."""
    safe = safe_table_name(name)
    df.createOrReplaceTempView(safe)
    return safe


def register_all(tables: Mapping[str, DataFrame]) -> list[str]:
    return [register(df, name) for name, df in tables.items()]


def list_tables(spark: SparkSession, database: str | None = None, names: Iterable[str] | None = None) -> DataFrame:
    """Tables with their row counts, in alphabetical order (S10, S17); with
    ``names`` only these.  One count per table, as one plan."""
    found = sorted((t.name, t.isTemporary) for t in spark.catalog.listTables(database))
    if names is not None:
        found = [f for f in found if f[0] in set(names)]
    parts = [spark.table(n if temporary or database is None else f"{database}.{n}").agg(F.count(F.lit(1)).alias("rows"))
             .select(F.lit(n).alias("name"), F.lit(temporary).alias("is_temporary"), "rows") for n, temporary in found]
    if not parts:
        return local_frame(spark, [], "name string, is_temporary boolean, rows bigint")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("name")


def catalog_digest(spark: SparkSession, names: list[str] | None = None, n: int = 3,
                   order_by: Mapping[str, list[str]] | None = None) -> DataFrame:
    """Per table and column: position, type and up to ``n`` sample values.

    The samples come from ``limit(n)`` of each table: a few rows per table,
    whatever the table size.  Nulls are samples too, so the samples of one row
    have one place in every column.  ``order_by`` gives key columns of some
    tables: their samples are the first rows by these, in that order.
    """
    names = names if names is not None else sorted(t.name for t in spark.catalog.listTables())
    parts = []
    for t in names:
        df = table(spark, t)
        keys = [qcol(k) for k in (order_by or {}).get(t, [])]
        sample = (df.orderBy(*keys) if keys else df).limit(int(n))
        fields = df.schema.fields
        place = F.struct(*[k.alias(f"k{j}") for j, k in enumerate(keys)]) if keys else F.lit(0)
        agg = sample.agg(*[F.transform(
            F.array_sort(F.collect_list(F.struct(place.alias("k"), qcol(f.name).cast("string").alias("v")))) if keys
            else F.collect_list(F.struct(qcol(f.name).cast("string").alias("v"))), lambda r: r["v"]).alias(f"s{i}")
            for i, f in enumerate(fields)])
        parts.append(
            agg.select(
                F.inline(
                    F.array(
                        *[
                            F.struct(
                                F.lit(t).alias("table"), F.lit(i).alias("position"),
                                F.lit(f.name).alias("column"),
                                F.lit(f.dataType.simpleString()).alias("type"),
                                F.col(f"s{i}").alias("samples"),
                            )
                            for i, f in enumerate(fields)
                        ]
                    )
                )
            )
        )
    if not parts:
        return local_frame(spark, [], "table string, position int, column string, type string, samples array<string>")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def sample_rows(df: DataFrame, n: int = 5) -> DataFrame:
    """First ``n`` rows, any order."""
    return df.limit(int(n))


def table(spark: SparkSession, name: str) -> DataFrame:
    """A registered table, lazily."""
    return spark.table(name)


def row_count(df: DataFrame) -> int:
    """``COUNT(*)``."""
    return df.count()


def ensure_database(spark: SparkSession, name: str) -> None:
    """``CREATE DATABASE IF NOT EXISTS``."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}`")


def ensure_table(spark: SparkSession, database: str, name: str, path: str, fmt: str = "parquet") -> None:
    """Point a catalog name at stored files, idempotently."""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS `{database}`.`{name}` USING {fmt} LOCATION '{path}'"
    )


def lake_path(base: str, name: str) -> str:
    return f"{base.rstrip('/')}/{name}"


def _versions(spark: SparkSession, path: str) -> list[str]:
    """Names of a stored table's complete versions, oldest first."""
    try:
        return sorted(r["value"] for r in spark.read.text(f"{path}/versions").collect())  # a row a version
    except AnalysisException:
        return []


def _write_version(df: DataFrame, path: str, fmt: str, save) -> str:
    """Write a new version below ``path``; it counts once its name is listed,
    which is the last thing written.  Returns the version's folder."""
    version = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    save(df.write.format(fmt).mode("overwrite"), f"{path}/data/{version}")
    local_frame(df.sparkSession, [(version,)], "value string").coalesce(1).write.mode("append").text(f"{path}/versions")
    return f"{path}/data/{version}"


def write_lake(df: DataFrame, base: str, name: str, fmt: str = "parquet",
               partition_by: list[str] | None = None) -> str:
    """Full replace of a stored table (S18), in a new version folder.  Readers
    see the old rows until the new ones are complete, and go on seeing them if
    writing fails midway; ``drop_old_versions`` removes them later."""
    return _write_version(df, lake_path(base, name), fmt,
                          lambda w, at: (w.partitionBy(*partition_by) if partition_by else w).save(at))


def read_lake(spark: SparkSession, base: str, name: str, fmt: str = "parquet") -> DataFrame:
    """Load a stored table (S6), its last complete version; a table that was
    written elsewhere, without versions, is read as it is.  ``fmt='delta'`` if
    that reader is installed."""
    path = lake_path(base, name)
    versions = _versions(spark, path)
    return spark.read.format(fmt).load(f"{path}/data/{versions[-1]}" if versions else path)


def drop_old_versions(spark: SparkSession, base: str, name: str, keep_seconds: float = 86_400) -> list[str]:
    """Remove the versions that were replaced more than ``keep_seconds`` ago;
    returns their names.  Longer than the longest query is a safe keep time."""
    path = lake_path(base, name)
    versions = _versions(spark, path)
    limit = time.time_ns() - int(keep_seconds * 1e9)
    gone = [v for v, after in zip(versions, versions[1:]) if int(after.split("-")[0]) <= limit]
    remove_paths(spark, [f"{path}/data/{v}" for v in gone])
    return gone


def save_report(df: DataFrame, base: str, name: str, fmt: str = "parquet") -> str:
    """Persist a query result or anomaly report (S19, D8).  Always written,
    even when empty, so an old report cannot survive a clean run."""
    return write_lake(df, base, name, fmt)


def ingest(spark: SparkSession, tables: Mapping[str, DataFrame], base: str, database: str,
           fmt: str = "parquet", buckets: Mapping[str, tuple[int, list[str]]] | None = None) -> list[str]:
    """Write every table, create the database and a catalog table per
    written table; returns the catalog names.

    A table that is in the catalog with the same columns is switched to its new
    version by one change of location, so it is never missing or half written.
    ``buckets`` gives a number of buckets and key columns per table: its rows
    are stored by the keys' hash and sorted, so that joins and aggregates on
    the keys of tables with equally many buckets need no exchange.
    """
    ensure_database(spark, database)
    out = []
    for name, df in tables.items():
        safe = safe_table_name(name)
        many, keys = (buckets or {}).get(name, (0, []))
        full, fresh = f"`{database}`.`{safe}`", f"`{database}`.`{safe}__{uuid.uuid4().hex[:8]}`"
        if many:
            path = _write_version(df, lake_path(base, safe), fmt, lambda w, at: (
                w.bucketBy(many, *keys).sortBy(*keys).option("path", at).saveAsTable(fresh.replace("`", ""))))
        else:
            path = write_lake(df, base, safe, fmt)
            spark.sql(f"CREATE TABLE {fresh} USING {fmt} LOCATION '{path}'")
        if _same_layout(spark, full, fresh):
            spark.sql(f"ALTER TABLE {full} SET LOCATION '{path}'")
            spark.sql(f"REFRESH TABLE {full}")
            spark.sql(f"DROP TABLE {fresh}")  # an external table: its files stay
        else:
            spark.sql(f"DROP TABLE IF EXISTS {full}")
            spark.sql(f"ALTER TABLE {fresh} RENAME TO {full}")
        out.append(f"{database}.{safe}")
    return out


def _same_layout(spark: SparkSession, one: str, other: str) -> bool:
    """Whether two catalog tables exist with the same columns and buckets."""
    if not spark.catalog.tableExists(one.replace("`", "")):
        return False

    def layout(table):
        rows = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").collect()  # a row a column
        own = ("Num Buckets", "Bucket Columns", "Sort Columns", "Provider")
        return [f.simpleString() for f in spark.table(table).schema], sorted(
            (r["col_name"], r["data_type"]) for r in rows if r["col_name"] in own)

    return layout(one) == layout(other)
