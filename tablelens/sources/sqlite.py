"""SQLite source as a Python data source.

The driver only reads metadata (table list, column declarations, rowid
bounds); rows are read on executors, one input partition per (file, rowid
range), so a large table is read by many tasks.  Files must sit on storage
every executor can read.  ``write_sqlite`` writes one database file per
Spark partition.
"""

from __future__ import annotations

import glob
import json
import os
import sqlite3

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import (
    BinaryType,
    DoubleType,
    LongType,
    StringType,
    StructField,
    StructType,
)

SOURCE_NAME = "tablelens_sqlite"
ROWS_PER_PARTITION = 1_000_000


def _connect(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def _q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def list_sqlite_tables(path: str) -> list[str]:
    with _connect(path) as con:
        rows = con.execute("SELECT name FROM sqlite_master WHERE type = 'table' ORDER BY rowid").fetchall()
    return [r[0] for r in rows if not r[0].startswith("sqlite_")]


def _spark_type(decl: str):
    """SQLite type affinity rules mapped to Spark types."""
    d = (decl or "").upper()
    if "INT" in d:
        return LongType()
    if any(k in d for k in ("CHAR", "CLOB", "TEXT")):
        return StringType()
    if "BLOB" in d or d == "":
        return BinaryType() if "BLOB" in d else StringType()
    if any(k in d for k in ("REAL", "FLOA", "DOUB")):
        return DoubleType()
    return DoubleType()  # NUMERIC affinity


def table_schema(path: str, table: str) -> StructType:
    with _connect(path) as con:
        cols = con.execute(f"PRAGMA table_info({_q(table)})").fetchall()
    return StructType([StructField(c[1], _spark_type(c[2]), True) for c in cols])


class _RangePartition(InputPartition):
    def __init__(self, path: str, lo: int, hi: int):
        super().__init__((path, lo, hi))
        self.path, self.lo, self.hi = path, lo, hi


class SqliteDataSource(DataSource):
    """Options: ``paths`` (JSON list of files), ``table``,
    ``rows_per_partition``."""

    @classmethod
    def name(cls) -> str:
        return SOURCE_NAME

    def schema(self) -> StructType:
        paths = json.loads(self.options["paths"])
        return table_schema(paths[0], self.options["table"])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _SqliteReader(json.loads(self.options["paths"]), self.options["table"], schema,
                             int(self.options.get("rows_per_partition", ROWS_PER_PARTITION)))


class _SqliteReader(DataSourceReader):
    def __init__(self, paths, table, schema, per_part):
        self.paths, self.table, self.schema, self.per_part = paths, table, schema, per_part

    def partitions(self):
        parts = []
        for p in self.paths:
            with _connect(p) as con:
                lo, hi = con.execute(f"SELECT min(rowid), max(rowid) FROM {_q(self.table)}").fetchone()
            if lo is None:
                continue
            start = lo
            while start <= hi:
                parts.append(_RangePartition(p, start, start + self.per_part - 1))
                start += self.per_part
        return parts or [_RangePartition(self.paths[0] if self.paths else "", 1, 0)]

    def read(self, partition):
        if partition.lo > partition.hi:
            return
        cols = ", ".join(_q(f.name) for f in self.schema.fields)
        conv = []
        for f in self.schema.fields:
            if isinstance(f.dataType, LongType):
                conv.append(lambda v: None if v is None else int(v))
            elif isinstance(f.dataType, DoubleType):
                conv.append(lambda v: None if v is None else float(v))
            elif isinstance(f.dataType, BinaryType):
                conv.append(lambda v: None if v is None else bytes(v))
            else:
                conv.append(lambda v: None if v is None else str(v))
        with _connect(partition.path) as con:
            cur = con.execute(
                f"SELECT {cols} FROM {_q(self.table)} WHERE rowid BETWEEN ? AND ? ORDER BY rowid",
                (partition.lo, partition.hi),
            )
            for row in cur:
                yield tuple(c(v) for c, v in zip(conv, row))


_REGISTERED: set[int] = set()


def _ensure_registered(spark: SparkSession) -> None:
    if id(spark) not in _REGISTERED:
        spark.dataSource.register(SqliteDataSource)
        _REGISTERED.add(id(spark))


def read_sqlite(spark: SparkSession, paths: str | list[str], table: str,
                rows_per_partition: int = ROWS_PER_PARTITION) -> DataFrame:
    """One table from one SQLite file, or the union of it over many files."""
    from tablelens.session import local_path

    files = sorted(glob.glob(local_path(paths))) if isinstance(paths, str) else [local_path(p) for p in paths]
    from tablelens.session import ship_package

    ship_package(spark)
    _ensure_registered(spark)
    return (
        spark.read.format(SOURCE_NAME)
        .option("paths", json.dumps(files))
        .option("table", table)
        .option("rows_per_partition", str(int(rows_per_partition)))
        .load()
    )


def read_sqlite_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Every table of a SQLite file, under its own name."""
    return {t: read_sqlite(spark, [path], t) for t in list_sqlite_tables(path)}


def _decl(dt) -> str:
    name = dt.simpleString()
    if name in ("tinyint", "smallint", "int", "bigint", "boolean"):
        return "INTEGER"
    if name in ("float", "double") or name.startswith("decimal"):
        return "REAL"
    if name == "binary":
        return "BLOB"
    return "TEXT"


def write_sqlite(df: DataFrame, out_dir: str, table: str) -> DataFrame:
    """Write each partition of ``df`` as its own SQLite file holding ``table``;
    returns a frame of the written paths (evaluate it to write)."""
    from tablelens.session import local_path

    out_dir = local_path(out_dir)
    import uuid

    from tablelens.session import ship_package

    ship_package(df.sparkSession)
    fields = df.schema.fields
    ddl = ", ".join(f"{_q(f.name)} {_decl(f.dataType)}" for f in fields)
    marks = ", ".join("?" for _ in fields)

    def write(it):
        import pandas as pd

        from pyspark import TaskContext

        path = tmp = None
        n = 0
        con = None
        for pdf in it:
            if con is None:
                # named by partition, built under a temporary name and renamed:
                # a retried task replaces its file instead of adding one
                os.makedirs(out_dir, exist_ok=True)
                path = os.path.join(out_dir, f"part-{TaskContext.get().partitionId():05d}.sqlite")
                tmp = f"{path}.{uuid.uuid4().hex}.tmp"
                con = sqlite3.connect(tmp)
                con.execute(f"CREATE TABLE {_q(table)} ({ddl})")
            rows = [
                tuple(None if (v is None or (isinstance(v, float) and v != v)) else
                      (str(v) if hasattr(v, "isoformat") else v) for v in r)
                for r in pdf.astype(object).itertuples(index=False, name=None)
            ]
            con.executemany(f"INSERT INTO {_q(table)} VALUES ({marks})", rows)
            n += len(rows)
        if con is not None:
            con.commit()
            con.close()
            os.replace(tmp, path)
            yield pd.DataFrame({"path": [path], "rows": [n]})

    return df.mapInPandas(write, "path string, rows bigint")
