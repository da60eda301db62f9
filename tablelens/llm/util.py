"""Helpers shared by the operators of this subpackage.

Everything here is either a Column expression, a two-level (never
one-task-per-key) ranking or running total, or numpy code over one Arrow
batch inside a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablelens.session import materialize

__all__ = ["materialize", "read", "words_of", "word_count", "global_rank", "hash_sample", "row_names", "slices", "utf8",
           "connected_components", "WS"]

# The white space that separates words (space, \x09 to \x0D).
WS = " \t\n\x0b\x0c\r"
WS_RE = "[ \\x09-\\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def words_of(text: Column) -> Column:
    """Array of the words of a text (empty for null, empty or blank texts)."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, WS_RE, -1))


def word_count(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add ``name``: the 0-based position of each row in the whole order.

    Rows are dealt by range, ranked inside each range partition, and shifted
    by the counts of the partitions before it; no task sees all rows.
    """
    parts = df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    parts = materialize(parts)
    w = Window.partitionBy("__part").orderBy(*order)
    counts = parts.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return (parts.withColumn("__r", F.row_number().over(w) - 1)
            .join(offsets, "__part")
            .withColumn(name, (F.col("__r") + F.col("__before")).cast("long"))
            .drop("__r", "__before", "__part"))


def hash_sample(df: DataFrame, columns: list[str], n: int) -> DataFrame:
    """At most ``n`` rows, those of least hash of ``columns``.  A threshold on
    the hash leaves about 1.5 n rows before they are sorted, so what meets in
    one place does not grow with the table or its number of tasks."""
    total = df.count()
    u = F.shiftrightunsigned(F.xxhash64(*columns), 32)
    if total > 2 * n:
        df = df.where(u < int(1.5 * n / total * (1 << 32)))
    return df.orderBy(u, *columns).limit(n)


def row_names(table: DataFrame, name: str = "rid") -> DataFrame:
    """Add ``name``, a number of every row of a table read from files, the same
    in every job whatever splits the files are read in: the hash of its file
    plus its place in the file.  The files' hashes are checked to lie further
    apart than a file has rows."""
    path = F.col("_metadata.file_path")
    for salt in range(64):
        starts = sorted(r[0] for r in table.select(F.xxhash64(path, F.lit(salt))).distinct().collect())  # a row a file
        if all(b - a >= 1 << 28 for a, b in zip(starts, starts[1:])) and (not starts or starts[-1] < (1 << 63) - (1 << 28)):
            return table.withColumn(name, F.xxhash64(path, F.lit(salt)) + F.col("_metadata.row_index"))
    raise RuntimeError("files cannot be told apart")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of an Arrow string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    off = off.astype(np.int64)
    if data is None or len(off) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0]:off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``max_bytes`` of text; every row
    is kept whole, so a longer text makes a slice of its own."""
    _, off = utf8(batch.column(batch.schema.get_field_index(column)))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(off, off[start] + max_bytes, side="right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end
    pa.default_memory_pool().release_unused()  # earlier batches: a worker outlives its task


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, component): the smallest node reachable over ``edges`` (a, b: long).

    Large-star / small-star rounds; each round is two grouped minima with
    map-side combining, joined back (adaptive execution splits hot nodes), and
    its links are written below the checkpoint folder.  Nodes without an edge
    are not listed.  Repeated links stay until the end of a round, which never
    has more than twice its input.  Rounds stop when the links no longer change.
    """
    links = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    links = materialize(links.where("a <> b"))
    last = None
    for _ in range(max_rounds):
        # large star: every larger neighbour of a node links to the node's smallest neighbour
        both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (both.join(low, "a").where("b > a")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b"))
        # small star: every smaller neighbour (and the node) links to the smallest
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        links = materialize(small)
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    else:
        raise RuntimeError("components did not settle")
    tops = links.select(F.col("b").alias("node")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        tops.select("node", F.col("node").alias("component")))
