"""Records of CSV files whose quoted fields hold line breaks, read in splits.

Whether a split begins inside a quoted field depends on all text before it.
Each split therefore reports, in one pass over its lines, the state it ends in
for either state it may begin in (outside or inside quotes); composing these
in file order tells every split its first state (one pair of bits a split goes
through the driver).  A second pass joins the lines of a record.  What a split
holds of records that cross its ends comes out as fragments, a few a split,
which are put together by the record they belong to.  No file is read by one
task, and no text but the fragments is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablelens.session import materialize


def ends_inside(line: str, inside: bool, sep: str = ",") -> bool:
    """Whether the text after ``line`` is inside a quoted field.  A quote opens
    a field only at its start; inside, two quotes stand for one."""
    if '"' not in line:
        return inside
    at, n = 0, len(line)
    while True:
        if inside:
            at = line.find('"', at)
            if at < 0:
                return True
            if line.startswith('"', at + 1):
                at += 2
                continue
            inside = False
        elif line.startswith('"', at):
            inside = True
            at += 1
            continue
        at = line.find(sep, at)
        if at < 0:
            return False
        at += 1
        if at >= n:
            return False


def _lines(spark: SparkSession, path) -> DataFrame:
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
                       F.coalesce("value", F.lit("")).alias("value"))


def _runs(batch: pa.RecordBatch):
    """(file, split, lines) for the runs of one split's lines in a batch."""
    files, splits = batch.column("file").to_pylist(), batch.column("split").to_pylist()
    values = batch.column("value").to_pylist()
    start = 0
    for i in range(1, len(values) + 1):
        if i == len(values) or (files[i], splits[i]) != (files[start], splits[start]):
            yield files[start], splits[start], values[start:i]
            start = i


def first_states(spark: SparkSession, path, sep: str = ",") -> set[tuple[int, int]]:
    """The (file, split) pairs that begin inside a quoted field."""
    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends: dict[tuple, list[bool]] = {}
        for batch in batches:
            for file, split, lines in _runs(batch):
                state = ends.setdefault((file, split), [False, True])
                for line in lines:
                    if '"' in line:
                        state[:] = [ends_inside(line, s, sep) for s in state]
        if ends:
            yield pa.record_batch([pa.array([k[0] for k in ends]), pa.array([k[1] for k in ends]),
                                   pa.array([v[0] for v in ends.values()]), pa.array([v[1] for v in ends.values()])],
                                  names=["file", "split", "after_out", "after_in"])

    rows = _lines(spark, path).mapInArrow(states, "file long, split long, after_out boolean, after_in boolean").collect()
    begins, inside, last = set(), False, None
    for r in sorted(rows):  # a row a split
        inside = inside if r["file"] == last else False
        last = r["file"]
        if inside:
            begins.add((r["file"], r["split"]))
        inside = r["after_in"] if inside else r["after_out"]
    return begins


def records(spark: SparkSession, path, sep: str = ",") -> DataFrame:
    """(value): every record of the files as one text, but for each file's
    first (the header) and empty ones."""
    begins = first_states(spark, path, sep)
    names = ["file", "split", "part", "value"]

    def join_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # part: 0 a whole record, 1 the end of an earlier split's, 2 the start
        # of one that goes on, 3 neither end in this split; -2 as 2, of the header
        key, held, inside, head, first = None, [], False, False, False

        def part_of(whole: bool) -> int:
            if whole:
                return 1 if head else 0
            return 3 if head else (-2 if first else 2)

        for batch in batches:
            out = []
            for file, split, lines in _runs(batch):
                if (file, split) != key:
                    if held:
                        out.append((*key, part_of(False), "\n".join(held)))
                    key, held = (file, split), []
                    inside = head = key in begins
                    first = split == 0
                for line in lines:
                    inside = ends_inside(line, inside, sep)
                    held.append(line)
                    if inside:
                        continue
                    if not (first and not head):  # else the header
                        out.append((*key, part_of(True), "\n".join(held)))
                    held, head, first = [], False, False
            yield pa.record_batch([pa.array(c, t) for c, t in zip(
                zip(*out) if out else [[]] * 4, (pa.int64(), pa.int64(), pa.int32(), pa.string()))], names=names)
        if held:
            yield pa.record_batch([pa.array([x], t) for x, t in zip(
                (*key, part_of(False), "\n".join(held)), (pa.int64(), pa.int64(), pa.int32(), pa.string()))], names=names)

    parts = _lines(spark, path).mapInArrow(join_lines, "file long, split long, part int, value string")
    cut = materialize(parts.where("part <> 0"))  # a few a split
    in_file = Window.partitionBy("file").orderBy("split", F.abs("part") == 2)
    chain = F.sum((F.abs("part") == 2).cast("int")).over(in_file)
    joined = (cut.withColumn("chain", chain).groupBy("file", "chain")
              .agg(F.array_sort(F.collect_list(F.struct("split", (F.abs("part") == 2).alias("starts"), "part", "value"))).alias("held")))
    joined = joined.where(~F.exists("held", lambda h: h["part"] == -2)).select(
        F.array_join(F.transform("held", lambda h: h["value"]), "\n").alias("value"))
    whole = parts.where("part = 0").select("value").unionByName(joined)
    return whole.select(F.regexp_replace("value", "\r$", "").alias("value")).where("value <> ''")


def field_count(record, sep: str = ","):
    """Fields of a record: separators outside quoted fields, and one."""
    bare = F.when(F.contains(record, F.lit('"')), F.regexp_replace(record, '"[^"]*"', "")).otherwise(record)
    return F.char_length(bare) - F.char_length(F.translate(bare, sep, "")) + 1
