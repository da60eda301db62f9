"""Line dedup by a deletion-neighbourhood join.

Lines are compared by their words; the edit bound is one word (inserted,
deleted or replaced).  A line is dropped when an earlier line (by document
id, then line number) has the same words, or is within the bound and both
lines have at least ``min_words`` words.  Lines without a word are kept.

1. Every line's hash (two 64-bit words) is grouped: the earliest stays.
2. Two lines within the bound share their first or their last half exactly
   (of one of the two lengths that fit).  Lines that share no half with
   another line leave here; nothing else is lost.
3. The other lines emit the hash of every variant with one word deleted in
   the half that may differ.  Replacements meet at (variant, place); an
   insertion meets the whole shorter line.  Members of a group are therefore
   all within the bound, and a group's earliest member decides: groups are
   aggregated, never paired.
4. Each line and its earliest partner are verified word by word.

Defined cases: null and empty texts have no lines to drop; repeated rows are
separate documents (the first row keeps the lines, ties in document id go by
row order); an empty table gives no rows; long texts and long lines are
handled whole; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.llm.util import materialize, slices, utf8, words_of
from tablelens.llm.wordhash import BASE, BASE_2, powers, scramble, span, sums, words

MIN_WORDS = 6


def _lines(piece: pa.RecordBatch):
    """Word hashes with the first word of every line, and lines per text."""
    data, off = utf8(piece.column("text"))
    hashes, owner, before = words(data, off, line_breaks=True)
    total = int(before[-1])
    first = np.searchsorted(owner, np.arange(total + 1))
    return hashes, first, before


def _line_rows(min_words: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                hashes, first, before = _lines(piece)
                n = np.diff(first)
                some = np.flatnonzero(n)
                n, lo, hi = n[some], first[some], first[some + 1]
                one, two = sums(hashes, BASE), sums(hashes, BASE_2)
                text = np.searchsorted(before, some, side="right") - 1
                whole = scramble(span(one, lo, hi, BASE))
                long = n >= min_words
                cols = {"f1": whole, "f2": scramble(span(two, lo, hi, BASE_2)), "n": n}
                for name, size, front in (("p1", n // 2, True), ("p2", (n - 1) // 2, True),
                                          ("s1", n - n // 2, False), ("s2", n // 2, False)):
                    cut = span(one, lo, lo + size, BASE) if front else span(one, hi - size, hi, BASE)
                    key = scramble(cut + size.astype(np.uint64) * np.uint64(2) + np.uint64(front))
                    cols[name] = pa.array(key.view(np.int64), mask=~long)
                yield pa.record_batch(
                    [piece.column("doc_id").take(pa.array(text)), piece.column("rid").take(pa.array(text)),
                     pa.array((some - before[text]).astype(np.int32)),
                     *[pa.array(c.view(np.int64)) if isinstance(c, np.ndarray) and c.dtype == np.uint64 else
                       pa.array(c) for c in cols.values()]],
                    names=["doc_id", "rid", "line", *cols])
    return rows


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (v, place, f1, raw): place -1 is the whole line with its text, others
    a deleted word."""
    for batch in batches:
        for piece in slices(batch, "text"):
            hashes, first, before = _lines(piece)
            one = sums(hashes, BASE)
            text, line, f1, front, back, raw = [], [], [], [], [], []
            for i, (whole, found) in enumerate(zip(piece.column("text").to_pylist(),
                                                   piece.column("lines").to_pylist())):
                parts = whole.split("\n")
                for x in found:
                    raw.append(parts[x["line"]])
                    text.append(i)
                    line.append(x["line"])
                    f1.append(x["f1"])
                    front.append(x["front"])
                    back.append(x["back"])
            at = before[np.array(text, np.int64)] + np.array(line, np.int64)
            lo, hi = first[at], first[at + 1]
            n = hi - lo
            front, back = np.array(front, bool), np.array(back, bool)
            # a shared front half leaves the places after it, a shared back half those before it
            start = np.where(back, 0, (n - 1) // 2)
            stop = np.where(front, n, n - n // 2 + 1)
            count = np.maximum(stop - start, 0)
            which = np.repeat(np.arange(len(n)), count)
            place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + start[which]
            cut = lo[which] + place
            head = span(one, lo[which], cut, BASE)
            tail = span(one, cut + 1, hi[which], BASE)
            shift = powers(BASE, len(hashes) + 1)[0][place]
            v = scramble(head + tail * shift)
            f1 = np.array(f1, np.int64)
            yield pa.record_batch(
                [pa.array(np.concatenate((f1, v.view(np.int64)))),
                 pa.array(np.concatenate((np.full(len(f1), -1), place)).astype(np.int32)),
                 pa.array(np.concatenate((f1, f1[which]))), pa.array(raw + [None] * len(v), pa.string())],
                names=["v", "place", "f1", "raw"])


def line_drops(named: DataFrame, min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """(lines, near): every line with a word and its first occurrence; distinct
    lines dropped for an earlier near one.

    ``named`` has doc_id, text and rid.
    """
    fields = (T.StructType().add("doc_id", named.schema["doc_id"].dataType).add("rid", "long")
              .add("line", "integer").add("f1", "long").add("f2", "long").add("n", "long")
              .add("p1", "long").add("p2", "long").add("s1", "long").add("s2", "long"))
    source = named.select("doc_id", F.col("text").cast("string").alias("text"), "rid")
    lines = materialize(source.mapInArrow(_line_rows(min_words), fields))
    at = F.struct("doc_id", "rid", "line")
    distinct = materialize(lines.groupBy("f1", "f2").agg(
        F.min(at).alias("first"), F.count("*").alias("times"),
        *[F.min(c).alias(c) for c in ("n", "p1", "p2", "s1", "s2")]))

    halves = distinct.where("p1 is not null").select(
        "f1", F.explode(F.array_distinct(F.array("p1", "p2"))).alias("key"), F.lit(True).alias("front")).union(
        distinct.where("p1 is not null").select(
            "f1", F.explode(F.array_distinct(F.array("s1", "s2"))), F.lit(False)))
    shared = halves.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key")
    flagged = (halves.join(shared, "key", "left_semi").groupBy("f1")
               .agg(F.max("front").alias("front"), F.max(~F.col("front")).alias("back")))
    places = (distinct.select("f1", "first").join(flagged, "f1")
              .groupBy(F.col("first.rid").alias("rid"))
              .agg(F.collect_list(F.struct(F.col("first.line").alias("line"), "f1", "front", "back")).alias("lines")))
    variants = materialize(source.join(places, "rid").select("text", "lines").mapInArrow(
        _variants, "v long, place int, f1 long, raw string"))
    met = variants.groupBy("v").agg(F.count("*").alias("m")).where("m > 1").select("v")
    rows = materialize(variants.select("v", "place", "f1").join(met, "v", "left_semi")
                       .join(distinct.select("f1", "first"), "f1"))

    me = F.struct("first", "f1")
    by_place = rows.groupBy("v", "place").agg(F.min(me).alias("same"))
    by_key = rows.groupBy("v").agg(F.min(F.when(F.col("place") < 0, me)).alias("whole"),
                                   F.min(F.when(F.col("place") >= 0, me)).alias("cut"))
    partner = F.least(F.when(F.col("place") >= 0, F.col("same")),
                      F.when(F.col("place") >= 0, F.col("whole")),
                      F.when(F.col("place") < 0, F.col("cut")))
    near = (rows.join(by_place, ["v", "place"]).join(by_key, "v").withColumn("partner", partner)
            .where(F.col("partner.first") < F.col("first"))
            .groupBy("f1").agg(F.min("partner").alias("partner"), F.min("first").alias("first")))
    return lines, verified(near, variants.where("place < 0").select("f1", "raw"))


def words_apart(a, b):
    """Whether two word arrays are at most one edit apart: what remains after
    their common front and common back is at most one word on either side."""
    short = F.least(F.size(a), F.size(b))
    same = lambda x, y: F.coalesce(F.array_position(
        F.transform(F.arrays_zip(F.slice(x, 1, short).alias("x"), F.slice(y, 1, short).alias("y")),
                    lambda p: p["x"] == p["y"]), False), F.lit(0))
    front = F.when(same(a, b) == 0, short).otherwise(same(a, b) - 1)
    back = F.when(same(F.reverse(a), F.reverse(b)) == 0, short).otherwise(same(F.reverse(a), F.reverse(b)) - 1)
    longest = F.greatest(F.size(a), F.size(b))
    return (longest - F.least(front + back, short) <= 1) & (longest - short <= 1)


def verified(near: DataFrame, raw: DataFrame) -> DataFrame:
    """``near`` without pairs that only share a hash."""
    near = near.select("f1", "first", F.col("partner.f1").alias("p1"))
    need = near.select("f1").union(near.select("p1")).distinct()
    texts = materialize(raw.join(need, "f1", "left_semi").select("f1", words_of(F.col("raw")).alias("w")))
    pairs = (near.join(texts.withColumnRenamed("w", "mine"), "f1")
             .join(texts.select(F.col("f1").alias("p1"), F.col("w").alias("theirs")), "p1"))
    return pairs.where(words_apart(F.col("mine"), F.col("theirs"))).select("f1", "first")


def dropped_lines(named: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(rid, line, near): the dropped lines; near is false for repeated ones."""
    lines, near = line_drops(named, min_words)
    near = materialize(near)
    firsts = materialize(lines.groupBy("f1", "f2").agg(
        F.min(F.struct("doc_id", "rid", "line")).alias("first"), F.count("*").alias("m")).where("m > 1"))
    again = (lines.select("f1", "f2", "doc_id", "rid", "line").join(firsts, ["f1", "f2"])
             .where(F.struct("doc_id", "rid", "line") != F.col("first")).select("rid", "line"))
    return again.withColumn("near", F.lit(False)).union(
        near.select("first.rid", "first.line").withColumn("near", F.lit(True)))


def line_dedup(named: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per row of ``named`` (doc_id, text, rid): rid, doc_id, n_lines,
    n_repeated, n_near, dropped (line numbers from 0, ascending)."""
    drops = dropped_lines(named, min_words).groupBy("rid").agg(
        F.count(F.when(~F.col("near"), 1)).alias("n_repeated"), F.count(F.when(F.col("near"), 1)).alias("n_near"),
        F.sort_array(F.collect_list("line")).alias("dropped"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1)))
    return named.select("rid", "doc_id", n_lines.cast("long").alias("n_lines")).join(drops, "rid", "left").select(
        "rid", "doc_id", "n_lines", F.coalesce("n_repeated", F.lit(0)).alias("n_repeated"),
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"))


def without_repeated_lines(docs: DataFrame, id_col="doc_id", text_col="text", length_col: str | None = "n_chars",
                           min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the dropped lines taken out of their texts."""
    columns = docs.columns
    kept = materialize(docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)])
                       .withColumn("rid", F.monotonically_increasing_id()))
    col = lambda c: F.col(f"c{columns.index(c)}")
    named = kept.select(col(id_col).alias("doc_id"), col(text_col).alias("text"), "rid")
    drops = dropped_lines(named, min_words).groupBy("rid").agg(F.collect_set("line").alias("__drop"))
    out = kept.join(drops, "rid", "left")
    left = F.array_join(F.filter(
        F.transform(F.split(col(text_col), "\n", -1),
                    lambda x, i: F.when(~F.array_contains("__drop", i), x)), lambda x: x.isNotNull()), "\n")
    text = F.when(F.col("__drop").isNull(), col(text_col)).otherwise(left)
    out = out.withColumn(f"c{columns.index(text_col)}", text)
    if length_col in columns:
        length = F.char_length(col(text_col)).cast(docs.schema[length_col].dataType)
        out = out.withColumn(f"c{columns.index(length_col)}",
                             F.when(F.col("__drop").isNull(), col(length_col)).otherwise(length))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)])
