"""Importance resampling towards a target distribution.

Texts are bags of hashed features: runs of 1 to ``order`` consecutive words
(ASCII digits, letters with A-Z lower-cased, and all characters beyond ASCII),
joined by one space, each in one of ``buckets`` buckets by its CRC-32.  Counts
of all source texts and all target texts give every bucket a gain (the log
ratio of the smoothed shares, in thousandths), and a text the mean gain of its
features.  Adding Gumbel noise seeded by the id and taking the highest scores
draws without replacement.

1. One pass over the texts writes each one's buckets (2 or 4 bytes a feature);
   counts are one partial sum a task, at most ``buckets`` rows each.
2. Weights are looked up in one array of gains (``buckets`` numbers, the only
   thing that goes through the driver) and summed per text.
3. The cutoff: KLL sketches, merged in two levels, bracket the score of the
   last one drawn.  Exact counts outside the bracket confirm it or widen it,
   and only the rows inside are sorted, by ranges, to find the cutoff row.
4. What lies above the cutoff is ranked by ranges.

Defined cases: a null or empty text, or one without words, has no features and
weight 0; a null id is noised as the empty string and comes last in ties;
repeated rows are separate rows and keep the order in which they were written;
an empty table gives no rows; with fewer than ``100 / percent`` long enough
texts nothing is drawn; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.llm.util import global_rank, materialize, slices, utf8

SKETCH_K = 2000
SKETCH_GROUPS = 64
# Share of the rows on either side of the aim that the first bracket spans, at
# least the sketch's rank error (about 2.3 / k ** 0.9).
SKETCH_MARGIN = 2 * 2.3 / SKETCH_K ** 0.9


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    return table


CRC = _crc_table()
# Word bytes after lower-casing A-Z: digits, a-z, and every byte beyond ASCII.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True


def crc32_of(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of every data[start:end]: all spans advance a byte at a time,
    longest first, and very long ones go to zlib."""
    length = end - start
    out = np.empty(len(start), np.uint32)
    for k in np.flatnonzero(length > 48):
        out[k] = zlib.crc32(data[start[k]:end[k]].tobytes())
    short = np.flatnonzero(length <= 48)
    short = short[np.argsort(-length[short], kind="stable")]
    crc = np.full(len(short), 0xFFFFFFFF, np.uint32)
    alive = np.searchsorted(-length[short], -np.arange(49), side="left")  # spans longer than i
    at = start[short]
    for i in range(48):
        m = alive[i]
        if not m:
            break
        crc[:m] = CRC[(crc[:m] ^ data[at[:m] + i]) & np.uint32(255)] ^ (crc[:m] >> np.uint32(8))
    out[short] = ~crc
    return out


def text_buckets(data: np.ndarray, off: np.ndarray, order: int, buckets: int):
    """(bucket of every feature, features of each text, words of each text)."""
    n = len(off) - 1
    data = FOLD[data]
    word = np.append(WORD[data], False)
    edge = np.zeros(len(word), bool)
    edge[off] = True
    begins = word.copy()
    begins[1:] &= ~word[:-1] | edge[1:]
    ends = word[:-1] & (~word[1:] | edge[1:])
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    owner = np.searchsorted(off, start, side="right") - 1
    if order > 1:  # words with one space between them, so that runs are spans
        keep = word[:-1].copy()
        gap = start[1:][owner[1:] == owner[:-1]] - 1  # the byte before a word that follows another
        tidy = data.copy()
        tidy[gap] = 32
        keep[gap] = True
        place = np.cumsum(keep) - keep
        start, end, data = place[start], place[end - 1] + 1, tidy[keep]
    found, owners = [], []
    for k in range(1, order + 1):
        if len(start) < k:
            break
        same = owner[:len(owner) - k + 1] == owner[k - 1:]
        first, last = start[:len(start) - k + 1][same], end[k - 1:][same]
        found.append(crc32_of(data, first, last) % np.uint32(buckets))
        owners.append(owner[:len(owner) - k + 1][same])
    found = np.concatenate(found) if found else np.zeros(0, np.uint32)
    owners = np.concatenate(owners) if owners else np.zeros(0, np.int64)
    by_text = np.argsort(owners, kind="stable") if order > 1 else slice(None)
    return found[by_text], np.bincount(owners, minlength=n), np.bincount(owner, minlength=n)


def hashed(docs: DataFrame, id_col: str, text_col: str, order: int, buckets: int) -> DataFrame:
    """(rid, doc_id, n_words, n_features, features), written once."""
    narrow = np.uint16 if buckets <= 1 << 16 else np.uint32
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"),
                       F.col(text_col).cast("string").alias("text"))

    def hash_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                data, off = utf8(piece.column("text"))
                found, n, words = text_buckets(data, off, order, buckets)
                found = found.astype(narrow)
                ends = np.concatenate(([0], np.cumsum(n))).astype(np.int64) * found.itemsize
                raw = pa.Array.from_buffers(pa.binary(), len(n), [
                    None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(found.tobytes())])
                yield pa.record_batch([piece.column("rid"), piece.column("doc_id"), pa.array(words.astype(np.int64)),
                                       pa.array(n.astype(np.int64)), raw],
                                      names=["rid", "doc_id", "n_words", "n_features", "features"])

    fields = rows.drop("text").schema.add("n_words", "long").add("n_features", "long").add("features", "binary")
    return materialize(rows.mapInArrow(hash_texts, fields))


def _features(batch: pa.RecordBatch, buckets: int) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index("features"))
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, np.int64)
    off = np.frombuffer(offsets, np.int32)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0]:off[-1]].tobytes()
    return np.frombuffer(raw, np.uint16 if buckets <= 1 << 16 else np.uint32)


def bucket_counts(rows: DataFrame, buckets: int) -> np.ndarray:
    """Features of all rows in each bucket."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(_features(batch, buckets), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    per = rows.select("features").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    for bucket, n in per.collect():  # at most one row a bucket
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, floored."""
    size = len(source)
    s, t = source.astype(np.float64) + 1, target.astype(np.float64) + 1
    top, low = t * (source.sum() + size), s * (target.sum() + size)
    return np.floor(1000 * np.log(top / low)).astype(np.int64)


def weighted(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """``rows`` with ``weight`` (floored mean gain) in place of the features."""
    buckets = len(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n_features").to_numpy()
            upto = np.concatenate(([0], np.cumsum(gain[_features(batch, buckets)])))
            ends = np.cumsum(n)
            total = upto[ends] - upto[ends - n]
            kept = [batch.column(c) for c in ("rid", "doc_id", "n_words", "n_features")]
            yield pa.record_batch([*kept, pa.array(total // np.maximum(n, 1))],
                                  names=["rid", "doc_id", "n_words", "n_features", "weight"])

    return rows.mapInArrow(weigh, rows.drop("features").schema.add("weight", "long"))


def noise(doc_id, seed: int):
    """Gumbel noise in thousandths, floored, from the id's SHA-256."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def bracket(rows: DataFrame, k: int, n: int, margin: float = SKETCH_MARGIN) -> tuple[int, int, int]:
    """(low, high, above): the k-th highest of ``n`` scores lies in [low, high]
    and ``above`` scores are higher than ``high``, by exact counts."""
    sketch = (rows.groupBy(F.pmod(F.spark_partition_id(), F.lit(SKETCH_GROUPS)).alias("g"))
              .agg(F.expr(f"kll_sketch_agg_bigint(score, {SKETCH_K})").alias("q"))
              .agg(F.expr(f"kll_merge_agg_bigint(q, {SKETCH_K})").alias("q")))
    sketch = materialize(sketch)
    while True:
        ends = [min(1.0, max(0.0, 1 - k / n + side * margin)) for side in (-1, 1)]
        whole = ends[0] == 0.0 and ends[1] == 1.0
        low, high = sketch.select(
            *[F.expr(f"kll_sketch_get_quantile_bigint(q, {p!r}D)").alias(f"q{i}") for i, p in enumerate(ends)]).first()
        if whole:
            low, high = rows.agg(F.min("score"), F.max("score")).first()
        above, inside = rows.agg(F.count_if(F.col("score") > high),
                                 F.count_if(F.col("score").between(low, high))).first()
        if above < k <= above + inside or whole:
            return low, high, above
        margin *= 4


def cutoff(rows: DataFrame, k: int, n: int, order: list, margin: float = SKETCH_MARGIN):
    """Whether a row (rid, doc_id, score) is among the first ``k`` of ``n``."""
    low, high, above = bracket(rows, k, n, margin)
    inside = global_rank(rows.where(F.col("score").between(low, high)), order, "place")
    last = inside.where(F.col("place") == k - above - 1).first()
    same = F.col("doc_id").eqNullSafe(F.lit(last["doc_id"]))
    earlier = F.col("doc_id").isNotNull() if last["doc_id"] is None else F.col("doc_id") < F.lit(last["doc_id"])
    tied = F.coalesce(earlier, F.lit(False)) | (same & (F.col("rid") <= last["rid"]))
    return (F.col("score") > last["score"]) | ((F.col("score") == last["score"]) & tied)


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             target_col: str = "text", order: int = 1, buckets: int = 10_000, seed: int = 2024,
             least_words: int = 20, percent: int = 10, margin: float = SKETCH_MARGIN) -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, rank (null if
    it is not among the ``percent`` of long enough documents drawn)."""
    rows = hashed(docs, id_col, text_col, order, buckets)
    aim = hashed(target.select(F.lit(0).alias("doc_id"), F.col(target_col).alias("text")), "doc_id", "text", order, buckets)
    gain = gains(bucket_counts(rows, buckets), bucket_counts(aim, buckets))
    scored = weighted(rows, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = materialize(scored)
    long_enough = F.col("n_words") >= least_words
    n = scored.where(long_enough).count()
    k = percent * n // 100
    if not k:
        return scored.select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("rid").asc()]
    first = long_enough & cutoff(scored.where(long_enough), k, n, order, margin)
    ranked = global_rank(scored.where(first), order, "place").withColumn("rank", F.col("place") + 1).drop("place")
    rest = scored.where(~first).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")
