"""Centroid clustering (Lloyd's rounds in whole numbers) over a VA-file.

Every vector is kept with an approximation: per dimension, the number of a cell
of a few bits.  The cells of a dimension are cut at quantiles of a bounded
sample (``FIT_ROWS`` vectors) and each has an exact least and greatest value.
For a set of centroids, lookup tables over (dimension, cell) give the interval
that -2xc can lie in; with the centroid's squared norm they sum to an interval
of the squared distance less the vector's own squared norm, which is common to
all centroids.  A centroid whose interval starts above the least end of all
intervals cannot be nearest; only where several centroids are left are the
vector's own components read and compared with those.

Rounds move no vectors: a task assigns its vectors under the last centroids
and under those before, and reports, per cluster and dimension, the components
of the vectors that moved.  Spark sums these (at most centroids x dimensions
rows a task), and sums, counts and centroids go through the driver: bounded by
the parameters, not by the data.

Defined cases: vectors that are null, of another number of components, or that
hold a null or non-finite component are left out; a zero vector is kept;
components are clamped to +/- 2**27 after scaling, so that squared distances
fit a long; repeated rows are separate vectors; of equal starting hashes the
vector with the smaller components comes first, and a null id hashes as the
empty string; with fewer vectors than centroids there are as many centroids as
vectors; a cluster that loses all vectors keeps its centroid; no kept vector,
no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.llm.util import hash_sample, materialize
from tablelens.llm.vectors import binaries, matrix, usable
from tablelens.session import local_frame

BITS = 6
FIT_ROWS = 4096
LIMIT = 1 << 27


def scaled(rows: DataFrame, dim: int, scale: float) -> DataFrame:
    """(vec_id, v): whole components, 4 bytes each."""
    def scale_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            with np.errstate(over="ignore"):
                x = np.floor(matrix(batch.column("v"), dim) * scale)
            x = np.clip(x, -LIMIT, LIMIT).astype(np.int32)
            yield pa.record_batch([batch.column("vec_id"), binaries(x)], names=["vec_id", "v"])

    fields = rows.select("vec_id").schema.add("v", "binary")
    return materialize(rows.select("vec_id", "v").mapInArrow(scale_all, fields))


class Cells:
    """Per dimension, the cuts between cells and each cell's least and greatest value."""

    def __init__(self, sample: np.ndarray, low: np.ndarray, high: np.ndarray, bits: int):
        n = 1 << bits
        self.cuts, self.low, self.high = [], np.zeros((len(low), n), np.int64), np.zeros((len(low), n), np.int64)
        for d in range(len(low)):
            cuts = np.unique(np.quantile(sample[:, d], np.arange(1, n) / n, method="lower"))
            cuts = cuts[(cuts >= low[d]) & (cuts < high[d])]  # a cell holds cut < x <= next cut
            self.cuts.append(cuts)
            self.low[d, :len(cuts) + 1] = np.concatenate(([low[d]], cuts + 1))
            self.high[d, :len(cuts) + 1] = np.concatenate((cuts, [high[d]]))

    def of(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(cuts, x[:, d], side="left") for d, cuts in enumerate(self.cuts)],
                        axis=1).astype(np.uint8)


def fitted(rows: DataFrame, dim: int, bits: int, fit_rows: int) -> Cells:
    """Cells from a bounded sample and the exact range of every dimension."""
    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.full(dim, LIMIT + 1), np.full(dim, -LIMIT - 1)
        for batch in batches:
            x = matrix(batch.column("v"), dim, np.int32)
            if len(x):
                low, high = np.minimum(low, x.min(axis=0)), np.maximum(high, x.max(axis=0))
        yield pa.record_batch([pa.array(np.arange(dim)), pa.array(low), pa.array(high)], names=["d", "low", "high"])

    ends = (rows.select("v").mapInArrow(ranges, "d long, low long, high long").groupBy("d")
            .agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("d").collect())
    sample = hash_sample(rows.select("v"), ["v"], fit_rows).collect()
    points = np.stack([np.frombuffer(r["v"], np.int32) for r in sample]).astype(np.int64)
    return Cells(points, np.array([r["low"] for r in ends]), np.array([r["high"] for r in ends]), bits)


def approximated(rows: DataFrame, cells: Cells, dim: int) -> DataFrame:
    """The VA-file: (vec_id, cells, v), written once."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = cells.of(matrix(batch.column("v"), dim, np.int32))
            yield pa.record_batch([batch.column("vec_id"), binaries(codes), batch.column("v")],
                                  names=["vec_id", "cells", "v"])

    fields = rows.select("vec_id").schema.add("cells", "binary").add("v", "binary")
    return materialize(rows.mapInArrow(encode, fields))


class Lookup:
    """Distance intervals to a set of centroids, from cells."""

    def __init__(self, cells: Cells, centroids: np.ndarray):
        ends = np.stack([-2 * cells.low[:, :, None] * centroids.T[:, None, :],
                         -2 * cells.high[:, :, None] * centroids.T[:, None, :]])
        self.tables = np.concatenate((ends.min(axis=0), ends.max(axis=0)), axis=2)  # dimension, cell, low | high
        self.centroids, self.own = centroids, (centroids ** 2).sum(axis=1)

    def nearest(self, codes: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, int]:
        """Nearest centroid of every vector (ties: the smaller number), and
        how many vectors were read for it."""
        k = len(self.own)
        out = np.empty(len(codes), np.int64)
        read = 0
        for a in range(0, len(codes), 2048):
            part = slice(a, a + 2048)
            ends = np.zeros((len(codes[part]), 2 * k), np.int64)
            for d in range(codes.shape[1]):
                ends += self.tables[d][codes[part, d]]
            low, high = ends[:, :k] + self.own, ends[:, k:] + self.own
            left = low <= high.min(axis=1, keepdims=True)
            best = left.argmax(axis=1)
            several = np.flatnonzero(left.sum(axis=1) > 1)
            read += len(several)
            r, c = np.nonzero(left[several])
            exact = np.full((len(several), k), np.iinfo(np.int64).max)
            full = x[part][several].astype(np.int64)
            exact[r, c] = ((full[r] - self.centroids[c]) ** 2).sum(axis=1)
            best[several] = exact.argmin(axis=1)
            out[part] = best
        return out, read


def moved(va: DataFrame, cells: Cells, dim: int, before: np.ndarray | None, now: np.ndarray) -> DataFrame:
    """(cluster, d, total): what the clusters' sums gain (and lose) as vectors
    go from the nearest of ``before`` to the nearest of ``now``; d = -1 is the
    number of vectors, d = -2 that of vectors read for their assignment."""
    def changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new, old = Lookup(cells, now), None if before is None else Lookup(cells, before)
        sums, counts, read = np.zeros((len(now), dim), np.int64), np.zeros(len(now), np.int64), 0
        for batch in batches:
            codes = matrix(batch.column("cells"), dim, np.uint8)
            x = matrix(batch.column("v"), dim, np.int32)
            to, n = new.nearest(codes, x)
            read += n
            sides = [(to, 1, np.arange(len(to)))]
            if old is not None:
                was, _ = old.nearest(codes, x)
                gone = np.flatnonzero(was != to)
                sides = [(to[gone], 1, gone), (was[gone], -1, gone)]
            for cluster, sign, rows in sides:
                np.add.at(sums, cluster, sign * x[rows].astype(np.int64))
                np.add.at(counts, cluster, sign)
        k = np.repeat(np.arange(len(now)), dim)
        d = np.tile(np.arange(dim), len(now))
        yield pa.record_batch([
            pa.array(np.concatenate((k, np.arange(len(now)), [0]))),
            pa.array(np.concatenate((d, np.full(len(now), -1), [-2]))),
            pa.array(np.concatenate((sums.ravel(), counts, [read])))], names=["cluster", "d", "total"])

    parts = va.mapInArrow(changes, "cluster long, d long, total long")
    return parts.groupBy("cluster", "d").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))


def assigned(va: DataFrame, cells: Cells, dim: int, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) under fixed centroids."""
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(cells, centroids)
        for batch in batches:
            x = matrix(batch.column("v"), dim, np.int32)
            to, _ = lookup.nearest(matrix(batch.column("cells"), dim, np.uint8), x)
            away = np.empty(len(to), np.int64)
            for a in range(0, len(to), 2048):
                part = slice(a, a + 2048)
                away[part] = ((x[part].astype(np.int64) - centroids[to[part]]) ** 2).sum(axis=1)
            yield pa.record_batch([batch.column("vec_id"), pa.array(to.astype(np.int32)), pa.array(away)],
                                  names=["vec_id", "cluster", "distance"])

    fields = va.select("vec_id").schema.add("cluster", "integer").add("distance", "long")
    return va.mapInArrow(assign, fields)


def starts(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors of least SHA-256 of ``seed:vec_id``, in that order."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    least = rows.select(digest.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([np.frombuffer(r["v"], np.int32) for r in least], np.int64)


def cluster(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = 64, k: int = 40,
            rounds: int = 5, scale: float = 256.0, seed: int = 2, bits: int = BITS, fit_rows: int = FIT_ROWS) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia,
    inertia, centroid_sha256 (of the final centroid's components)."""
    whole = scaled(usable(rows, id_col, vector_col, zero=True, dim=dim), dim, scale)
    centroids = starts(whole, k, seed)
    if not len(centroids):
        return whole.select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in (
            ("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"),
            ("centroid_sha256", "string"))])
    cells = fitted(whole, dim, bits, fit_rows)
    va = approximated(whole, cells, dim)
    before, totals = None, np.zeros((len(centroids), dim + 1), object)
    for _ in range(rounds):
        for r in moved(va, cells, dim, before, centroids).collect():  # centroids x (dim + 1) rows
            if r["d"] >= -1:
                totals[r["cluster"], r["d"]] += int(r["total"])
        before, centroids = centroids, centroids.copy()
        for c in np.flatnonzero(totals[:, dim] > 0):
            centroids[c] = [int(t) // int(totals[c, dim]) for t in totals[c, :dim]]
    out = materialize(assigned(va, cells, dim, centroids))
    per = out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # k rows
    inertia = {r["cluster"]: int(r["s"]) for r in per}
    named = [(c, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest())
             for c in sorted(inertia)]
    info = local_frame(out.sparkSession, named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(info), "cluster").select(  # at most k rows
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
