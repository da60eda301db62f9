"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest of ``PIVOTS`` pivots (a bounded sample
of the distinct vectors), in order.  Vectors are dealt to blocks by hash; a
block's inverted files hold, for every pivot, the posting of every vector that
has it among its nearest ``PREFIX``: ``PREFIX`` less its place in the order, one
byte a vector, 0 where it is not posted.  A query walks the files of its own
pivots; each posting takes min(posting, own) off the footrule distance of the
two orders (a pivot that is not posted counts as place ``PREFIX``), so the sum
of these minima ranks a block's vectors by footrule.  The best ``RERANK`` share
of every block (``RERANK_LEAST`` vectors at least) is compared exactly.

Queries are dealt to groups the same way, and every block meets every group:
the stated query set against all rows, in blocks.  ``RUN`` blocks and ``TEAM``
groups make a cell, to which each of them is sent once, through the shuffle
alone: a task holds a cell's groups (about 0.5 MB each with 64 floats a vector),
walks its blocks past them one by one, and returns a query's nearest of the
cell.  The driver sees the pivots and counts, never a block or a group.

Equal vectors are one entry of the index with its first rows by id, as many as
an answer can hold, so a hot vector is neither indexed nor compared twice.

Defined cases: null, empty and zero vectors and those with a null or non-finite
component are neither query nor candidate; vectors of different dimension are
not compared; a repeated row is a row of its own and so a candidate of its
copies; a null id is no query, and last among ties; fewer candidates give
fewer rows; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablelens.llm.util import hash_sample, materialize
from tablelens.llm.vectors import matrix, usable

PIVOTS = 256
PREFIX = 255
BLOCK = 1024
GROUP = 1024
RUN = 16
TEAM = 16
TASKS = 4096  # at most; a task takes several cells then
RERANK = 0.03
RERANK_LEAST = 64
SALT = 64


def in_order(alias: str = "at"):
    """(no id, id, row): the order of rows of equal distance."""
    return F.struct(F.col("vec_id").isNull().alias("none"), "vec_id", "rid").alias(alias)


def by_shuffle(rows: DataFrame) -> DataFrame:
    """Rows that a join must not send through the driver: Spark takes a written
    table for small by its compressed files, a tenth of its rows in memory."""
    return rows.hint("merge")


def entries_of(rows: DataFrame, k: int, is_query) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Distinct vectors (entry, dim, v, and wanted: whether a row of theirs
    meets ``is_query``), their first ``k + 1`` rows (entry, at), and the entry
    of every row (rid, vec_id, entry)."""
    keyed = rows.withColumn("key", F.unhex(F.md5("v")))
    firsts = materialize(keyed.groupBy("dim", "key")
                         .agg(F.min(in_order()).alias("at"), F.count("*").alias("n"), F.first("v").alias("v"),
                              F.max(is_query).alias("wanted"))
                         .select("dim", "key", F.col("at.rid").alias("entry"), "n", "v", "wanted"))
    numbers = by_shuffle(firsts.select("dim", "key", "entry", "n"))
    members = materialize(keyed.select("rid", "vec_id", "dim", "key").join(numbers, ["dim", "key"])
                          .select("rid", "vec_id", "entry", "n"))
    single = members.where("n = 1").select("entry", in_order())
    several = members.where("n > 1").select("entry", in_order(), F.pmod(F.xxhash64("rid"), F.lit(SALT)).alias("salt"))
    for keys in (["entry", "salt"], ["entry"]):  # a hot vector's rows are narrowed down in two steps
        place = F.row_number().over(Window.partitionBy(*keys).orderBy("at"))
        several = several.withColumn("place", place).where(F.col("place") <= k + 1).drop("place")
    copies = materialize(single.unionByName(several.select("entry", "at"))
                         .groupBy("entry").agg(F.array_sort(F.collect_list("at")).alias("rows")))
    return firsts.select("entry", "dim", "v", "wanted"), copies, members.select("rid", "vec_id", "entry")


def postings(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """(vector, pivot): prefix less the pivot's place in the vector's order."""
    size = max(np.abs(pivots).max(), np.abs(x).max())  # squares of any double stay finite
    away = ((pivots / size) ** 2).sum(axis=1) - 2 * ((x / size) @ (pivots / size).T)
    order = np.argsort(away, axis=1, kind="stable")[:, :prefix]
    out = np.zeros((len(x), len(pivots)), np.uint8)
    np.put_along_axis(out, order, (prefix - np.arange(order.shape[1])).astype(np.uint8)[None, :], axis=1)
    return out


def blocks_of(entries: DataFrame, pivots: np.ndarray, prefix: int, size: int, by_pivot: bool,
              kind: str) -> tuple[DataFrame, int]:
    """One row per block of about ``size`` vectors: block, entries, vectors (as
    ``kind``) and postings as bytes, the postings pivot by pivot (the inverted
    files) or, for queries, vector by vector.  Also the number of blocks."""
    n = max(1, -(-entries.count() // size))
    dealt = (entries.groupBy(F.pmod(F.xxhash64("entry", F.lit(7)), F.lit(n)).alias("block"))
             .agg(F.array_sort(F.collect_list(F.struct("entry", "v"))).alias("held")))
    dim = pivots.shape[1]

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, held in zip(batch.column("block").to_pylist(), batch.column("held")):
                inner = held.values
                x = matrix(inner.field("v"), dim, kind)
                posted = postings(x.astype(np.float64), pivots, prefix)
                posted = np.ascontiguousarray(posted.T) if by_pivot else posted
                yield pa.record_batch([
                    pa.array([at]), pa.array([np.asarray(inner.field("entry")).astype(np.int64).tobytes()], pa.binary()),
                    pa.array([x.tobytes()], pa.binary()), pa.array([posted.tobytes()], pa.binary())],
                    names=["block", "entries", "vectors", "posted"])

    return dealt.mapInArrow(post, "block long, entries binary, vectors binary, posted binary"), n


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows to ``q``; scaled only where squares overflow."""
    with np.errstate(over="ignore"):
        gap = x - q
        away = np.sqrt((gap ** 2).sum(axis=-1))
    for i in zip(*np.nonzero(~np.isfinite(away))):
        size = np.abs(gap[i]).max()
        away[i] = size * np.sqrt(((gap[i] / size) ** 2).sum()) if np.isfinite(size) else np.inf
    return away


def nearest_in_block(files: np.ndarray, x: np.ndarray, posted: np.ndarray, q: np.ndarray, depth: int, k: int):
    """Number of the query, number in the block and distance of the ``k``
    exactly nearest of every query among the ``depth`` of least footrule
    distance; ``files`` is pivot by vector, ``posted`` query by pivot."""
    near = np.empty((len(q), depth), np.int64)
    walked = np.empty_like(files)
    for i, own in enumerate(posted):
        at = np.flatnonzero(own)
        if 2 * len(at) > len(own):  # the files of the other pivots add nothing; picking its own costs more here
            np.minimum(files, own[:, None], out=walked)
            shared = walked.sum(axis=0, dtype=np.uint16)  # at most 255 * 256 / 2
        else:
            shared = np.minimum(files[at], own[at][:, None]).sum(axis=0, dtype=np.uint16)
        near[i] = np.argpartition(-shared.astype(np.int32), depth - 1)[:depth] if depth < len(x) else np.arange(len(x))
    out = []
    step = max(1, (1 << 17) // (depth * x.shape[1]))
    for i in range(0, len(q), step):
        away = distances(x[near[i:i + step]], q[i:i + step, None])
        limit = np.partition(away, k - 1, axis=1)[:, k - 1:k] if depth > k else np.inf
        query, place = np.nonzero(away <= limit)  # ties are settled by id, later
        out.append((query + i, near[i:i + step][query, place], away[query, place]))
    return tuple(np.concatenate(part) for part in zip(*out))


class Group:
    """A group of queries and the nearest entries it has met so far."""

    def __init__(self, entries: np.ndarray, vectors: np.ndarray, posted: np.ndarray, k: int):
        self.entries, self.vectors, self.posted, self.k = entries, vectors, posted, k
        self.found, self.n = [], 0

    def meet(self, files: np.ndarray, x: np.ndarray, entries: np.ndarray, depth: int) -> None:
        """Add every query's nearest of a block."""
        query, near, away = nearest_in_block(files, x, self.posted, self.vectors.astype(np.float64), depth, self.k)
        self.found.append((query, entries[near], away))
        self.n += len(query)
        if self.n > 8 * self.k * len(self.entries):
            self.nearest()

    def nearest(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of the query, entry and distance of the ``k`` nearest of every
        query and of those as near as the last; the others are forgotten."""
        query, entry, away = (np.concatenate(part) for part in zip(*self.found))
        order = np.lexsort((away, query))
        query, entry, away = query[order], entry[order], away[order]
        first = np.searchsorted(query, np.arange(len(self.entries)))
        last = np.minimum(first + self.k, np.append(first[1:], len(query))) - 1
        keep = away <= away[last][query]  # ties are settled by id, later
        self.found, self.n = [(query[keep], entry[keep], away[keep])], int(keep.sum())
        return self.found[0]


def in_cells(blocks: DataFrame, n_blocks: int, groups: DataFrame, n_groups: int) -> DataFrame:
    """(run, team, of, block, entries, vectors, posted): the groups (of = 0) and
    then the blocks (of = 1) of every cell, a cell in one partition."""
    runs, teams = -(-n_blocks // RUN), -(-n_groups // TEAM)
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    share = lambda n: F.floor(F.col("block") / F.lit(n)).cast("long")
    names = ["block", "entries", "vectors", "posted"]
    # dealt out first: the tasks that read a small table are few, and each of its rows is sent many times
    held = groups.repartition(min(n_groups, TASKS), "block").select(
        each(runs).alias("run"), share(TEAM).alias("team"), F.lit(0).alias("of"), *names)
    walked = blocks.select(share(RUN).alias("run"), each(teams).alias("team"), F.lit(1).alias("of"), *names)
    cells = held.unionByName(walked).repartition(min(runs * teams, TASKS), "run", "team")
    return cells.sortWithinPartitions("run", "team", "of", "block")


def searched(blocks: DataFrame, n_blocks: int, groups: DataFrame, n_groups: int, dim: int, n_pivots: int, k: int,
             share: float, least: int, kind: str) -> DataFrame:
    """(query, entry, score): the nearest entries of every query in each cell."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = lambda value, kind: np.frombuffer(value.as_buffer(), kind)

        def answer(held: list[Group]) -> Iterator[pa.RecordBatch]:
            for group in held:
                if group.found:
                    query, entry, away = group.nearest()
                    yield pa.record_batch([pa.array(group.entries[query]), pa.array(entry), pa.array(away)],
                                          names=["query", "entry", "score"])

        cell, held = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                value = lambda c: batch.column(c)[i]  # noqa: B023, E731
                at = value("run").as_py(), value("team").as_py()
                if at != cell:
                    yield from answer(held)
                    cell, held = at, []
                entries, x = raw(value("entries"), np.int64), raw(value("vectors"), kind).reshape(-1, dim)
                posted = raw(value("posted"), np.uint8)
                if not value("of").as_py():
                    held.append(Group(entries.copy(), x.copy(), posted.reshape(-1, n_pivots).copy(), k + 1))
                    continue
                depth = min(len(x), max(least, int(np.ceil(share * len(x)))))
                x, files = x.astype(np.float64), posted.reshape(n_pivots, -1)
                for group in held:
                    group.meet(files, x, entries, depth)
        yield from answer(held)

    cells = in_cells(blocks, n_blocks, groups, n_groups)
    return materialize(cells.mapInArrow(search, "query long, entry long, score double"))


def answers(found: DataFrame, copies: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest rows of every query row."""
    lead = found.join(by_shuffle(copies), "entry").select("query", "score", F.col("rows")[0].alias("at"), "rows")
    lead = lead.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("score", "at")))
    one = F.transform("rows", lambda r: F.struct(F.col("score").alias("score"), r.alias("at")))
    per = (lead.where(F.col("place") <= k + 1).select("query", F.explode(one).alias("r"))
           .groupBy("query").agg(F.slice(F.array_sort(F.collect_list("r")), 1, k + 1).alias("nearest")))
    mine = asked.join(per, asked["entry"] == per["query"])
    others = F.slice(F.filter("nearest", lambda r: r["at"]["rid"] != F.col("rid")), 1, k)
    listed = mine.select(F.col("vec_id").alias("query_id"), F.posexplode(others).alias("place", "r"))
    return listed.select("query_id", (F.col("place") + 1).cast("int").alias("rank"),
                         F.col("r.at.vec_id").alias("vec_id"), F.col("r.score").alias("score"))


def search(rows: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10,
           n_pivots: int = PIVOTS, prefix: int = PREFIX, share: float = RERANK, least: int = RERANK_LEAST) -> DataFrame:
    """The ``k`` nearest other rows of every row that meets ``is_query`` (a
    condition on vec_id): query_id, rank, vec_id, score."""
    kept = usable(rows, id_col, vector_col)
    is_query = F.coalesce(is_query, F.lit(False))
    distinct, copies, members = entries_of(kept, k, is_query)
    asked = materialize(members.where(is_query))
    out = None
    for (dim,) in kept.select("dim").distinct().collect():  # an index for each number of components
        mine = distinct.where(F.col("dim") == dim).select("entry", "v", "wanted")
        picked = hash_sample(mine.select("v"), ["v"], n_pivots).collect()
        wide = len(picked[0]["v"]) // dim
        kind = "f4" if wide == 4 else "f8"
        pivots = np.array([np.frombuffer(r["v"], kind) for r in picked], np.float64)
        blocks, n_blocks = blocks_of(mine, pivots, prefix, BLOCK, True, kind)
        groups, n_groups = blocks_of(mine.where("wanted"), pivots, prefix, GROUP, False, kind)
        found = searched(blocks, n_blocks, groups, n_groups, dim, len(pivots), k, share, least, kind)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = members.select(F.col("rid").alias("query"), "entry", F.lit(0.0).alias("score")).where("false")
    return answers(out, copies, asked, k)
