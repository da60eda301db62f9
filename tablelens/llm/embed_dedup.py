"""Near-duplicate embeddings by dual traversal of cover trees.

Vectors of one label (and one dimension) link when their cosine is at least
``least``.  On unit vectors this is a distance bound, and the pairs are found
exactly:

1. Equal vectors of a label are one node with a number of copies.
2. Nodes are dealt to cells by the nearest of a bounded number of reference
   vectors, and cells to blocks of about ``BLOCK`` nodes by hash, so neither a
   hot label nor a hot cell is held by one task.  A block is one row: its
   vectors and its least and greatest distance to every reference.
3. Cell pairs, then block pairs, of a label are pruned by these distances
   (triangle inequality).  The blocks of a label, in the order of their cells,
   form groups of ``GROUP_BYTES``; a task gets the blocks of two groups once
   and joins all pairs left between them by dual traversal of the blocks' cover
   trees: node pairs are pruned, or linked as a whole, by their covering radii.
4. A task returns one row per node with a link: its number of links and its
   component among the two blocks; components are joined over all tasks.

A vector is sent three times (copies, blocks, and the written blocks) and then
once for every group of its label that holds a block near its own.

Defined cases: a vector that is null, empty or zero, or that holds a null or
non-finite component, or has no label, links with nothing; vectors of
different dimensions do not link; repeated rows are copies and link with one
another; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.llm.cover_tree import Tree, join
from tablelens.llm.util import connected_components, global_rank, hash_sample, materialize

BLOCK = 1024
REFERENCES = 64
GROUP_BYTES = 16 << 20
DOUBLES = T.ArrayType(T.DoubleType())


def unit_rows(raw) -> np.ndarray:
    """Unit vectors (double precision) of rows of components."""
    x = np.asarray([np.asarray(v, np.float64) for v in raw])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def nodes_of(rows: DataFrame, id_col: str, vector_col: str, label_col: str, salt: int = 0) -> DataFrame:
    """(vec_id, label, dim, node, check, v): node, a hash of label and vector,
    is null where nothing can link; check is a second hash.  Components keep
    single precision where the table has it."""
    single = rows.schema[vector_col].dataType == T.ArrayType(T.FloatType(), rows.schema[vector_col].dataType.containsNull)
    v = F.col(vector_col) if single else F.col(vector_col).cast("array<double>")
    good = (F.col(label_col).isNotNull() & v.isNotNull()
            & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
            & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False)))
    key = lambda seed: F.when(good, F.xxhash64(F.lit(seed), F.col(label_col), F.size(v), v))
    return rows.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.size(v).alias("dim"),
                       key(salt).alias("node"), key(-1 - salt).alias("check"), F.when(good, v).alias("v"))


def told_apart(rows: DataFrame, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    """``nodes_of`` the rows, and (node, low, copies, label, dim) of the nodes,
    under a salt that gives different vectors different nodes."""
    for salt in range(64):
        named = nodes_of(rows, id_col, vector_col, label_col, salt)
        nodes = materialize(named.where("node is not null").groupBy("node").agg(
            F.min("vec_id").alias("low"), F.count("*").alias("copies"), F.first("label").alias("label"),
            F.first("dim").alias("dim"), F.min("check").alias("check"), F.max("check").alias("other")))
        if not nodes.where("check <> other").take(1):
            return named, nodes.drop("check", "other")
    raise RuntimeError("vectors cannot be told apart")


def references_of(named: DataFrame, nodes: DataFrame) -> dict[int, np.ndarray]:
    """Reference unit vectors by dimension, at most ``REFERENCES`` in all."""
    hot = nodes.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
    wanted = int(min(REFERENCES, max(1, hot // (BLOCK // 2))))
    picked = [r["node"] for r in hash_sample(nodes.select("node"), ["node"], wanted).collect()]
    rows = (named.where(F.col("node").isin(picked)).groupBy("node", "dim").agg(F.first("v").alias("v"))
            .orderBy("node").collect()) if picked else []
    return {dim: unit_rows([r["v"] for r in rows if r["dim"] == dim]) for dim in {r["dim"] for r in rows}}


def distances(unit: np.ndarray, references: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * unit @ references.T, 0.0))


def with_cell(rows: DataFrame, references: dict[int, np.ndarray]) -> DataFrame:
    """Add cell: the nearest reference of every vector ``v``."""
    def placed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            cell = np.zeros(len(frame), np.int64)
            for dim, at in frame.groupby("dim").indices.items():
                if dim in references:
                    cell[at] = distances(unit_rows(frame["v"].to_numpy()[at]), references[dim]).argmin(axis=1)
            yield frame.assign(cell=cell)

    return rows.mapInPandas(placed, T.StructType([*rows.schema.fields, T.StructField("cell", T.LongType())]))


def blocks_of(named: DataFrame, references: dict[int, np.ndarray]) -> DataFrame:
    """One row per block: nodes, copies and vectors as bytes, low and high
    distances to the references, bid (its place in the order of label, cell
    and block) and team (its group of blocks)."""
    held = named.where("node is not null")
    # the sizes of the cells only set the number of blocks
    sizes = materialize(with_cell(held.select("label", "dim", "node", "v"), references).groupBy("label", "dim", "cell")
                        .agg(F.approx_count_distinct("node").alias("m")))
    nodes = held.groupBy("node").agg(F.first("label").alias("label"), F.first("dim").alias("dim"),
                                     F.count("*").alias("copies"), F.first("v").alias("v"))
    subs = F.greatest(F.round(F.coalesce("m", F.lit(0)) / BLOCK), F.lit(1)).cast("long")
    placed = (with_cell(nodes, references).join(sizes, ["label", "dim", "cell"], "left")
              .withColumn("sub", F.pmod(F.xxhash64("node", F.lit(1)), subs)).drop("m"))
    kind = kind_of(named)
    width = max([len(r) for r in references.values()], default=1)

    def block(frame: pd.DataFrame) -> pd.DataFrame:
        first = frame.iloc[0]
        raw = np.stack(frame["v"].to_numpy()).astype(kind)
        away = np.zeros((len(frame), width))
        if first["dim"] in references:
            d = distances(unit_rows(raw), references[first["dim"]])
            away[:, :d.shape[1]] = d
        return pd.DataFrame([{
            "label": first["label"], "dim": first["dim"], "cell": first["cell"], "sub": first["sub"],
            "nodes": frame["node"].to_numpy(np.int64).tobytes(), "copies": frame["copies"].to_numpy(np.int64).tobytes(),
            "raw": raw.tobytes(), "lo": away.min(axis=0), "hi": away.max(axis=0)}])

    fields = placed.select("label", "dim", "cell", "sub").schema
    for name in ("nodes", "copies", "raw"):
        fields = fields.add(name, "binary")
    fields = fields.add("lo", DOUBLES).add("hi", DOUBLES)
    return materialize(placed.groupBy("label", "dim", "cell", "sub").applyInPandas(block, fields))


def kind_of(named: DataFrame) -> str:
    return "f4" if named.schema["v"].dataType.elementType == T.FloatType() else "f8"


def numbered(blocks: DataFrame) -> DataFrame:
    """(label, dim, cell, sub, lo, hi, bid, team): bid is the block's place in
    the order of label, dim, cell and sub, team its group of that order."""
    brief = blocks.select("label", "dim", "cell", "sub", "lo", "hi")
    out = global_rank(brief, [F.col("label"), F.col("dim"), F.col("cell"), F.col("sub")], "bid")
    size = F.greatest(F.floor(F.lit(GROUP_BYTES) / (F.col("dim") * 8 * BLOCK)), F.lit(1))
    return materialize(out.withColumn("team", F.floor(F.col("bid") / size)))


def apart(lo_a, hi_a, lo_b, hi_b, tau: float):
    """Whether some reference proves that no pair can be within ``tau``."""
    gap = lambda lo, hi: F.exists(F.zip_with(lo, hi, lambda x, y: x - y), lambda g: g > tau + 1e-6)
    return gap(lo_a, hi_b) | gap(lo_b, hi_a)


def block_pairs(brief: DataFrame, least: float) -> DataFrame:
    """(label, dim, ta, tb, a, b): numbers and groups of the blocks to join,
    a <= b, both of one label."""
    tau = float(np.sqrt(2.0 - 2.0 * least))
    least_of = lambda c, f: F.array(*[f(F.get(c, F.lit(k))) for k in range(REFERENCES)])
    cells = brief.groupBy("label", "dim", "cell").agg(least_of("lo", F.min).alias("lo"), least_of("hi", F.max).alias("hi"))
    tidy = lambda c: F.filter(F.col(c), lambda x: x.isNotNull()).alias(c)
    cells = materialize(cells.select("label", "dim", "cell", tidy("lo"), tidy("hi")))
    a = cells.select("label", "dim", F.col("cell").alias("ca"), F.col("lo").alias("la"), F.col("hi").alias("ha"))
    b = cells.select("label", "dim", F.col("cell").alias("cb"), F.col("lo").alias("lb"), F.col("hi").alias("hb"))
    near = (a.join(b, ["label", "dim"]).where("ca <= cb")
            .where(~apart(F.col("la"), F.col("ha"), F.col("lb"), F.col("hb"), tau)).select("label", "dim", "ca", "cb"))
    near = materialize(near)
    side = lambda s: brief.select("label", "dim", F.col("cell").alias(f"c{s}"), F.col("bid").alias(s),
                                  F.col("team").alias(f"t{s}"), F.col("lo").alias(f"l{s}"), F.col("hi").alias(f"h{s}"))
    return (near.join(side("a"), ["label", "dim", "ca"]).join(side("b"), ["label", "dim", "cb"])
            .where("ca < cb or a <= b")
            .where(~apart(F.col("la"), F.col("ha"), F.col("lb"), F.col("hb"), tau))
            .select("label", "dim", "ta", "tb", "a", "b"))


def joined(pairs: DataFrame, blocks: DataFrame, brief: DataFrame, kind: str, least: float) -> DataFrame:
    """(node, n, root) of every node with a link in some block pair."""
    where = ["label", "dim", "ta", "tb"]
    first = pairs.groupBy(*where, F.col("a").alias("bid")).agg(F.collect_list("b").alias("others"))
    second = pairs.select(*where, F.col("b").alias("bid"), F.array().cast("array<long>").alias("others"))
    sent = first.unionByName(second).groupBy(*where, "bid").agg(F.flatten(F.collect_list("others")).alias("others"))
    place = ["label", "dim", "cell", "sub"]
    sent = materialize(sent.join(brief.select("bid", "cell", "sub"), "bid"))
    wide = sent.join(blocks.select(*place, "nodes", "copies", "raw"), place).select(*where, "bid", "others", "nodes", "copies", "raw")

    def traverse(frame: pd.DataFrame) -> pd.DataFrame:
        held = {}
        for r in frame.itertuples(index=False):
            nodes, copies = np.frombuffer(r.nodes, np.int64), np.frombuffer(r.copies, np.int64)
            held[r.bid] = Tree(unit_rows(np.frombuffer(r.raw, kind).reshape(len(nodes), -1))), nodes, copies
        out = [(np.zeros(0, np.int64),) * 3]
        for a, others in zip(frame["bid"], frame["others"]):
            ta, na, wa = held[a]
            for b in others:
                tb, nb, wb = held[b]
                counts, label = join(ta, tb, wa, wb, least, a == b)
                ids, hit = np.concatenate((na[ta.place], nb[tb.place])), counts > 0
                out.append((ids[hit], counts[hit], ids[label[hit]]))
        node, n, root = (np.concatenate(part) for part in zip(*out))
        return pd.DataFrame({"node": node, "n": n, "root": root})

    return materialize(wide.groupBy(*where).applyInPandas(traverse, "node long, n long, root long"))


def embedding_dedup(rows: DataFrame, id_col="vec_id", vector_col="embedding", label_col="label",
                    least: float = 0.93) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    named, nodes = told_apart(rows, id_col, vector_col, label_col)
    blocks = blocks_of(named, references_of(named, nodes))
    brief = numbered(blocks)
    pairs = materialize(block_pairs(brief, least))
    found = joined(pairs, blocks, brief, kind_of(named), least)
    links = found.groupBy("node").agg(F.sum("n").alias("n"))
    parts = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    info = (nodes.select("node", "low", "copies").join(links, "node", "left").join(parts, "node", "left")
            .select("node", "low", "copies", F.coalesce("n", F.lit(0)).alias("n"),
                    F.coalesce("component", "node").alias("part")))
    info = materialize(info)
    lows = info.groupBy("part").agg(F.min("low").alias("component"))
    info = materialize(info.join(lows, "part").select("node", (F.col("n") + F.col("copies") - 1).alias("n"), "component"))
    out = named.select("vec_id", "node").join(info, "node", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
