"""Near-duplicate documents by improved consistent weighted sampling.

A document is the multiset of its five-word shingles (all its words, if it
has fewer).  A shingle weighs ``1 + IDF_SHARE * idf`` with idf = log(N / df) /
log(N) between 0 and 1; df is read from a fixed-size count sketch over all
documents, less the sketch's mean load, so that only shingles more frequent
than the sketch's noise weigh less.  Documents link when the weighted Jaccard
similarity of their multisets is at least 0.8.

1. Texts are grouped by hash; equal texts are one node.
2. Every node gets ``BINS`` samples: shingles fall into bins by hash and each
   bin keeps the shingle that improved consistent weighted sampling picks
   (``t = floor(ln w / r + b)``, ``a = c / exp(r (t - b) + r)``, least ``a``);
   empty bins borrow from hashed ones.
3. ``BAND`` samples make a band key.  Members of a bucket are compared with
   the bucket's hub, the member that shares buckets with most others, which is
   the original among its copies.  Members of buckets that then still hold
   several components are clumped by a prefix filter (two documents that
   similar share one of the rarest shingles that make up a fifth of their
   weight) and judged exactly, block against block inside tasks, so that only
   similar pairs become rows.
4. Links are verified on the shingles; components are classes.

Defined cases: null text is an empty text; texts without a word link to equal
texts only; repeated rows are equal texts; ties go to the smaller document id,
then to row order; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablelens.llm.util import connected_components, materialize, slices, utf8
from tablelens.llm.wordhash import scramble, words

SHINGLE = 5
BINS = 96
BAND = 4
SKETCH_BITS = 16
IDF_SHARE = 0.25
LOW = (1 << 44) - 1
FILTER_BITS = 23
BLOCK_WEIGHT = 60_000  # of the documents that are judged together
MATRIX_CELLS = 2 ** 22  # of documents by elements at a time, 4 bytes each


def elements(piece: pa.RecordBatch):
    """(owner, element) of every shingle, sorted by both: 44 bits of the
    shingle's hash below its occurrence number in the text."""
    data, off = utf8(piece.column("text"))
    hashes, owner, _ = words(data, off)
    n_texts = len(off) - 1
    first = np.searchsorted(owner, np.arange(n_texts + 1))
    count = np.diff(first)
    mult = scramble(np.arange(1, SHINGLE + 1, dtype=np.uint64)) | np.uint64(1)
    keys, owners = [], []
    if len(hashes) >= SHINGLE:
        m = len(hashes) - SHINGLE + 1
        mixed = np.zeros(m, np.uint64)
        for k in range(SHINGLE):
            mixed += hashes[k:k + m] * mult[k]
        inside = owner[:m] == owner[SHINGLE - 1:]
        keys.append(mixed[inside])
        owners.append(owner[:m][inside])
    short = np.flatnonzero((count > 0) & (count < SHINGLE))
    if len(short):
        mixed = np.zeros(len(short), np.uint64)
        for k in range(SHINGLE - 1):
            has = count[short] > k
            mixed[has] += hashes[first[short[has]] + k] * mult[k]
        keys.append(mixed + count[short].astype(np.uint64))
        owners.append(short)
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), n_texts
    key = scramble(np.concatenate(keys)) >> np.uint64(20)
    own = np.concatenate(owners).astype(np.uint64)
    if n_texts < 1 << 20:
        packed = own << np.uint64(44) | key
        packed.sort()
        own, key = (packed >> np.uint64(44)).astype(np.int64), packed & np.uint64(LOW)
    else:
        order = np.lexsort((key, own))
        own, key = own[order].astype(np.int64), key[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1])
    at = np.flatnonzero(new)
    nth = np.arange(len(key)) - np.repeat(at, np.diff(np.append(at, len(key))))
    return own, key | nth.astype(np.uint64) << np.uint64(44), n_texts


def slot_of(element: np.ndarray) -> np.ndarray:
    return (element & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << SKETCH_BITS, np.int64)
    for batch in batches:
        for piece in slices(batch, "text"):
            _, element, _ = elements(piece)
            first = element[element <= np.uint64(LOW)]  # once per text
            counts += np.bincount(slot_of(first), minlength=len(counts))
    some = np.flatnonzero(counts)
    yield pa.record_batch([pa.array(some), pa.array(counts[some])], names=["slot", "n"])


def weights(texts: DataFrame) -> np.ndarray:
    """Weight of every sketch slot, from all texts."""
    rows = texts.mapInArrow(_sketch, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    n_texts = max(texts.count(), 2)
    counts = np.zeros(1 << SKETCH_BITS)
    counts[rows["slot"].to_numpy(np.int64)] = rows["n"]
    df = np.clip(counts - counts.mean(), 1, n_texts)
    return 1.0 + IDF_SHARE * np.log(n_texts / df) / np.log(n_texts)


def uniform(x: np.ndarray):
    """Two numbers in (0, 1) from each 64-bit hash."""
    return (((x >> np.uint64(32)).astype(np.float64) + 0.5) / 4294967296.0,
            ((x & np.uint64(0xFFFFFFFF)).astype(np.float64) + 0.5) / 4294967296.0)


def samples(own: np.ndarray, element: np.ndarray, n_texts: int, slot_weights: np.ndarray) -> np.ndarray:
    """Signature matrix (texts x BINS) of consistent weighted samples; a sample
    is named by the bits of its ``a``, which its shingle and level determine.
    Rows of texts without elements are zero."""
    out = np.zeros((n_texts, BINS), np.uint64)
    if not len(element):
        return out
    h = scramble(element * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    u1, u2 = uniform(h)
    u3, u4 = uniform(scramble(h + np.uint64(0x632BE59BD9B4E019)))
    r, c = -np.log(u1 * u2), -np.log(u3 * u4)
    h = scramble(h + np.uint64(0xD1B54A32D192ED03))
    b, _ = uniform(h)
    log_w = np.log(slot_weights[slot_of(element)])
    t = np.floor(log_w / r + b)
    a = (c * np.exp(-r * (t - b) - r)).astype(np.float32)
    bins = (scramble(h + np.uint64(7)) % np.uint64(BINS))
    packed = (own.astype(np.uint64) * np.uint64(BINS) + bins) << np.uint64(32) | a.view(np.uint32).astype(np.uint64)
    packed.sort()
    cell = (packed >> np.uint64(32)).astype(np.int64)
    first = np.ones(len(cell), bool)
    first[1:] = cell[1:] != cell[:-1]
    flat = out.reshape(-1)
    flat[cell[first]] = scramble(packed[first] & np.uint64(0xFFFFFFFF)) | np.uint64(1)
    rows = np.unique(own)
    sig = out[rows]
    full = sig != 0
    original = sig.copy()
    j = np.arange(BINS, dtype=np.uint64)
    for attempt in range(1, 4096):
        if full.all():
            break
        if attempt < 64:
            other = (scramble(j * np.uint64(4096) + np.uint64(attempt)) % np.uint64(BINS)).astype(np.int64)
        else:
            other = ((j + np.uint64(attempt)) % np.uint64(BINS)).astype(np.int64)
        borrowed = original[:, other]
        fill = ~full & (borrowed != 0)
        sig[fill] = borrowed[fill]
        full |= fill
    out[rows] = sig
    return out


def band_keys(texts: DataFrame, slot_weights: np.ndarray) -> DataFrame:
    """(node, keys): one key per band, for nodes with a word."""
    shared = texts.sparkSession.sparkContext.broadcast(slot_weights)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                own, element, n = elements(piece)
                sig = samples(own, element, n, shared.value)
                has = sig.any(axis=1)
                band = np.zeros((n, BINS // BAND), np.uint64)
                for k in range(BAND):
                    band = scramble(band + sig[:, k::BAND])
                band = scramble(band + np.arange(BINS // BAND, dtype=np.uint64)).view(np.int64)
                flat = pa.array(band[has].reshape(-1))
                offsets = pa.array(np.arange(has.sum() + 1, dtype=np.int32) * (BINS // BAND))
                yield pa.record_batch([piece.column("node").filter(pa.array(has)),
                                       pa.ListArray.from_arrays(offsets, flat)], names=["node", "keys"])

    return texts.mapInArrow(keys, "node long, keys array<long>")


def shingle_sets(texts: DataFrame) -> DataFrame:
    """(node, elements): sorted elements as unsigned 64-bit bytes."""
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                own, element, n = elements(piece)
                cut = np.searchsorted(own, np.arange(n + 1))
                raw = [np.sort(element[a:b]).tobytes() for a, b in zip(cut[:-1], cut[1:])]
                yield pa.record_batch([piece.column("node"), pa.array(raw, pa.binary())], names=["node", "elements"])

    return texts.mapInArrow(sets, "node long, elements binary")


def weighted_elements(sets: DataFrame, slot_weights: np.ndarray) -> DataFrame:
    """(element, node, weight) of every element of every node."""
    shared = sets.sparkSession.sparkContext.broadcast(slot_weights)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, node in zip(batch.column("elements").to_pylist(), batch.column("node").to_pylist()):
                element = np.frombuffer(raw, np.uint64)
                yield pa.record_batch([pa.array(element.view(np.int64)), pa.array(np.full(len(element), node, np.int64)),
                                       pa.array(shared.value[slot_of(element)])], names=["element", "node", "weight"])

    return sets.select("node", "elements").mapInArrow(rows, "element long, node long, weight double")


def rarest(sets: DataFrame, slot_weights: np.ndarray, least: float) -> DataFrame:
    """(element, node, weight): of each node the rarest elements that weigh more
    than 1 - ``least`` of it, as far as other nodes have them too; weight is
    the node's.  Rarity is the number of nodes among ``sets``, ties by value.
    A node whose own elements alone weigh that much has no partner and no row."""
    rows = materialize(weighted_elements(sets, slot_weights))
    count = rows.groupBy("element").agg(F.count("*").alias("df")).where("df > 1")
    common = materialize(rows.join(materialize(count), "element"))
    whole = rows.groupBy("node").agg(F.sum("weight").alias("whole"))
    spare = (common.groupBy("node").agg(F.sum("weight").alias("common")).join(whole, "node")
             .withColumn("spare", F.col("common") - least * F.col("whole") + 1e-9).where("spare >= 0")
             .select("node", "whole", "spare"))
    before = Window.partitionBy("node").orderBy("df", "element").rowsBetween(Window.unboundedPreceding, -1)
    return (common.join(materialize(spare), "node")
            .withColumn("before", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
            .where("before <= spare").select("element", "node", F.col("whole").alias("weight")))


def linked(pairs: DataFrame, sets: DataFrame, slot_weights: np.ndarray, least: float) -> DataFrame:
    """The pairs (a, b) whose weighted Jaccard similarity is at least ``least``."""
    shared = pairs.sparkSession.sparkContext.broadcast(slot_weights)
    both = (pairs.join(sets.select(F.col("node").alias("b"), F.col("elements").alias("eb")), "b")
            .join(sets.select(F.col("node").alias("a"), F.col("elements").alias("ea")), "a"))

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = shared.value
        for frame in frames:
            good = np.zeros(len(frame), bool)
            for i, (x, y) in enumerate(zip(frame["ea"], frame["eb"])):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                joint = np.intersect1d(x, y, assume_unique=True)
                common = w[slot_of(joint)].sum()
                union = w[slot_of(x)].sum() + w[slot_of(y)].sum() - common
                good[i] = common >= least * union - 1e-9
            yield frame.loc[good, ["a", "b"]]

    return both.select("a", "b", "ea", "eb").mapInPandas(judge, "a long, b long")


def clumped(rest: DataFrame, sets: DataFrame, slot_weights: np.ndarray, least: float) -> DataFrame:
    """The similar pairs (a, b) of different parts among ``rest`` (node, part).

    Nodes that share a prefix element are clumped together.  A clump is cut
    into blocks of bounded weight by weight class and hash; blocks of one or
    neighbouring classes are judged against each other, and only similar pairs
    leave a task.
    """
    spark = rest.sparkSession
    held = materialize(rarest(sets.join(rest.select("node"), "node"), slot_weights, least))
    lows = materialize(held.groupBy("element").agg(F.min("node").alias("low")))
    clumps = connected_components(held.join(lows, "element").select(F.col("node").alias("a"), F.col("low").alias("b")).distinct())
    heavy = held.select("node", "weight").distinct()
    mine = (materialize(clumps.withColumnRenamed("component", "clump")).join(rest, "node").join(heavy, "node")
            .withColumn("cls", F.floor(F.log("weight") / -F.log(F.lit(float(least)))).cast("int")))
    mine = materialize(mine)
    sizes = mine.groupBy("clump", "cls").agg(F.sum("weight").alias("w"), F.min("part").alias("p"), F.max("part").alias("q"))
    sizes = materialize(sizes.withColumn("subs", F.ceil(F.col("w") / BLOCK_WEIGHT).cast("long")).drop("w"))
    several = materialize(sizes.groupBy("clump").agg(F.min("p").alias("p"), F.max("q").alias("q")).where("p < q").select("clump"))
    dealt = (mine.join(sizes.select("clump", "cls", "subs"), ["clump", "cls"]).join(several, "clump")
             .withColumn("sub", F.pmod(F.xxhash64("node", F.lit(3)), F.col("subs"))))
    blocks = (dealt.join(sets, "node").groupBy("clump", "cls", "sub")
              .agg(F.collect_list(F.struct("node", "part", "elements")).alias("docs")))
    blocks = materialize(blocks)
    one = blocks.select("clump", F.col("cls").alias("ca"), F.col("sub").alias("sa"))
    two = blocks.select("clump", F.col("cls").alias("cb"), F.col("sub").alias("sb"))
    pairs = one.join(two, "clump").where("cb = ca + 1 or (cb = ca and sa <= sb)")
    pairs = materialize(pairs.repartition("clump", "ca", "sa", "cb", "sb"))
    wide = (pairs.join(blocks.select("clump", F.col("cls").alias("ca"), F.col("sub").alias("sa"), F.col("docs").alias("da")),
                       ["clump", "ca", "sa"])
            .join(blocks.select("clump", F.col("cls").alias("cb"), F.col("sub").alias("sb"), F.col("docs").alias("db")),
                  ["clump", "cb", "sb"]).select("da", "db"))
    shared = spark.sparkContext.broadcast(slot_weights)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for da, db in zip(batch.column("da").to_pylist(), batch.column("db").to_pylist()):
                found = similar_pairs(da, db, shared.value, least)
                yield pa.record_batch([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())],
                                      names=["a", "b"])

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "4")  # a row holds two blocks
    try:
        return materialize(wide.mapInArrow(judge, "a long, b long"))
    finally:
        spark.conf.set(key, before)


def similar_pairs(da: list, db: list, slot_weights: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Pairs (smaller, larger node) of different parts across two blocks."""
    def incidence(docs):
        each = [np.frombuffer(d["elements"], np.uint64) for d in docs]
        return each, np.array([slot_weights[slot_of(e)].sum() for e in each])

    (ea, wa), (eb, wb) = incidence(da), incidence(db)
    both = np.intersect1d(np.concatenate(ea), np.concatenate(eb))
    if not len(both):
        return []

    def places(each):
        row = np.repeat(np.arange(len(each)), [len(e) for e in each])
        all_e = np.concatenate(each)
        at = np.minimum(np.searchsorted(both, all_e), len(both) - 1)
        row, at = row[both[at] == all_e], at[both[at] == all_e]
        order = np.argsort(at, kind="stable")
        return row[order], at[order]

    def matrix(each, found, start, width):
        out = np.zeros((len(each), width), np.float32)
        row, at = found
        lo, hi = np.searchsorted(at, (start, start + width))
        out[row[lo:hi], at[lo:hi] - start] = 1.0
        return out

    # the elements in slices, so that the matrices stay small whatever the blocks hold
    at_a, at_b = places(ea), places(eb)
    step = max(64, MATRIX_CELLS // max(len(ea), len(eb)))
    common = np.zeros((len(ea), len(eb)), np.float32)
    for start in range(0, len(both), step):
        w = slot_weights[slot_of(both[start:start + step])].astype(np.float32)
        left = matrix(ea, at_a, start, len(w))
        left *= w
        common += left @ matrix(eb, at_b, start, len(w)).T
    likely = common >= (least - 1e-3) * (wa[:, None] + wb[None, :] - common)
    out = set()
    for i, j in zip(*np.nonzero(likely)):
        if da[i]["part"] != db[j]["part"]:
            exact = slot_weights[slot_of(np.intersect1d(ea[i], eb[j], assume_unique=True))].sum()
            if exact >= least * (wa[i] + wb[j] - exact) - 1e-9:
                out.add((min(da[i]["node"], db[j]["node"]), max(da[i]["node"], db[j]["node"])))
    return sorted(out)


def classes(docs: DataFrame, id_col="doc_id", text_col="text", least: float = 0.8) -> DataFrame:
    """(node, part, class_id, class_size): the class of every distinct text;
    part tells classes apart, class_id is the smallest document id in one.
    ``node`` is ``text_node`` of the text."""
    texts = docs.select(text_node(F.col(text_col)).alias("node"),
                        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ids = docs.select(F.col(id_col).alias("doc_id"), text_node(F.col(text_col)).alias("node"))
    w = weights(texts.select("text"))
    keyed = materialize(band_keys(texts, w))
    # equal texts have equal keys: one row per node
    bands = materialize(keyed.groupBy("node").agg(F.first("keys").alias("keys"))
                        .select("node", F.explode("keys").alias("key")))
    shared = bands.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    shared = materialize(bands.join(materialize(shared), "key"))
    # a bucket is compared with its hub, the member that meets most others anywhere
    hubs = materialize(shared.groupBy("node").agg(F.sum("m").alias("met")))
    shared = materialize(shared.join(hubs, "node").select("key", "node", F.struct("met", "node").alias("rank")))
    tops = materialize(shared.groupBy("key").agg(F.max("rank").alias("rank")).select("key", F.col("rank.node").alias("top")))
    met = materialize(shared.join(tops, "key").select("key", "node", "top"))
    wanted = hubs.select("node")
    sets = materialize(shingle_sets(
        likely(texts, wanted).join(wanted, "node").groupBy("node").agg(F.first("text").alias("text"))))
    star = met.where("node <> top").select(F.least("top", "node").alias("a"), F.greatest("top", "node").alias("b")).distinct()
    links = materialize(linked(star, sets, w, least))
    parts = materialize(connected_components(links))
    # members of buckets that still hold several components
    placed = met.join(parts, "node", "left").select("key", "node", F.coalesce("component", "node").alias("part"))
    mixed = (placed.groupBy("key").agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a < b").select("key"))
    rest = materialize(placed.join(materialize(mixed), "key", "left_semi").select("node", "part").distinct())
    more = clumped(rest, sets, w, least)
    if more.take(1):
        # the components found are stars already, which settles in fewer rounds
        stars = parts.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
        parts = materialize(connected_components(stars.union(more)))
    nodes = ids.groupBy("node").agg(F.min("doc_id").alias("low"), F.count("*").alias("copies"))
    nodes = materialize(nodes.join(parts, "node", "left").withColumn("part", F.coalesce("component", "node")))
    low = nodes.groupBy("part").agg(F.min("low").alias("class_id"), F.sum("copies").alias("class_size"))
    return materialize(nodes.join(low, "part").select("node", "part", "class_id", "class_size"))


def likely(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``texts`` whose node may be among ``wanted``: a bitmap of
    2**FILTER_BITS hashed nodes (at most 2 MB as rows of 64 bits) is broadcast,
    so that other texts are not shuffled for the join that follows."""
    slot = F.shiftrightunsigned(F.xxhash64("node", F.lit(5)), 64 - FILTER_BITS)
    bit = F.expr("shiftleft(1L, cast(__slot % 64 as int))")
    bits = (wanted.select(slot.alias("__slot")).select(F.floor(F.col("__slot") / 64).alias("__word"), bit.alias("__bit"))
            .groupBy("__word").agg(F.bit_or("__bit").alias("__bits")))
    return (texts.withColumn("__slot", slot).withColumn("__word", F.floor(F.col("__slot") / 64))
            .join(F.broadcast(bits), "__word").where(F.col("__bits").bitwiseAND(bit) != 0)
            .drop("__slot", "__word", "__bits"))


def text_node(text):
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def near_dedup(docs: DataFrame, id_col="doc_id", text_col="text", least: float = 0.8) -> DataFrame:
    """One row per document: doc_id, class_id, class_size, kept (the row is its
    class's smallest id)."""
    found = classes(docs, id_col, text_col, least)
    return (docs.select(F.col(id_col).alias("doc_id"), text_node(F.col(text_col)).alias("node"))
            .join(found, "node")
            .select("doc_id", "class_id", "class_size", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept")))


def one_per_class(docs: DataFrame, id_col="doc_id", text_col="text", least: float = 0.8) -> DataFrame:
    """``docs`` with one row of each class: the smallest id, of repeated rows
    the first."""
    columns = docs.columns
    named = materialize(docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)])
                        .withColumn("rid", F.monotonically_increasing_id()))
    ident, text = f"c{columns.index(id_col)}", f"c{columns.index(text_col)}"
    found = classes(named, ident, text, least)
    first = (named.select(F.col(ident).alias("doc_id"), "rid", text_node(F.col(text)).alias("node"))
             .join(found.select("node", "part"), "node")
             .groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "rid")).alias("f")))
    return (named.join(first.select(F.col("f.rid").alias("rid")), "rid", "left_semi")
            .select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)]))
