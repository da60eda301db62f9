"""Importance resampling, centroid clustering, permutation index and row names."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablelens.llm import centroid_clusters, importance, line_dedup, pivot_index, suffix_dedup
from tablelens.llm.util import row_names
from tests.llm.conftest import LONG_TEXT, LONG_WORD, odd_rows

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


# -- 11 importance resampling -----------------------------------------------------------

def grams(text, order):
    w = WORD.findall((text or "").translate(FOLD))
    return [" ".join(w[i:i + k]) for k in range(1, order + 1) for i in range(len(w) - k + 1)], len(w)


def plain_resample(docs, target, order=1, buckets=10_000, least_words=20, percent=10):
    hashed = lambda text: [zlib.crc32(g.encode()) % buckets for g in grams(text, order)[0]]
    s, t = collections.Counter(), collections.Counter()
    for _, text in docs:
        s.update(hashed(text))
    for text in target:
        t.update(hashed(text))
    ns, nt = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (ns + buckets) / ((s[b] + 1) * (nt + buckets))))
    out, enough = [], []
    for doc_id, text in docs:
        f = hashed(text)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(f), weight, score, None])
        if grams(text, 1)[1] >= least_words:
            enough.append(out[-1])
    enough.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(enough[:percent * len(enough) // 100]):
        r[4] = i + 1
    return collections.Counter(map(tuple, out))


def rows_of(df, *names):
    return collections.Counter(tuple(r[n] for n in names) for r in df.collect())


DRAWN = ("doc_id", "n_features", "weight", "score", "rank")


@pytest.mark.parametrize("order", [1, 3])
def test_resampling_against_a_plain_version(spark, small, order):
    target = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    docs = [(r[0], r[1]) for r in small.select("doc_id", "text").collect()]
    want = plain_resample(docs, [r["text"] for r in target.collect()], order)
    assert rows_of(importance.resample(small, target, order=order), *DRAWN) == want


@pytest.mark.parametrize("margin", [1e-9, 0.3])
def test_resampling_widens_a_bracket_that_missed(spark, small, margin):
    target = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    docs = [(r[0], r[1]) for r in small.select("doc_id", "text").collect()]
    want = plain_resample(docs, [r["text"] for r in target.collect()], percent=37)
    assert rows_of(importance.resample(small, target, percent=37, margin=margin), *DRAWN) == want


def test_resampling_odd_rows(odd, empty, small):
    target = odd.select("text")
    got = rows_of(importance.resample(odd, target, least_words=1, percent=60), *DRAWN)
    want = plain_resample([r[:2] for r in odd_rows()], [r[1] for r in odd_rows()], least_words=1, percent=60)
    tied = lambda c: collections.Counter(r[:4] for r in c.elements())
    assert tied(got) == tied(want) and sorted(r[4] for r in got.elements() if r[4]) == sorted(r[4] for r in want.elements() if r[4])
    assert importance.resample(empty, target).count() == 0
    assert importance.resample(small, empty).count() == small.count()


def test_ties_of_score_go_to_the_smaller_id_and_hot_copies_are_ranked(spark):
    docs = spark.createDataFrame([(7, "same text " * 15)] * 300 + [(i, f"other words{i} " * 12) for i in range(100)],
                                 "doc_id bigint, text string").repartition(5)
    plain = [(r[0], r[1]) for r in docs.collect()]
    target = spark.createDataFrame([("same text",)], "text string")
    assert rows_of(importance.resample(docs, target), *DRAWN) == plain_resample(plain, ["same text"])


def test_crc_of_spans():
    data = np.frombuffer(("añb" + LONG_WORD[:5000] + "xyz").encode(), np.uint8)
    start, end = np.array([0, 0, 1, 4, 4, 5003]), np.array([1, 4, 4, 52, 5004, 5007])
    assert importance.crc32_of(data, start, end).tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(start, end)]


def test_features_of_long_and_unusual_texts():
    from tablelens.llm.util import utf8
    import pyarrow as pa

    texts = ["", None, "É é A a-b", "x" * 70_000, LONG_TEXT[:20_000], "😀 z9_z", "  q  ", "a b", "c"]
    for order in (1, 2):
        data, off = utf8(pa.array(texts, pa.string()))
        found, n, words = importance.text_buckets(data, off, order, 1000)
        want = [[zlib.crc32(g.encode()) % 1000 for g in grams(t, order)[0]] for t in texts]
        assert n.tolist() == [len(w) for w in want] and words.tolist() == [grams(t, 1)[1] for t in texts]
        assert found.tolist() == [b for w in want for b in w]


# -- 12 centroid clustering ----------------------------------------------------------------

def plain_clusters(rows, dim, k, rounds=5):
    kept = [(i, [max(-2**27, min(2**27, math.floor(256 * x))) for x in v]) for i, v in rows
            if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest()
    raw = lambda v: np.array(v, "<i4").tobytes()
    c = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), raw(r[1])))[:k]]
    d = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((d(v, m), j) for j, m in enumerate(c))
    for _ in range(rounds):
        members = collections.defaultdict(list)
        for _, v in kept:
            members[near(v)[1]].append(v)
        c = [[sum(x) // len(members[j]) for x in zip(*members[j])] if members[j] else m for j, m in enumerate(c)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    total = collections.Counter()
    for _, j, away in found:
        total[j] += away
    sha = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    return collections.Counter((i, j, away, total[j], sum(total.values()), sha[j]) for i, j, away in found)


CLUSTER = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


@pytest.mark.parametrize("bits", [2, 6])
def test_clusters_against_a_plain_version(spark, bits):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + rng.normal(size=8) * 0.4).tolist()) for i in range(240)]
    rows += [(i, rows[0][1]) for i in range(500, 580)]  # copies
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(4)
    got = rows_of(centroid_clusters.cluster(df, dim=8, k=9, bits=bits, fit_rows=100), *CLUSTER)
    assert got == plain_clusters(rows, 8, 9)


ODD_VECTORS = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, []),
               (7, [1.0]), (8, [float("-inf"), 1.0]), (None, [0.25, -0.1]), (9, [1e300, -1e300]), (1, [2.0, 0.0]), (10, [-0.001, 3.0])]


@pytest.mark.parametrize("k", [3, 40])
def test_clusters_odd_rows(spark, k):
    df = spark.createDataFrame(ODD_VECTORS, "vec_id bigint, embedding array<double>").withColumn("cluster", F.lit("x"))
    got = rows_of(centroid_clusters.cluster(df, dim=2, k=k), *CLUSTER)
    assert got == plain_clusters(ODD_VECTORS, 2, k)
    none = centroid_clusters.cluster(df.where("false"), dim=2)
    assert none.count() == 0 and tuple(none.columns) == CLUSTER
    assert centroid_clusters.cluster(df, dim=5).count() == 0


def test_cells_spare_vectors_of_clear_clusters():
    rng = np.random.default_rng(1)
    centres = rng.integers(-400, 400, (5, 16))
    x = centres[np.arange(1000) % 5] + rng.integers(-20, 20, (1000, 16))
    cells = centroid_clusters.Cells(x[:200], x.min(axis=0), x.max(axis=0), 6)
    to, read = centroid_clusters.Lookup(cells, centres.astype(np.int64)).nearest(cells.of(x), x.astype(np.int32))
    assert (to == np.arange(1000) % 5).all() and read == 0


# -- 13 nearest neighbours -------------------------------------------------------------------

def plain_neighbours(rows, k, asked):
    ok = [(n, i, v) for n, (i, v) in enumerate(rows)
          if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for n, i, v in ok:
        if i is not None and asked(i):
            near = sorted((math.dist(v, w), j is None, j or 0, m) for m, j, w in ok if m != n and len(w) == len(v))[:k]
            out += [(i, r + 1, None if none else j, away) for r, (away, none, j, _) in enumerate(near)]
    return sorted(out, key=str)


FOUND = ("query_id", "rank", "vec_id", "score")


def same_answers(got, want):
    got = sorted(got.elements(), key=str)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert np.allclose([r[3] for r in got], [r[3] for r in want], rtol=1e-12, atol=0)


def test_neighbours_with_all_vectors_reranked(spark, monkeypatch):
    monkeypatch.setattr(pivot_index, "BLOCK", 32)
    monkeypatch.setattr(pivot_index, "GROUP", 4)
    rng = np.random.default_rng(2)
    rows = [(i, np.round(rng.normal(size=6), 1).tolist()) for i in range(200)]
    rows += [(1000 + i, rows[20][1]) for i in range(120)] + [(20, rows[20][1])]  # a hot vector that is asked for too
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(5)
    got = rows_of(pivot_index.search(df, F.col("vec_id") % 20 == 0, share=1.0, n_pivots=16, prefix=8), *FOUND)
    same_answers(got, plain_neighbours(rows, 10, lambda i: i % 20 == 0))


def test_neighbours_odd_rows(spark):
    df = spark.createDataFrame(ODD_VECTORS, "vec_id bigint, embedding array<double>").select(
        "*", *[F.lit("x").alias(c) for c in ("rid", "dim", "v", "entry", "score")])
    got = rows_of(pivot_index.search(df, F.col("vec_id") >= 0, k=3), *FOUND)
    same_answers(got, plain_neighbours(ODD_VECTORS, 3, lambda i: True))
    assert pivot_index.search(df.where("false"), F.col("vec_id") >= 0).count() == 0
    assert pivot_index.search(df, F.lit(None).cast("boolean")).count() == 0


def test_recall_of_the_index(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.select("vec_id", "embedding").toPandas()
    x, ids = np.stack(rows["embedding"].to_numpy()).astype(float), rows["vec_id"].to_numpy()
    found = collections.defaultdict(set)
    for r in pivot_index.search(df, F.col("vec_id") % 100 == 0).collect():
        found[r["query_id"]].add(r["vec_id"])
    hits = total = 0
    for n in np.flatnonzero(ids % 100 == 0):
        away = ((x - x[n]) ** 2).sum(axis=1)
        away[n] = np.inf
        want = set(ids[np.argsort(away, kind="stable")[:10]].tolist())
        hits, total = hits + len(want & found[int(ids[n])]), total + len(want)
    assert hits >= 0.9 * total


def test_no_vector_goes_through_the_driver(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, np.round(rng.normal(size=6), 1).tolist()) for i in range(200)]
    df = spark.createDataFrame(rows + rows[:50], "vec_id bigint, embedding array<double>").repartition(5)
    monkeypatch.setattr(pivot_index, "BLOCK", 32)
    monkeypatch.setattr(pivot_index, "GROUP", 4)
    inner, plans = pivot_index.materialize, []

    def noted(out):
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return inner(out)

    monkeypatch.setattr(pivot_index, "materialize", noted)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")  # whatever the session takes for small
    try:
        assert pivot_index.search(df, F.col("vec_id") % 20 == 0, k=3).count() == 3 * 13  # 3 of the 10 stand twice
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plans and not any("BroadcastExchange" in plan for plan in plans)


@pytest.mark.parametrize("run, team", [(2, 2), (50, 1), (1, 50)])
def test_neighbours_in_cells(spark, monkeypatch, run, team):
    for name, value in (("BLOCK", 8), ("GROUP", 4), ("RUN", run), ("TEAM", team), ("TASKS", 3)):
        monkeypatch.setattr(pivot_index, name, value)
    rng = np.random.default_rng(4)
    rows = [(i, rng.integers(-2, 3, 3).astype(float).tolist()) for i in range(300)]  # many ties, zero vectors too
    rows += [(1000 + i, rng.normal(size=3).tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(5)
    got = rows_of(pivot_index.search(df, F.col("vec_id") % 9 == 0, k=3, share=1.0, n_pivots=16, prefix=8), *FOUND)
    same_answers(got, plain_neighbours(rows, 3, lambda i: i % 9 == 0))


def test_blocks_and_groups_are_sent_once_a_cell(spark):
    side = lambda n: spark.range(n).selectExpr("id as block", *[f"binary('') as {c}" for c in ("entries", "vectors", "posted")])
    parts = pivot_index.in_cells(side(40), 40, side(35), 35).select("run", "team", "of", "block").rdd.glom().collect()
    assert sum(map(len, parts)) == 40 * 3 + 35 * 3
    met = collections.Counter()
    for part in parts:
        cell, held = None, []
        for r in part:
            cell, held = (r[:2], held if cell == r[:2] else [])
            if r["of"] == 0:
                held.append(r["block"])
            else:
                met.update((r["block"], group) for group in held)
    assert met == collections.Counter((b, g) for b in range(40) for g in range(35))


# -- names of rows -----------------------------------------------------------------------------

@pytest.mark.parametrize("which", ["lines", "repeats"])
def test_results_survive_other_file_splits_between_jobs(spark, tmp_path, monkeypatch, which):
    key = "spark.sql.files.maxPartitionBytes"
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(400)
    for part in range(3):
        docs.where(F.col("doc_id") % 3 == part).coalesce(1).write.option("parquet.block.size", "20000").mode(
            "append").parquet(str(tmp_path / "docs"))
    module = line_dedup if which == "lines" else suffix_dedup

    def run():
        table = row_names(spark.read.parquet(str(tmp_path / "docs"))).select("doc_id", "text", "rid")
        if which == "lines":
            return rows_of(line_dedup.line_dedup(table).withColumn("dropped", F.col("dropped").cast("string")), "doc_id", "n_near", "dropped")
        return rows_of(suffix_dedup.without_repeats(table), "doc_id", "n_removed", "kept_sha256")

    want = run()
    inner, calls = module.materialize, []

    def resplit(df):
        out = inner(df)
        calls.append(1)
        spark.conf.set(key, str(30_000 if len(calls) % 2 else 128 << 20))
        return out

    monkeypatch.setattr(module, "materialize", resplit)
    try:
        assert run() == want and len(calls) > 1
    finally:
        spark.conf.unset(key)
