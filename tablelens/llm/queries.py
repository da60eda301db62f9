"""The registered query of each operator, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from tablelens.llm import (centroid_clusters, embed_dedup, importance, langid, line_dedup, mixing, near_dedup, packing,
                           pii, pivot_index, quality, secret_scan, suffix_dedup)
from tablelens.llm.oracles import CLUSTERS, EMBEDDINGS, IMPORTANCE, LINES
from tablelens.llm.spans import joined
from tablelens.llm.util import read, row_names
from tablelens.session import tidied

QUERIES = {}
ORACLE_SQL: dict[str, str] = {"op2_embedding_near_dedup": EMBEDDINGS, "op4_line_dedup": LINES,
                              "op11_importance_resampling": IMPORTANCE, "op12_centroid_clustering": CLUSTERS}
TOKENIZER = "word_bpe_49k.json"


def query(fn):
    QUERIES[fn.__name__] = tidied(fn)
    return fn


@query
def op1_best_fit_packing(spark, sf_dir):
    """Pieces of all documents in sequences of at most 4096 tokens."""
    docs = read(spark, sf_dir, "documents")
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


@query
def op8_language_id(spark, sf_dir):
    """Predicted language of every document."""
    return langid.identify(read(spark, sf_dir, "documents"))


@query
def op10_source_mixing(spark, sf_dir):
    """Words that the mix takes from every document."""
    docs = read(spark, sf_dir, "documents")
    named = docs.withColumn("__rid", F.monotonically_increasing_id())
    return mixing.mix(named).drop("rid")


@query
def op4_line_dedup(spark, sf_dir):
    """Lines that every document loses: repeated ones, and those within one
    word of an earlier line."""
    docs = row_names(read(spark, sf_dir, "documents")).select("doc_id", "text", "rid")
    return line_dedup.line_dedup(docs).drop("rid")


@query
def op7_minhash_near_dedup(spark, sf_dir):
    """Near-duplicate class of every document."""
    return near_dedup.near_dedup(read(spark, sf_dir, "documents"))


@query
def op2_embedding_near_dedup(spark, sf_dir):
    """Links and component of every embedding."""
    return embed_dedup.embedding_dedup(read(spark, sf_dir, "embeddings"))


@query
def op3_pii(spark, sf_dir):
    """Personal data in every document, and the terms that reveal it."""
    found = pii.find(read(spark, sf_dir, "documents").select("doc_id", "text"))
    base = pii.all_spans(pii.KINDS)
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(pii.all_spans()).alias("spans"),
        F.size(pii.TERM).cast("long").alias("n_terms"))


@query
def op5_quality_rules(spark, sf_dir):
    """Base counts, base verdict and learned verdict of every document."""
    return quality.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op6_secret_scan(spark, sf_dir):
    """Secrets in every document, and tokens of a credential's format."""
    found = secret_scan.scan_secrets(read(spark, sf_dir, "documents"))
    named = lambda spans: F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"),
        F.element_at(F.array(*[F.lit(k) for k in (*secret_scan.KINDS, secret_scan.FORMAT)]), s["rank"] + 1).alias("kind")))
    counts = [F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long").alias(f"n_{kind}")
              for rank, kind in enumerate(secret_scan.KINDS)]
    return found.select(
        "doc_id", *counts, F.sha2(joined(named(F.col("base"))).cast("binary"), 256).alias("base_sha256"),
        joined(F.concat(named(F.col("base")), named(F.col("formats")))).alias("spans"),
        F.size("formats").cast("long").alias("n_format"))


@query
def op9_suffix_array_dedup(spark, sf_dir):
    """Bytes of every document that repeated passages of 400 bytes cover."""
    docs = row_names(read(spark, sf_dir, "documents")).select("doc_id", "text", "rid")
    return suffix_dedup.without_repeats(docs).drop("spans")


@query
def op11_importance_resampling(spark, sf_dir):
    """A tenth of the documents, drawn by importance for the benchmark texts."""
    return importance.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query
def op12_centroid_clustering(spark, sf_dir):
    """Cluster of every embedding after five rounds from 40 centroids."""
    return centroid_clusters.cluster(read(spark, sf_dir, "embeddings"))


@query
def op13_nearest_neighbours(spark, sf_dir):
    """The 10 nearest found of every embedding whose id is divisible by 100."""
    return pivot_index.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
