"""The pipeline's stages on whole small documents, odd rows and empty tables."""

import shutil

import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
import __spark_entry__ as entry
from tablelens.llm import packing
from tablelens.session import materialize


def test_stages_keep_the_columns_and_feed_each_other(spark, odd):
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == odd.columns, name
        docs = materialize(out)
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert rows and all(r["length"] <= 4096 for r in rows)
    assert {r["doc_id"] for r in rows} <= {1, None, 7, 8, 9, 11}


def test_stages_on_an_empty_table(spark, empty):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0, name


def test_run_is_the_stages(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert rows and len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)


def test_queries_are_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_texts_reach_workers_in_bounded_batches(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.nbytes])], names=["n"])

    corpus_pipeline._ready(spark)
    docs = spark.range(0, 40, 1, 1).select(F.repeat(F.lit("word "), 100_000).alias("text"))
    seen = [r["n"] for r in docs.mapInArrow(sizes, "n long").collect()]
    assert sum(seen) > 20_000_000 and max(seen) < 5_000_000


def test_pack_leaves_no_words_in_its_workers(spark, tmp_path):
    path = shutil.copy(public_tokenizers.path(corpus_pipeline.TOKENIZER), str(tmp_path))  # not held by an earlier test
    docs = spark.range(0, 200, 1, 1).select(F.col("id").alias("doc_id"), F.concat(F.lit("word"), "id").alias("text"))

    def held(batches):
        from tablelens.llm import packing

        for batch in batches:
            words = packing._words(path)
            yield pa.record_batch([pa.array([len(words) + len(words.runs)])], names=["n"])

    rows = {}
    for hold in (False, True):
        found = packing.tokenize(docs, path, hold=hold)
        rows[hold] = sorted(map(tuple, found.drop("task").collect()))
        left = [r["n"] for r in spark.range(0, 8, 1, 8).mapInArrow(held, "n long").collect()]
        assert (max(left) > 100) == hold
    assert rows[False] == rows[True]
