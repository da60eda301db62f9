"""From documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of documents.  ``run`` writes every stage's result as
Parquet and reads it again as the next one's input.  So does whoever calls the
stages, one run at a time in a process: a stage removes the tables that earlier
stages left for their results to read, but for those its ``docs`` still reads.

1. language: documents without a recognised language (no text, no letter, or a
   code no shorter than a flat one in every learned language) go.
2. lines: repeated lines, and lines within one word of an earlier line, go.
3. near_duplicates: one document of each near-duplicate class stays.
4. mix: documents are taken to the sources' target weights; one row per lap in
   which the mix takes a document.
5. pack: pieces of the documents in sequences of at most 4096 tokens.

No stage reads other tables, so ``sf_dir`` is used by ``run`` alone.
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tablelens.llm import langid, line_dedup, mixing, near_dedup, packing
from tablelens.session import apply_required_conf, ensure_checkpoint_dir, materialize, ship_package, sweep, tidied

TOKENIZER = "word_bpe_49k.json"

# The stages score byte statistics, hash variants, sample shingles and solve a
# linear program; SQL cannot express them.
ORACLE_SQL = None

_LEFT: list[str] = []  # written tables that the last stage's result still reads


def _ready(spark: SparkSession) -> None:
    apply_required_conf(spark)
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def stage(fn):
    @functools.wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _ready(spark)
        sweep(spark, _LEFT, docs)
        return tidied(fn, _LEFT)(spark, docs, sf_dir)

    return run_stage


@stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.known_language(docs)


@stage
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.without_repeated_lines(docs)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.one_per_class(docs)


@stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path(TOKENIZER), hold=False)


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("mix", mix), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    _ready(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, step in STAGES[:-1]:
        docs = tidied(materialize, _LEFT)(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
