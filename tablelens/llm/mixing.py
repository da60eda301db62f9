"""Mixing sources to target weights: a low-discrepancy source schedule.

The mix is a sequence of slots.  Slot ``i`` takes the golden-ratio point
``frac(i * phi)`` (as a 32-bit fixed-point product, exact in integers), which
is mapped through the cumulative target weights to a source; the slots of one
source are ranked, and slot ``r`` of a source takes block ``r`` of that
source's shuffled word stream.  A block is ``block_words`` words of the
stream; a stream runs over its documents in hash order and starts again when
it ends, so a document is taken at most ``max_repeat`` times.

Targets are the sources' weight shares of all words; a target stops at
``max_repeat`` times its source's size and the excess is shared by weight.

Defined cases: null text has no words (size 0, nothing taken, but the row is
returned); a null source is a source of its own, last in order; repeated rows
are separate documents; an empty table gives an empty mix; extra columns are
ignored.  Ties in the shuffled order (rows equal in id and text) are between
interchangeable rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablelens.llm.util import global_rank, materialize, word_count, words_of

# Source weights in code point order, repeating.
WEIGHTS = (1, 2, 3)
GOLDEN = 2654435769  # floor(2**32 / golden ratio)
UNIT = 1 << 32
CELL = 1 << 20  # the unit interval has 4096 cells for the slot-to-source join


def source_key(source):
    """One never-null string per source: code point order, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def source_targets(sized: DataFrame, weights=WEIGHTS, max_repeat: int = 3) -> DataFrame:
    """One row per source: skey, n_docs, source_size, weight, target, quota.

    The level ``lam`` of ``target = min(cap, lam * weight)`` is found by
    repeated sharing over the per-source rows; the driver sees two sums a
    round.
    """
    per = sized.groupBy("skey").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    per = global_rank(per, [F.col("skey").asc()], "place")
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                        (F.col("place") % len(weights) + 1).cast("int"))
    per = materialize(per.select("skey", "place", "n_docs", "source_size", pick.alias("weight"),
                                 (F.col("source_size") * max_repeat).alias("cap")))
    total = per.agg(F.sum("source_size")).first()[0] or 0
    lam, held = 0.0, -1
    while total:
        capped = F.col("cap") <= F.lit(lam) * F.col("weight")
        got = per.agg(F.coalesce(F.sum(F.when(capped, F.col("cap"))), F.lit(0)).alias("caps"),
                      F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0.0)).alias("free"),
                      F.count(F.when(capped, 1)).alias("n")).first()
        if got["n"] == held or got["free"] == 0:
            break
        held, lam = got["n"], (total - got["caps"]) / got["free"]
    target = F.least(F.col("cap").cast("double"), F.lit(lam) * F.col("weight"))
    return materialize(per.select("skey", "place", "n_docs", "source_size", "weight", target.alias("target"),
                                  F.least(F.floor(target + 0.5), F.col("cap")).cast("long").alias("quota")))


def slot_schedule(spark, targets: DataFrame, block_words: int) -> DataFrame:
    """(skey, block, slot): slot number of every block each source needs."""
    need = targets.withColumn("need", F.ceil(F.col("quota") / block_words).cast("long")).where("need > 0")
    n_slots = need.agg(F.sum("need")).first()[0] or 0
    cum = global_rank(need.select("skey", "place", "need"), [F.col("place").asc()], "ord")
    w = Window.partitionBy(F.lit(0)).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    cum = cum.withColumn("upto", F.sum("need").over(w))
    edge = lambda c: F.floor(c / F.lit(float(max(n_slots, 1))) * UNIT).cast("long")
    cum = materialize(cum.select("skey", "need", edge(F.col("upto") - F.col("need")).alias("lo"),
                                 edge(F.col("upto")).alias("hi")))
    cells = cum.where("hi > lo").withColumn(
        "cell", F.explode(F.sequence(F.floor(F.col("lo") / CELL), F.floor((F.col("hi") - 1) / CELL))))
    slots = spark.range(n_slots).select(
        F.col("id").alias("slot"), ((F.col("id") % (1 << 31)) * GOLDEN).bitwiseAND(UNIT - 1).alias("point"))
    slots = slots.withColumn("cell", F.floor(F.col("point") / CELL))
    drawn = (slots.join(cells, "cell").where("point >= lo and point < hi")
             .select("skey", "slot", F.floor(F.col("slot") / 1024).alias("chunk"), "need"))
    # ranks inside chunks of the schedule, shifted by the counts of the chunks before
    per = drawn.groupBy("skey", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("skey").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("skey", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    local = Window.partitionBy("skey", "chunk").orderBy("slot")
    ranked = (drawn.withColumn("r", F.row_number().over(local) - 1).join(per, ["skey", "chunk"])
              .select("skey", (F.col("r") + F.col("before")).alias("block"), "slot", "need")
              .where("block < need").drop("need"))
    # the few blocks that the points left over follow at the end of the schedule
    got = drawn.groupBy("skey").agg(F.count("*").alias("got"))
    rest = (need.select("skey", "need", "place").join(got, "skey", "left")
            .withColumn("got", F.coalesce("got", F.lit(0))).where("got < need")
            .select("skey", F.explode(F.sequence(F.col("got"), F.col("need") - 1)).alias("block"),
                    (F.col("place") + n_slots).alias("slot")))
    return ranked.union(rest)


def stream_offsets(sized: DataFrame, targets: DataFrame, seed: int, group: int = 512) -> DataFrame:
    """Add ``at``: the words before a document in its source's shuffled stream.

    Documents are ordered by hash; running sums are taken inside hash ranges
    of about ``group`` documents and shifted by the sums of the ranges before,
    so a hot source is spread over many tasks.
    """
    h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "mark"), 32)
    docs = sized.join(targets, "skey").withColumn("h", h)
    ranges = F.ceil(F.col("n_docs") / group)
    docs = docs.withColumn("part", F.floor(F.col("h") / UNIT * ranges))
    sums = docs.groupBy("skey", "part").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("skey").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("skey", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    local = (Window.partitionBy("skey", "part").orderBy("h", "doc_id", "mark", "rid")
             .rowsBetween(Window.unboundedPreceding, -1))
    return (docs.withColumn("inside", F.coalesce(F.sum("size").over(local), F.lit(0)))
            .join(sums, ["skey", "part"])
            .withColumn("at", F.col("inside") + F.col("before"))
            .drop("inside", "before", "part", "h"))


def measured(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), word_count(F.col(text_col)).alias("size"),
                       source_key(F.col(source_col)).alias("skey"),
                       F.xxhash64(text_col).alias("mark"), F.col("__rid").alias("rid"))


def mix_blocks(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS,
               max_repeat: int = 3, block_words: int = 1024, seed: int = 17):
    """Plan a mix over ``docs``, whose ``__rid`` column names its rows.

    Returns (documents, pieces): documents has rid, doc_id, size, skey,
    source_size, target, quota, at; pieces has one row per run of a
    document's words in the mix: rid, epoch, slot, block, first (word of the
    document), words.
    """
    spark = docs.sparkSession
    sized = materialize(measured(docs, id_col, text_col, source_col))
    targets = source_targets(sized, weights, max_repeat)
    placed = materialize(stream_offsets(sized, targets, seed))
    laps = (placed.where("size > 0")
            .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max_repeat - 1))))
            .withColumn("start", F.col("epoch") * F.col("source_size") + F.col("at"))
            .withColumn("end", F.least(F.col("start") + F.col("size"), F.col("quota")))
            .where("end > start"))
    pieces = (laps.withColumn("block", F.explode(F.sequence(
        F.floor(F.col("start") / block_words), F.floor((F.col("end") - 1) / block_words))))
        .withColumn("lo", F.greatest("start", F.col("block") * block_words))
        .withColumn("hi", F.least("end", (F.col("block") + 1) * block_words))
        .select("rid", "skey", "epoch", "block", (F.col("lo") - F.col("start")).alias("first"),
                (F.col("hi") - F.col("lo")).alias("words")))
    pieces = pieces.join(slot_schedule(spark, targets, block_words), ["skey", "block"]).drop("skey")
    return placed, pieces


def with_row_names(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of ``docs`` written once with a row name, so that reruns of
    a task cannot rename rows."""
    return materialize(docs.select(*columns).withColumn("__rid", F.monotonically_increasing_id()))


def mix(docs: DataFrame, **options) -> DataFrame:
    """One row per document: rid, doc_id, size, source_size, target, taken."""
    placed, pieces = mix_blocks(docs, **options)
    taken = pieces.groupBy("rid").agg(F.sum("words").alias("taken"))
    return placed.join(taken, "rid", "left").select(
        "rid", "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", **options) -> DataFrame:
    """The documents of the mix, with the columns of ``docs``: one row per lap
    in which the mix takes a document.  A document that the mix takes in part
    keeps its first words of that lap, joined by single spaces (at most one
    per source)."""
    columns = docs.columns
    inner = {c: f"c{i}" for i, c in enumerate(columns)}
    named = with_row_names(docs.select(*[F.col(c).alias(k) for c, k in inner.items()]), list(inner.values()))
    roles = {"id_col": "doc_id", "source_col": "source"} | {k: v for k, v in options.items() if k.endswith("_col")}
    options = {k: v for k, v in options.items() if k not in roles} | {k: inner[v] for k, v in roles.items()}
    text = inner[text_col]
    placed, pieces = mix_blocks(named, text_col=text, **options)
    laps = pieces.groupBy("rid", "epoch").agg(F.sum("words").alias("__words"))
    laps = laps.join(placed.select("rid", "size"), "rid").select(
        F.col("rid").alias("__rid"), "__words", F.col("size").alias("__size"))
    out = named.join(laps, "__rid")
    part = F.array_join(F.slice(words_of(F.col(text)), 1, F.col("__words").cast("int")), " ")
    out = out.withColumn(text, F.when(F.col("__words") < F.col("__size"), part).otherwise(F.col(text)))
    if length_col in columns:
        out = out.withColumn(inner[length_col], F.char_length(text).cast(docs.schema[length_col].dataType))
    return out.select(*[F.col(k).alias(c) for c, k in inner.items()])
