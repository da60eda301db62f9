"""Quality rules: fixed base rules and a learned decision list.

Features are Spark expressions over the words and lines of a whole text.  The
list is learned by sequential covering from labelled rows: a rule is a
conjunction of thresholds that grows by information gain on two thirds of the
rows and is pruned on the rest; it is kept when it is precise enough there,
and the rows it covers leave before the next rule grows.  At most
``max_rows`` labelled rows (least hash of the id first) are fitted on; their
binned features are what the driver sees.  The rules become one ordered
``CASE WHEN`` over the features of all rows.

Defined cases: null text has no words; texts under 20 words, or with over 30
per cent of their words in repeated 8-word windows, fail the base rules; rows
without a label are judged, not learned from; ids labelled twice count twice;
without usable labels the list is empty and base rules decide alone; repeated
rows are separate rows; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens.llm.util import WS, hash_sample, materialize, words_of

# The symbol characters, the window of repeated words and the base rules' limits.
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT = 30
FEATURES = ("mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share",
            "shout_share", "distinct_share")


def _without(text: Column, chars: str) -> Column:
    return F.char_length(F.translate(text, chars, ""))


def measure(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, the five counts and FEATURES of every row."""
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    df = df.withColumn("w", words_of(F.col("t")))
    df = df.withColumn("lines", F.filter(F.split("t", "\n", -1), lambda x: F.btrim(x, F.lit(WS)) != ""))
    hashes = F.when(F.size("w") >= WINDOW, F.transform(
        F.sequence(F.lit(1), F.size("w") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("w", i, WINDOW)))).otherwise(
        F.array().cast("array<bigint>"))
    df = df.withColumn("h", hashes)
    some = F.size(F.array_distinct("h")) < F.size("h")
    by_hash = F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    df = df.withColumn("s", F.when(some, by_hash))
    again = F.expr("""filter(transform(s, (e, j) ->
        CASE WHEN e.h = get(s, j - 1).h OR e.h = get(s, j + 1).h THEN e.i END), x -> x IS NOT NULL)""")
    df = df.withColumn("p", F.when(F.col("s").isNotNull(), F.array_sort(again)))
    covered = F.expr(f"""aggregate(transform(p, (x, j) ->
        least({WINDOW}, coalesce(get(p, j + 1), x + {WINDOW}) - x)), 0, (a, x) -> a + x)""")
    length = F.char_length("t")
    words = F.size("w")
    per = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    df = df.select(
        "doc_id", words.cast("long").alias("n_words"), _without(F.col("t"), WS).cast("long").alias("word_chars"),
        (length - _without(F.col("t"), SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").alias("n_lines"), F.size(F.array_distinct("w")).alias("n_distinct"),
        (length - _without(F.col("t"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).alias("n_upper"),
        (length - _without(F.col("t"), "0123456789")).alias("n_digits"),
        (length - _without(F.col("t"), "!?")).alias("n_shouts"))
    n, chars = F.col("n_words"), F.col("word_chars")
    return df.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        per(chars, n).alias("mean_word"), per(F.col("n_symbols"), n).alias("symbol_share"),
        per(F.col("n_dup_lines"), F.col("n_lines")).alias("dup_line_share"),
        per(F.col("n_repeat_words"), n).alias("repeat_share"), per(F.col("n_upper"), chars).alias("upper_share"),
        per(F.col("n_digits"), chars).alias("digit_share"), per(F.col("n_shouts"), n).alias("shout_share"),
        per(F.col("n_distinct"), n).alias("distinct_share"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT)


def labelled(measured: DataFrame, labels: DataFrame, id_col: str, label_col: str, max_rows: int) -> list:
    """At most ``max_rows`` labelled rows that pass the base rules: (bad, part, features)."""
    marks = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("doc_id"), (F.col(label_col) == 0).alias("bad"))
    rows = materialize(measured.where(~base_failed()).join(marks, "doc_id").select("doc_id", "bad", *FEATURES))
    part = F.pmod(F.xxhash64(F.xxhash64("doc_id")), F.lit(3))
    return hash_sample(rows, ["doc_id"], max_rows).select("bad", part.alias("part"), *FEATURES).collect()


def thresholds(rows: list, steps: int = 24) -> list[tuple[str, float]]:
    """Cut points per feature: equally frequent values of the bad rows and of all."""
    cuts = []
    for f in FEATURES:
        values = set()
        for group in (rows, [r for r in rows if r["bad"]]):
            ordered = sorted(r[f] for r in group)
            values |= {ordered[min(len(ordered) - 1, k * len(ordered) // steps)] for k in range(1, steps)} if ordered else set()
        cuts += [(f, v) for v in sorted(values)]
    return cuts


def _holds(row, rule) -> bool:
    return all(row[f] >= v if op == ">=" else row[f] < v for f, op, v in rule)


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def grow(rows: list, cuts: list, longest: int) -> list:
    """Add the condition of the greatest information gain until only bad rows are left."""
    rule: list = []
    while len(rule) < longest:
        p0 = sum(r["bad"] for r in rows)
        n0 = len(rows) - p0
        if not p0 or not n0:
            break
        best, taken = 1e-9, None
        for f in FEATURES:
            ordered = sorted((r[f], r["bad"]) for r in rows)
            mine, at, p, n = [v for g, v in cuts if g == f], 0, 0, 0  # p, n: rows below the cut
            for v in mine:
                while at < len(ordered) and ordered[at][0] < v:
                    p += ordered[at][1]
                    n += not ordered[at][1]
                    at += 1
                for op, a, b in (("<", p, n), (">=", p0 - p, n0 - n)):
                    if (g := _gain(a, b, p0, n0)) > best:
                        best, taken = g, (f, op, v)
        if taken is None:
            break
        rule.append(taken)
        rows = [r for r in rows if _holds(r, [taken])]
    return rule


def learn(rows: list, longest: int = 4, most: int = 12, precision: float = 0.97, least: int = 5) -> list:
    """Ordered rules, each a list of (feature, ">=" or "<", value) that name bad rows."""
    cuts = thresholds(rows)
    growing = [r for r in rows if r["part"] != 0]
    pruning = [r for r in rows if r["part"] == 0]
    rules: list = []
    while len(rules) < most:
        rule = grow(growing, cuts, longest)
        if not rule:
            break

        def worth(cut):
            hit = [r["bad"] for r in pruning if _holds(r, cut)]
            return (2 * sum(hit) - len(hit)) / len(hit) if hit else -1.0

        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=worth)
        hit = [r["bad"] for r in growing + pruning if _holds(r, rule)]
        if len(hit) < least or sum(hit) < precision * len(hit) or worth(rule) < 2 * precision - 1:
            break
        rules.append(rule)
        growing = [r for r in growing if not _holds(r, rule)]
        pruning = [r for r in pruning if not _holds(r, rule)]
    return rules


def verdict(rules: list) -> Column:
    """Ordered conditional expression: false where a rule fires first, else true."""
    out = None
    for rule in rules:
        fires = F.lit(True)
        for f, op, v in rule:
            fires = fires & (F.col(f) >= F.lit(float(v)) if op == ">=" else F.col(f) < F.lit(float(v)))
        out = F.when(fires, False) if out is None else out.when(fires, False)
    return F.lit(True) if out is None else out.otherwise(True)


def judge(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="quality",
          max_rows: int = 20_000) -> DataFrame:
    """One row per document: doc_id, the counts, base_failed, kept and the features."""
    measured = materialize(measure(docs, id_col, text_col))
    rules = learn(labelled(measured, labels, id_col, label_col, max_rows))
    return measured.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *FEATURES)
