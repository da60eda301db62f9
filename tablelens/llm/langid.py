"""Language identification by prediction by partial matching (PPM).

Training counts every byte with its ``ORDER`` preceding bytes, per language,
over all labelled documents (numpy per task, one grouped sum in Spark).  The
lower orders are marginals of these counts.  Frozen statistics give each
language a variable-order context tree with escape method C: a byte seen
after its context costs ``-log2(n / (total + distinct))``; otherwise the
escape ``distinct / (total + distinct)`` is paid and the next shorter context
is asked, down to a flat 8 bits.  A text's code length is the exact sum over
its bytes; the shortest code names the language, and ``score`` is that
language's share when each is weighed by 2 ** -(bits per byte), so that it does
not saturate with the length of the text.

The classifier is fitted on whole labelled texts of at most about ``FIT_BYTES``
bytes, shared equally by the languages (a language with less gives all it has;
rows are taken by a hash of id and text, never cut).  So the model, which goes through the
driver to the tasks, is bounded by that parameter: its contexts are at most as
many as the bytes it was fitted on.  Scoring covers all texts in whole.

Defined cases: null, empty and letterless texts are ``und`` with score 0, as
is every text when nothing was learned; rows without language are not learned
from; ties in code length go to the language first by code point; repeated
rows count and are predicted separately; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens.llm.util import slices, utf8

ORDER = 3
UND = "und"
# Bytes of labelled text to fit on, over all languages.
FIT_BYTES = 24 << 20
# Bits a byte beyond which no learned language explains a text: those of a flat code.
MOST_BITS = 8.0


def padded(batch: pa.RecordBatch, column: str):
    """Bytes with ORDER zero bytes before each text; positions of the text
    bytes' (ORDER + 1)-grams and the offsets of the texts among them."""
    data, off = utf8(batch.column(batch.schema.get_field_index(column)))
    n = len(off) - 1
    at = np.arange(len(data), dtype=np.int64) + ORDER * np.repeat(np.arange(1, n + 1), np.diff(off))
    buf = np.zeros(len(data) + ORDER * n, np.uint8)
    buf[at] = data
    grams = buf.astype(np.uint32)
    for k in range(1, ORDER + 1):
        grams[k:] |= buf[:-k].astype(np.uint32) << np.uint32(8 * k)
    return grams[at], off


def runs(sorted_values: np.ndarray):
    """Distinct values of a sorted array and their counts."""
    if not len(sorted_values):
        return sorted_values, np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1])))
    return sorted_values[first], np.diff(np.append(first, len(sorted_values)))


def _merge(parts):
    keys = np.concatenate([p[0] for p in parts])
    counts = np.concatenate([p[1] for p in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, int)
    return keys[first], (np.add.reduceat(counts, first) if len(first) else counts)


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list] = {}
    for batch in batches:
        for piece in slices(batch, "text"):
            grams, off = padded(piece, "text")
            langs = np.asarray(piece.column("lang").to_pylist(), dtype=object)
            for lang in dict.fromkeys(langs):
                pick = np.repeat(langs == lang, np.diff(off))
                mine = np.sort(grams[pick])
                parts = held.setdefault(lang, [])
                parts.append(runs(mine))
                if len(parts) >= 16:
                    held[lang] = [_merge(parts)]
    for lang, parts in held.items():
        keys, counts = _merge(parts)
        yield pa.record_batch([pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64)),
                               pa.array(counts.astype(np.int64))], names=["lang", "gram", "n"])


def fit_sample(labelled: DataFrame, fit_bytes: int) -> DataFrame:
    """Rows (id, text, lang) whose texts hold about ``fit_bytes`` bytes at most,
    the same share of them for every language."""
    per = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(
        F.sum(F.octet_length("text")).alias("n")).collect()}  # a row a language
    left, share = fit_bytes, {}
    for i, lang in enumerate(sorted(per, key=per.get)):  # what small ones leave goes to the others
        most = left / (len(per) - i)
        share[lang] = min(1.0, most / max(1, per[lang]))
        left -= share[lang] * per[lang]
    u = F.shiftrightunsigned(F.xxhash64("id", "text"), 32)
    keep = F.lit(False)
    for lang, part in share.items():
        keep = keep | ((F.col("lang") == lang) & (u < int(part * (1 << 32))))
    return labelled.where(keep) if any(part < 1 for part in share.values()) else labelled


def gram_counts(parts: DataFrame) -> DataFrame:
    """(lang, gram, n) over the rows (text, lang)."""
    return (parts.select("text", "lang").mapInArrow(_count_grams, "lang string, gram long, n long")
            .groupBy("lang", "gram").agg(F.sum("n").alias("n")))


class Trees:
    """Frozen context trees of all languages, as cost tables in bits."""

    def __init__(self, counts: pd.DataFrame):
        self.langs = sorted(counts["lang"].unique())
        width = len(self.langs)
        tables = []  # per order: keys (order + 1 bytes), counts by language
        lang = counts["lang"].map({v: i for i, v in enumerate(self.langs)}).to_numpy()
        gram, n = counts["gram"].to_numpy(np.int64), counts["n"].to_numpy(np.float64)
        for order in range(ORDER + 1):
            keys, place = np.unique(gram & ((1 << 8 * (order + 1)) - 1), return_inverse=True)
            table = np.zeros((len(keys), width))
            np.add.at(table, (place, lang), n)
            tables.append((keys, table))
        lower = None  # cost of a key one byte shorter
        self.levels = []
        for order, (keys, table) in enumerate(tables):
            ctx, place = np.unique(keys >> 8, return_inverse=True)
            total, distinct = np.zeros((len(ctx), width)), np.zeros((len(ctx), width))
            np.add.at(total, place, table)
            np.add.at(distinct, place, (table > 0).astype(float))
            whole = total + distinct
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(distinct / whole), 0.0)
                seen = -np.log2(table / whole[place])
            shorter = np.full((len(keys), width), 8.0) if order == 0 else lower(keys & ((1 << 8 * order) - 1))
            cost = np.where(table > 0, seen, escape[place] + shorter)
            level = {"keys": keys, "cost": cost, "ctx": ctx, "escape": escape, "shift": 8 * order}
            if order == ORDER:  # a direct table for the keys, the most frequent first
                slots = np.full(1 << 21, -1, np.int32)
                by_use = np.argsort(table.sum(axis=1), kind="stable")  # later writes win
                slots[self.slot(keys[by_use])] = by_use
                level["slots"] = slots
            self.levels.append(level)
            lower = lambda k, o=order: self.cost(k, o)

    @staticmethod
    def slot(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B1)) & np.uint64(0xFFFFFFFF)) >> np.uint64(11)

    def cost(self, keys: np.ndarray, order: int) -> np.ndarray:
        """Bits of each key's last byte after its ``order`` bytes, by language."""
        keys = keys.astype(np.int64)
        out = np.empty((len(keys), len(self.langs)))
        if order < 0:
            out[:] = 8.0
            return out
        level = self.levels[order]
        at = np.minimum(np.searchsorted(level["keys"], keys), len(level["keys"]) - 1)
        hit = level["keys"][at] == keys
        out[hit] = level["cost"][at[hit]]
        if not hit.all():
            miss = keys[~hit]
            ctx = np.minimum(np.searchsorted(level["ctx"], miss >> 8), len(level["ctx"]) - 1)
            known = (level["ctx"][ctx] == miss >> 8)[:, None]
            out[~hit] = np.where(known, level["escape"][ctx], 0.0) + self.cost(
                miss & ((1 << level["shift"]) - 1), order - 1)
        return out

    def bits(self, grams: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Code length of each text (rows) in each language (columns)."""
        out = np.zeros((len(off) - 1, len(self.langs)))
        if not len(grams):
            return out
        level = self.levels[ORDER]
        at = level["slots"][self.slot(grams)]
        hit = level["keys"][at] == grams
        cost = level["cost"][at]
        if not hit.all():
            cost[~hit] = self.cost(grams[~hit], ORDER)
        some = np.flatnonzero(np.diff(off))
        out[some] = np.add.reduceat(cost, off[some], axis=0)
        return out


def train(rows: DataFrame, fit_bytes: int = FIT_BYTES) -> Trees | None:
    """Trees over the rows (id, text, lang), or over a sample of ``fit_bytes``."""
    labelled = rows.where("text is not null and lang is not null").select(
        "id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    frame = gram_counts(fit_sample(labelled, fit_bytes)).toPandas()  # at most fit_bytes rows
    return Trees(frame) if len(frame) else None


def predict(docs: DataFrame, trees: Trees | None, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and bits (of the best code, per byte) in
    place of columns of those names."""
    keep = [c for c in docs.columns if c not in ("lang_pred", "score", "bits")]
    letter = F.coalesce(F.col(text_col).rlike("\\p{L}"), F.lit(False))
    if trees is None:
        return docs.select(*keep, F.lit(UND).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(8.0).alias("bits"))
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.asarray(model.langs, dtype=object)
        for batch in batches:
            for piece in slices(batch, text_col):
                grams, off = padded(piece, text_col)
                bits = model.bits(grams, off)
                best = bits.argmin(axis=1)
                bits = bits / np.maximum(1, np.diff(off))[:, None]
                least = bits.min(axis=1, keepdims=True)
                share = 1.0 / np.exp2(least - bits).sum(axis=1)
                has = np.asarray(piece.column("__letter").to_numpy(zero_copy_only=False), bool)
                pred = np.where(has, names[best], UND)
                cols = [piece.column(c) for c in keep]
                yield pa.record_batch([*cols, pa.array(pred.tolist(), pa.string()),
                                       pa.array(np.where(has, share, 0.0)), pa.array(least[:, 0])],
                                      names=[*keep, "lang_pred", "score", "bits"])

    fields = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double").add("bits", "double")
    return docs.select(*keep, letter.alias("__letter")).mapInArrow(scored, fields)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def taught(docs: DataFrame, id_col: str, text_col: str, lang_col: str, fit_bytes: int) -> Trees | None:
    """Trees learned from the rows that are not held out."""
    rows = docs.where(~held_out(F.col(id_col)))
    return train(rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")),
                 fit_bytes)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             fit_bytes: int = FIT_BYTES) -> DataFrame:
    """Learn from the rows that are not held out, predict all: id, held_out,
    lang_pred, score, bits.  Language, source and id are no inputs of a prediction."""
    mine = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"),
                       F.col(text_col).alias("text"))
    trees = taught(docs, id_col, text_col, lang_col, fit_bytes)
    return predict(mine, trees).select("doc_id", "held_out", "lang_pred", "score", "bits")


def known_language(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
                   most_bits: float = MOST_BITS, fit_bytes: int = FIT_BYTES) -> DataFrame:
    """Documents whose language is recognised, with the columns of ``docs``.

    ``und`` (no text, no letter) goes, and so does a text for which the best
    language's code takes more than ``most_bits`` bits a byte.  Where no row
    teaches a language, every text with a letter stays.
    """
    trees = taught(docs, id_col, text_col, lang_col, fit_bytes)
    renamed = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)])
    text = f"c{docs.columns.index(text_col)}"
    if trees is None:
        out = renamed.where(F.col(text).rlike("\\p{L}"))
    else:
        out = predict(renamed, trees, text).where((F.col("lang_pred") != UND) & (F.col("bits") <= most_bits))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
