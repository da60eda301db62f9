"""Packing token sequences by a configuration linear program.

Documents are tokenized on the executors and cut into pieces of at most
``seq_len`` tokens.  The histogram of piece lengths (at most ``seq_len``
numbers, whatever the corpus) is covered by configurations, multisets of
lengths that fit one sequence: ``min sum(x)`` such that every length is
covered as often as it occurs.  The program is solved by multiplicative
weights: lengths covered ahead of schedule get cheaper, and each round a
knapsack dynamic program over all capacities prices the best configuration
around every length.  The fractional solution is rounded to whole
configurations, fullest first; what rounding leaves over is placed by best
fit.  Pieces are ranked per length (per task, then over tasks) and look up
their sequence by rank.

Defined cases: null text is empty, an empty text is the end id alone; repeated
rows are separate documents; an empty table gives no rows; long texts are cut
at multiples of ``seq_len`` only; extra columns are ignored; which of two
pieces of one length goes where follows the order of the input files.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.llm.util import materialize, slices

# White space of the tokenizer's own rule (Unicode White_Space);
# characters that Python splits at and the tokenizer does not; words of plain
# Latin letters (one lower-case letter each, composed) and closing punctuation.
SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
NOT_SPACE = re.compile("[\x1c-\x1f]")
PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0132-\u0148\u014a-\u017f]+)([!-&(-/:-@\\[-`{-~]*)")
KEPT_WORDS = 600_000
_TOKENIZERS: dict = {}


class Words(dict):
    """Ids (little-endian unsigned 32-bit bytes) of white-space separated words.

    The tokenizer drops white space and merges inside words only, so a text's
    ids are its words' ids in order and each word is tokenized once per
    worker.  A plain word is a run of letters and a run of punctuation to the
    tokenizer, which its model then merges one by one; any other word goes
    through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.bytes_as_text = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.runs: dict[str, bytes] = {"": b""}

    def run(self, run: str) -> bytes:
        ids = self.runs.get(run)
        if ids is None:
            if len(self.runs) > KEPT_WORDS:
                self.runs = {"": b""}
            text = run if run.isascii() else self.bytes_as_text.pre_tokenize_str(run)[0][0]
            ids = self.runs[run] = array("I", [t.id for t in self.model.tokenize(text)]).tobytes()
        return ids

    def __missing__(self, word: str) -> bytes:
        plain = PLAIN.fullmatch(word)
        if plain:
            ids = self.run(plain[1].lower()) + self.run(plain[2])
        else:
            ids = array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        if len(self) > KEPT_WORDS:
            self.clear()
        self[word] = ids
        return ids

    def ids(self, text: str) -> bytes:
        parts = [w for w in SPACE.split(text) if w] if NOT_SPACE.search(text) else text.split()
        return b"".join(map(self.__getitem__, parts))

    def forget(self) -> None:
        self.clear()
        self.runs = {"": b""}


def _words(path: str) -> Words:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = Words(path)
    return _TOKENIZERS[path]


def piece_fields(id_type, with_ids: bool) -> T.StructType:
    fields = T.StructType().add("doc_id", id_type).add("piece", "integer").add("start", "long").add("length", "long")
    fields = fields.add("ids_crc32", "long").add("task", "long").add("nth", "long")
    return fields.add("ids", "binary") if with_ids else fields


def tokenize(docs: DataFrame, tokenizer: str, id_col="doc_id", text_col="text", seq_len: int = 4096,
             end_id: int = 1, with_ids: bool = False, hold: bool = True) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, the task
    and the place among the task's pieces of that length; with ``with_ids``
    also the ids as little-endian unsigned 32-bit bytes.  With ``hold`` a
    worker's words stay for its next task: less time, more memory."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(tokenizer)
        task = TaskContext.get().partitionId()
        nth = [0] * (seq_len + 1)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for part in slices(batch, "text"):
                rows = {k: [] for k in ("at", "piece", "start", "length", "crc", "nth", "ids")}
                for i, text in enumerate(part.column("text").to_pylist()):
                    ids = words.ids(text or "") + end
                    for k, lo in enumerate(range(0, len(ids), 4 * seq_len)):
                        raw = ids[lo:lo + 4 * seq_len]
                        n = len(raw) // 4
                        for name, v in zip(rows, (i, k, lo // 4, n, zlib.crc32(raw), nth[n], raw if with_ids else None)):
                            rows[name].append(v)
                        nth[n] += 1
                cols = [part.column("doc_id").take(pa.array(rows["at"], pa.int64())), pa.array(rows["piece"], pa.int32()),
                        *[pa.array(rows[c], pa.int64()) for c in ("start", "length", "crc")],
                        pa.array([task] * len(rows["at"]), pa.int64()), pa.array(rows["nth"], pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"]
                if with_ids:
                    cols.append(pa.array(rows["ids"], pa.binary()))
                    names.append("ids")
                yield pa.record_batch(cols, names=names)
        if not hold:
            words.forget()

    mine = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return mine.mapInArrow(cut, piece_fields(mine.schema["doc_id"].dataType, with_ids))


def knapsack(lengths: np.ndarray, price: np.ndarray, cap: int):
    """Best price for every capacity up to ``cap`` and the length taken there
    (0 where the last place stays empty)."""
    best, taken = np.zeros(cap + 1), np.zeros(cap + 1, np.int64)
    for c in range(1, cap + 1):
        k = int(np.searchsorted(lengths, c, side="right"))
        best[c], taken[c] = best[c - 1], 0
        if k:
            value = best[c - lengths[:k]] + price[:k]
            i = int(value.argmax())
            if value[i] > best[c]:
                best[c], taken[c] = value[i], lengths[i]
    return best, taken


def configurations(counts: dict[int, int], cap: int, rounds: int = 16, rate: float = 16.0) -> dict[tuple, float]:
    """Fractional cover of the histogram: configuration -> amount."""
    lengths = np.array(sorted(counts), np.int64)
    demand = np.array([counts[int(v)] for v in lengths], float)
    place = {int(v): i for i, v in enumerate(lengths)}
    weight, covered = np.ones(len(lengths)), np.zeros(len(lengths))
    amounts: dict[tuple, float] = {}
    for r in range(1, rounds + 1):
        _, taken = knapsack(lengths, lengths * weight, cap)
        for i in np.argsort(-lengths):
            short = demand[i] * r / rounds - covered[i]
            if short <= 0:
                continue
            items, room = [int(lengths[i])], cap - int(lengths[i])
            while room > 0:
                if taken[room]:
                    items.append(int(taken[room]))
                    room -= int(taken[room])
                else:
                    room -= 1
            config = {v: items.count(v) for v in set(items)} if len(items) < 50 else dict(
                zip(*[x.tolist() for x in np.unique(items, return_counts=True)]))
            x = short / config[int(lengths[i])]
            key = tuple(sorted(config.items(), reverse=True))
            amounts[key] = amounts.get(key, 0.0) + x
            for v, m in config.items():
                covered[place[v]] += m * x
        ahead = covered / demand - r / rounds
        weight = np.exp(-rate * np.clip(ahead, -2, 2))
    return amounts


def best_fit(left: dict[int, int], cap: int) -> list[tuple[dict[int, int], int]]:
    """Best fit, longest first, on groups of equal sequences."""
    groups: dict[int, list] = {}
    for v in sorted(left, reverse=True):
        n = left[v]
        for room in sorted(r for r in groups if r >= v):
            if not n:
                break
            waiting, groups[room] = groups[room], []
            for items, many in waiting:
                each = room // v
                full = min(many, n // each)
                if full:
                    groups.setdefault(room - each * v, []).append((items + [(v, each)], full))
                    n -= full * each
                    many -= full
                if many and n:
                    groups.setdefault(room - n * v, []).append((items + [(v, n)], 1))
                    many, n = many - 1, 0
                if many:
                    groups.setdefault(room, []).append((items, many))
        if n:
            each = cap // v
            if n // each:
                groups.setdefault(cap - each * v, []).append(([(v, each)], n // each))
            if n % each:
                groups.setdefault(cap - n % each * v, []).append(([(v, n % each)], 1))
    return [(dict(items), many) for waiting in groups.values() for items, many in waiting]


def plan(counts: dict[int, int], cap: int) -> list[tuple[dict[int, int], int]]:
    """Whole configurations that hold every piece of the histogram once."""
    left = {v: n for v, n in counts.items() if n and v < cap}
    chosen: list[tuple[dict[int, int], int]] = []
    if counts.get(cap):
        chosen.append(({cap: 1}, counts[cap]))
    if left:
        amounts = configurations(left, cap)
        fill = lambda key: sum(v * m for v, m in key)
        for key in sorted(amounts, key=lambda k: (-fill(k), -amounts[k], k)):
            if fill(key) < cap:
                break  # best fit does better with what is left than a sequence with a gap
            many = min(int(np.ceil(amounts[key])), *[left[v] // m for v, m in key])
            if many > 0:
                chosen.append((dict(key), many))
                for v, m in key:
                    left[v] -= m * many
        chosen += best_fit({v: n for v, n in left.items() if n}, cap)
    return chosen


def places(chosen: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """The plan as intervals of ranks per length, sorted by length and rank."""
    rows, following, sequence = [], {}, 0
    for config, many in chosen:
        at = 0
        for v, m in sorted(config.items(), reverse=True):
            first = following.get(v, 0)
            rows.append((v, first, m, at, sequence))
            following[v] = first + m * many
            at += v * m
        sequence += many
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "first", "copies", "at", "sequence"), cols))


def pack(docs: DataFrame, tokenizer: str, id_col="doc_id", text_col="text", seq_len: int = 4096, end_id: int = 1,
         with_ids: bool = False, hold: bool = True) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id,
    offset (and ids)."""
    spark = docs.sparkSession
    pieces = materialize(tokenize(docs, tokenizer, id_col, text_col, seq_len, end_id, with_ids, hold))
    per = materialize(pieces.groupBy("length", "task").agg(F.count("*").alias("n")))
    counts = {int(r[0]): int(r[1]) for r in per.groupBy("length").agg(F.sum("n")).collect()}
    table = places(plan(counts, seq_len))
    shared = spark.sparkContext.broadcast(table)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = (pieces.join(offsets, ["length", "task"])
              .withColumn("rank", F.col("nth") + F.col("before")).drop("nth", "before", "task"))
    keep = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        keys = t["length"] << 44 | t["first"]
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            i = np.searchsorted(keys, length << 44 | rank, side="right") - 1
            nth = rank - t["first"][i]
            sequence = t["sequence"][i] + nth // t["copies"][i]
            offset = t["at"][i] + nth % t["copies"][i] * length
            yield pa.record_batch([*[batch.column(c) for c in keep], pa.array(sequence), pa.array(offset)],
                                  names=[*keep, "sequence_id", "offset"])

    fields = T.StructType([ranked.schema[c] for c in keep]).add("sequence_id", "long").add("offset", "long")
    return ranked.select(*keep, "rank").mapInArrow(placed, fields)


def sequences(packed: DataFrame) -> DataFrame:
    """Token bytes of every sequence, from ``pack(..., with_ids=True)``: each
    group holds one sequence, at most seq_len ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(
        F.sum("length").alias("length"), parts.alias("parts")).select(
        "sequence_id", "length", F.col("parts.ids").alias("ids"))
