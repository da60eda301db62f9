"""Secrets: pattern spans, and tokens whose format is a credential's.

Base spans are assignments of secrets, access keys and long hexadecimal runs.
Their values are the labelled credentials: at most ``max_credentials`` per
kind (least hash first) teach one probabilistic automaton per kind, by merging
compatible states of their prefix tree (``grammar``); at most ``max_words`` of
the words of letters that all documents hold more than once teach a background.  Then every
run of 6 or more characters that an assigned value can hold, outside base
spans, is scored.  It is marked when, for some automaton, an example ends where
it ends, it is ``least_bits`` likelier than as an ordinary word, and it is as
likely as all but the least likely ``tail`` of that kind's examples of its
length (of any length, per character, where fewer than ``SAME`` have it).  An
example is rated without its own counts.

Texts are read twice, for the values that teach and for the spans, so that
candidates are scored where they are found and never stored.  Words are
counted out in a distributed distinct; only the sample of them is gathered.

Defined cases: null text is empty text; empty texts have no spans; a null id
stays null; with fewer than ``LEAST_EXAMPLES`` credentials a kind has no
automaton, and without any base spans stand alone; spans of different kinds
may overlap and all are returned, by start, then kind; of equal hashes the
smaller value or word teaches; very long tokens are scored whole; repeated
rows are separate rows; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.llm.grammar import Automaton, Background
from tablelens.llm.util import hash_sample, materialize, slices, words_of

# The base patterns in order of kind, and their least lengths.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ASSIGN_HINTS = ("password", "passwd", "secret", "token", "api")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{24,}+")
LEAST = {"assign": 6, "access": 20}
TOKEN = re.compile(f"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{{{LEAST['assign']},}}+")
MEMO = 1 << 17  # verdicts that a task keeps of tokens it has met
FORMAT = "format"
LEAST_EXAMPLES = 5  # distinct credentials that a kind needs for a format
SAME = 5  # examples of a length that make a scale of their own
ORDINARY = "^\\p{L}{1,40}\\p{P}*$"  # letters, then punctuation


def scan(text: str):
    """(base spans as (start, rank, end, value), candidate tokens as (start, end))."""
    base = []
    low = text.lower()
    if any(h in low for h in ASSIGN_HINTS):
        base += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    runs = [m.span() for m in TOKEN.finditer(text)]
    for start, end in runs:  # access keys and hexadecimal runs lie inside runs of token characters
        if end - start >= LEAST["access"]:
            base += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text, start, end)
                     if len(m[0]) >= LEAST["access"]]
            base += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text, start, end)]
    base.sort(key=lambda s: s[:3])
    free, k, reach = [], 0, 0  # reach: the furthest end of the base spans that start before the run's end
    for start, end in runs:
        while k < len(base) and base[k][0] < end:
            reach = max(reach, base[k][2])
            k += 1
        if reach <= start:
            free.append((start, end, text[start:end]))
    return base, free


SPAN = T.ArrayType(T.StructType().add("start", "long").add("rank", "integer").add("end", "long").add("value", "string"))


def _arrow(rows: list) -> pa.Array:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("end", pa.int64()), ("value", pa.string())]))
    return pa.array([[dict(zip(("start", "rank", "end", "value"), s)) for s in spans] for spans in rows], kind)


def scanned(docs: DataFrame, id_col: str, text_col: str, verdict=None) -> DataFrame:
    """doc_id, base and formats (arrays of start, rank, end, value): the tokens
    for which ``verdict``, a broadcast Scorer, holds."""
    mine = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bool] = {}

        def holds(token: str) -> bool:
            found = known.get(token)
            if found is None:
                if len(known) >= MEMO:
                    known.clear()
                found = verdict.value(token)
                if len(token) <= 64:
                    known[token] = found
            return found

        for batch in batches:
            for piece in slices(batch, "text"):
                base, formats = [], []
                for t in piece.column("text").to_pylist():
                    spans, free = scan(t or "")
                    base.append(spans)
                    formats.append([(s, len(KINDS), e, v) for s, e, v in free if holds(v)] if verdict else [])
                yield pa.record_batch([piece.column("doc_id"), _arrow(base), _arrow(formats)],
                                      names=["doc_id", "base", "formats"])

    fields = T.StructType([mine.schema["doc_id"]]).add("base", SPAN).add("formats", SPAN)
    return mine.mapInArrow(rows, fields)


def least_likely(bits: list[float], tail: float) -> float:
    """The ``tail`` quantile; beyond the least of examples too few to have one,
    by up to three of their standard deviations."""
    bits = sorted(bits)
    mean = sum(bits) / len(bits)
    spread = (sum((x - mean) ** 2 for x in bits) / len(bits)) ** 0.5
    return bits[int(tail * len(bits))] - 3 * spread * max(0.0, 1 - tail * len(bits))


class Scorer:
    def __init__(self, credentials: dict[str, list[str]], words: list[str], least_bits: float, tail: float):
        self.background = Background(words)
        self.least_bits = least_bits
        self.automata = {}
        for kind, values in credentials.items():
            model = Automaton(values)
            of_length: dict[int, list[float]] = {}
            for v in values:
                of_length.setdefault(len(v), []).append(model.score(v, known=True)[0])
            cut = lambda bits: least_likely(bits, tail)
            limits = {n: cut(bits) for n, bits in of_length.items() if len(bits) >= SAME}
            rate = cut([x / (n + 1) for n, bits in of_length.items() for x in bits])
            self.automata[kind] = (model, limits, rate)

    def __call__(self, token: str) -> bool:
        plain = None
        for model, limits, rate in self.automata.values():
            bits, ends = model.score(token)
            if not ends or bits < limits.get(len(token), rate * (len(token) + 1)):
                continue
            plain = self.background.log2(token) if plain is None else plain
            if bits - plain >= self.least_bits:
                return True
        return False


def ordinary_words(docs: DataFrame, text_col: str) -> DataFrame:
    """The words of letters that all texts hold more than once (w); what stands
    in one place only may be a credential itself."""
    words = docs.select(F.explode(words_of(F.col(text_col).cast("string"))).alias("w"))
    return words.groupBy("w").agg(F.count("*").alias("n")).where((F.col("n") > 1) & F.col("w").rlike(ORDINARY)).select("w")


def train(found: DataFrame, docs: DataFrame, text_col: str, max_credentials: int = 500,
          max_words: int = 20_000, least_bits: float = 16.0, tail: float = 0.02) -> Scorer | None:
    values = materialize(found.select(F.explode("base").alias("s")).select("s.rank", "s.value").distinct())
    credentials = {}
    for rank, kind in enumerate(KINDS):
        rows = hash_sample(values.where(F.col("rank") == rank), ["value"], max_credentials).collect()
        if len(rows) >= LEAST_EXAMPLES:
            credentials[kind] = [r["value"] for r in rows]
    if not credentials:
        return None
    words = hash_sample(materialize(ordinary_words(docs, text_col)), ["w"], max_words).collect()
    return Scorer(credentials, [r["w"] for r in words], least_bits, tail)


def scan_secrets(docs: DataFrame, id_col="doc_id", text_col="text", **options) -> DataFrame:
    """One row per document: doc_id, base and formats (arrays of start, rank,
    end, value)."""
    model = train(scanned(docs, id_col, text_col), docs, text_col, **options)
    shared = model and docs.sparkSession.sparkContext.broadcast(model)
    return scanned(docs, id_col, text_col, shared)


def masked(text: str, spans) -> str:
    """``text`` with its spans (start, end) blotted out."""
    out, at = [], 0
    for start, end in sorted(spans):
        if end > at:
            out += [text[at:max(at, start)], "<SECRET>"]
            at = end
    return "".join(out) + text[at:]
