"""Removal of passages that repeat, by suffix order over bytes.

A byte is removed when it lies in a string of ``length`` bytes that also
starts anywhere else, in the same document or another; strings do not cross
documents and are judged on the input.

1. Every string of ``length`` bytes is owned by one of the ``CORE``-byte
   pieces inside it: the one of least hash, the leftmost of equal ones.  Equal
   strings are owned by equal pieces, so strings are compared only under
   equal owners.  The strings that one piece owns start in a row, and reach
   over the piece's context.
2. Owners that occur once are done.  Contexts that occur more than once as a
   whole (copies, however many) repeat from end to end and are grouped, never
   listed against each other.
3. What is left are contexts that occur once beside others of their owner.
   The contexts of an owner are ordered by ``suffix_order`` (the owner's piece
   as one symbol, since it is equal in all); neighbours that agree on
   ``length`` bytes repeat.  A group holds at most ``MOST`` contexts.
4. Owners with more different contexts than that are counted exactly string
   by string: hashes of the strings are grouped over all tasks.
5. The removed runs of a document are joined and cut from its bytes.

Defined cases: null text is empty; texts shorter than ``length`` lose nothing;
a run of one byte overlaps itself and goes; repeated rows remove each other;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.llm.suffix_order import suffix_order
from tablelens.llm.util import materialize, slices, utf8
from tablelens.llm.wordhash import BASE, BASE_2, scramble, span, sums

LENGTH = 400
CORE = 256
MOST = 512
PART = 1 << 19  # a longer text is looked at in overlapping parts
PLACE = np.uint64((1 << 24) - 1)


def owned(data: np.ndarray, off: np.ndarray, length: int, core: int):
    """Per owner: place, first and last string start it owns, hash of the
    piece, hash of the context; places are in ``data``."""
    n, width = len(data), length - core + 1
    empty = np.zeros(0, np.int64)
    if n < length:
        return empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    bytes_ = data.astype(np.uint64) + np.uint64(1)
    prefix = sums(bytes_, BASE)
    at = np.arange(n - core + 1)
    piece = scramble(span(prefix, at, at + core, BASE))
    key = (piece & ~PLACE) | at.astype(np.uint64)
    blocks = np.full(-(-len(key) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[:len(key)] = key
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    behind = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    starts = np.arange(n - length + 1)
    owner = (np.minimum(ahead[starts], behind[starts + width - 1]) & PLACE).astype(np.int64)
    text = np.repeat(np.arange(len(off) - 1), np.diff(off))[:len(starts)]
    inside = starts + length <= off[text + 1]
    starts, owner, text = starts[inside], owner[inside], text[inside]
    if not len(starts):
        return empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    new = np.ones(len(starts), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    own, lo, hi = owner[first], starts[first], starts[last]
    context = scramble(span(sums(bytes_, BASE_2), lo, hi + length, BASE_2) + (own - lo).astype(np.uint64) * np.uint64(BASE)
                       + (hi - lo).astype(np.uint64))
    return own, lo, hi, piece[own], context


def parts(piece: pa.RecordBatch, length: int):
    """(bytes, offsets, row of each text, place of each text in its row)."""
    data, off = utf8(piece.column("text"))
    if len(off) == 2 and len(data) > PART:
        for s in range(0, len(data) - length + 1, PART):
            part = data[s:s + PART + length - 1]
            yield part, np.array([0, len(part)]), np.zeros(1, np.int64), np.array([s])
    else:
        yield data, off, np.arange(len(off) - 1), np.zeros(len(off) - 1, np.int64)


OWNERS = T.StructType().add("piece", "long").add("context", "long").add("rid", "long").add("at", "long").add(
    "lo", "long").add("hi", "long")


def owners(named: DataFrame, length: int, core: int) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "text"):
                rid = some.column("rid").to_numpy()
                for data, off, row, base in parts(some, length):
                    own, lo, hi, piece, context = owned(data, off, length, core)
                    text = np.searchsorted(off, lo, side="right") - 1
                    shift = base[text] - off[text]
                    yield pa.record_batch(
                        [pa.array(piece.view(np.int64)), pa.array(context.view(np.int64)), pa.array(rid[row[text]]),
                         pa.array(own + shift), pa.array(lo + shift), pa.array(hi + shift)], names=OWNERS.names)

    return named.select("rid", "text").mapInArrow(rows, OWNERS)


def contexts(found: DataFrame, length: int, core: int, most: int) -> DataFrame:
    """Rows of the open contexts (text, list of them): for owners of at most
    ``most`` contexts the bytes before and behind the piece, for others one
    row per string with its hash."""
    fields = (T.StructType().add("piece", "long").add("string", "long").add("n", "long").add("rid", "long")
              .add("lo", "long").add("before", "binary").add("behind", "binary"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "text"):
                out: list[tuple] = []
                data, off = utf8(some.column("text"))
                prefix = None
                for i, (rid, open_) in enumerate(zip(some.column("rid").to_pylist(), some.column("open").to_pylist())):
                    raw = data[off[i]:off[i + 1]]
                    for x in open_:
                        if x["m"] <= most:
                            out.append((x["piece"], None, x["n"], rid, x["lo"], raw[x["lo"]:x["at"]].tobytes(),
                                        raw[x["at"] + core:x["hi"] + length].tobytes()))
                            continue
                        if prefix is None:
                            prefix = sums(data.astype(np.uint64) + np.uint64(1), BASE_2)
                        starts = np.arange(x["lo"], x["hi"] + 1)
                        strings = scramble(span(prefix, off[i] + starts, off[i] + starts + length, BASE_2)).view(np.int64)
                        out += [(x["piece"], w, x["n"], rid, s, None, None) for s, w in zip(starts.tolist(), strings.tolist())]
                cols = list(zip(*out)) if out else [()] * 7
                kinds = [pa.int64()] * 5 + [pa.binary()] * 2
                yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=fields.names)

    return found.select("rid", "text", "open").mapInArrow(rows, fields)


def repeats(group: list[tuple], length: int, core: int) -> list[tuple[int, int, int]]:
    """(rid, start, end) of the repeated runs in an owner's contexts, each
    (n, rid, lo, before, behind); contexts with n > 1 only lend their strings."""
    same = length - core + 1  # symbols of a string, its piece being one
    text: list[int] = []
    begin, last = [], []
    for _, _, _, before, behind in group:
        begin.append(len(text))
        text += [b + 1 for b in before]
        text.append(257)
        text += [b + 1 for b in behind]
        last.append(len(text) - same)
        text.append(0)
    member = np.repeat(np.arange(len(group)), np.diff([*begin, len(text)]))
    place = np.arange(len(text))
    is_string = place <= np.array(last)[member]
    order = np.array(suffix_order(text), np.int64)
    order = order[is_string[order]]
    if len(order) < 2:
        return []
    symbols = np.array(text + [0] * same, np.int16)
    view = np.lib.stride_tricks.sliding_window_view(symbols, same)
    agree = np.zeros(len(order), bool)
    for s in range(1, len(order), 1 << 14):
        e = min(s + (1 << 14), len(order))
        agree[s:e] = (view[order[s:e]] == view[order[s - 1:e - 1]]).all(axis=1)
    run = np.cumsum(~agree)
    many = np.array([g[0] > 1 for g in group])[member[order]]
    rid = np.array([g[1] for g in group])[member[order]]
    start = np.array([g[2] for g in group])[member[order]] + order - np.array(begin)[member[order]]
    size = run[-1] + 1
    lent = np.zeros(size, bool)
    lent[run[many]] = True
    # a run repeats when two of its strings stand at different places
    lows, highs = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for value in (rid, start):  # row names are any numbers, negative ones too
        lows[:] = np.iinfo(np.int64).max
        highs[:] = np.iinfo(np.int64).min
        np.minimum.at(lows, run, value)
        np.maximum.at(highs, run, value)
        lent |= lows < highs
    hit = lent[run] & ~many
    out: list[tuple[int, int, int]] = []
    for r, s in sorted(set(zip(rid[hit].tolist(), start[hit].tolist()))):
        if out and out[-1][0] == r and s <= out[-1][2]:
            out[-1] = (r, out[-1][1], s + length)
        else:
            out.append((r, s, s + length))
    return out


RUNS = T.StructType().add("rid", "long").add("start", "long").add("end", "long")


def ordered_groups(rows: DataFrame, length: int, core: int) -> DataFrame:
    """Repeated runs from the contexts of each owner, owner by owner."""
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, group = None, []

        def out(found):
            cols = list(zip(*found)) if found else [()] * 3
            return pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=RUNS.names)

        for batch in batches:
            found = []
            for piece, *context in zip(*(batch.column(c).to_pylist() for c in ("piece", "n", "rid", "lo", "before", "behind"))):
                if piece != held:
                    found += repeats(group, length, core) if len(group) > 1 else []
                    held, group = piece, []
                group.append(tuple(context))
            yield out(found)
        yield out(repeats(group, length, core) if len(group) > 1 else [])

    return rows.repartition("piece").sortWithinPartitions("piece").select(
        "piece", "n", "rid", "lo", "before", "behind").mapInArrow(runs, RUNS)


def repeated_runs(named: DataFrame, length: int = LENGTH, core: int = CORE, most: int = MOST) -> DataFrame:
    """(rid, start, end): runs of repeated bytes; they may overlap."""
    found = materialize(owners(named, length, core))
    again = materialize(found.groupBy("piece").agg(F.count("*").alias("k")).where("k > 1").select("piece"))
    met = materialize(found.join(again, "piece", "left_semi"))
    where = F.struct("rid", "lo", "hi", "at")
    kinds = materialize(met.groupBy("piece", "context").agg(F.count("*").alias("n"), F.min(where).alias("one")))
    whole = met.join(materialize(kinds.where("n > 1").select("piece", "context")), ["piece", "context"], "left_semi").select(
        "rid", F.col("lo").alias("start"), (F.col("hi") + length).alias("end"))
    per = materialize(kinds.groupBy("piece").agg(F.count("*").alias("m"), F.min("n").alias("least"))
                      .where("m > 1 and least = 1").select("piece", "m"))
    open_ = (kinds.join(per, "piece").groupBy(F.col("one.rid").alias("rid"))
             .agg(F.collect_list(F.struct("piece", "m", "n", F.col("one.lo").alias("lo"), F.col("one.hi").alias("hi"),
                                          F.col("one.at").alias("at"))).alias("open")))
    rows = materialize(contexts(named.select("rid", "text").join(open_, "rid"), length, core, most))
    few = ordered_groups(rows.where("string is null"), length, core)
    strings = rows.where("string is not null").select("piece", "string", "n", "rid", "lo")
    place = F.struct("rid", "lo")
    counted = materialize(strings.groupBy("piece", "string").agg(
        F.max("n").alias("most"), F.min(place).alias("a"), F.max(place).alias("b"))
        .where("most > 1 or a < b").select("piece", "string"))
    many = strings.where("n = 1").join(counted, ["piece", "string"], "left_semi").select(
        "rid", F.col("lo").alias("start"), (F.col("lo") + length).alias("end"))
    return whole.union(few).union(many)


def without_repeats(named: DataFrame, length: int = LENGTH, core: int = CORE, most: int = MOST) -> DataFrame:
    """One row per row of ``named`` (doc_id, text, rid): doc_id, n_bytes,
    n_removed, n_spans, kept_sha256, spans (start, end of the removed runs)."""
    named = named.select("rid", "doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    runs = materialize(repeated_runs(named, length, core, most))
    runs = runs.groupBy("rid").agg(F.collect_list(F.struct("start", "end")).alias("runs"))
    fields = (T.StructType().add("doc_id", named.schema["doc_id"].dataType).add("n_bytes", "long").add("n_removed", "long")
              .add("n_spans", "long").add("kept_sha256", "string")
              .add("spans", T.ArrayType(T.StructType().add("start", "long").add("end", "long"))))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for some in slices(batch, "text"):
                data, off = utf8(some.column("text"))
                removed, shas, spans = [], [], []
                for i, found in enumerate(some.column("runs").to_pylist()):
                    raw = data[off[i]:off[i + 1]]
                    joined: list[list[int]] = []
                    for s, e in sorted((x["start"], x["end"]) for x in found or ()):
                        if joined and s <= joined[-1][1]:
                            joined[-1][1] = max(joined[-1][1], e)
                        else:
                            joined.append([s, e])
                    sha, at = hashlib.sha256(), 0
                    for s, e in joined:
                        sha.update(raw[at:s])
                        at = e
                    sha.update(raw[at:])
                    removed.append(sum(e - s for s, e in joined))
                    shas.append(sha.hexdigest())
                    spans.append([{"start": s, "end": e} for s, e in joined])
                yield pa.record_batch(
                    [some.column("doc_id"), pa.array(np.diff(off)), pa.array(removed, pa.int64()),
                     pa.array([len(s) for s in spans], pa.int64()), pa.array(shas, pa.string()), pa.array(spans, span_type)],
                    names=fields.names)

    return named.join(runs, "rid", "left").select("doc_id", "text", "runs").mapInArrow(cut, fields)


def cut_text(raw: bytes, spans) -> bytes:
    """``raw`` without its spans (start, end; ascending, disjoint)."""
    kept, at = [], 0
    for s, e in spans:
        kept.append(raw[at:s])
        at = e
    return b"".join(kept) + raw[at:]
