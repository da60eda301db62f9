"""Spans of pattern matches as Column expressions (code points, end exclusive)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "array<struct<start:bigint,end:bigint,found:string>>"
NO_TEXTS = "array<string>"


def add_matches(df: DataFrame, text: str, name: str, pattern, when: Column | None = None) -> DataFrame:
    """Add ``name``: the leftmost non-overlapping matches of ``pattern`` as
    array<struct<start, end, found>>.

    ``split`` gives what lies between the matches that ``regexp_extract_all``
    gives, so lengths add up to places.  ``pattern`` must not match empty
    strings; it may be a Column.
    """
    m, g = f"__{name}_m", f"__{name}_g"
    pat = F.lit(pattern) if isinstance(pattern, str) else pattern
    found = F.regexp_extract_all(F.col(text), pat, F.lit(0))
    if when is not None:
        found = F.when(when, found).otherwise(F.array().cast(NO_TEXTS))
    df = df.withColumn(m, found)
    gaps = F.when(F.size(m) > 0, F.split(F.col(text), pat, -1)).otherwise(F.array().cast(NO_TEXTS))
    df = df.withColumn(g, gaps)
    places = F.expr(f"""
        CASE WHEN size({m}) = 0 THEN CAST(array() AS {SPAN}) ELSE
        aggregate(sequence(0, size({m}) - 1),
          named_struct('at', 0L, 'got', CAST(array() AS {SPAN})),
          (acc, i) -> named_struct(
            'at', acc.at + char_length({g}[i]) + char_length({m}[i]),
            'got', concat(acc.got, array(named_struct(
              'start', acc.at + char_length({g}[i]),
              'end', acc.at + char_length({g}[i]) + char_length({m}[i]),
              'found', {m}[i])))),
          acc -> acc.got) END""")
    return df.withColumn(name, places).drop(m, g)


def joined(spans: Column) -> Column:
    """kind:start:end of array<struct<start, rank, end, kind>>, in order, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat(
        s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def ranked(spans: Column, rank: int, kind: str) -> Column:
    """array<struct<start, rank, end, kind>> of one kind's spans."""
    return F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))
