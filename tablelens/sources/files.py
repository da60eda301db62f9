"""File sources: CSV with missing-value tokens and inferred types, Parquet,
and extension dispatch over several files (S1, S2, S5, S7).

CSV follows RFC 4180: quotes inside quoted fields are doubled, quoted fields
may hold line breaks, a record with more fields than the header is an error.
One pass over the text lines looks for a line with an odd number of quotes and
for the most separators outside quotes; only where quotes are odd are lines
joined to records first (``csv_records``).  Files are read in splits either way.

Type inference is one aggregate over the file: for every column it counts how
many non-missing values have the form of each candidate type and survive
``try_cast`` to it; the first type that keeps them all wins.  Numbers need a
numeric form and timestamps a date part, so ``1D`` and ``08:00:00`` stay text.
The counts (a few numbers per column) pick the casts of the final read.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.functions.columns import qcol
from tablelens.sources.csv_records import field_count, records

# Text that counts as a missing value in CSV input (the
# defaults of the pandas CSV reader).
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)
# Candidate types, tried in this order; text is the fallback.
CANDIDATE_TYPES = ("bigint", "double", "boolean", "date", "timestamp")
BOOLEAN_WORDS = ("true", "false")
# The forms that text of each candidate type has.
FORMS = {
    "bigint": r"^\s*[+-]?\d+\s*$",
    "double": r"(?i)^\s*[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?|inf(?:inity)?)\s*$",
    "date": r"^\s*\d{4}-\d{1,2}-\d{1,2}\s*$",
    "timestamp": r"^\s*\d{4}-\d{1,2}-\d{1,2}(?:[ T]\d.*)?$",
}

# File suffixes by kind.
CSV_SUFFIXES = (".csv",)
PARQUET_SUFFIXES = (".parquet",)
WORKBOOK_SUFFIXES = (".xlsx",)
SQLITE_SUFFIXES = (".db", ".sqlite", ".sqlite3")


def stem_name(path: str) -> str:
    """File stem with spaces and ``-`` made ``_`` (case kept)."""
    stem = os.path.splitext(os.path.basename(path.rstrip("/")))[0]
    return stem.replace(" ", "_").replace("-", "_")


def _missing_to_null(c, tokens: Sequence[str]):
    return F.when(~c.isin(list(tokens)) & c.isNotNull(), c)


def infer_types(df: DataFrame, candidates: Sequence[str] = CANDIDATE_TYPES) -> dict[str, str]:
    """Pick a type per string column from one aggregate over the data."""
    aggs = []
    names = df.columns
    for i, name in enumerate(names):
        c = qcol(name)
        aggs.append(F.count(c).alias(f"n{i}"))
        for t in candidates:
            if t == "boolean":
                ok = F.count_if(F.lower(c).isin(list(BOOLEAN_WORDS)))
            else:
                ok = F.count_if(c.rlike(FORMS[t]) & c.try_cast(t).isNotNull())
            aggs.append(ok.alias(f"n{i}_{t}"))
    if not aggs:
        return {}
    r = df.agg(*aggs).collect()[0]  # a few counts per column
    out = {}
    for i, name in enumerate(names):
        n = r[f"n{i}"]
        if n == 0:
            out[name] = "double"  # an empty column reads as floating point
            continue
        out[name] = next((t for t in candidates if r[f"n{i}_{t}"] == n), "string")
    return out


def apply_types(df: DataFrame, types: dict[str, str]) -> DataFrame:
    cols = []
    for name in df.columns:
        t = types.get(name, "string")
        c = qcol(name)
        if t == "boolean":
            cols.append(F.when(F.lower(c) == "true", True).when(F.lower(c) == "false", False).alias(name))
        elif t == "string":
            cols.append(c.alias(name))
        else:
            cols.append(c.try_cast(t).alias(name))
    return df.select(*cols)


def header_names(first: Sequence[str | None]) -> list[str]:
    """Column names of a header record: empty ones are numbered, a repeated
    name gets ``.1``, ``.2`` (the rule of the workbook reader)."""
    out: list[str] = []
    for i, name in enumerate(first):
        base = name if name else f"Unnamed: {i}"
        unique, n = base, 0
        while unique in out:
            n += 1
            unique = f"{base}.{n}"
        out.append(unique)
    return out


def line_shape(spark: SparkSession, path: str | list[str], sep: str) -> tuple[bool, int]:
    """Whether some line holds an odd number of quotes, and the most fields of
    a line (one pass, one row)."""
    value = F.col("value")
    quotes = F.char_length(value) - F.char_length(F.translate(value, '"', ""))
    odd, most = spark.read.text(path).agg(F.bool_or(quotes % 2 == 1), F.max(field_count(value, sep))).first()
    return bool(odd), most or 0


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | str | None = None,
    na_tokens: Sequence[str] = NA_TOKENS,
    infer: bool = True,
    **options,
) -> DataFrame:
    """Header row, missing-value tokens as null, inferred (or given) types.

    Raises ``ValueError`` if a record has more fields than the header.
    """
    given = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "inferSchema": "false"} | options
    sep = given.get("sep", ",")
    some_file = [unquote(f) for f in sorted(spark.read.text(path).inputFiles())[:1]]  # they come as URIs
    if not some_file:
        return spark.createDataFrame([], schema or "`Unnamed: 0` double")
    broken, most = line_shape(spark, path, sep)
    first = spark.read.options(**given, header="false", multiLine=str(broken).lower()).csv(some_file).limit(1).first()
    names = header_names(list(first) if first else [])
    inner = [f"f{i}" for i in range(len(names))]
    text = T.StructType([T.StructField(n, T.StringType()) for n in inner])
    if broken:
        whole = records(spark, path, sep)
        most = whole.agg(F.max(field_count(F.col("value"), sep))).first()[0] or 0
        parsed = F.from_csv("value", ", ".join(f"{n} string" for n in inner), given)
        raw = whole.select(parsed.alias("r")).select("r.*")
    else:
        raw = spark.read.options(**given, header="true", enforceSchema="true").schema(text).csv(path)
    if most > len(names):
        raise ValueError(f"a record of {path} has {most} fields, the header has {len(names)}")
    cleaned = raw.select(*[_missing_to_null(F.col(i), na_tokens).alias(n) for i, n in zip(inner, names)])
    if schema is not None:
        st = spark.createDataFrame([], schema).schema if isinstance(schema, str) else schema
        return cleaned.select(*[qcol(f.name).try_cast(f.dataType).alias(f.name) for f in st.fields])
    if not infer:
        return cleaned
    return apply_types(cleaned, infer_types(cleaned))


def read_parquet(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """S2."""
    return spark.read.parquet(*([path] if isinstance(path, str) else path))


def read_table(spark: SparkSession, path: str, **options) -> DataFrame:
    """One table from a CSV or Parquet file."""
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    if ext in CSV_SUFFIXES:
        return read_csv(spark, path, **options)
    if ext in PARQUET_SUFFIXES:
        return read_parquet(spark, path)
    raise ValueError(f"not a CSV or Parquet file: {path}")


def load_files(spark: SparkSession, paths: Iterable[str]) -> dict[str, DataFrame]:
    """Tables from several files, by lower-cased suffix.

    CSV / Parquet give one table named after the file stem; a workbook gives
    ``<stem>_<sheet>`` per sheet; a SQLite file gives one table per table.
    An unknown suffix raises.
    """
    from tablelens.sources.sqlite import read_sqlite_tables
    from tablelens.sources.workbook import read_workbooks

    out: dict[str, DataFrame] = {}
    for p in paths:
        ext = os.path.splitext(p.rstrip("/"))[1].lower()
        if ext in CSV_SUFFIXES or ext in PARQUET_SUFFIXES:
            out[stem_name(p)] = read_table(spark, p)
        elif ext in WORKBOOK_SUFFIXES:
            out.update(read_workbooks(spark, p))
        elif ext in SQLITE_SUFFIXES:
            out.update(read_sqlite_tables(spark, p))
        else:
            raise ValueError(f"unsupported file type: {p}")
    return out


def from_rows(spark: SparkSession, rows, schema) -> DataFrame:
    """Local rows to a distributed table."""
    return spark.createDataFrame(rows, schema)
