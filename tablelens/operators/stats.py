"""Single-pass per-column statistics.

``column_stats`` computes, for every column of a table, in one aggregate
over one scan (plus a second one for exact distinct counts): row count, non-null count (NaN counts as missing, rule N1),
exact or approximate distinct count, a sample value and numeric min / max /
mean.  The wide one-row aggregate is then
unpivoted with ``inline(array(struct...))`` to one row per column, so the
output size is bounded by the number of columns, never by the data.

Scale notes
* Everything except exact distinct counts is a fixed-size aggregation
  buffer per column, merged map-side: no shuffle of data at all.
* Exact distinct counts are a second aggregate over the same columns,
  planned by Catalyst with one ``Expand`` branch per column and a partial
  hash aggregate on ``(branch, key)`` before the shuffle, so repeated
  values (even one value in a third of all rows) collapse map-side; the key
  of a text or nested value is a 128-bit hash, never the value.  ``distinct="approx"`` switches to HyperLogLog++
  (no data shuffle) for very wide tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.session import local_frame
from tablelens.functions.columns import is_numeric_type, normalized, qcol

STATS_FIELDS = (
    "pos int, column string, type string, rows bigint, non_null bigint, "
    "unique bigint, sample_value string, min double, max double, mean double, "
    "min_text string, constant boolean"
)


def groupable(df: DataFrame, name: str) -> Column:
    """A form of the column that can be grouped and counted distinct.

    Map columns (and anything containing one) cannot be compared in Spark;
    they are replaced by the JSON text of their key-sorted entries.  NaN in a
    float column is turned into null so that it counts as missing.
    """
    dt = df.schema[name].dataType
    if _contains_map(dt):
        c = qcol(name)
        if isinstance(dt, T.MapType):
            c = F.array_sort(F.map_entries(c))
        return F.to_json(c)
    return normalized(df, name)


def _contains_map(dt: T.DataType) -> bool:
    if isinstance(dt, T.MapType):
        return True
    if isinstance(dt, T.ArrayType):
        return _contains_map(dt.elementType)
    if isinstance(dt, T.StructType):
        return any(_contains_map(f.dataType) for f in dt.fields)
    return type(dt).__name__ == "VariantType"


def groupable_columns(df: DataFrame) -> list[Column]:
    return [groupable(df, f.name).alias(f.name) for f in df.schema.fields]


# Columns per exact distinct-count aggregate.
DISTINCT_GROUP = 16


def groupable_sql(df: DataFrame, name: str) -> str:
    """SQL text of ``groupable``."""
    from tablelens.functions.columns import normalized_sql, sql_ident

    dt = df.schema[name].dataType
    if _contains_map(dt):
        c = sql_ident(name)
        return f"to_json(array_sort(map_entries({c})))" if isinstance(dt, T.MapType) else f"to_json({c})"
    return normalized_sql(df, name)


def distinct_key_sql(df: DataFrame, name: str) -> str:
    """SQL text of what ``count(DISTINCT ...)`` tells values apart by: fixed-size
    types by value, texts and nested values by two 64-bit hashes (one wrong
    merge is expected in 10 ** 19 distinct values), so no text is shuffled."""
    dt = df.schema[name].dataType
    c = groupable_sql(df, name)
    if not isinstance(dt, (T.StringType, T.BinaryType, T.ArrayType, T.StructType)) and not _contains_map(dt):
        return c
    text = c
    if isinstance(dt, (T.ArrayType, T.StructType)) and not _contains_map(dt):  # hashes skip nulls inside
        text = f"to_json(named_struct('v', {c}), map('ignoreNullFields', 'false'))"
    return ", ".join(f"CASE WHEN {c} IS NOT NULL THEN xxhash64({salt}{text}) END" for salt in ("", "1, "))


def column_stats(
    df: DataFrame,
    *,
    columns: Sequence[str] | None = None,
    distinct: str | None = "exact",
    sample: bool = True,
    order_by: str | Sequence[str] | None = None,
    rsd: float = 0.01,
) -> DataFrame:
    """One row per column with the fields of ``STATS_FIELDS``.

    ``distinct``: ``"exact"``, ``"approx"`` or ``None`` (skip).
    ``order_by``: key column(s) giving "first" a meaning for ``sample_value``;
    without it the sample is any non-null value.

    The per-column aggregates are written as SQL text (one expression per
    column), which keeps building the plan cheap for wide tables.
    """
    from tablelens.functions.columns import normalized_sql, sql_ident, sql_str

    names = list(columns) if columns is not None else df.columns
    if not names:
        return local_frame(df.sparkSession, [], STATS_FIELDS)
    texts = []
    for i, name in enumerate(names):
        f = df.schema[name]
        c = normalized_sql(df, name)
        numeric = is_numeric_type(f.dataType)
        if distinct == "approx":
            uniq = f"approx_count_distinct({groupable_sql(df, name)}, {float(rsd)})"
        else:
            uniq = "CAST(NULL AS BIGINT)"
        if not sample:
            samp = "CAST(NULL AS STRING)"
        elif order_by is not None:
            keys = [order_by] if isinstance(order_by, str) else list(order_by)
            okey = (sql_ident(keys[0]) if len(keys) == 1 else
                    "named_struct(" + ", ".join(f"'k{n}', {sql_ident(k)}" for n, k in enumerate(keys)) + ")")
            samp = f"min_by(CAST({c} AS STRING), CASE WHEN {c} IS NOT NULL THEN {okey} END)"
        else:
            samp = f"first(CAST({c} AS STRING), true)"
        if numeric:
            d = f"CAST({c} AS DOUBLE)"
            mn, mx, mean = f"min({d})", f"max({d})", f"avg({d})"
            mn_text = f"CAST(min({c}) AS STRING)"
            constant = f"(min({c}) = max({c}))"  # in the column's own type
        else:
            mn = mx = mean = "CAST(NULL AS DOUBLE)"
            mn_text = "CAST(NULL AS STRING)"
            constant = "CAST(NULL AS BOOLEAN)"
        texts.append(
            f"named_struct('pos', {i}, 'column', {sql_str(name)}, "
            f"'type', {sql_str(f.dataType.simpleString())}, 'rows', count(1), "
            f"'non_null', count({c}), 'unique', CAST({uniq} AS BIGINT), 'sample_value', {samp}, "
            f"'min', {mn}, 'max', {mx}, 'mean', {mean}, 'min_text', {mn_text}, "
            f"'constant', {constant})"
        )
    wide = df.agg(*[F.expr(t).alias(f"__s{i}") for i, t in enumerate(texts)])
    out = wide.selectExpr(f"inline(array({', '.join(f'__s{i}' for i in range(len(names)))}))")
    fields = [f.split()[0] for f in STATS_FIELDS.split(", ")]
    if distinct != "exact":
        return out
    # Exact distinct counts run as their own aggregate: Catalyst expands each
    # row once per column and hash-aggregates on (column, value).  Kept apart
    # from the sample values, whose string buffers would turn the expanded
    # aggregate into a sort-based one.
    # Expanded rows carry one slot per distinct column, so the work per input
    # row grows with the square of the width; columns are counted in groups of
    # DISTINCT_GROUP (a union of independent aggregates, each reading only its
    # own columns, so the bytes read stay those of one scan).
    groups = [list(enumerate(names))[a:a + DISTINCT_GROUP] for a in range(0, len(names), DISTINCT_GROUP)]
    dist = None
    for group in groups:
        items = ", ".join(
            f"named_struct('pos', {i}, '__u', count(DISTINCT {distinct_key_sql(df, name)}))"
            for i, name in group
        )
        part = df.agg(F.expr(f"array({items})").alias("__d")).selectExpr("inline(__d)")
        dist = part if dist is None else dist.unionByName(part)
    # both sides have one row per column
    joined = out.join(F.broadcast(dist), "pos")
    return joined.select(*[F.col("__u").alias("unique") if f == "unique" else F.col(f) for f in fields])
