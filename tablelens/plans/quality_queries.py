"""Registered profile, overview, histogram and anomaly queries.

The fixture tables are clean (no nulls, no duplicated rows), so the checks
run on derived inputs that exercise them; each input is defined twice, as a
Spark plan and as the equal SQL, together with its column list so the SQL
oracle can be written out per column.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.operators import anomaly, profile, sketches
from tablelens.operators.relational import union_reports
from tablelens.operators.sketches import rank_margin
from tablelens.plans.registry import register, table
from tablelens.session import shared_dir

NUMERIC = {"tinyint", "smallint", "int", "bigint", "float", "double"}


@dataclass(frozen=True)
class Input:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str
    columns: tuple[tuple[str, str], ...]  # (name, Spark type)

    def df(self, spark, sf_dir):
        return self.build(spark, sf_dir)

    @property
    def numeric(self):
        return [c for c, t in self.columns if t in NUMERIC]


def _docs_labels(spark, d):
    docs = table(spark, d, "documents")
    lab = table(spark, d, "labels").select("doc_id", "quality", "toxic")
    return docs.join(lab, "doc_id", "left")


def _lineitem_nullflag(spark, d):
    li = table(spark, d, "lineitem")
    return li.withColumn("l_returnflag", F.nullif(F.col("l_returnflag"), F.lit("A")))


DOCS_LABELS = Input(
    "docs_labels", _docs_labels,
    "select d.*, l.quality, l.toxic from documents d "
    "left join labels l on d.doc_id = l.doc_id",
    (("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"),
     ("n_chars", "bigint"), ("quality", "int"), ("toxic", "int")),
)
LINEITEM_NULLFLAG = Input(
    "lineitem_nullflag", _lineitem_nullflag,
    "select * replace (nullif(l_returnflag, 'A') as l_returnflag) from lineitem",
    (("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"),
     ("l_linenumber", "int"), ("l_quantity", "double"), ("l_extendedprice", "double"),
     ("l_discount", "double"), ("l_tax", "double"), ("l_returnflag", "string"),
     ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz")),
)
FLAGS = Input(
    "flags", lambda s, d: table(s, d, "lineitem").select("l_returnflag", "l_linestatus"),
    "select l_returnflag, l_linestatus from lineitem",
    (("l_returnflag", "string"), ("l_linestatus", "string")),
)
DOCUMENTS = Input(
    "documents", lambda s, d: table(s, d, "documents"),
    "select * from documents",
    (("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"),
     ("n_chars", "bigint")),
)
EVENTS = Input(
    "events", lambda s, d: table(s, d, "events"),
    "select * from events",
    (("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"),
     ("event_type", "string"), ("value", "double"), ("props", "string")),
)
LABELS = Input(
    "labels", lambda s, d: table(s, d, "labels"),
    "select * from labels",
    (("doc_id", "bigint"), ("quality", "int"), ("toxic", "int")),
)
SUPPLIER_NAME_LEN = Input(
    "supplier_name_len",
    lambda s, d: table(s, d, "supplier").select(
        "s_suppkey", "s_name", "s_nationkey", F.length("s_name").cast("int").alias("name_len"), "s_acctbal"),
    "select s_suppkey, s_name, s_nationkey, cast(length(s_name) as integer) as name_len, s_acctbal from supplier",
    (("s_suppkey", "bigint"), ("s_name", "string"), ("s_nationkey", "int"), ("name_len", "int"), ("s_acctbal", "double")),
)
ORDERS = Input(
    "orders", lambda s, d: table(s, d, "orders"),
    "select * from orders",
    (("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
     ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")),
)
LINEITEM = Input(
    "lineitem", lambda s, d: table(s, d, "lineitem"),
    "select * from lineitem",
    (("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"),
     ("l_linenumber", "int"), ("l_quantity", "double"), ("l_extendedprice", "double"),
     ("l_discount", "double"), ("l_tax", "double"), ("l_returnflag", "string"),
     ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz")),
)


def q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


# ---------------------------------------------------------------------------
# SQL text of the checks, one branch per column (oracle side)
# ---------------------------------------------------------------------------

def _sql_nulls(inp: Input) -> list[str]:
    out = []
    for c, _ in inp.columns:
        out.append(
            f"select '{inp.name}' as {q('table')}, '{c}' as {q('column')}, "
            f"'High Null Rate' as anomaly_type, "
            f"case when pct >= 50 then 'high' else 'medium' end as severity, "
            f"printf('%.1f%% of values are null (%d rows)', pct, nulls) as description, "
            f"pct as value from (select (count(*) - count({c})) / count(*) * 100 as pct, "
            f"count(*) - count({c}) as nulls from ({inp.sql})) where pct >= 20"
        )
    return out


def _sql_duplicates(inp: Input) -> list[str]:
    return [
        f"select '{inp.name}' as {q('table')}, '(entire row)' as {q('column')}, "
        f"'Duplicate Rows' as anomaly_type, 'medium' as severity, "
        f"printf('%.1f%% of rows are exact duplicates (%d rows)', pct, dups) as description, "
        f"pct as value from (select dups / n * 100 as pct, dups from (select count(*) as n, "
        f"count(*) - (select count(*) from (select distinct * from ({inp.sql}))) as dups "
        f"from ({inp.sql}))) where pct >= 5"
    ]


def _sql_outliers(inp: Input) -> list[str]:
    out = []
    for c in inp.numeric:
        out.append(
            f"select '{inp.name}' as {q('table')}, '{c}' as {q('column')}, "
            f"'Outliers Detected' as anomaly_type, 'low' as severity, "
            f"printf('%.1f%% outliers (IQR x3.0). Expected range: [%.2f, %.2f]', pct, lower, upper) "
            f"as description, pct as value from (select f.*, (select count(*) from ({inp.sql}) t "
            f"where t.{c} < f.lower or t.{c} > f.upper) / f.n * 100 as pct from ("
            f"select n, q1, q3, q3 - q1 as iqr, q1 - 3.0 * (q3 - q1) as lower, "
            f"q3 + 3.0 * (q3 - q1) as upper from (select count({c}) as n, "
            f"quantile_cont({c}, 0.25) as q1, quantile_cont({c}, 0.75) as q3 from ({inp.sql}))) f) "
            f"where n >= 20 and iqr <> 0 and pct >= 1"
        )
    return out


def _sql_zero_variance(inp: Input) -> list[str]:
    out = []
    for c in inp.numeric:
        out.append(
            f"select '{inp.name}' as {q('table')}, '{c}' as {q('column')}, "
            f"'Zero Variance' as anomaly_type, 'low' as severity, "
            f"'All non-null values are identical: ' || cast(mn as varchar) as description, "
            f"0.0::double as value from (select min({c}) as mn, max({c}) as mx, count({c}) as n "
            f"from ({inp.sql})) where n > 0 and mn = mx"
        )
    return out


_SQL_CHECKS = {
    "nulls": _sql_nulls,
    "duplicates": _sql_duplicates,
    "outliers": _sql_outliers,
    "zero_variance": _sql_zero_variance,
}


def sql_detect(inputs: list[Input], checks: tuple[str, ...]) -> str:
    parts = []
    for inp in inputs:
        for chk in checks:
            parts.extend(_SQL_CHECKS[chk](inp))
    return "\nunion all\n".join(parts)


def spark_detect(spark, sf_dir, inputs: list[Input], checks: tuple[str, ...], **kw) -> DataFrame:
    tables = {inp.name: inp.df(spark, sf_dir) for inp in inputs}
    parts = anomaly.detect_many(tables, checks=checks, **kw)
    return union_reports(*parts).orderBy("table", "check_no", "col_pos").drop("check_no", "col_pos")


# ---------------------------------------------------------------------------
# D1-D7
# ---------------------------------------------------------------------------

_NULL_INPUTS = [DOCS_LABELS, LINEITEM_NULLFLAG]
_DUP_INPUTS = [FLAGS, DOCUMENTS, EVENTS]
_OUTLIER_INPUTS = [DOCUMENTS, EVENTS, LABELS, LINEITEM]
_ZV_INPUTS = [SUPPLIER_NAME_LEN, LABELS]
_REPORT_INPUTS = [DOCS_LABELS, LINEITEM_NULLFLAG, FLAGS, DOCUMENTS, EVENTS, LABELS, SUPPLIER_NAME_LEN]
_ALL = ("nulls", "duplicates", "outliers", "zero_variance")


@register("null_anomalies", sql_detect(_NULL_INPUTS, ("nulls",)))
def q_null_anomalies(spark, sf_dir):
    return spark_detect(spark, sf_dir, _NULL_INPUTS, ("nulls",))


@register("duplicate_anomalies", sql_detect(_DUP_INPUTS, ("duplicates",)))
def q_duplicate_anomalies(spark, sf_dir):
    return spark_detect(spark, sf_dir, _DUP_INPUTS, ("duplicates",))


@register("outlier_anomalies", sql_detect(_OUTLIER_INPUTS, ("outliers",)))
def q_outlier_anomalies(spark, sf_dir):
    return spark_detect(spark, sf_dir, _OUTLIER_INPUTS, ("outliers",), method="exact")


@register("outlier_anomalies_approx")
def q_outlier_anomalies_approx(spark, sf_dir):
    """The notebook's approximate quartiles; no oracle (values differ)."""
    return spark_detect(spark, sf_dir, _OUTLIER_INPUTS, ("outliers",), method="approx")


@register("zero_variance", sql_detect(_ZV_INPUTS, ("zero_variance",)))
def q_zero_variance(spark, sf_dir):
    return spark_detect(spark, sf_dir, _ZV_INPUTS, ("zero_variance",))


def _report(spark, sf_dir):
    return anomaly.anomaly_report({inp.name: inp.df(spark, sf_dir) for inp in _REPORT_INPUTS})


@register("anomaly_report", sql_detect(_REPORT_INPUTS, _ALL))
def q_anomaly_report(spark, sf_dir):
    return _report(spark, sf_dir)


@register(
    "severity_summary",
    "select s.severity, coalesce(c.n, 0)::bigint as count from "
    "(select 'high' as severity union all select 'medium' union all select 'low') s "
    "left join (select severity, count(*) as n from (" + sql_detect(_REPORT_INPUTS, _ALL)
    + ") group by severity) c on s.severity = c.severity",
)
def q_severity_summary(spark, sf_dir):
    return anomaly.severity_summary(_report(spark, sf_dir))


# ---------------------------------------------------------------------------
# T1 overview, T2 profile, T3 notebook profile, T4 histograms
# ---------------------------------------------------------------------------

def _sql_overview(inp: Input) -> str:
    nulls = " + ".join(f"count(*) - count({c})" for c, _ in inp.columns)
    return (
        f"select count(*) as {q('rows')}, {len(inp.columns)} as {q('columns')}, "
        f"({nulls})::bigint as null_cells, "
        f"count(*) - (select count(*) from (select distinct * from ({inp.sql}))) as duplicate_rows "
        f"from ({inp.sql})"
    )


def _sql_profile(inp: Input, key) -> str:
    if not isinstance(key, str):
        key = "row(" + ", ".join(key) + ")"
    parts = []
    for c, t in inp.columns:
        if t in NUMERIC:
            rng = (f"round(min({c})::double, 2) as {q('min')}, round(max({c})::double, 2) as {q('max')}, "
                   f"round(avg({c}), 2) as mean")
        else:
            rng = f"null::double as {q('min')}, null::double as {q('max')}, null::double as mean"
        parts.append(
            f"select '{c}' as {q('column')}, '{t}' as {q('type')}, count({c}) as non_null, "
            f"round((count(*) - count({c})) / count(*) * 100, 1) as null_pct, "
            f"count(distinct {c}) as {q('unique')}, "
            f"coalesce(cast(arg_min({c}, case when {c} is not null then {key} end) as varchar), 'N/A') "
            f"as sample_value, {rng} from ({inp.sql})"
        )
    return "\nunion all\n".join(parts)


for _inp in (FLAGS, DOCS_LABELS, ORDERS):
    register(f"table_overview_{_inp.name}", _sql_overview(_inp))(
        (lambda inp: lambda spark, sf_dir: profile.table_overview(inp.df(spark, sf_dir)))(_inp)
    )

for _inp, _key in ((ORDERS, "o_orderkey"), (DOCS_LABELS, "doc_id"), (EVENTS, "event_id")):
    register(f"column_profile_{_inp.name}", _sql_profile(_inp, _key))(
        (lambda inp, key: lambda spark, sf_dir: profile.profile_table(
            inp.df(spark, sf_dir), order_by=key))(_inp, _key)
    )


@register(
    "null_rates_docs_labels",
    "select " + ", ".join(
        f"round(count_if({c} is null) / count(*) * 100, 2) as {c}" for c, _ in DOCS_LABELS.columns
    ) + f" from ({DOCS_LABELS.sql})",
)
def q_null_rates(spark, sf_dir):
    return profile.null_rates(DOCS_LABELS.df(spark, sf_dir))


@register(
    "distinct_counts_orders",
    "select " + ", ".join(f"count(distinct {c}) as {c}" for c, _ in ORDERS.columns) + " from orders",
)
def q_distinct_counts(spark, sf_dir):
    return profile.distinct_counts(ORDERS.df(spark, sf_dir))


@register(
    "numeric_summary_lineitem",
    "\nunion all\n".join(
        f"select '{c}' as {q('column')}, count({c}) as {q('count')}, round(avg({c}), 4) as mean, "
        f"round(stddev_samp({c}), 4) as stddev, round(min({c})::double, 4) as {q('min')}, "
        f"round(max({c})::double, 4) as {q('max')} from lineitem"
        for c in LINEITEM.numeric
    ),
)
def q_numeric_summary(spark, sf_dir):
    s = profile.numeric_summary(LINEITEM.df(spark, sf_dir))
    return s.select("column", "count", *[F.round(c, 4).alias(c) for c in ("mean", "stddev", "min", "max")])


def _sql_histogram(inp: Input, bins: int = 30) -> str:
    parts = []
    for c in inp.numeric:
        parts.append(
            f"select '{c}' as {q('column')}, g.bin::integer as bin, "
            f"r.lo + g.bin * ((r.hi - r.lo) / {bins}) as lo, "
            f"r.lo + (g.bin + 1) * ((r.hi - r.lo) / {bins}) as hi, "
            f"coalesce(h.n, 0)::bigint as {q('count')} "
            f"from (select min({c})::double as lo, max({c})::double as hi from ({inp.sql})) r "
            f"cross join range(0, {bins}) g(bin) "
            f"left join (select case when x.hi = x.lo then 0 else least(floor((t.{c}::double - x.lo) "
            f"/ (x.hi - x.lo) * {bins}), {bins - 1}) end as b, count(*) as n from ({inp.sql}) t, "
            f"(select min({c})::double as lo, max({c})::double as hi from ({inp.sql})) x "
            f"where t.{c} is not null group by 1) h on h.b = g.bin where r.lo is not null"
        )
    return "\nunion all\n".join(parts)


for _inp in (EVENTS, DOCUMENTS, LINEITEM):
    register(f"histogram_{_inp.name}", _sql_histogram(_inp))(
        (lambda inp: lambda spark, sf_dir: profile.histograms(inp.df(spark, sf_dir)))(_inp)
    )


# ---------------------------------------------------------------------------
# Text-heavy and nested tables: whole texts and arrays through the same checks
# ---------------------------------------------------------------------------

CONVERSATIONS = Input(
    "conversations", lambda s, d: table(s, d, "conversations"),
    "select * from conversations",
    (("conv_id", "bigint"), ("turn", "bigint"), ("role", "string"), ("text", "string")),
)
PAGES = Input(
    "pages", lambda s, d: table(s, d, "pages"),
    "select * from pages",
    (("page_id", "bigint"), ("url", "string"), ("html", "string")),
)
BENCHMARK = Input(
    "benchmark", lambda s, d: table(s, d, "benchmark"),
    "select * from benchmark",
    (("item_id", "bigint"), ("text", "string")),
)
EMBEDDINGS = Input(
    "embeddings", lambda s, d: table(s, d, "embeddings"),
    "select * from embeddings",
    (("vec_id", "bigint"), ("embedding", "array<float>"), ("label", "int")),
)
CONV_TEXT = Input(
    "conversation_texts", lambda s, d: table(s, d, "conversations").select("role", "text"),
    "select role, text from conversations",
    (("role", "string"), ("text", "string")),
)

for _inp in (CONVERSATIONS, EMBEDDINGS, PAGES):
    register(f"table_overview_{_inp.name}", _sql_overview(_inp))(
        (lambda inp: lambda spark, sf_dir: profile.table_overview(inp.df(spark, sf_dir)))(_inp)
    )

for _inp, _key in ((PAGES, "page_id"), (CONVERSATIONS, ("conv_id", "turn")), (BENCHMARK, "item_id")):
    register(f"column_profile_{_inp.name}", _sql_profile(_inp, _key))(
        (lambda inp, key: lambda spark, sf_dir: profile.profile_table(
            inp.df(spark, sf_dir), order_by=key))(_inp, _key)
    )

_TEXT_INPUTS = [CONVERSATIONS, PAGES, BENCHMARK, CONV_TEXT, EMBEDDINGS]


@register("text_table_anomalies", sql_detect(_TEXT_INPUTS, _ALL))
def q_text_table_anomalies(spark, sf_dir):
    """D1-D4 over text and array tables (duplicate texts per role, ...)."""
    return spark_detect(spark, sf_dir, _TEXT_INPUTS, _ALL)


# ---------------------------------------------------------------------------
# T1 over the whole catalog: one plan, one union branch per table
# ---------------------------------------------------------------------------

REGION = Input("region", lambda s, d: table(s, d, "region"), "select * from region",
               (("r_regionkey", "int"), ("r_name", "string")))
NATION = Input("nation", lambda s, d: table(s, d, "nation"), "select * from nation",
               (("n_nationkey", "int"), ("n_name", "string"), ("n_regionkey", "int")))
CUSTOMER = Input("customer", lambda s, d: table(s, d, "customer"), "select * from customer",
                 (("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"),
                  ("c_acctbal", "double"), ("c_mktsegment", "string")))
SUPPLIER = Input("supplier", lambda s, d: table(s, d, "supplier"), "select * from supplier",
                 (("s_suppkey", "bigint"), ("s_name", "string"), ("s_nationkey", "int"),
                  ("s_acctbal", "double")))
PART = Input("part", lambda s, d: table(s, d, "part"), "select * from part",
             (("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"),
              ("p_type", "string"), ("p_size", "int"), ("p_retailprice", "double")))

_CATALOG = [REGION, NATION, CUSTOMER, SUPPLIER, PART, ORDERS, LINEITEM, EVENTS, DOCUMENTS,
            EMBEDDINGS, PAGES, BENCHMARK, LABELS, CONVERSATIONS]


@register(
    "table_overview_all",
    "\nunion all\n".join(
        f"select '{i.name}' as {q('table')}, * from ({_sql_overview(i)})" for i in _CATALOG
    ),
)
def q_table_overview_all(spark, sf_dir):
    """T1 for every fixture table; the branches are independent, so adaptive
    execution runs their stages side by side."""
    parts = [
        profile.table_overview(i.df(spark, sf_dir)).select(F.lit(i.name).alias("table"), "*")
        for i in _CATALOG
    ]
    return union_reports(*parts)


_PROFILE_KEYS = [
    (REGION, "r_regionkey"), (NATION, "n_nationkey"), (CUSTOMER, "c_custkey"),
    (SUPPLIER, "s_suppkey"), (PART, "p_partkey"), (ORDERS, "o_orderkey"),
    (LINEITEM, ("l_orderkey", "l_linenumber")), (EVENTS, "event_id"), (DOCUMENTS, "doc_id"),
    (PAGES, "page_id"), (BENCHMARK, "item_id"), (LABELS, "doc_id"),
    (CONVERSATIONS, ("conv_id", "turn")),
]


@register(
    "column_profile_all",
    "\nunion all\n".join(
        f"select '{i.name}' as {q('table')}, * from ({_sql_profile(i, k)})" for i, k in _PROFILE_KEYS
    ),
)
def q_column_profile_all(spark, sf_dir):
    """T2 for every fixture table with a key (first sample by that key)."""
    parts = [
        profile.profile_table(i.df(spark, sf_dir), order_by=k).select(F.lit(i.name).alias("table"), "*")
        for i, k in _PROFILE_KEYS
    ]
    return union_reports(*parts)


@register("anomaly_report_all", sql_detect(_CATALOG, _ALL))
def q_anomaly_report_all(spark, sf_dir):
    """D6 over every fixture table: all four checks, tables checked
    concurrently, sorted by severity."""
    return anomaly.anomaly_report({i.name: i.df(spark, sf_dir) for i in _CATALOG})


@register("duplicate_anomalies_hashed", sql_detect(_DUP_INPUTS, ("duplicates",)))
def q_duplicate_anomalies_hashed(spark, sf_dir):
    """Rows counted by hash, repeated ones grouped in full (as every check does)."""
    return spark_detect(spark, sf_dir, _DUP_INPUTS, ("duplicates",))


def _nested_nulls(spark, d):
    e = table(spark, d, "embeddings")
    # nulls put into the arrays at places that differ by row
    v = F.transform(F.slice("embedding", 1, 3), lambda x, i: F.when(i != F.col("vec_id") % 4, F.lit(1)))
    return e.select((F.col("vec_id") % 200).alias("grp"), v.alias("v"))


NESTED_NULLS = Input(
    "nested_nulls", _nested_nulls,
    "select vec_id % 200 as grp, [case when vec_id % 4 <> 0 then 1 end, case when vec_id % 4 <> 1 then 1 end, "
    "case when vec_id % 4 <> 2 then 1 end] as v from embeddings",
    (("grp", "bigint"), ("v", "array<int>")),
)
LARGE_KEYS = Input(
    "large_keys",
    lambda s, d: table(s, d, "supplier").select((F.col("s_suppkey") % 2 + 9007199254740992).alias("big"),
                                                F.lit(9007199254740993).alias("same")),
    "select (s_suppkey % 2 + 9007199254740992)::bigint as big, 9007199254740993::bigint as same from supplier",
    (("big", "bigint"), ("same", "bigint")),
)


@register("duplicate_anomalies_nested", sql_detect([NESTED_NULLS], ("duplicates",)))
def q_duplicate_anomalies_nested(spark, sf_dir):
    return spark_detect(spark, sf_dir, [NESTED_NULLS], ("duplicates",))


@register("zero_variance_large_keys", sql_detect([LARGE_KEYS], ("zero_variance",)))
def q_zero_variance_large_keys(spark, sf_dir):
    return spark_detect(spark, sf_dir, [LARGE_KEYS], ("zero_variance",))


@register("column_profile_orders_approx")
def q_column_profile_orders_approx(spark, sf_dir):
    """T2 with HyperLogLog distinct counts (wide-table option; rows only)."""
    return profile.profile_table(ORDERS.df(spark, sf_dir), order_by="o_orderkey", exact=False)


# -- order statistics -----------------------------------------------------------

_QUANTILES = (0.0, 0.01, 0.25, 0.5, 0.9, 1.0)


@register("quantile_large_keys", "\nunion all\n".join(
    f"select '{c}' as column_name, {p!r}::double as p, quantile_cont({c}, {p!r})::double as q from ("
    "select o_orderkey + 9007199254740993 as big, o_custkey * 1000003 as spread, "
    "o_totalprice::double * case when o_orderkey % 3 = 0 then 1e200 else 1e-200 end as wide from orders)"
    for c in ("big", "spread", "wide") for p in _QUANTILES))
def q_quantile_large_keys(spark, sf_dir):
    """Quantiles of keys above 2 ** 53 and of a column over 400 powers of ten."""
    from tablelens.operators.quantiles import exact_quantiles

    far = F.when(F.col("o_orderkey") % 3 == 0, F.lit(1e200)).otherwise(F.lit(1e-200))
    df = table(spark, sf_dir, "orders").select(
        (F.col("o_orderkey") + F.lit(9007199254740993)).alias("big"), (F.col("o_custkey") * 1000003).alias("spread"),
        (F.col("o_totalprice").cast("double") * far).alias("wide"))
    each = F.posexplode(F.arrays_zip(F.array(*[F.lit(p) for p in _QUANTILES]).alias("p"), F.col("q")))
    return exact_quantiles(df, df.columns, _QUANTILES).select(F.col("column").alias("column_name"), each.alias("j", "r")).select(
        "column_name", F.col("r.p").alias("p"), F.col("r.q").alias("q"))


@register("approx_quantile_ranks", "\nunion all\n".join(
    f"select '{c}' as column_name, {p!r}::double as p, count({c}) as n, true as within_error from lineitem"
    for c in ("l_quantity", "l_extendedprice", "l_discount") for p in (0.25, 0.75)))
def q_approx_quantile_ranks(spark, sf_dir):
    """The true ranks of sketched quartiles lie within the stated error of
    the aim (the share of values below, and up to, the quartile)."""
    from tablelens.operators.quantiles import approx_quantiles, rank_error

    columns, probs = ["l_quantity", "l_extendedprice", "l_discount"], [0.25, 0.75]
    df = table(spark, sf_dir, "lineitem").select(*columns)
    found = {r["column"]: r["q"] for r in approx_quantiles(df, columns, probs).collect()}  # a row a column
    error = rank_error()
    items = [F.struct(
        F.lit(c).alias("column_name"), F.lit(p).alias("p"), F.count(c).alias("n"),
        ((F.count_if(F.col(c) < F.lit(q)) <= (p + error) * F.count(c))
         & (F.count_if(F.col(c) <= F.lit(q)) >= (p - error) * F.count(c))).alias("within_error"))
        for c in columns for p, q in zip(probs, found[c])]
    return df.agg(F.array(*items).alias("a")).select(F.inline("a"))


# -- stored sketches --------------------------------------------------------------

_SKETCHED = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
_SKETCH_MARGIN = rank_margin()


@register("stored_sketch_quartiles", "\nunion all\n".join(
    f"select '{c}' as column_name, {p!r}::double as p, count(distinct year(l_shipdate)) as parts, count({c}) as n, "
    f"greatest(0, ceil(({p!r}::double - {_SKETCH_MARGIN!r}::double) * count({c})))::bigint as rank_low, "
    f"least(count({c}), floor(({p!r}::double + {_SKETCH_MARGIN!r}::double) * count({c})))::bigint as rank_high, "
    "true as inside from lineitem" for c in _SKETCHED for p in (0.25, 0.75)))
def q_stored_sketch_quartiles(spark, sf_dir):
    """Sketches stored per shipping year in two loads, the second of which
    replaces a year that the first had loaded in part; the merged quartiles are
    held against the true ranks."""
    df = table(spark, sf_dir, "lineitem").select("l_shipdate", *_SKETCHED)
    base, year = shared_dir(spark, f"lake-{uuid.uuid4().hex}"), F.year("l_shipdate")
    for load in (df.where((year < 1996) & ((year < 1995) | (F.month("l_shipdate") < 4))), df.where(year >= 1995)):
        sketches.store_sketches(spark, base, "lineitem_sketches", sketches.part_sketches(load, year, _SKETCHED))
    probs = (0.25, 0.75)
    found = sketches.merged_quantiles(sketches.read_lake(spark, base, "lineitem_sketches"), probs)
    own = F.struct("parts", "n", "q", "rank_low", "rank_high")
    wide = found.agg(F.array(*[F.max(F.when(F.col("column") == c, own)) for c in _SKETCHED]).alias("f")).scalar()
    each = [(c, i, p, F.col("f")[k]) for k, c in enumerate(_SKETCHED) for i, p in enumerate(probs)]
    ranks = df.select(*_SKETCHED, wide.alias("f")).agg(F.first("f").alias("f"), *[
        F.struct(F.count_if(F.col(c) < f["q"][i]).alias("below"), F.count_if(F.col(c) <= f["q"][i]).alias("upto"))
        .alias(f"r_{c}_{i}") for c, i, _, f in each])
    return ranks.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.lit(p).alias("p"), f["parts"].alias("parts"), f["n"].alias("n"),
                 f["rank_low"][i].alias("rank_low"), f["rank_high"][i].alias("rank_high"),
                 ((F.col(f"r_{c}_{i}.below") <= f["rank_high"][i]) & (F.col(f"r_{c}_{i}.upto") >= f["rank_low"][i])).alias("inside"))
        for c, i, p, f in each])))
