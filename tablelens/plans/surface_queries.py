"""Registered queries for KPIs, drift, ad-hoc SQL, text cleaning, formatting,
calendar spines, sampling and the catalog."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tablelens.functions import columns as C
from tablelens.operators import anomaly, drift, kpi
from tablelens.operators.relational import group_summary, with_group_total
from tablelens.plans import ask
from tablelens.plans.registry import register, table
from tablelens.session import shared_dir
from tablelens.sources import catalog, files, spines

FIXTURE_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def register_fixtures(spark, sf_dir, names=FIXTURE_TABLES):
    """Temp views named after the fixture tables, for SQL queries."""
    for n in names:
        catalog.register(table(spark, sf_dir, n), n)


# ---------------------------------------------------------------------------
# K1-K5
# ---------------------------------------------------------------------------

def _money_sql(expr: str) -> str:
    return (f"case when {expr} > 100 then '$' || format('{{:,.0f}}', {expr}) "
            f"else format('{{:,.2f}}', {expr}) end")


@register(
    "kpis",
    "select label, value, hint from ("
    "select 'Total Rows' as label, format('{:,}', count(*)) as value, 'across 3 table(s)' as hint, 1 as pos from events "
    "union all select 'Date Range', strftime(min(ts), '%b %Y') || ' – ' || strftime(max(ts), '%b %Y'), "
    "'ts', 3 from events "
    "union all select 'Unique User Id', format('{:,}', count(distinct user_id)), 'events', 4 from events "
    f"union all select 'Total L Extendedprice', {_money_sql('sum(l_extendedprice)')}, 'lineitem', 12 from lineitem"
    ") order by pos",
)
def q_kpis(spark, sf_dir):
    return kpi.kpis({n: table(spark, sf_dir, n) for n in ("orders", "lineitem", "events")})


@register(
    "kpis_people",
    "select 'Unique User Id' as label, format('{:,}', count(distinct user_id)) as value, 'events' as hint from events",
)
def q_kpis_people(spark, sf_dir):
    """K4 on its own: the unique-people card of the events table."""
    cards = kpi.table_kpis(table(spark, sf_dir, "events"), "events", 0, 1)
    return cards.filter(F.col("label").startswith("Unique ")).select("label", "value", "hint")


@register(
    "kpis_nan",
    "select label, value, hint from ("
    "select 'Total Rows' as label, format('{:,}', count(*)) as value, 'across 1 table(s)' as hint, 1 as pos from events "
    f"union all select 'Total Price', {_money_sql('sum(case when event_id % 3 <> 0 then value end)')}, 'events', 2 from events "
    "union all select 'Unique User Id', format('{:,}', count(distinct case when event_id % 5 <> 0 then user_id end)), "
    "'events', 4 from events) order by pos",
)
def q_kpis_nan(spark, sf_dir):
    """K2, K4: NaN is a missing value in sums and in numbers of people."""
    nan = F.lit(float("nan"))
    events = table(spark, sf_dir, "events").select(
        F.when(F.col("event_id") % 3 != 0, F.col("value")).otherwise(nan).alias("price"),
        F.when(F.col("event_id") % 5 != 0, F.col("user_id").cast("double")).otherwise(nan).alias("user_id"))
    return kpi.kpis({"events": events})


# ---------------------------------------------------------------------------
# D8/D9, A17, P22
# ---------------------------------------------------------------------------

@register(
    "schema_drift",
    "select 'added' as change, 'discount_code' as \"column\" "
    "union all select 'added', 'referral_source' union all select 'removed', 'o_orderpriority'",
)
def q_schema_drift(spark, sf_dir):
    old = table(spark, sf_dir, "orders")
    batch = (old.drop("o_orderpriority")
             .withColumn("discount_code", F.lit(None).cast("string"))
             .withColumn("referral_source", F.lit(None).cast("string")))
    return drift.schema_drift(old, batch)


def _small_report(spark, sf_dir):
    from tablelens.plans.quality_queries import DOCS_LABELS, LABELS, SUPPLIER_NAME_LEN

    return anomaly.anomaly_report(
        {i.name: i.df(spark, sf_dir) for i in (DOCS_LABELS, LABELS, SUPPLIER_NAME_LEN)}
    )


def _small_report_sql():
    from tablelens.plans.quality_queries import DOCS_LABELS, LABELS, SUPPLIER_NAME_LEN, sql_detect

    return sql_detect([DOCS_LABELS, LABELS, SUPPLIER_NAME_LEN],
                      ("nulls", "duplicates", "outliers", "zero_variance"))


@register(
    "anomaly_type_counts",
    f"select anomaly_type, count(*) as count from ({_small_report_sql()}) group by anomaly_type",
)
def q_type_counts(spark, sf_dir):
    return anomaly.type_counts(_small_report(spark, sf_dir))


@register(
    "issue_lines",
    "select 'Table: ' || \"table\" || ', Column: ' || \"column\" || ', Issue: ' || anomaly_type "
    f"|| ', Detail: ' || description as line from ({_small_report_sql()})",
)
def q_issue_lines(spark, sf_dir):
    return _small_report(spark, sf_dir).select(C.issue_line().alias("line"))


@register("saved_anomaly_report", _small_report_sql())
def q_saved_report(spark, sf_dir):
    """The report written to the lake and read back; each run has a
    folder of its own."""
    base = shared_dir(spark, f"lake-{uuid.uuid4().hex}")
    catalog.save_report(_small_report(spark, sf_dir), base, "anomaly_report")
    return catalog.read_lake(spark, base, "anomaly_report")


# ---------------------------------------------------------------------------
# Q1-Q4: ad-hoc SQL over registered tables
# ---------------------------------------------------------------------------

SQL_NATIONS = (
    "select n.n_name as nation, count(*) as customers, round(sum(c.c_acctbal), 2) as balance "
    "from customer c join nation n on c.c_nationkey = n.n_nationkey "
    "group by n.n_name order by customers desc, nation limit 500"
)
SQL_MONTHS = (
    "select strftime(o_orderdate, '%Y-%m') as ym, count(*) as orders "
    "from orders group by 1 order by 1"
)
SQL_TOP_ORDERS = "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey"
SQL_PRIORITIES = "select o_orderpriority as priority, count(*) as orders from orders group by 1"


@register("sql_nation_customers", SQL_NATIONS)
def q_sql_nations(spark, sf_dir):
    register_fixtures(spark, sf_dir, ("customer", "nation"))
    return ask.run_sql(spark, SQL_NATIONS)


@register("sql_monthly_strftime", SQL_MONTHS)
def q_sql_months(spark, sf_dir):
    register_fixtures(spark, sf_dir, ("orders",))
    return ask.run_sql(spark, SQL_MONTHS)


@register("sql_preview", SQL_TOP_ORDERS + " limit 5")
def q_sql_preview(spark, sf_dir):
    register_fixtures(spark, sf_dir, ("orders",))
    return ask.preview(ask.run_sql(spark, SQL_TOP_ORDERS), 5)


@register(
    "chart_data",
    "select 'bar' as kind, o_orderpriority as x, count(*) as y from orders group by 2",
)
def q_chart_data(spark, sf_dir):
    register_fixtures(spark, sf_dir, ("orders",))
    kind, frame = ask.chart_data(ask.run_sql(spark, SQL_PRIORITIES))
    return frame.select(F.lit(kind).alias("kind"), "x", "y")


SQL_STRFTIME = (
    "select o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M') as stamp, strftime(o_orderdate, '%Y week %j') as day, "
    "strftime(o_orderdate, '%Y%%') as share from orders"
)


@register("sql_strftime_literals", SQL_STRFTIME)
def q_sql_strftime_literals(spark, sf_dir):
    """P11 in SQL: letters and doubled percent signs are literal."""
    register_fixtures(spark, sf_dir, ("orders",))
    return ask.run_sql(spark, SQL_STRFTIME)


@register(
    "query_log",
    "select 2 as nth, 'customers per nation' as question, count(*) as \"rows\" from "
    f"({SQL_NATIONS}) union all select 1, 'orders by priority', count(*) from ({SQL_PRIORITIES})",
)
def q_query_log(spark, sf_dir):
    """Q3: log two queries (result saved, rows counted during the write), then
    read the newest 10 entries, newest first, without their times."""
    register_fixtures(spark, sf_dir, ("customer", "nation", "orders"))
    log = shared_dir(spark, f"query_log-{uuid.uuid4().hex}")
    for question, sql in (("orders by priority", SQL_PRIORITIES), ("customers per nation", SQL_NATIONS)):
        ask.log_query(spark, question, sql, ask.run_sql(spark, sql), log_path=log)
    nth = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("seq"))  # at most 10 rows
    return ask.recent_queries(spark, log, n=10).select(nth.alias("nth"), "question", "rows")


@register("catalog_digest")
def q_catalog_digest(spark, sf_dir):
    """Names, types and 3 sample values per column (rows only)."""
    register_fixtures(spark, sf_dir)
    return catalog.catalog_digest(spark, list(FIXTURE_TABLES), n=3)


# (table, key columns, other columns) of tables whose values print alike everywhere
_DIGESTED = (("region", ("r_regionkey",), ("r_name",)), ("nation", ("n_nationkey",), ("n_name", "n_regionkey")),
             ("conversations", ("conv_id", "turn"), ("role", "text")), ("labels", ("doc_id",), ("quality", "toxic")),
             ("pages", ("page_id",), ("url", "html")))


@register("catalog_digest_keyed", "\nunion all\n".join(
    f"select '{t}' as table_name, {i} as position, '{c}' as column_name, "
    f"array_to_string(list(coalesce({c}::varchar, '?') order by {', '.join(k)}), '|') as samples "
    f"from (select * from {t} order by {', '.join(k)} limit 3)"
    for t, k, more in _DIGESTED for i, c in enumerate((*k, *more))))
def q_catalog_digest_keyed(spark, sf_dir):
    """The samples are the first three rows by key."""
    names = [t for t, _, _ in _DIGESTED]
    register_fixtures(spark, sf_dir, names)
    d = catalog.catalog_digest(spark, names, n=3, order_by={t: list(k) for t, k, _ in _DIGESTED})
    samples = F.array_join(F.transform("samples", lambda v: F.coalesce(v, F.lit("?"))), "|")
    return d.select(F.col("table").alias("table_name"), "position", F.col("column").alias("column_name"), samples.alias("samples"))


@register(
    "text_order_dates",
    "select date_trunc('month', o_orderdate)::date as month, count(*) as orders, "
    "count_if(o_orderkey % 5 = 4) as unreadable, "
    "count(distinct case when o_orderkey % 5 <> 4 then o_orderdate::date end) as days from orders group by 1",
)
def q_text_order_dates(spark, sf_dir):
    """Order dates as text in four layouts, one in five spoilt."""
    layouts = ["yyyy-MM-dd", "M/d/yyyy", "d MMM yyyy", "MMMM d, yyyy"]
    kind = F.col("o_orderkey") % 5
    text = F.lit("no date")
    for i, layout in enumerate(layouts):
        text = F.when(kind == i, F.date_format("o_orderdate", layout)).otherwise(text)
    read = table(spark, sf_dir, "orders").select(
        C.month_of("o_orderdate").alias("month"), C.coerce_timestamp(text).cast("date").alias("day"))
    return read.groupBy("month").agg(F.count("*").alias("orders"), F.count_if(F.col("day").isNull()).alias("unreadable"),
                                     F.count_distinct("day").alias("days"))


_DUTIES = (("BUILDING", 0.5), ("MACHINERY", 0.25), ("ELSEWHERE", 0.0))


@register(
    "segment_duties",
    "select segment, count(c_custkey) as customers, round(sum(c_acctbal * duty), 4) as due from "
    f"(values {', '.join(map(str, _DUTIES))}) t(segment, duty) left join customer on c_mktsegment = segment group by 1",
)
def q_segment_duties(spark, sf_dir):
    """A local table of rates joined to the customers."""
    duties = files.from_rows(spark, list(_DUTIES), "segment string, duty double")
    c = table(spark, sf_dir, "customer")
    return (duties.join(c, c.c_mktsegment == duties.segment, "left").groupBy("segment")
            .agg(F.count("c_custkey").alias("customers"), F.round(F.sum(F.col("c_acctbal") * F.col("duty")), 4).alias("due")))


SQL_DAYS = "select strftime(o_orderdate, '%Y-%m-%d') as day, count(*) as n from orders group by 1"


@register("chart_line", f"select 'line' as kind, day as x, n as y from ({SQL_DAYS})")
def q_chart_line(spark, sf_dir):
    """Q4: more than 30 points make a line."""
    register_fixtures(spark, sf_dir, ("orders",))
    kind, frame = ask.chart_data(ask.run_sql(spark, SQL_DAYS))
    return frame.select(F.lit(kind).alias("kind"), "x", "y")


@register(
    "list_tables",
    "\nunion all\n".join(f"select '{t}' as name, true as is_temporary, count(*) as \"rows\" from {t}" for t in FIXTURE_TABLES),
)
def q_list_tables(spark, sf_dir):
    """Registered tables in alphabetical order, with their row counts."""
    register_fixtures(spark, sf_dir)
    return catalog.list_tables(spark, names=FIXTURE_TABLES)


# ---------------------------------------------------------------------------
# P23-P25 text cleaning over whole documents
# ---------------------------------------------------------------------------

_WS = r"'^\s+|\s+$'"


@register(
    "strip_fences",
    "select doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace("
    "'```sql' || chr(10) || text || chr(10) || '```', '```(?:sql)?\\n?', '', 'g'), "
    f"{_WS}, '', 'g'), '`+$', '', 'g'), {_WS}, '', 'g') as cleaned from documents",
)
def q_strip_fences(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    fenced = F.concat(F.lit("```sql\n"), F.col("text"), F.lit("\n```"))
    return docs.select("doc_id", C.strip_fences(fenced).alias("cleaned"))


@register(
    "strip_markdown",
    "select doc_id, regexp_replace(replace(regexp_replace(regexp_replace(text, "
    "'(?m)^#+\\s*.+\\n?', '', 'g'), '\\*{1,2}(.+?)\\*{1,2}', '\\1', 'g'), '`', ''), "
    f"{_WS}, '', 'g') as cleaned from documents",
)
def q_strip_markdown(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", C.strip_markdown("text").alias("cleaned"))


@register(
    "first_lines",
    "select doc_id, array_to_string(l, chr(10)) as lines, len(l) as n_lines from ("
    "select doc_id, list_slice(list_filter(list_transform(string_split(text, chr(10)), "
    f"lambda x: regexp_replace(x, {_WS}, '', 'g')), lambda x: x <> ''), 1, 5) as l from documents)",
)
def q_first_lines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    lines = C.first_lines("text", 5)
    return docs.select("doc_id", F.array_join(lines, "\n").alias("lines"),
                       F.size(lines).cast("bigint").alias("n_lines"))


# ---------------------------------------------------------------------------
# P13-P20 formatting, J3, A15
# ---------------------------------------------------------------------------

@register(
    "order_fields",
    "select o_orderkey, printf('O%06d', o_orderkey) as order_code, printf('C%04d', o_custkey) as customer_code, "
    "strftime(o_orderdate, '%b %Y') as month_label, "
    "case when o_orderstatus = 'F' then cast(o_orderdate as date) + 7 end as delivery_date, "
    "datediff('day', cast(o_orderdate as date), cast(o_orderdate as date) + 3) as stay_days, "
    "greatest(o_totalprice / 1000, 1.0) as k_price, "
    "round(o_totalprice * 2, 2) as double_total, "
    f"{_money_sql('o_totalprice')} as price_text, "
    "coalesce(cast(o_orderstatus as varchar), 'N/A') as status_text "
    "from orders",
)
def q_order_fields(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(
        "o_orderkey",
        C.format_key("O", "o_orderkey", 6).alias("order_code"),
        C.format_key("C", "o_custkey", 4).alias("customer_code"),
        C.month_year("o_orderdate").alias("month_label"),
        C.add_days_if(F.col("o_orderstatus") == "F", "o_orderdate", 7).alias("delivery_date"),
        C.days_between(C.add_days("o_orderdate", 3), "o_orderdate").cast("bigint").alias("stay_days"),
        C.clamp_min(F.col("o_totalprice") / 1000, 1.0).alias("k_price"),
        C.line_total("o_totalprice", F.lit(2)).alias("double_total"),
        C.format_measure("o_totalprice").alias("price_text"),
        C.text_or_na("o_orderstatus").alias("status_text"),
    )


@register(
    "order_totals",
    "select o.o_orderkey, o.o_totalprice, t.total_amount from orders o left join "
    "(select l_orderkey, round(sum(l_extendedprice), 2) as total_amount from lineitem group by 1) t "
    "on o.o_orderkey = t.l_orderkey",
)
def q_order_totals(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    li = table(spark, sf_dir, "lineitem")
    return with_group_total(o, li, "o_orderkey", "l_extendedprice", alias="total_amount",
                            items_key="l_orderkey")


@register(
    "group_summary",
    "select c_mktsegment, count(*) as headcount, floor(avg(c_acctbal))::bigint as avg_balance, "
    "round(avg(c_acctbal), 2) as avg_balance_2 from customer group by 1",
)
def q_group_summary(spark, sf_dir):
    return group_summary(table(spark, sf_dir, "customer"), "c_mktsegment",
                         floor_mean={"avg_balance": "c_acctbal"},
                         round_mean={"avg_balance_2": "c_acctbal"})


# ---------------------------------------------------------------------------
# S21-S23
# ---------------------------------------------------------------------------

@register(
    "daily_orders_filled",
    "select d.day, coalesce(o.n, 0)::bigint as orders from ("
    "select unnest(generate_series(min(cast(o_orderdate as date)), max(cast(o_orderdate as date)), "
    "interval 1 day))::date as day from orders) d left join ("
    "select cast(o_orderdate as date) as day, count(*) as n from orders group by 1) o on d.day = o.day",
)
def q_daily_orders_filled(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    spine = spines.date_spine(spines.data_bounds(o, "o_orderdate"))
    daily = o.groupBy(C.parse_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return spine.join(daily, "day", "left").select(
        "day", F.coalesce("n", F.lit(0)).cast("bigint").alias("orders"))


@register(
    "business_days",
    "select day from (select unnest(generate_series(min(cast(ts as date)), max(cast(ts as date)), "
    "interval 1 day))::date as day from events) where isodow(day) <= 5",
)
def q_business_days(spark, sf_dir):
    return spines.business_days(spines.data_bounds(table(spark, sf_dir, "events"), "ts"))


@register("sample_orders", "select * from orders order by md5('42|' || o_orderkey), o_orderkey limit 100")
def q_sample_orders(spark, sf_dir):
    """100 orders, reproducible for the seed."""
    return spines.sample_n(table(spark, sf_dir, "orders"), ["o_orderkey"], 100, seed=42)


@register("sample_orders_half",
          "select * from orders order by md5('7|' || o_orderkey), o_orderkey limit (select count(*) // 2 from orders)")
def q_sample_orders_half(spark, sf_dir):
    """Half of all orders; a filter below a rank threshold, nothing is sorted."""
    orders = table(spark, sf_dir, "orders")
    return spines.sample_n(orders, ["o_orderkey"], orders.count() // 2, seed=7)
