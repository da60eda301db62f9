"""Registered queries over the driver's fixture tables, with SQL oracles.

Each entry of ``QUERIES`` maps a name to ``fn(spark, sf_dir) -> DataFrame``;
``ORACLE_SQL`` holds the equivalent ANSI SQL (DuckDB dialect) for the entries
that have one.  Column names and rounding are identical on both sides.

Fixture stand-ins for the e-commerce roles: orders -> ``orders``; order items
-> ``lineitem``; line total -> ``l_extendedprice``; category -> ``part.p_type``;
delivered -> ``o_orderstatus = 'F'``; customer state -> ``nation.n_name``;
loyalty tier -> ``c_mktsegment``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.plans import reports
from tablelens.session import materialize

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql.strip()
        return fn

    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def items_with_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their part type as category (stand-in for order_items)."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    return li.join(part, li.l_partkey == part.p_partkey, "inner").select(
        "l_orderkey", F.col("p_type").alias("category"), "l_extendedprice"
    )


# ---------------------------------------------------------------------------
# R1-R6 reports
# ---------------------------------------------------------------------------

@register(
    "revenue_by_category_share",
    """
    select p.p_type as category, count(distinct o.o_orderkey) as total_orders,
      round(sum(l.l_extendedprice), 2) as total_revenue,
      round(avg(l.l_extendedprice), 4) as avg_order_value,
      round(sum(l.l_extendedprice) / sum(sum(l.l_extendedprice)) over () * 100, 2) as revenue_share_pct
    from orders o join lineitem l on o.o_orderkey = l.l_orderkey
    join part p on l.l_partkey = p.p_partkey
    where o.o_orderstatus = 'F'
    group by p.p_type
    order by total_revenue desc, category
    """,
)
def q_revenue_by_category_share(spark, sf_dir):
    return reports.revenue_by_category_share(
        table(spark, sf_dir, "orders"),
        items_with_category(spark, sf_dir),
        order_key="o_orderkey", items_order_key="l_orderkey",
        status_col="o_orderstatus", status_value="F",
        category_col="category", amount_col="l_extendedprice",
    )


@register(
    "revenue_by_category",
    """
    select p.p_type as category, round(sum(l.l_extendedprice), 2) as total_revenue,
      count(*) as total_orders
    from orders o join lineitem l on o.o_orderkey = l.l_orderkey
    join part p on l.l_partkey = p.p_partkey
    where o.o_orderstatus = 'F'
    group by p.p_type
    order by total_revenue desc, category
    """,
)
def q_revenue_by_category(spark, sf_dir):
    return reports.revenue_by_category(
        table(spark, sf_dir, "orders"),
        items_with_category(spark, sf_dir),
        order_key="o_orderkey", items_order_key="l_orderkey",
        status_col="o_orderstatus", status_value="F",
        category_col="category", amount_col="l_extendedprice",
    )


def _twice_f(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.unionByName(orders.where("o_orderstatus = 'F'"))


@register(
    "revenue_by_category_dup_orders",
    """
    select p.p_type as category, round(sum(l.l_extendedprice), 2) as total_revenue,
      count(*) as total_orders
    from (select * from orders union all select * from orders where o_orderstatus = 'F') o
    join lineitem l on o.o_orderkey = l.l_orderkey
    join part p on l.l_partkey = p.p_partkey
    where o.o_orderstatus = 'F'
    group by p.p_type
    """,
)
def q_revenue_by_category_dup_orders(spark, sf_dir):
    """R4 where every delivered order occurs twice: its lines count twice."""
    return reports.revenue_by_category(
        _twice_f(spark, sf_dir), items_with_category(spark, sf_dir),
        order_key="o_orderkey", items_order_key="l_orderkey",
        status_col="o_orderstatus", status_value="F",
        category_col="category", amount_col="l_extendedprice",
    )


@register("revenue_by_category_saved", ORACLE_SQL["revenue_by_category"])
def q_revenue_by_category_saved(spark, sf_dir):
    """R4 with its save step: written below the shared root and read back."""
    return materialize(q_revenue_by_category(spark, sf_dir))


@register(
    "monthly_order_trend",
    """
    select cast(date_trunc('month', cast(o_orderdate as date)) as date) as month,
      count(*) as total_orders, round(sum(o_totalprice), 2) as monthly_revenue,
      round(avg(o_totalprice), 4) as avg_order_value
    from orders group by 1 order by 1
    """,
)
def q_monthly_order_trend(spark, sf_dir):
    return reports.monthly_trend(
        table(spark, sf_dir, "orders"), date_col="o_orderdate", amount_col="o_totalprice"
    )


@register(
    "customer_segments",
    """
    select n.n_name as state, c.c_mktsegment as tier,
      count(distinct c.c_custkey) as customer_count,
      count(distinct o.o_orderkey) as total_orders,
      round(avg(o.o_totalprice), 2) as aov
    from customer c join nation n on c.c_nationkey = n.n_nationkey
    left join orders o on c.c_custkey = o.o_custkey
    group by 1, 2
    order by customer_count desc, state, tier
    limit 20
    """,
)
def q_customer_segments(spark, sf_dir):
    cust = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    c = cust.join(nation, cust.c_nationkey == nation.n_nationkey, "inner").select(
        "c_custkey", "c_mktsegment", F.col("n_name").alias("state")
    )
    return reports.customer_segments(
        c, table(spark, sf_dir, "orders"),
        customer_key="c_custkey", orders_customer_key="o_custkey",
        segment_cols=("state", "c_mktsegment"), segment_aliases=("state", "tier"),
        order_key="o_orderkey", amount_col="o_totalprice", k=20,
    )


@register(
    "top_categories",
    """
    select p.p_type as category, round(sum(l.l_extendedprice), 2) as revenue
    from lineitem l join part p on l.l_partkey = p.p_partkey
    group by 1 order by revenue desc, category limit 5
    """,
)
def q_top_categories(spark, sf_dir):
    return reports.top_groups(
        items_with_category(spark, sf_dir), "category", "l_extendedprice", k=5,
        measure_alias="revenue",
    )


@register(
    "top_customers",
    """
    select o_custkey as customer, round(sum(o_totalprice), 2) as revenue
    from orders group by 1 order by revenue desc, customer limit 10
    """,
)
def q_top_customers(spark, sf_dir):
    return reports.top_groups(
        table(spark, sf_dir, "orders"), "o_custkey", "o_totalprice", k=10,
        key_alias="customer", measure_alias="revenue",
    )


@register(
    "top_group_in_period",
    """
    select n.n_name as nation, round(sum(o.o_totalprice), 2) as spend
    from orders o join customer c on o.o_custkey = c.c_custkey
    join nation n on c.c_nationkey = n.n_nationkey
    where o.o_orderdate >= timestamp '1998-10-01' and o.o_orderdate < timestamp '1999-01-01'
    group by 1 order by spend desc, nation limit 1
    """,
)
def q_top_group_in_period(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", "o_orderdate")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    df = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return reports.top_group_in_period(
        df, "n_name", "o_totalprice", "o_orderdate", "1998-10-01", "1999-01-01", k=1,
        key_alias="nation", measure_alias="spend",
    )


@register(
    "customer_segments_1997",
    """
    select n.n_name as state, c.c_mktsegment as tier,
      count(distinct c.c_custkey) as customer_count,
      count(distinct o.o_orderkey) as total_orders,
      round(avg(o.o_totalprice), 6) as aov
    from customer c join nation n on c.c_nationkey = n.n_nationkey
    left join (select * from orders where year(o_orderdate) = 1997) o on c.c_custkey = o.o_custkey
    group by 1, 2
    """,
)
def q_customer_segments_1997(spark, sf_dir):
    """R3 over one year's orders, which leave many customers without any."""
    cust = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    c = cust.join(nation, cust.c_nationkey == nation.n_nationkey, "inner").select(
        "c_custkey", "c_mktsegment", F.col("n_name").alias("state")
    )
    return reports.customer_segments(
        c, table(spark, sf_dir, "orders").where(F.year("o_orderdate") == 1997),
        customer_key="c_custkey", orders_customer_key="o_custkey",
        segment_cols=("state", "c_mktsegment"), segment_aliases=("state", "tier"),
        order_key="o_orderkey", amount_col="o_totalprice", k=1_000_000, digits=6,
    )
