"""Ready-made business reports.

Each report takes DataFrames plus the names of the columns that play each
role, so the same plan serves any schema (the defaults are the e-commerce
names: orders / order_items / customers).  Everything is declarative; the
joins, filters and aggregates are left to Catalyst and AQE:

* the order-status filter joins the key column of the matching orders only,
  so the line items are never widened; a repeated order repeats its lines;
* distinct counts are a single distinct aggregate per query, which Spark
  plans as a partial aggregate on ``(group, value)`` before the shuffle, so a
  hot group is spread over the ``value`` hash instead of landing in one task;
* top-k is ``orderBy().limit()``, planned as TakeOrderedAndProject.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.functions.columns import month_of, qcol
from tablelens.operators.relational import share_of_total, skew_safe_left_join, top_k
from tablelens.session import materialize


def delivered_items(
    orders: DataFrame,
    items: DataFrame,
    *,
    order_key: str = "order_id",
    items_order_key: str | None = None,
    status_col: str = "status",
    status_value: str = "delivered",
) -> DataFrame:
    """Items whose order has ``status_col = status_value`` (J1 + P3).

    ``orders`` is reduced to the key column of matching orders and joined, so
    a key that occurs twice keeps its items twice; adaptive execution can
    split a hot key on either side.
    """
    ik = items_order_key or order_key
    keys = orders.filter(qcol(status_col) == F.lit(status_value)).select(
        qcol(order_key).alias(ik)
    )
    return items.join(keys, on=ik, how="inner")


def revenue_by_category_share(
    orders: DataFrame,
    items: DataFrame,
    *,
    order_key: str = "order_id",
    items_order_key: str | None = None,
    status_col: str = "status",
    status_value: str = "delivered",
    category_col: str = "category",
    amount_col: str = "line_total",
    digits: int = 2,
    avg_digits: int = 4,
) -> DataFrame:
    """Distinct orders, revenue, average line and share of total revenue."""
    ik = items_order_key or order_key
    sel = delivered_items(orders, items, order_key=order_key, items_order_key=ik,
                          status_col=status_col, status_value=status_value)
    agg = sel.groupBy(qcol(category_col).alias("category")).agg(
        F.count_distinct(qcol(ik)).alias("total_orders"),
        F.sum(qcol(amount_col)).alias("__revenue"),
        F.avg(qcol(amount_col)).alias("__avg"),
    )
    # the grouped rows are written once; their total is a scalar of them
    out = share_of_total(materialize(agg), "__revenue", alias="revenue_share_pct", digits=digits)
    return out.select(
        "category",
        "total_orders",
        F.round("__revenue", digits).alias("total_revenue"),
        F.round("__avg", avg_digits).alias("avg_order_value"),
        "revenue_share_pct",
    ).orderBy(F.col("total_revenue").desc(), "category")


def revenue_by_category(
    orders: DataFrame,
    items: DataFrame,
    *,
    order_key: str = "order_id",
    items_order_key: str | None = None,
    status_col: str = "status",
    status_value: str = "delivered",
    category_col: str = "category",
    amount_col: str = "line_total",
    digits: int = 2,
) -> DataFrame:
    """Revenue and number of item lines per category, for saving."""
    ik = items_order_key or order_key
    sel = delivered_items(orders, items, order_key=order_key, items_order_key=ik,
                          status_col=status_col, status_value=status_value)
    return (
        sel.groupBy(qcol(category_col).alias("category"))
        .agg(
            F.round(F.sum(qcol(amount_col)), digits).alias("total_revenue"),
            F.count(F.lit(1)).alias("total_orders"),
        )
        .orderBy(F.col("total_revenue").desc(), "category")
    )


def monthly_trend(
    orders: DataFrame,
    *,
    date_col: str = "order_date",
    amount_col: str = "total_amount",
    digits: int = 2,
    avg_digits: int = 4,
) -> DataFrame:
    """R2: orders, revenue and average order per calendar month, ascending."""
    return (
        orders.groupBy(month_of(qcol(date_col)).alias("month"))
        .agg(
            F.count(F.lit(1)).alias("total_orders"),
            F.round(F.sum(qcol(amount_col)), digits).alias("monthly_revenue"),
            F.round(F.avg(qcol(amount_col)), avg_digits).alias("avg_order_value"),
        )
        .orderBy("month")
    )


def customer_segments(
    customers: DataFrame,
    orders: DataFrame,
    *,
    customer_key: str = "customer_id",
    orders_customer_key: str | None = None,
    segment_cols: tuple[str, str] = ("state", "loyalty_tier"),
    segment_aliases: tuple[str, str] | None = None,
    order_key: str = "order_id",
    amount_col: str = "total_amount",
    k: int = 20,
    digits: int = 2,
) -> DataFrame:
    """Per segment pair, distinct customers and orders and the average
    order, top ``k`` by customers.  Customers without orders are kept (J2);
    the left join is skew-safe (see ``skew_safe_left_join``)."""
    ock = orders_customer_key or customer_key
    aliases = segment_aliases or segment_cols
    o = orders.select(
        qcol(ock).alias("__ck"), qcol(order_key).alias("__ok"), qcol(amount_col).alias("__amt")
    )
    # customers LEFT JOIN orders, written so a customer holding a third of
    # all orders is still split across tasks
    joined = skew_safe_left_join(customers, o, customer_key, "__ck")
    agg = joined.groupBy(
        qcol(segment_cols[0]).alias(aliases[0]), qcol(segment_cols[1]).alias(aliases[1])
    ).agg(
        F.count_distinct(qcol(customer_key)).alias("customer_count"),
        F.count_distinct("__ok").alias("total_orders"),
        F.round(F.avg("__amt"), digits).alias("aov"),
    )
    return top_k(
        agg,
        [F.col("customer_count").desc(), F.col(aliases[0]), F.col(aliases[1])],
        k,
    )


def top_groups(
    df: DataFrame,
    key: str,
    measure: str,
    k: int = 5,
    *,
    key_alias: str | None = None,
    measure_alias: str = "total",
    digits: int = 2,
) -> DataFrame:
    """The ``k`` groups with the largest sum of ``measure``; ties by key."""
    ka = key_alias or key
    agg = df.groupBy(qcol(key).alias(ka)).agg(
        F.round(F.sum(qcol(measure)), digits).alias(measure_alias)
    )
    return top_k(agg, [F.col(measure_alias).desc(), F.col(ka)], k)


def top_group_in_period(
    df: DataFrame,
    key: str,
    measure: str,
    date_col: str,
    start: str,
    end: str,
    k: int = 1,
    *,
    key_alias: str | None = None,
    measure_alias: str = "total",
    digits: int = 2,
) -> DataFrame:
    """R5 over rows with ``start <= date_col < end`` (pushed to the scan)."""
    d = qcol(date_col)
    period = df.filter((d >= F.lit(start).cast("timestamp_ntz")) & (d < F.lit(end).cast("timestamp_ntz"))) \
        if dict(df.dtypes).get(date_col) == "timestamp_ntz" else \
        df.filter((d >= F.lit(start).cast("date")) & (d < F.lit(end).cast("date")))
    return top_groups(period, key, measure, k, key_alias=key_alias,
                      measure_alias=measure_alias, digits=digits)
