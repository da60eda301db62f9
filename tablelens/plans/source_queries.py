"""Registered round trips through the file sources.

Each query writes a fixture table with Spark into a fresh folder below the
shared checkpoint root, then reads it back through the library's reader, so
the work grows with the table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tablelens.plans.registry import register, table
from tablelens.session import local_path, shared_dir
from tablelens.sources import files, sqlite, workbook

CUSTOMER_SQL = (
    "select c_custkey, c_name, c_nationkey::bigint as c_nationkey, c_acctbal, c_mktsegment from customer"
)


def _scratch(spark, kind):
    return shared_dir(spark, f"{kind}-{uuid.uuid4().hex}")


@register(
    "csv_customer",
    "select c_custkey, c_name, c_nationkey::bigint as c_nationkey, c_acctbal, "
    "case when c_mktsegment in ('BUILDING', 'MACHINERY') then null else c_mktsegment end as c_mktsegment "
    "from customer",
)
def q_csv_customer(spark, sf_dir):
    """Missing-value tokens ('NA', 'null') become null; types inferred."""
    c = table(spark, sf_dir, "customer")
    seg = (F.when(F.col("c_mktsegment") == "BUILDING", F.lit("NA"))
           .when(F.col("c_mktsegment") == "MACHINERY", F.lit("null"))
           .otherwise(F.col("c_mktsegment")))
    path = _scratch(spark, "csv") + "/customer.csv"
    c.select("c_custkey", "c_name", "c_nationkey", "c_acctbal", seg.alias("c_mktsegment")) \
        .write.mode("overwrite").option("header", "true").csv(path)
    return files.read_table(spark, path)


@register("csv_documents", "select * from documents")
def q_csv_documents(spark, sf_dir):
    """Whole documents with line breaks and quotes, in plain RFC 4180 form."""
    docs = table(spark, sf_dir, "documents")
    path = _scratch(spark, "csv") + "/documents.csv"
    docs.write.mode("overwrite").options(header="true", escape='"', ignoreLeadingWhiteSpace="false",
                                         ignoreTrailingWhiteSpace="false").csv(path)
    return files.read_table(spark, path)


@register(
    "csv_codes",
    "select o_orderkey, printf('%02d:00:00', o_orderkey % 24) as clock, (o_orderkey % 9) || 'D' as code, "
    "strftime(o_orderdate, '%Y-%m') as month, cast(o_orderdate as date) as day from orders",
)
def q_csv_codes(spark, sf_dir):
    """Clock times, months and suffixed codes stay text; dates are dates."""
    o = table(spark, sf_dir, "orders")
    path = _scratch(spark, "csv") + "/codes.csv"
    o.select("o_orderkey", F.format_string("%02d:00:00", F.col("o_orderkey") % 24).alias("clock"),
             F.concat((F.col("o_orderkey") % 9).cast("string"), F.lit("D")).alias("code"),
             F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.to_date("o_orderdate").alias("day")
             ).write.mode("overwrite").option("header", "true").csv(path)
    return files.read_table(spark, path)


@register(
    "load_files_tables",
    "select 'customer' as \"table\", count(*) as \"rows\", 5 as \"columns\" from customer "
    "union all select 'orders', count(*), 6 from orders",
)
def q_load_files(spark, sf_dir):
    """S2 + S5: a CSV and a Parquet file loaded by suffix, one table each."""
    c = table(spark, sf_dir, "customer")
    path = _scratch(spark, "csv") + "/customer.csv"
    c.write.mode("overwrite").option("header", "true").csv(path)
    loaded = files.load_files(spark, [path, f"{sf_dir.rstrip('/')}/orders.parquet"])
    parts = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("table"), "rows", F.lit(len(df.columns)).alias("columns"))
        for name, df in loaded.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("workbook_customer", CUSTOMER_SQL)
def q_workbook_customer(spark, sf_dir):
    """S3: the table written as workbooks (one per partition), read back with
    one input partition per (file, sheet) and inferred types."""
    c = table(spark, sf_dir, "customer")
    out_dir = local_path(_scratch(spark, "xlsx"))
    workbook.write_workbooks(c, out_dir, "customer").collect()  # one path per file
    return workbook.read_sheet(spark, f"{out_dir}/*.xlsx", "customer")


@register("sqlite_customer", CUSTOMER_SQL)
def q_sqlite_customer(spark, sf_dir):
    """The table written as SQLite files (one per partition), read back
    by rowid ranges of 500 rows (several input partitions per file)."""
    c = table(spark, sf_dir, "customer")
    out_dir = local_path(_scratch(spark, "sqlite"))
    sqlite.write_sqlite(c, out_dir, "customer").collect()  # one path per file
    return sqlite.read_sqlite(spark, f"{out_dir}/*.sqlite", "customer", rows_per_partition=500)


@register("stream_event_anomalies")
def q_stream_event_anomalies(spark, sf_dir):
    """Anomaly checks of the events table arriving as a file stream, two
    files per micro-batch; the per-batch reports are read back (rows only:
    batch boundaries depend on file order)."""
    from tablelens.streaming.monitor import monitor_files, read_reports

    ev = table(spark, sf_dir, "events")
    src = _scratch(spark, "stream-src")
    ev.repartition(4).write.mode("overwrite").parquet(src)
    report = _scratch(spark, "stream-report")
    q = monitor_files(spark, src, ev.schema, "events", report, _scratch(spark, "stream-ckpt"),
                      max_files_per_trigger=2)
    q.awaitTermination()
    return read_reports(spark, report)


def _ingest(spark, sf_dir, buckets=None):
    from tablelens.sources import catalog

    base = _scratch(spark, "lake")
    db = f"tablelens_lake_{uuid.uuid4().hex[:12]}"  # runs at the same time do not meet
    names = catalog.ingest(
        spark, {"orders": table(spark, sf_dir, "orders"), "Order Items": table(spark, sf_dir, "lineitem")},
        base, db, buckets=buckets)
    return db, names


@register(
    "lake_revenue",
    "select o_orderstatus, count(*) as lines, round(sum(l_extendedprice), 2) as revenue "
    "from orders o join lineitem l on o.o_orderkey = l.l_orderkey group by 1",
)
def q_lake_revenue(spark, sf_dir):
    """Tables written to the lake, registered in a database and
    queried by catalog name."""
    db, _ = _ingest(spark, sf_dir)
    return spark.sql(
        f"select o_orderstatus, count(*) as lines, round(sum(l_extendedprice), 2) as revenue "
        f"from {db}.orders o join {db}.order_items l on o.o_orderkey = l.l_orderkey group by 1"
    )


@register(
    "lake_revenue_bucketed",
    "select o_orderstatus, count(*) as lines, round(sum(l_extendedprice), 2) as revenue "
    "from orders o join lineitem l on o.o_orderkey = l.l_orderkey group by 1",
)
def q_lake_revenue_bucketed(spark, sf_dir):
    """S16 with J1: both tables stored in buckets of the order key, joined
    where they lie (no exchange below the join)."""
    db, _ = _ingest(spark, sf_dir, {"orders": (8, ["o_orderkey"]), "Order Items": (8, ["l_orderkey"])})
    return spark.sql(
        f"select /*+ merge(o, l) */ o_orderstatus, count(*) as lines, round(sum(l_extendedprice), 2) as revenue "
        f"from {db}.orders o join {db}.order_items l on o.o_orderkey = l.l_orderkey group by 1"
    )


@register(
    "lake_replaced",
    "select o_orderpriority, count(*) as orders, round(sum(o_totalprice), 2) as total from orders "
    "where o_orderstatus = 'F' group by 1",
)
def q_lake_replaced(spark, sf_dir):
    """A stored table replaced by some of its own rows, then read."""
    from tablelens.sources import catalog

    base = _scratch(spark, "lake")
    catalog.write_lake(table(spark, sf_dir, "orders"), base, "orders")
    mine = catalog.read_lake(spark, base, "orders").where(F.col("o_orderstatus") == "F")
    catalog.write_lake(mine, base, "orders")  # reads the old version while it writes the new one
    return catalog.read_lake(spark, base, "orders").groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@register("csv_broken_lines",
          "select conv_id, turn, role, text || chr(10) || '\"' || role || '\", said' as text from conversations "
          "where text is not null")
def q_csv_broken_lines(spark, sf_dir):
    """One large CSV file whose every record holds a quoted line break."""
    said = table(spark, sf_dir, "conversations").where("text is not null").select(
        "conv_id", "turn", "role", F.concat("text", F.lit('\n"'), "role", F.lit('", said')).alias("text"))
    path = _scratch(spark, "csv") + "/said.csv"
    said.coalesce(1).write.mode("overwrite").options(header="true", escape='"', ignoreLeadingWhiteSpace="false",
                                                     ignoreTrailingWhiteSpace="false").csv(path)
    kinds = said.schema  # types as they were; the reader infers BIGINT for whole numbers
    return files.read_table(spark, path).select(*[F.col(f.name).cast(f.dataType) for f in kinds])


@register(
    "lake_tables",
    "select 'order_items' as name, false as is_temporary, count(*) as \"rows\" from lineitem "
    "union all select 'orders', false, count(*) from orders",
)
def q_lake_tables(spark, sf_dir):
    """The tables of the lake database with their row counts."""
    from tablelens.sources import catalog

    db, _ = _ingest(spark, sf_dir)
    return catalog.list_tables(spark, db, ("orders", "order_items")).where("not is_temporary")


@register(
    "table_sample_count",
    "select count(*) as sample_rows, (select count(*) from orders) as table_rows "
    "from (select * from orders limit 5)",
)
def q_table_sample_count(spark, sf_dir):
    """S12 + S14: a 5-row sample (any rows) and the full row count."""
    from tablelens.sources import catalog

    o = table(spark, sf_dir, "orders")
    sample = catalog.sample_rows(o, 5)
    return sample.agg(F.count(F.lit(1)).alias("sample_rows")).select(
        "sample_rows", F.lit(catalog.row_count(o)).cast("bigint").alias("table_rows"))


@register(
    "batch_schema_drift",
    "select 'batch_1' as from_batch, 'batch_2' as to_batch, 'added' as change, 'discount_code' as \"column\" "
    "union all select 'batch_2', 'batch_3', 'removed', 'o_orderpriority' "
    "union all select 'batch_2', 'batch_3', 'removed', 'discount_code'",
)
def q_batch_schema_drift(spark, sf_dir):
    """D9 over stored batches: the orders table written as three batch
    folders whose columns change, compared batch to batch."""
    from tablelens.operators.drift import batch_drift, read_batches

    o = table(spark, sf_dir, "orders")
    root = _scratch(spark, "batches")
    o.write.mode("overwrite").parquet(f"{root}/batch_1")
    o.withColumn("discount_code", F.lit("none")).write.mode("overwrite").parquet(f"{root}/batch_2")
    o.drop("o_orderpriority").write.mode("overwrite").parquet(f"{root}/batch_3")
    return batch_drift(spark, read_batches(spark, [f"{root}/batch_{i}" for i in (1, 2, 3)]))


@register(
    "stream_null_rates",
    "\nunion all\n".join(
        f"select '{c}' as \"column\", count(*) as \"rows\", count(*) - count({c}) as nulls, "
        f"round((count(*) - count({c})) / count(*) * 100, 2) as null_pct from events"
        for c in ("event_id", "ts", "user_id", "event_type", "value", "props")
    ),
)
def q_stream_null_rates(spark, sf_dir):
    """Running null rates of the events table arriving as a file stream
    (two files per micro-batch, stateful aggregation); after the stream has
    drained, the rates equal those of the whole table."""
    from tablelens.streaming.monitor import monitor_null_rates

    ev = table(spark, sf_dir, "events")
    src = _scratch(spark, "stream-src")
    ev.repartition(4).write.mode("overwrite").parquet(src)
    report = _scratch(spark, "stream-rates")
    q = monitor_null_rates(spark, src, ev.schema, report, _scratch(spark, "stream-ckpt"),
                           max_files_per_trigger=2)
    q.awaitTermination()
    return spark.read.parquet(report).select("column", "rows", "nulls", "null_pct")
