"""KPI cards, schema drift, text cleaning, formatting and ad-hoc SQL."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from tablelens.functions import columns as C
from tablelens.operators import drift, kpi
from tablelens.plans import ask


def test_kpi_choice_dedupe_and_cap(spark):
    orders = spark.createDataFrame(
        [(1, "c1", 150.0, dt.datetime(2023, 1, 5)), (2, "c2", 50.5, dt.datetime(2024, 3, 1))],
        "order_id int, customer_id string, total_amount double, order_date timestamp",
    )
    other = spark.createDataFrame([(1, "x", "2022-02-02")], "id int, user_id string, ship_date string")
    cards = [tuple(r) for r in kpi.kpis({"orders": orders, "other": other}).collect()]
    assert cards == [
        ("Total Rows", "2", "across 2 table(s)"),
        ("Total Total Amount", "$200", "orders"),
        ("Date Range", "Jan 2023 – Mar 2024", "order_date"),
        ("Unique Customer Id", "2", "orders"),
    ]


def test_kpi_small_sum_and_unparseable_dates(spark):
    df = spark.createDataFrame([(1.25, "not a date"), (2.5, "soon")], "price double, due_date string")
    cards = {r["label"]: r for r in kpi.kpis({"t": df}).collect()}
    assert cards["Total Price"]["value"] == "3.75"
    assert "Date Range" not in cards


def test_schema_drift_mirrors(spark):
    a = spark.createDataFrame([], "a int, b int")
    b = spark.createDataFrame([], "b int, c int, d string")
    ab = sorted(tuple(r) for r in drift.schema_drift(a, b).collect())
    ba = sorted(tuple(r) for r in drift.schema_drift(b, a).collect())
    assert ab == [("added", "c"), ("added", "d"), ("removed", "a")]
    flip = {"added": "removed", "removed": "added"}
    assert sorted((flip[c], n) for c, n in ab) == ba
    typed = drift.schema_drift(a, spark.createDataFrame([], "a string, b int"), with_types=True).collect()
    assert [(r["change"], r["column"]) for r in typed] == [("type_changed", "a")]


# (text, without fences, without markdown, its first five lines)
CLEANED = [
    ("```sql\nSELECT 1\n```", "SELECT 1", "sql\nSELECT 1", ["```sql", "SELECT 1", "```"]),
    ("  ```\nselect *\nfrom t``` \n", "select *\nfrom t", "select *\nfrom t", ["```", "select *", "from t```"]),
    ("# Title\nSome **bold** and *it* text `code`\n## Sub\nend  ", "# Title\nSome **bold** and *it* text `code`\n## Sub\nend",
     "Some bold and it text code\nend", ["# Title", "Some **bold** and *it* text `code`", "## Sub", "end"]),
    ("\n\n  line one  \n\nline two\n   \nthree\nfour\nfive\nsix\n", "line one  \n\nline two\n   \nthree\nfour\nfive\nsix",
     "line one  \n\nline two\n   \nthree\nfour\nfive\nsix", ["line one", "line two", "three", "four", "five"]),
    ("", "", "", []),
]


@pytest.mark.parametrize("text, fences, markdown, lines", CLEANED)
def test_text_cleaning(spark, text, fences, markdown, lines):
    df = spark.createDataFrame([(text,)], "t string")
    r = df.select(C.strip_fences("t").alias("f"), C.strip_markdown("t").alias("m"),
                  C.first_lines("t", 5).alias("l")).collect()[0]
    assert (r["f"], r["m"], r["l"]) == (fences, markdown, lines)


def test_formatting_helpers(spark):
    df = spark.createDataFrame([(7, 12345.5, 42.0, "total_amount")], "k long, big double, small double, n string")
    r = df.select(
        C.format_key("C", "k", 4).alias("key"), C.format_key("C", F.lit(123456), 4).alias("long_key"),
        C.format_measure("big").alias("big"), C.format_measure("small").alias("small"),
        C.title_label_col("n").alias("title"), C.text_or_na(F.lit(None)).alias("na"),
        C.clamp_min(F.lit(0.2), 1.0).alias("clamp"),
    ).collect()[0]
    assert (r["key"], r["long_key"]) == ("C0007", "C123456")
    assert (r["big"], r["small"]) == ("$12,346", "42.00")
    assert r["title"] == "Total Amount" and C.title_label("total_amount") == "Total Amount"
    assert r["na"] == "N/A" and r["clamp"] == 1.0
    assert C.strftime_pattern("%Y-%m-%d %H:%M") == "yyyy-MM-dd HH:mm"


def test_run_sql_refuses_non_queries(spark):
    spark.createDataFrame([(1, dt.datetime(2024, 5, 1))], "a int, ts timestamp").createOrReplaceTempView("tq")
    assert ask.run_sql(spark, "-- c\n select a from tq").collect()[0]["a"] == 1
    r = ask.run_sql(spark, "select strftime(ts, '%Y-%m') as ym from tq").collect()[0]
    assert r["ym"] == "2024-05"
    assert ask.run_sql(spark, "describe tq").count() == 2
    assert ask.run_sql(spark, "show tables").where("tableName = 'tq'").count() == 1
    assert ask.run_sql(spark, "explain select a from tq").count() == 1
    for bad in ("drop table tq", "insert into tq values (1, null)", "create table x (a int)", "set a = 1", "cache table tq",
                "with c as (select 1 as a) insert into tq select a, null from c",
                "from values (5) as v(a) insert into tq select a, null"):
        with pytest.raises(ValueError):
            ask.run_sql(spark, bad)


def test_chart_data_rules(spark):
    small = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    kind, frame = ask.chart_data(small)
    assert kind == "bar" and frame.columns == ["x", "y"]
    big = spark.range(40).select(F.col("id").alias("x"), (F.col("id") * 2).alias("y"))
    assert ask.chart_data(big)[0] == "line"
    assert ask.chart_data(spark.createDataFrame([("a",)], "k string")) is None
    assert ask.chart_data(spark.createDataFrame([], "k string, v int")) is None


def test_skew_safe_left_join_equals_left_join(spark):
    from tablelens.operators.relational import skew_safe_left_join

    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (3, "c2"), (None, "n")], "k int, v string")
    right = spark.createDataFrame([(1, 10.0)] * 5 + [(3, 1.0), (4, 2.0), (None, 0.0)], "rk int, x double")
    got = sorted(map(tuple, skew_safe_left_join(left, right, "k", "rk").collect()), key=str)
    exp = sorted(map(tuple, left.join(right, left.k == right.rk, "left").collect()), key=str)
    assert got == exp


def test_kpis_and_profile_of_empty_table(spark):
    from tablelens.operators import profile

    df = spark.createDataFrame([], "order_id int, amount double, order_date timestamp")
    cards = {r["label"]: r["value"] for r in kpi.kpis({"t": df}).collect()}
    assert cards == {"Total Rows": "0", "Total Amount": "0.00"}
    prof = profile.profile_table(df).collect()
    assert [r["null_pct"] for r in prof] == [None, None, None]
    assert [r["sample_value"] for r in prof] == ["N/A"] * 3


def test_coerce_timestamp_layouts(spark):
    df = spark.createDataFrame([("2024-01-05",), ("1/5/2024",), ("Jan 5, 2024",), ("5.1.2024",), ("soon",)], "s string")
    got = [r["t"] for r in df.select(C.coerce_timestamp("s").alias("t")).collect()]
    assert got[:4] == [dt.datetime(2024, 1, 5)] * 4 and got[4] is None


def test_spines(spark):
    from tablelens.sources import spines

    days = spines.date_spine_between(spark, "2023-01-01", "2024-12-31")
    assert days.count() == 731
    b = spark.range(1).selectExpr("date'2023-01-01' as start", "date'2024-12-31' as end")
    assert spines.business_days(b).count() == 522
    ts = [r["ts"] for r in spines.timestamp_spine(spark, "2024-01-01 00:00:00", "2024-01-02 00:00:00", 5).collect()]
    assert ts[0] == dt.datetime(2024, 1, 1) and ts[-1] == dt.datetime(2024, 1, 2) and len(ts) == 5
    assert ts[2] == dt.datetime(2024, 1, 1, 12)


def test_sample_n_is_reproducible(spark):
    from tablelens.sources import spines

    df = spark.range(1000).selectExpr("id as k")
    a = [r["k"] for r in spines.sample_n(df, ["k"], 10, seed=7).collect()]
    b = [r["k"] for r in spines.sample_n(df.repartition(5), ["k"], 10, seed=7).collect()]
    assert a == b and len(set(a)) == 10


def test_query_log_counts_rows_during_write(spark, tmp_path):
    spark.range(7).createOrReplaceTempView("seven")
    log = str(tmp_path / "log")
    res = str(tmp_path / "res")
    n = ask.log_query(spark, "how many?", "select * from seven", ask.run_sql(spark, "select * from seven"),
                      log_path=log, result_root=res)
    ask.log_query(spark, "again", "select 1", ask.run_sql(spark, "select 1"), log_path=log, result_root=res)
    recent = ask.recent_queries(spark, log, n=10).collect()
    assert n == 7 and [r["question"] for r in recent] == ["again", "how many?"]
    assert [r["rows"] for r in recent] == [1, 7]


def test_column_helpers(spark):
    df = spark.createDataFrame(
        [(1, 2.5, True, "2024-02-10", "total_amount"), (2, None, False, "oops", "x")],
        "Order_ID int, Total_Price double, flag boolean, d string, n string")
    assert C.numeric_columns(df) == ["Order_ID", "Total_Price"]
    assert C.other_columns(df) == ["flag", "d", "n"]
    r = df.select(
        C.equals("Order_ID", 1).alias("eq"), C.outside("Total_Price", 0.0, 2.0).alias("out"),
        C.parse_date("d").alias("pd"), C.month_of("d").alias("mo"), C.month_year(C.parse_date("d")).alias("my"),
        C.add_days_if(F.col("flag"), "d", 3).alias("plus3"), C.days_between(F.lit("2024-03-01"), "d").alias("gap"),
    ).collect()
    assert (r[0]["eq"], r[0]["out"], r[0]["pd"], r[0]["mo"], r[0]["my"]) == (
        True, True, dt.date(2024, 2, 10), dt.date(2024, 2, 1), "Feb 2024")
    assert r[0]["plus3"] == dt.date(2024, 2, 13) and r[0]["gap"] == 20
    assert (r[1]["eq"], r[1]["pd"], r[1]["plus3"]) == (False, None, None)


def test_csv_records(spark, tmp_path):
    from tablelens.sources import files

    def read(text, **kw):
        (tmp_path / "t.csv").write_text(text)
        return files.read_csv(spark, str(tmp_path / "t.csv"), **kw)

    df = read('a,b\n"x ""y"" z",1\n"two\nlines",2\nshort\n')
    assert [tuple(r) for r in df.collect()] == [('x "y" z', 1), ("two\nlines", 2), ("short", None)]
    with pytest.raises(ValueError):
        read("a,b\n1,2\n3,4,5\n")
    df = read("a,a,t,m,c,d,s\n1,2.5,08:00:00,2024-05,1D,2024-05-01,2024-05-01 10:00:00\n")
    assert df.columns == ["a", "a.1", "t", "m", "c", "d", "s"]
    assert [t for _, t in df.dtypes] == ["bigint", "double", "string", "string", "string", "date", "timestamp"]


def test_nan_is_no_money_and_no_person(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1.0, 1.0), (nan, nan), (nan, 2.0)], "price double, user_id double")
    cards = {r["label"]: r["value"] for r in kpi.kpis({"t": df}).collect()}
    assert cards["Total Price"] == "1.00" and cards["Unique User Id"] == "2"


def test_share_of_total_has_no_single_task(spark):
    from tablelens.operators.relational import share_of_total

    df = share_of_total(spark.createDataFrame([("a", 1.0), ("b", 3.0)], "k string, v double"), "v")
    assert sorted(r["share_pct"] for r in df.collect()) == [25.0, 75.0]
    assert "Window" not in df._jdf.queryExecution().executedPlan().toString()


def test_sql_functions_are_known_in_a_new_session(spark):
    fresh = spark.newSession()
    got = ask.run_sql(fresh, "select strftime(timestamp '2024-03-01 00:00:00', '%Y-%m') as ym").collect()
    assert got[0]["ym"] == "2024-03"
