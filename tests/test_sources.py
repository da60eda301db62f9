"""CSV tokens and inference, workbooks with several sheets, SQLite files."""

import os
import sqlite3

from tablelens.sources import files, workbook
from tablelens.sources.catalog import register, safe_table_name
from tablelens.sources.sqlite import read_sqlite_tables


def test_csv_tokens_and_types(spark, tmpdir_local):
    path = os.path.join(tmpdir_local, "My Data-1.csv")
    with open(path, "w") as fh:
        fh.write('id,amount,flag,day,name,at\n1,2.5,true,2024-01-02,"Smith, J",2024-01-02 10:30:00\n'
                 "2,NA,false,2024-01-03,null,2024-01-03\n3,,TRUE,N/A,x,\n")
    tables = files.load_files(spark, [path])
    assert list(tables) == ["My_Data_1"]
    df = tables["My_Data_1"]
    assert dict(df.dtypes) == {"id": "bigint", "amount": "double", "flag": "boolean",
                               "day": "date", "name": "string", "at": "timestamp"}
    rows = [tuple(r) for r in df.orderBy("id").collect()]
    assert rows[0][4] == "Smith, J" and rows[1][1] is None and rows[1][4] is None
    assert rows[2][2] is True and rows[2][3] is None
    assert safe_table_name("My Data-1") == "my_data_1"
    assert register(df, "My Data-1") == "my_data_1"


def test_workbook_two_sheets(spark, tmpdir_local):
    path = os.path.join(tmpdir_local, "sales book.xlsx")
    data = workbook.workbook_bytes([
        ("Q1 data", ["id", "amount"], [(1, 10.5), (2, None)]),
        ("notes", ["text"], [("hello",), ("NA",)]),
    ])
    with open(path, "wb") as fh:
        fh.write(data)
    tables = files.load_files(spark, [path])
    assert sorted(tables) == ["sales_book_Q1_data", "sales_book_notes"]
    q1 = tables["sales_book_Q1_data"]
    assert dict(q1.dtypes) == {"id": "bigint", "amount": "double"}
    assert sorted((r["id"], r["amount"]) for r in q1.collect()) == [(1, 10.5), (2, None)]
    assert [r["text"] for r in tables["sales_book_notes"].collect()] == ["hello", None]


def test_sqlite_two_tables(spark, tmpdir_local):
    path = os.path.join(tmpdir_local, "shop.sqlite")
    con = sqlite3.connect(path)
    con.execute("create table a (id integer, name text, price real)")
    con.executemany("insert into a values (?, ?, ?)", [(i, f"n{i}", i * 1.5) for i in range(25)])
    con.execute("create table b (k text)")
    con.execute("insert into b values ('x')")
    con.commit()
    con.close()
    tables = files.load_files(spark, [path])
    assert sorted(tables) == ["a", "b"]
    a = tables["a"]
    assert dict(a.dtypes) == {"id": "bigint", "name": "string", "price": "double"}
    assert a.count() == 25 and tables["b"].collect()[0]["k"] == "x"
    from tablelens.sources.sqlite import read_sqlite

    assert read_sqlite(spark, [path], "a", rows_per_partition=4).rdd.getNumPartitions() == 7


def test_workbook_duplicate_and_empty_headers(spark, tmpdir_local):
    path = os.path.join(tmpdir_local, "dups.xlsx")
    with open(path, "wb") as fh:
        fh.write(workbook.workbook_bytes([("s", ["a", "a", None, "b"], [(1, 2, 3, "x")])]))
    df = workbook.read_sheet(spark, [path], "s")
    assert df.columns == ["a", "a.1", "Unnamed: 2", "b"]
    assert tuple(df.collect()[0]) == (1, 2, 3, "x")


def test_csv_with_given_schema(spark, tmpdir_local):
    path = os.path.join(tmpdir_local, "given.csv")
    with open(path, "w") as fh:
        fh.write("a,b\n1,x\nNA,y\nbad,z\n")
    df = files.read_csv(spark, path, schema="a int, b string")
    assert dict(df.dtypes) == {"a": "int", "b": "string"}
    assert [tuple(r) for r in df.collect()] == [(1, "x"), (None, "y"), (None, "z")]


def test_ingest_and_read_lake(spark, tmpdir_local):
    from tablelens.sources import catalog

    a = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string")
    names = catalog.ingest(spark, {"My Table": a}, os.path.join(tmpdir_local, "lake"), "test_lake_db")
    assert names == ["test_lake_db.my_table"]
    assert spark.table("test_lake_db.my_table").count() == 2
    listed = catalog.list_tables(spark, "test_lake_db").collect()
    assert [r["name"] for r in listed if not r["is_temporary"]] == ["my_table"]
    assert catalog.read_lake(spark, os.path.join(tmpdir_local, "lake"), "my_table").count() == 2
    catalog.ingest(spark, {"My Table": a.limit(1)}, os.path.join(tmpdir_local, "lake"), "test_lake_db")
    assert spark.table("test_lake_db.my_table").count() == 1  # overwritten, not appended


def test_a_failed_replace_leaves_the_old_rows(spark, tmpdir_local):
    import pytest
    from pyspark.sql import functions as F
    from tablelens.sources import catalog

    base = os.path.join(tmpdir_local, "lake2")
    old = spark.range(100)
    catalog.write_lake(old, base, "t")
    reader = catalog.read_lake(spark, base, "t")
    bad = spark.range(1000).repartition(8).select(
        F.when(F.col("id") == 999, F.raise_error(F.lit("midway")).cast("bigint")).otherwise(F.col("id") + 1000).alias("id"))
    with pytest.raises(Exception, match="midway"):
        catalog.write_lake(bad, base, "t")
    assert catalog.read_lake(spark, base, "t").agg(F.sum("id")).first()[0] == 4950
    catalog.write_lake(spark.range(5), base, "t")
    assert catalog.read_lake(spark, base, "t").count() == 5 and reader.count() == 100  # an earlier reader goes on
    assert catalog.drop_old_versions(spark, base, "t") == []
    assert len(catalog.drop_old_versions(spark, base, "t", keep_seconds=0)) == 1
    assert catalog.read_lake(spark, base, "t").count() == 5


def test_catalog_tables_change_by_location(spark, tmpdir_local):
    from tablelens.sources import catalog

    base, db = os.path.join(tmpdir_local, "lake3"), "test_swap_db"
    a = spark.range(50).selectExpr("id as k", "id * 2 as v")
    for n in (50, 20):
        catalog.ingest(spark, {"t": a.limit(n), "b": a.limit(n)}, base, db, buckets={"b": (4, ["k"])})
        assert spark.table(f"{db}.t").count() == n == spark.table(f"{db}.b").count()
    catalog.ingest(spark, {"t": a.selectExpr("k", "cast(v as string) as v", "1 as more")}, base, db)
    assert spark.table(f"{db}.t").columns == ["k", "v", "more"]
    assert sorted(t.name for t in spark.catalog.listTables(db) if not t.isTemporary) == ["b", "t"]


def test_bucketed_join_needs_no_exchange_below_it(spark):
    import __spark_entry__ as entry

    df = entry.queries()["lake_revenue_bucketed"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("SortMergeJoin"):]
    assert "Exchange" not in below.split("Initial Plan")[0]
