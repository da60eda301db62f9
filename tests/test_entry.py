"""Driver contract and the SQL oracle on the smallest fixtures."""

import pytest

import __spark_entry__ as entry

FAST = [
    "revenue_by_category_share", "monthly_order_trend", "customer_segments", "kpis",
    "column_profile_orders", "table_overview_flags", "histogram_events", "null_anomalies",
    "zero_variance", "strip_markdown", "first_lines", "daily_orders_filled", "schema_drift",
    "sql_monthly_strftime", "order_fields",
]


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() >= 0 and df.columns


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", FAST)
def test_oracle_matches_at_sf0001(spark, name):
    from tests.oracle import compare

    res = compare(spark, "/root/testdata/sf0.001", [name], verbose=False)
    assert res[name] == "ok", res[name]


def test_entry_from_another_directory(tmp_path):
    """Python workers must import the package even when the driver runs
    elsewhere (it is shipped with addPyFile)."""
    import subprocess
    import sys

    root = __import__("os").path.dirname(__import__("os").path.dirname(__import__("os").path.abspath(__file__)))
    code = (
        "import sys; sys.path.insert(0, %r)\n"
        "from pyspark.sql import SparkSession\n"
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "import __spark_entry__ as e\n"
        "print('ROWS', e.queries()['sqlite_customer'](s, '/root/testdata/sf0.001').count())\n"
    ) % root
    out = subprocess.run([sys.executable, "-c", code], cwd=str(tmp_path), capture_output=True, text=True, timeout=600)
    assert "ROWS 150" in out.stdout, out.stderr[-2000:]
