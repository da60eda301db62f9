from pyspark.sql import functions as F
"""Plan shape: scans per table in the detector, no Python UDFs, pushdown."""

from tablelens.operators import profile
from tablelens.operators.stats import column_stats

LINEITEM = "/root/testdata/sf0.001/lineitem.parquet"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_profile_plan_has_no_python_udf(spark):
    df = spark.read.parquet(LINEITEM)
    plan = _plan(profile.profile_table(df))
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    assert "Expand" in plan  # exact distinct counts in one expanded aggregate


def test_stats_is_one_scan_without_distinct(spark):
    df = spark.read.parquet(LINEITEM)
    plan = _plan(column_stats(df, distinct=None))
    assert plan.count("FileScan parquet") == 1


def test_report_filter_reaches_scan(spark):
    from tablelens.plans.registry import QUERIES

    df = QUERIES["top_group_in_period"](spark, "/root/testdata/sf0.001")
    plan = _plan(df)
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in plan


def _table_scans(monkeypatch, df, column):
    """File scans, over every job of the detector, that read the table itself."""
    import tablelens.operators.anomaly as A

    seen = []
    import tablelens.operators.rows as R

    real_collect, real_materialize = type(df).collect, R.materialize
    scans = lambda frame: _plan(frame).count(f"FileScan parquet [{column}")

    def counting_collect(self):
        seen.append(scans(self))
        return real_collect(self)

    def counting_materialize(frame):
        seen.append(scans(frame))
        return real_materialize(frame)

    monkeypatch.setattr(type(df), "collect", counting_collect)
    monkeypatch.setattr(R, "materialize", counting_materialize)
    A.detect(df, "t").collect()
    return sum(seen)


def test_detector_scans_of_eight_numeric_columns(spark, monkeypatch):
    """Statistics, two or three passes for quartiles, outliers, row hashes, rows of repeated hashes."""
    assert _table_scans(monkeypatch, spark.read.parquet(LINEITEM), "l_") <= 7


def test_detector_scans_of_a_wide_table(spark, monkeypatch, tmp_path):
    """Forty numeric columns take as many scans as eight."""
    path = str(tmp_path / "wide")
    spark.range(500).select(*[(F.col("id") * (k + 1)).alias(f"w{k}") for k in range(40)]).write.parquet(path)
    assert _table_scans(monkeypatch, spark.read.parquet(path), "w") <= 7


def test_overview_and_profile_shuffle_hashes_not_texts(spark):
    from tablelens.operators.rows import with_row_hashes

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    plan = _plan(with_row_hashes(pages).groupBy("__h1", "__h2").agg(F.count("*"), F.sum("__nulls")))
    exchanged = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert exchanged and not any("html" in line or "url" in line for line in exchanged)
    plan = _plan(column_stats(pages, sample=False))
    keys = [line for line in plan.splitlines() if "HashAggregate(keys=[" in line and "partial" in line]
    assert keys and not any("html#" in line.split("functions=")[0] for line in keys)


def test_no_cross_joins_or_row_udfs_in_any_registered_query(spark):
    """Every registered query on the smallest fixtures: no cartesian product,
    no nested-loop join, no row-at-a-time Python UDF."""
    import __spark_entry__ as entry
    from tablelens.plans import registry

    bad = {}
    for name, fn in entry.queries().items():
        if name not in registry.QUERIES:
            continue  # an optional part's queries have tests of their own
        plan = _plan(fn(spark, "/root/testdata/sf0.001"))
        hits = [t for t in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython") if t in plan]
        if hits:
            bad[name] = hits
    assert not bad, bad
