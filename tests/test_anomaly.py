"""Edge cases of the data-quality checks (thresholds, NaN, IQR guard, ...)."""

import math

from pyspark.sql import functions as F

from tablelens.operators import anomaly


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_empty_table_reports_nothing(spark):
    df = spark.createDataFrame([], "x double, s string")
    assert rows(anomaly.detect(df, "t")) == []


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (1.0,), (2.0,)], "x double")
    out = rows(anomaly.detect(df, "t", checks=("nulls",)))
    assert len(out) == 1
    assert out[0]["severity"] == "high" and out[0]["value"] == 50.0
    assert out[0]["description"] == "50.0% of values are null (2 rows)"


def test_null_thresholds_are_inclusive(spark):
    d20 = spark.createDataFrame([(None,)] * 2 + [(i,) for i in range(8)], "x int")
    d50 = spark.createDataFrame([(None,)] * 5 + [(i,) for i in range(5)], "x int")
    d19 = spark.createDataFrame([(None,)] * 19 + [(i,) for i in range(81)], "x int")
    assert [r["severity"] for r in rows(anomaly.detect(d20, "t", checks=("nulls",)))] == ["medium"]
    assert [r["severity"] for r in rows(anomaly.detect(d50, "t", checks=("nulls",)))] == ["high"]
    assert rows(anomaly.detect(d19, "t", checks=("nulls",))) == []


def test_duplicate_threshold_and_null_safe_rows(spark):
    base = [(i, f"v{i}") for i in range(19)]
    d20 = spark.createDataFrame(base + [base[0]], "a int, b string")  # 1 of 20 = 5 %
    d21 = spark.createDataFrame(base + [(99, "x"), base[0]], "a int, b string")  # 1 of 21
    out = rows(anomaly.detect(d20, "t", checks=("duplicates",)))
    assert len(out) == 1 and out[0]["column"] == "(entire row)" and out[0]["value"] == 5.0
    assert rows(anomaly.detect(d21, "t", checks=("duplicates",))) == []
    with_nulls = spark.createDataFrame([(None, None), (None, None), (1, "a")], "a int, b string")
    s = anomaly.duplicate_summary(with_nulls).collect()[0]
    assert (s["rows"], s["duplicate_rows"]) == (3, 1)


def test_outlier_minimum_sample_size(spark):
    vals19 = [float(i % 5) for i in range(18)] + [1000.0]
    vals20 = [float(i % 5) for i in range(19)] + [1000.0]
    d19 = spark.createDataFrame([(v,) for v in vals19], "x double")
    d20 = spark.createDataFrame([(v,) for v in vals20], "x double")
    assert rows(anomaly.detect(d19, "t", checks=("outliers",))) == []
    out = rows(anomaly.detect(d20, "t", checks=("outliers",)))
    assert len(out) == 1 and math.isclose(out[0]["value"], 5.0)
    assert out[0]["description"].startswith("5.0% outliers (IQR x3.0). Expected range: [")


def test_outlier_iqr_zero_is_skipped(spark):
    df = spark.createDataFrame([(5.0,)] * 30 + [(500.0,)], "x double")
    assert rows(anomaly.detect(df, "t", checks=("outliers",))) == []


def test_zero_variance(spark):
    df = spark.createDataFrame(
        [(7, 1.5, None, i) for i in range(5)] + [(7, None, None, 9)], "c int, cn double, an int, v int"
    )
    out = {r["column"]: r for r in rows(anomaly.detect(df, "t", checks=("zero_variance",)))}
    assert set(out) == {"c", "cn"}
    assert out["c"]["description"] == "All non-null values are identical: 7"
    assert out["cn"]["description"] == "All non-null values are identical: 1.5"


def test_report_order_and_summary(spark):
    a = spark.createDataFrame([(None, 1)] * 6 + [(1, 1)] * 4, "x int, k int")
    b = spark.createDataFrame([(None, i) for i in range(3)] + [(1, i) for i in range(7)], "x int, k int")
    rep = anomaly.anomaly_report({"a": a, "b": b})
    sev = [r["severity"] for r in rep.collect()]
    assert sev == sorted(sev, key=["high", "medium", "low"].index)
    summ = {r["severity"]: r["count"] for r in anomaly.severity_summary(rep).collect()}
    assert set(summ) == {"high", "medium", "low"}
    assert sum(summ.values()) == len(sev)


def test_approx_method_runs(spark):
    df = spark.createDataFrame([(float(i),) for i in range(100)] + [(1e6,)] * 3, "x double")
    out = rows(anomaly.detect(df, "t", checks=("outliers",), method="approx"))
    assert len(out) == 1 and out[0]["anomaly_type"] == "Outliers Detected"


from hypothesis import given, settings
from hypothesis import strategies as st


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(-20, 20), min_size=25, max_size=120), st.sampled_from([3.0, 0.5, 1000.0]))
def test_scaling_keeps_outlier_percentage(spark, values, factor):
    vals = [float(v) for v in values] + [500.0, -700.0]
    df = spark.createDataFrame([(v, v * factor) for v in vals], "x double, y double")
    out = {r["column"]: r["value"] for r in anomaly.detect(df, "t", checks=("outliers",)).collect()}
    assert set(out) in (set(), {"x", "y"})
    if out:
        assert math.isclose(out["x"], out["y"])


def test_hashed_duplicates_agree(spark):
    rows = [(i % 7, None if i % 3 else "a", float(i % 5)) for i in range(60)]
    df = spark.createDataFrame(rows, "a int, b string, c double")
    exact = anomaly.duplicate_summary(df).collect()[0]
    hashed = anomaly.duplicate_summary(df).collect()[0]
    assert tuple(exact) == tuple(hashed) == (60, 60 - len(set(rows)))


def test_hashed_duplicates_respect_null_positions(spark):
    df = spark.createDataFrame([(None, 1), (1, None)], "a int, b int")
    assert anomaly.duplicate_summary(df).collect()[0]["duplicate_rows"] == 0


def test_duplicates_with_nulls_inside_arrays(spark):
    rows = [([1, None, 2],), ([1, 2],), ([None, 1, 2],), ([],), ([None],), ([None],)]
    df = spark.createDataFrame(rows, "v array<int>")
    assert tuple(anomaly.duplicate_summary(df).collect()[0]) == (6, 1)
    assert tuple(anomaly.duplicate_summary(df.where("false")).collect()[0]) == (0, 0)


def test_large_integers_are_not_constant(spark):
    df = spark.createDataFrame([(9007199254740992 + i % 2,) for i in range(30)], "k bigint")
    assert anomaly.detect(df, "t", checks=("zero_variance",)).count() == 0


def test_report_gathers_nothing_but_the_selection(spark, monkeypatch):
    """Only the passes of the exact quartiles collect; with given quartiles nothing does."""
    from tablelens.operators.quantiles import exact_quantiles

    df = spark.createDataFrame([(i, float(i % 9), None) for i in range(100)], "a int, b double, c int")
    quartiles = exact_quantiles(df, ["a", "b", "c"], anomaly.QUARTILES)
    want = rows(anomaly.detect(df, "t"))

    def no_collect(self):
        raise AssertionError("collected")

    with monkeypatch.context() as m:
        m.setattr(type(df), "collect", no_collect)
        lazy = anomaly.detect(df, "t", quartiles=quartiles)
    assert rows(lazy) == want and want


def test_outlier_counts_of_empty_and_valueless_columns(spark):
    from tablelens.operators.quantiles import exact_quantiles

    df = spark.createDataFrame([(None, 1.0)] * 3, "a int, b double")
    for frame in (df, df.where("false")):
        q = exact_quantiles(frame, ["a", "b"], anomaly.QUARTILES)
        got = {r["column"]: (r["n"], r["outliers"]) for r in anomaly.outlier_counts(frame, q, ["a", "b"]).collect()}
        assert got == ({"a": (0, None), "b": (3, 0)} if frame is df else {"a": (None, None), "b": (None, None)})
        assert rows(anomaly.detect(frame, "t", checks=("outliers",))) == []


def test_stored_sketches(spark, tmpdir_local):
    from tablelens.operators import sketches

    data = [(None if i % 10 == 9 else i % 3, float(i), None, float("nan") if i % 2 else 1.0) for i in range(300)]
    df = spark.createDataFrame(data + [(7, 1e6, None, 1.0)] * 6, "p int, x double, e int, f double")
    cols, part = ["x", "e", "f"], F.col("p")
    for load in (df.where("p < 2 and x < 50"), df):  # the second load replaces two parts
        sketches.store_sketches(spark, tmpdir_local, "s", sketches.part_sketches(load, part, cols))
    stored = sketches.read_lake(spark, tmpdir_local, "s")
    assert stored.count() == 5 * 3  # parts null, 0, 1, 2, 7
    found = {r["column"]: r for r in sketches.merged_quantiles(stored, (0.0, 0.5, 1.0)).collect()}
    assert (found["x"]["n"], found["e"]["n"], found["f"]["n"]) == (306, 0, 156)
    assert found["e"]["q"] is None and found["x"]["parts"] == 5 and list(found["x"]["q"])[::2] == [0.0, 1e6]
    assert found["x"]["rank_low"][1] <= 153 <= found["x"]["rank_high"][1]
    quartiles = sketches.merged_quantiles(stored, anomaly.QUARTILES)
    out = rows(anomaly.detect(df.select("x", "e", "f"), "t", checks=("outliers",), quartiles=quartiles))
    assert [(r["column"], round(r["value"], 3)) for r in out] == [("x", round(600 / 306, 3))]
    none = sketches.part_sketches(df.where("false"), part, cols)
    assert none.count() == 0 and sketches.merged_quantiles(none, (0.5,)).count() == 0
