"""Profile, overview, histograms and quantiles: edge cases and properties."""

import datetime as dt

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablelens.operators import profile
from tablelens.operators.quantiles import exact_quantiles
from tablelens.operators.stats import column_stats


def test_profile_of_mixed_types(spark):
    df = spark.createDataFrame(
        [(1, True, dt.date(2024, 1, 2), [1, 2], {"a": 1}, None),
         (2, False, dt.date(2024, 1, 3), [1, 2], {"a": 1}, None)],
        "k int, b boolean, d date, arr array<int>, m map<string,int>, n double",
    )
    out = {r["column"]: r for r in profile.profile_table(df, order_by="k").collect()}
    assert out["b"]["min"] is None and out["b"]["unique"] == 2
    assert out["arr"]["unique"] == 1 and out["m"]["unique"] == 1
    assert out["n"]["sample_value"] == "N/A" and out["n"]["null_pct"] == 100.0
    assert out["k"]["sample_value"] == "1" and out["k"]["mean"] == 1.5
    assert [r["column"] for r in profile.profile_table(df).collect()] == df.columns


def test_overview_counts(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")
    r = profile.table_overview(df).collect()[0]
    assert (r["rows"], r["columns"], r["null_cells"], r["duplicate_rows"]) == (3, 2, 2, 1)


def test_histogram_has_exact_bins_and_counts(spark):
    vals = [float(i) for i in range(100)] + [None]
    df = spark.createDataFrame([(v, 3) for v in vals], "x double, c int")
    h = profile.histograms(df, bins=30).collect()
    xs = [r for r in h if r["column"] == "x"]
    assert len(xs) == 30 and sum(r["count"] for r in xs) == 100
    assert xs[-1]["count"] >= 1  # the maximum lands in the last bin
    cs = [r for r in h if r["column"] == "c"]
    assert len(cs) == 30 and cs[0]["count"] == 101


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.one_of(st.none(), st.sampled_from("ab"))), max_size=40))
def test_duplicates_equal_rows_minus_distinct(spark, data):
    df = spark.createDataFrame(data, "a int, b string")
    r = profile.table_overview(df).collect()[0]
    assert r["duplicate_rows"] == len(data) - len(set(data))
    s = {x["column"]: x for x in column_stats(df, distinct=None, sample=False).collect()}
    assert s["b"]["non_null"] + sum(1 for _, b in data if b is None) == len(data)


def quartiles(df, columns, probs=(0.25, 0.75)):
    return {r["column"]: r["q"] for r in exact_quantiles(df, columns, probs).collect()}


@settings(max_examples=6, deadline=None)
@given(st.lists(st.integers(-50, 50), min_size=1, max_size=300))
def test_exact_quantiles_match_numpy(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    assert np.allclose(quartiles(df, ["x"])["x"], np.percentile(np.array(values, dtype=float), [25, 75]))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.one_of(st.floats(allow_nan=False, allow_infinity=False, width=64), st.sampled_from([0.0, -0.0, 5e-324, 1e308])),
                min_size=1, max_size=200), st.sampled_from([1, 3, 40]))
def test_selection_in_many_passes_finds_order_statistics(spark, values, cells):
    """Few cells force cuts of cells in place of counting their values."""
    from tablelens.operators import selection

    df = spark.createDataFrame([(v,) for v in values], "x double")
    before, selection.CELLS = selection.CELLS, max(cells, 2)
    try:
        n, q = selection.interpolated(df, ["x"], [0.0, 0.5, 1.0])[0]
    finally:
        selection.CELLS = before
    s = sorted(values)
    h = (len(s) - 1) * 0.5
    a, b = s[int(h)], s[min(int(h) + 1, len(s) - 1)]
    assert n == len(s) and q[0] == s[0] and q[2] == s[-1] and q[1] == (a if h == int(h) else a + 0.5 * (b - a))


def test_quantiles_of_large_keys_extremes_and_empty_columns(spark):
    df = spark.range(1000).selectExpr(
        "9007199254740993 + id * 3 as big", "cast(id as decimal(30,2)) / 7 as dec",
        "case when id = 5 then double('inf') when id < 300 then 1e-300 * id else 1e300 end as wide",
        "cast(null as double) as none", "if(id % 2 = 0, double('nan'), 4.0) as nans")
    got = quartiles(df, df.columns)
    pdf = df.select("big", "wide").toPandas()
    assert got["big"] == np.percentile(pdf["big"].astype(float), [25, 75]).tolist()
    assert got["wide"][1] == 1e300 and 2.4e-298 < got["wide"][0] < 2.6e-298
    assert got["none"] is None and got["nans"] == [4.0, 4.0]
    assert np.allclose(got["dec"], [249.75 / 7, 749.25 / 7])
    assert quartiles(df.where("false"), ["big"])["big"] is None


def test_selection_shuffles_counts_only(spark, monkeypatch):
    """A pass sends (target, cell, count, least, greatest) rows, one a cell."""
    from tablelens.operators import selection

    plans = []
    real = selection._cells

    def seen(values, entries, wanted):
        rows = real(values, entries, wanted)
        plans.append(len(entries))
        return rows

    monkeypatch.setattr(selection, "_cells", seen)
    df = spark.range(300_000).selectExpr("pow(1.0001, id % 70000) as x", "id as y")
    got = quartiles(df, ["x", "y"])
    assert len(plans) <= 4 and got["y"] == [74999.75, 224999.25]


@pytest.mark.parametrize("n", [0, 1, 137, 500, 700, 5000])
def test_rows_of_smallest_hash(spark, n):
    from tablelens.sources.spines import sample_n

    df = spark.range(400).selectExpr("id as k", "'x' as v").unionAll(spark.createDataFrame([(7, "same")] * 300, "k bigint, v string"))
    got = [tuple(r) for r in sample_n(df.repartition(6), ["k"], n).collect()]
    assert len(got) == min(n, 700)
    import hashlib

    name = lambda r: hashlib.md5(f"42|{r[0]}".encode()).hexdigest()[:15]
    rows = sorted([(k, "x") for k in range(400)] + [(7, "same")] * 300, key=lambda r: (name(r), r))
    assert sorted(got) == sorted(rows[:n])


def test_distinct_counts_tell_nested_nulls_apart(spark):
    df = spark.createDataFrame([([None, 1], b"a", "x"), ([1], b"a", None), ([1, None], b"b", "y" * 9000), (None, None, "x")],
                               "a array<int>, b binary, s string")
    assert profile.distinct_counts(df).first().asDict() == {"a": 3, "b": 2, "s": 2}
    assert {r["column"]: r["unique"] for r in profile.profile_table(df).collect()} == {"a": 3, "b": 2, "s": 2}


def test_profile_with_approximate_distinct(spark):
    df = spark.range(5000).selectExpr("id", "id % 7 as m", "cast(id as string) as s")
    out = {r["column"]: r["unique"] for r in profile.profile_table(df, exact=False).collect()}
    assert out["m"] == 7 and abs(out["id"] - 5000) <= 150 and abs(out["s"] - 5000) <= 150


def test_variant_and_map_columns(spark):
    from tablelens.operators import anomaly

    df = spark.createDataFrame([(1, '{"a":1}'), (2, '{"a":1}'), (2, '{"a":1}')], "k int, j string").select(
        F.parse_json("j").alias("v"), F.create_map(F.lit("x"), F.col("k")).alias("m"))
    out = {r["column"]: r["unique"] for r in profile.profile_table(df).collect()}
    assert out == {"v": 1, "m": 2}
    assert profile.table_overview(df).collect()[0]["duplicate_rows"] == 1
    assert [r["anomaly_type"] for r in anomaly.detect(df, "t").collect()] == ["Duplicate Rows"]


def test_wide_table_distinct_counts_in_groups(spark):
    df = spark.range(300).selectExpr(*[f"id % {k + 2} as c{k}" for k in range(40)])
    out = {r["column"]: r["unique"] for r in column_stats(df, sample=False).collect()}
    assert out == {f"c{k}": k + 2 for k in range(40)}


def test_exact_quantiles_wide_table(spark):
    df = spark.range(400).selectExpr(*[f"cast((id * {k + 3}) % 97 as double) as c{k}" for k in range(20)])
    got, pdf = quartiles(df, df.columns), df.toPandas()
    for c in df.columns:
        assert np.allclose(got[c], np.percentile(pdf[c], [25, 75]))


def test_approximate_quantiles_keep_the_stated_rank_error(spark):
    from tablelens.operators.quantiles import approx_quantiles, rank_error

    df = spark.range(200_000).selectExpr(*[f"(id * 7919) % 200003 * {k + 1.5} as c{k}" for k in range(18)]).repartition(7)
    pdf = df.toPandas()
    for r in approx_quantiles(df, df.columns, [0.25, 0.75], 400).collect():
        x = np.sort(pdf[r["column"]].to_numpy(float))
        for p, v in zip((0.25, 0.75), r["q"]):
            assert abs(np.searchsorted(x, v) / len(x) - p) <= rank_error(400)
