"""The file-stream monitor reports per micro-batch and resumes from its checkpoint."""

import os

from tablelens.streaming.monitor import monitor_files, read_reports


def test_monitor_reports_each_batch_and_resumes(spark, tmpdir_local):
    src = os.path.join(tmpdir_local, "src")
    schema = "k int, x double"
    good = spark.createDataFrame([(i, float(i)) for i in range(30)], schema)
    bad = spark.createDataFrame([(None, None)] * 10 + [(1, 1.0)] * 10, schema)
    good.coalesce(1).write.parquet(os.path.join(src, "b1"))
    report = os.path.join(tmpdir_local, "report")
    ckpt = os.path.join(tmpdir_local, "ckpt")
    monitor_files(spark, src + "/*", schema, "t", report, ckpt).awaitTermination()
    assert not os.path.exists(report) or read_reports(spark, report).count() == 0
    bad.coalesce(1).write.parquet(os.path.join(src, "b2"))
    monitor_files(spark, src + "/*", schema, "t", report, ckpt).awaitTermination()
    rep = read_reports(spark, report).collect()
    kinds = sorted({(r["anomaly_type"], r["batch_id"]) for r in rep})
    assert ("High Null Rate", 1) in kinds and ("Duplicate Rows", 1) in kinds
    assert all(r["batch_id"] == 1 for r in rep)


def test_running_null_rates_accumulate_across_batches(spark, tmpdir_local):
    from tablelens.streaming.monitor import monitor_null_rates

    src = os.path.join(tmpdir_local, "src2")
    schema = "k int, x double"
    spark.createDataFrame([(1, None), (2, 1.0)], schema).coalesce(1).write.parquet(os.path.join(src, "b1"))
    report = os.path.join(tmpdir_local, "rates")
    ckpt = os.path.join(tmpdir_local, "ckpt2")
    monitor_null_rates(spark, src + "/*", schema, report, ckpt).awaitTermination()
    first = {r["column"]: (r["rows"], r["nulls"]) for r in spark.read.parquet(report).collect()}
    assert first == {"k": (2, 0), "x": (2, 1)}
    spark.createDataFrame([(None, float("nan")), (4, 2.0)], schema).coalesce(1).write.parquet(os.path.join(src, "b2"))
    monitor_null_rates(spark, src + "/*", schema, report, ckpt).awaitTermination()
    both = {r["column"]: (r["rows"], r["nulls"], r["null_pct"]) for r in spark.read.parquet(report).collect()}
    assert both == {"k": (4, 1, 25.0), "x": (4, 2, 50.0)}
