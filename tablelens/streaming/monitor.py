"""Data-quality monitoring of arriving batches with Structured Streaming.

New files in a folder are read as a stream; every micro-batch runs the
anomaly checks (D1-D4) and its report is appended, with the batch id, to a
report table.  Progress lives in the checkpoint location, so a restarted
query continues with the files it has not seen, and a failed batch is
retried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tablelens.operators import anomaly


def report_batch(batch: DataFrame, batch_id: int, table: str, report_path: str, **detect_kw) -> None:
    """Checks of one micro-batch, written to ``report_path/batch_id=<n>``: a
    retried batch replaces its own folder.

    The batch is persisted while the checks run (they scan it several
    times) and released afterwards.
    """
    batch.persist()
    try:
        rep = anomaly.detect(batch, table, **detect_kw)
        rep.write.mode("overwrite").parquet(f"{report_path.rstrip('/')}/batch_id={int(batch_id)}")
    finally:
        batch.unpersist()


def monitor_files(
    spark: SparkSession,
    source_path: str,
    schema: T.StructType | str,
    table: str,
    report_path: str,
    checkpoint_location: str,
    *,
    fmt: str = "parquet",
    max_files_per_trigger: int | None = None,
    available_now: bool = True,
    processing_time: str | None = None,
    **detect_kw,
) -> StreamingQuery:
    """Start a stream over ``source_path`` that reports anomalies per batch.

    ``available_now=True`` processes what is there and stops (batch-style
    runs); otherwise it triggers every ``processing_time``.
    """
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    stream = reader.load(source_path)
    writer = (
        stream.writeStream.foreachBatch(
            lambda df, bid: report_batch(df, bid, table, report_path, **detect_kw)
        ).option("checkpointLocation", checkpoint_location)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()


def read_reports(spark: SparkSession, report_path: str) -> DataFrame:
    return spark.read.parquet(report_path)


def running_null_rates(stream: DataFrame) -> DataFrame:
    """Null rate per column over everything the stream has delivered so far.

    Each row becomes one ``(column, missing)`` pair per column, partially
    aggregated per micro-batch before the state store; the state is one row
    per column, whatever the stream length.  Use with output mode
    ``complete`` (or ``update``).
    """
    from tablelens.functions.columns import is_missing

    pairs = F.array(
        *[F.struct(F.lit(c).alias("column"), is_missing(stream, c).cast("long").alias("missing"))
          for c in stream.columns]
    )
    return (
        stream.select(F.explode(pairs).alias("m"))
        .groupBy(F.col("m.column").alias("column"))
        .agg(F.count(F.lit(1)).alias("rows"), F.sum("m.missing").alias("nulls"))
        .withColumn("null_pct", F.round(F.try_divide(F.col("nulls"), F.col("rows")) * 100.0, 2))
    )


def monitor_null_rates(
    spark: SparkSession,
    source_path: str,
    schema: T.StructType | str,
    report_path: str,
    checkpoint_location: str,
    *,
    fmt: str = "parquet",
    max_files_per_trigger: int | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Start ``running_null_rates`` over a file stream; after every batch the
    current rates replace the table at ``report_path``."""
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    rates = running_null_rates(reader.load(source_path))
    writer = (
        rates.writeStream.outputMode("complete")
        .foreachBatch(lambda df, bid: df.withColumn("batch_id", F.lit(int(bid)))
                      .write.mode("overwrite").parquet(report_path))
        .option("checkpointLocation", checkpoint_location)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
