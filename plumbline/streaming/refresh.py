"""Refresh as a stream: new files of records are upserted into a table, batch by batch.

A batch is written as a new version beside the old one and the pointer is moved last, so a batch that runs again after a
failure gives the same table. Late records are what the upsert replaces; no watermark drops any.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from plumbline.operators.curate import upserted

RECORD = "item_id string, article string, decision_date string, value double, ord bigint"


def current(spark: SparkSession, target: str, schema: str = RECORD, below: int | None = None) -> DataFrame:
    """The table as of the last finished batch, or the last one before ``below``; empty before the first."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(target).getFileSystem(spark._jsc.hadoopConfiguration())
    path = spark._jvm.org.apache.hadoop.fs.Path
    done = [s.getPath().getName() for s in fs.listStatus(path(target))] if fs.exists(path(target)) else []
    versions = sorted(int(n.removeprefix("v=")) for n in done if n.startswith("v=") and fs.exists(path(f"{target}/{n}/_SUCCESS")))
    versions = [v for v in versions if below is None or v < below]
    return spark.read.schema(schema).parquet(f"{target}/v={versions[-1]}") if versions else spark.createDataFrame([], schema)


def upsert_batch(batch: DataFrame, number: int, target: str) -> None:
    spark = batch.sparkSession
    before = current(spark, target, below=number)
    upserted(before, batch).select(*before.columns).write.mode("overwrite").parquet(f"{target}/v={number}")


def refresh(spark: SparkSession, source: str, target: str, checkpoint: str) -> DataStreamWriter:
    """A writer that takes files of records from ``source`` into ``target``; start it, or add a trigger first."""
    records = spark.readStream.schema(RECORD).json(source)
    return records.writeStream.foreachBatch(lambda b, n: upsert_batch(b, n, target)).option("checkpointLocation", checkpoint)


def daily_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Records of each day and type of a stream of (ts, event_type), days that are ``late`` old being final."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("day"), "event_type", "n")
