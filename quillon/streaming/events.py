"""Windowed counts of events with a watermark, batch and streaming from one definition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def hourly(events: DataFrame) -> DataFrame:
    """Events and their value by type and hour; events more than two hours late are left out when streaming."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = events.withWatermark("ts", "2 hours") if events.isStreaming else events
    return rows.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("hour"), "event_type", "n", "value")


def run(spark: SparkSession, path: str, out: str, checkpoint: str):
    """The started query over the Parquet folder at `path`, in append mode up to what is there."""
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    return hourly(stream).writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(out)
