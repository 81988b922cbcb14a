"""The hour-by-user raster as a stream: counts of tumbling windows with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """Event files as they arrive in a folder; the schema is that of the files there."""
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).parquet(folder)


def hourly_counts(events: DataFrame, delay: str = "2 hours", users: int = 64) -> DataFrame:
    """(start, x, v): events in each hour and user class; windows close ``delay`` after their end."""
    rows = events.select(F.col("ts").cast("timestamp").alias("ts"), F.pmod("user_id", F.lit(users)).cast("int").alias("x"))
    counts = rows.withWatermark("ts", delay).groupBy(F.window("ts", "1 hour"), "x").agg(F.count(F.lit(1)).cast("double").alias("v"))
    return counts.select(F.col("window.start").alias("start"), "x", "v")
