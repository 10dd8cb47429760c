"""The ledger as a stream: tumbling usage by key, with a watermark for late events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def usage(events: DataFrame, key: str, ts: str, amount: str, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(window start, key, requests, amount), for a stream or a table. Later than the watermark isn't counted in a stream."""
    source = events.withWatermark(ts, late) if events.isStreaming else events
    counted = source.groupBy(F.window(ts, window), key).agg(F.count(F.lit(1)).alias("requests"), F.sum(amount).alias("amount"))
    return counted.select(F.col("window.start").alias("window_start"), key, "requests", "amount")


def tail(spark: SparkSession, folder: str, schema) -> DataFrame:
    """A growing folder of Parquet ledger files as a stream."""
    return spark.readStream.schema(schema).parquet(folder)
