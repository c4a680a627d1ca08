"""Streaming counterparts of the batch operators (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by tumbling window; rows later than the watermark are dropped."""
    w = events.withWatermark(time, late) if events.isStreaming else events
    g = w.groupBy(F.window(time, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), key, "n", "total")


def first_sight(events: DataFrame, keys: list[str], time: str, late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def latest_of(events: DataFrame, key: str, time: str) -> DataFrame:
    """The latest row's time by key, as a running aggregate (update mode on a stream)."""
    return events.groupBy(key).agg(F.max(time).alias("latest"), F.count(F.lit(1)).alias("n"))


def replay(spark, path: str, schema) -> DataFrame:
    """A stream over the files of a folder."""
    return spark.readStream.schema(schema).parquet(path)
