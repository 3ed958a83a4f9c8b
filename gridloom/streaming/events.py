"""Streams of samples: windowed statistics with late data, and histograms that grow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of events as they arrive."""
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_statistics(events: DataFrame, window: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total, mean, least, greatest) of each window; the watermark bounds the state of a stream."""
    source = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = source.groupBy(F.window("ts", window, slide or window).alias("w"), "event_type")
    done = grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.avg("value").alias("mean"), F.min("value").alias("least"), F.max("value").alias("greatest"))
    return done.select(F.col("w.start").alias("start"), "event_type", "n", "total", "mean", "least", "greatest")


def streaming_histogram(events: DataFrame, lower: float, upper: float, bins: int = 64) -> DataFrame:
    """(bin, count) of values so far; a bounded state of as many rows as bins."""
    place = F.least(F.greatest(F.floor((F.col("value") - lower) / ((upper - lower) / bins)), F.lit(0)), F.lit(bins - 1)).cast("int")
    return events.groupBy(place.alias("bin")).count()


def streaming_threshold(events: DataFrame, limit: float) -> DataFrame:
    """Events at or over a limit, as they come."""
    return events.where(F.col("value") >= limit)
