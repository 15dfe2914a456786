"""Structured Streaming: event-time bars and deduplication. An extension; the batch form is the measure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def bars(events: DataFrame, *, every: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Open, high, low, close, volume of each key and window; works on streams (with the watermark) and on tables alike."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    order = F.struct("ts", "event_id")
    out = timed.groupBy(F.window("ts", every).alias("w"), F.col("event_type").alias("ticker")).agg(F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.count("*").alias("volume"))
    return out.select("ticker", F.col("w.start").alias("bar_start"), "open", "high", "low", "close", "volume")


def distinct_events(events: DataFrame, *, late: str = "1 day") -> DataFrame:
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])


def sessions(events: DataFrame, *, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Runs of a user's events without a longer pause: start, end, events."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    out = timed.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("events"), F.sum("value").alias("value"))
    return out.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events", "value")


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process what is there, append closed windows as Parquet, and stop."""
    stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()
