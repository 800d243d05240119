"""Incremental variants: resumable append and windowed counts over Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def resume(source: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows of source whose key is not done: the batch form of resuming an appended output."""
    return source.join(done.select(key).distinct(), key, "left_anti")


def append_new(spark: SparkSession, source: str, schema: str, out: str, checkpoint: str, step: Callable[[DataFrame], DataFrame]) -> None:
    """Process only the files that came since the last call, by step, and append. The checkpoint is the resume state."""
    rows = spark.readStream.schema(schema).parquet(source)
    query = step(rows).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


def timed(events: DataFrame, late: str) -> DataFrame:
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.withWatermark("ts", late) if rows.isStreaming else rows


def event_windows(events: DataFrame, late: str = "10 minutes", window: str = "1 hour", slide: str | None = None) -> DataFrame:
    """start, event_type, n, total per tumbling window, or per sliding one; for streams late rows are dropped after the watermark."""
    out = timed(events, late).groupBy(F.window("ts", window, slide).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def event_sessions(events: DataFrame, late: str = "10 minutes", gap: str = "30 minutes") -> DataFrame:
    """user_id, start, n, total per session: rows of a user less than gap apart."""
    out = timed(events, late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select("user_id", F.col("w.start").alias("start"), "n", "total")
