"""Streams: resumable ingestion without duplicates, and windows over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _timed(df: DataFrame, at: str) -> DataFrame:
    """Watermarks need a timestamp with a zone."""
    return df.withColumn(at, F.col(at).cast("timestamp"))


def new_documents(stream: DataFrame, at: str, key: str, late: str = "1 day") -> DataFrame:
    """A stream without rows whose key came before within the watermark."""
    return _timed(stream, at).withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and values by type and window of time; the state of closed windows is dropped."""
    g = _timed(events, "ts").withWatermark("ts", late) if events.isStreaming else events
    out = g.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    g = _timed(events, "ts").withWatermark("ts", late) if events.isStreaming else events
    out = g.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def read_stream(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.readStream.schema(like.schema).parquet(path)


def append_once(stream: DataFrame, path: str, checkpoint: str):
    """All that is there now, written once and exactly once; the next run goes on from there."""
    return stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).format("parquet").start(path)
