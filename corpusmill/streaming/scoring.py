"""Scoring with regular partial output: a stream of small files, a committed folder for each micro-batch.

`queue` lays rows out in files of at most so many; `score` takes a file at a time, writes what the
scorer gives for it into the batch's own folder and notes it in the checkpoint. A run that stops at any
point goes on at the batch it was at, and writing that batch again replaces its folder: no row is lost or
comes twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def queue(rows: DataFrame, path: str, every: int = 100) -> None:
    """Adds rows to the queue, at most `every` to a file."""
    rows.write.mode("append").option("maxRecordsPerFile", every).parquet(path)


def at_once(spark: SparkSession) -> int:
    """How many files the cluster scores at once, one for each of its cores."""
    return max(1, spark.sparkContext.defaultParallelism)


def score(spark: SparkSession, path: str, schema: StructType | str, scorer: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, files: int = 1) -> StreamingQuery:
    """Scores what the queue holds and is not scored yet; each commit covers `files` of its files."""

    def commit(batch: DataFrame, number: int) -> None:
        scorer(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def scored(spark: SparkSession, out: str) -> DataFrame:
    """All rows that are committed so far."""
    return spark.read.parquet(out).drop("batch")
