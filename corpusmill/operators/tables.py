"""Tables in the shared folder: a lineage cut by files, and consecutive numbers that files keep."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only where it names none on one machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="corpusmill-"))
    return sc.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """`df` as a table of files, which a lost executor does not take along."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def number_rows(df: DataFrame, order: Sequence[str | Column], start: int = 1, name: str = "sample_id") -> DataFrame:
    """Consecutive ids in `order`. Its ranges are sorted and written once, each row with its place, so that
    the counts taken next are of these rows; one count for each range reaches the driver."""
    ranged = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, first, total = F.shiftright("_at", 33), [], start
    for p, n in sorted(ranged.groupBy(part.alias("p")).count().collect()):
        first.append((p, total - (p << 33)))
        total += n
    starts = F.broadcast(df.sparkSession.createDataFrame(first, "_p long, _first long"))
    return ranged.join(starts, part == F.col("_p")).withColumn(name, F.col("_at") + F.col("_first")).drop("_at", "_p", "_first")


def rank_in_groups(df: DataFrame, group: str, order: Sequence[str | Column], name: str) -> DataFrame:
    """`name` from 1 within each group, in `order`. Rows are ranged over tasks by group and order, so that a
    group that holds a third of all rows is no hot one; groups' first numbers are joined back."""
    ranked = written(number_rows(df, [F.col(group).asc_nulls_first(), *order], 0, "_i"))
    first = ranked.groupBy(F.col(group).alias("_g")).agg(F.min("_i").alias("_first"))
    # one row for each group: adaptive execution broadcasts a small table and splits a skewed side of a large one
    return ranked.join(first, F.col(group).eqNullSafe(F.col("_g"))).withColumn(name, F.col("_i") - F.col("_first") + 1).drop("_i", "_g", "_first")
