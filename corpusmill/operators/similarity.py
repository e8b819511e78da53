"""How much of a text's wording a rewrite keeps, and how misses relate to it."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import scalars as S
from ..functions.matching import ratio
from .stats import fisher, mantel_haenszel


WORD = re.compile(r"\w+")


def word_ratio(a: str | None, b: str | None) -> float | None:
    """The share of lower-case words in matching blocks; null with a null text."""
    return None if a is None or b is None else ratio(WORD.findall(a.lower()), WORD.findall(b.lower()))


@F.arrow_udf(DoubleType())
def similarity(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([word_ratio(x.as_py(), y.as_py()) for x, y in zip(a, b, strict=True)], pa.float64())


similarity = similarity.asNondeterministic()  # else a filter inferred from a later join computes it a second time

def by_generator(table: DataFrame, model: str = "generator_model") -> DataFrame:
    return table.groupBy(model).agg(F.count(F.lit(1)).alias("texts"), F.median("similarity").alias("median"))


def by_similarity(table: DataFrame, missed: Column) -> DataFrame:
    """texts, missed and rate of every similarity bin, empty ones too."""
    bins = table.sparkSession.createDataFrame([(b, i) for i, (_, b) in enumerate(S.SIMILARITY_BINS)], "bin string, bin_ord int")
    g = table.groupBy(S.similarity_bin(F.col("similarity")).alias("bin")).agg(F.count(F.lit(1)).alias("texts"), F.count_if(missed).alias("missed"))
    return bins.join(g, "bin", "left").na.fill(0, ["texts", "missed"]).withColumn("miss_rate", F.try_divide("missed", "texts"))


def one_against_rest(table: DataFrame, missed: Column, group: Column) -> DataFrame:
    """Per similarity bin: missed and texts of the group and of the rest, rates and their difference."""
    bins = table.sparkSession.createDataFrame([(b, i) for i, (_, b) in enumerate(S.SIMILARITY_BINS)], "bin string, bin_ord int")
    count = lambda c: F.count_if(c)
    g = table.groupBy(S.similarity_bin(F.col("similarity")).alias("bin")).agg(count(group & missed).alias("one_missed"), count(group).alias("one_texts"), count(~group & missed).alias("other_missed"), count(~group).alias("other_texts"))
    j = bins.join(g, "bin", "left").na.fill(0)
    j = j.withColumn("one_rate", F.try_divide("one_missed", "one_texts")).withColumn("other_rate", F.try_divide("other_missed", "other_texts"))
    return j.withColumn("difference", F.col("one_rate") - F.col("other_rate"))


def stratified_test(rates: DataFrame) -> DataFrame:
    """Mantel-Haenszel over the bins of `one_against_rest`."""
    return mantel_haenszel(rates.select(F.col("one_missed").alias("a"), (F.col("one_texts") - F.col("one_missed")).alias("b"), F.col("other_missed").alias("c"), (F.col("other_texts") - F.col("other_missed")).alias("d")))


def pairwise_fisher(table: DataFrame, missed: Column, group: str, one: str, by: list[str]) -> DataFrame:
    """One group against each other group, for each of `by`: counts, rates, odds ratio and p."""
    g = table.groupBy(*by, group).agg(F.count_if(missed).alias("m"), F.count(F.lit(1)).alias("n"))
    left = g.where(F.col(group) == one).select(*by, F.col("m").alias("one_missed"), F.col("n").alias("one_texts"))
    right = g.where(F.col(group) != one).select(*by, F.col(group).alias("vs"), F.col("m").alias("other_missed"), F.col("n").alias("other_texts"))
    j = left.join(right, by) if by else left.crossJoin(right)  # without `by`, one row against the few groups
    t = j.withColumn("a", F.col("one_missed")).withColumn("b", F.col("one_texts") - F.col("one_missed")).withColumn("c", F.col("other_missed")).withColumn("d", F.col("other_texts") - F.col("other_missed"))
    return fisher(t).drop("a", "b", "c", "d").withColumnRenamed("p_value", "p_fisher")


def above_all_others(rates: DataFrame, by: str, group: str, value: str, one: str) -> DataFrame:
    """Whether one group's value is above every other's, for each of `by`."""
    own = F.max(F.when(F.col(group) == one, F.col(value)))
    return rates.groupBy(by).agg(F.coalesce(own > F.max(F.when(F.col(group) != one, F.col(value))), F.lit(False)).alias("above_all"))
