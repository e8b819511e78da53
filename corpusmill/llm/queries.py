"""The registered queries of this subpackage and the SQL that DuckDB checks them by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, importance, langid, licenses, materialise, ngram_join, quality, rules, runs, secrets, sharding, simhash, sql
from .common import table


def tokenizer() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_digest(table(spark, sf_dir, "documents"), secrets.ranked_words(tokenizer()[0]))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_digest(table(spark, sf_dir, "documents"))


def op4_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary, pattern = tokenizer()
    return materialise.materialise(table(spark, sf_dir, "documents"), vocabulary, pattern, 50_256)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_digest(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.rules_digest(table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_digest(table(spark, sf_dir, "documents"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digest(table(spark, sf_dir, "documents"), *tokenizer())


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.langid_digest(table(spark, sf_dir, "documents"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_digest(table(spark, sf_dir, "documents"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.runs_digest(table(spark, sf_dir, "documents"))


def langid_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator on web pages, which have an address and a declared language."""
    rows = langid.page_evidence(table(spark, sf_dir, "pages"))
    out = langid.identify(rows, ["page_id", "declared", "host"])
    return out.withColumn("posterior", F.round("posterior", 6))


def secrets_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 1's counts of base spans, which SQL finds too."""
    return op1_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def licenses_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 8's base columns, which SQL finds too."""
    return op8_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def sharding_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 3's columns of each row that SQL finds too."""
    return op3_sharding(spark, sf_dir).select("doc_id", "size", "text_crc32", "law")


def sharding_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op 3's law says of its result: places without gaps in each shard, and loads that differ by
    no more than the largest record."""
    rows = op3_sharding(spark, sf_dir)
    shards = rows.groupBy("law", "shard").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("b"), F.max("size").alias("most"), F.countDistinct("slot").alias("places"), F.min("slot").alias("low"), F.max("slot").alias("high")
    )
    gapless = F.bool_and((F.col("places") == F.col("n")) & (F.col("low") == 0) & (F.col("high") == F.col("n") - 1))
    return shards.groupBy("law").agg(
        F.count(F.lit(1)).alias("shards"), F.sum("n").alias("n_rows"), F.sum("b").alias("n_bytes"), gapless.alias("gapless"), (F.max("b") - F.min("b") <= F.max("most")).alias("even")
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_secret_scan, op2_quality, op3_sharding, op4_training_order, op5_decontamination, op6_ngram_join, op7_quality_rules, op8_license_scan, op9_byte_bpe, op10_language_id, op11_simhash, op12_importance_resampling, op13_periodic_runs, langid_pages, secrets_base, licenses_base, sharding_rows, sharding_law)
}
ORACLE_SQL: dict[str, str] = {
    "op6_ngram_join": sql.NGRAM_JOIN,
    "op12_importance_resampling": sql.IMPORTANCE,
    "op7_quality_rules": sql.QUALITY_RULES,
    "secrets_base": sql.SECRETS_BASE,
    "licenses_base": sql.LICENSES_BASE,
    "sharding_rows": sql.SHARDING_ROWS,
    "sharding_law": sql.SHARDING_LAW,
}
