"""A corpus pipeline: five stages over documents, each written and read again as the next one's input.

1. language ID drops documents whose text contradicts their declared language or has no letters;
2. the n-gram Jaccard join (five words, similarity 0.8) keeps one document of each group;
3. benchmark decontamination drops documents that hold a benchmark item, re-parameterised or not;
4. the secret scan replaces secrets in the texts by marks (n_chars follows);
5. byte-level BPE encodes the texts: doc_id, lang, source, n_tokens and ids.

Documents without letters (null and empty texts among them) go in stage 1. Of rows that repeat id and
text one stays, and of a group of near copies the row of least id (null last), then least text hash.
Null ids, languages and sources are kept as they are. Extra columns, whatever they are called, pass
through all stages but the last. Very long texts are judged and encoded whole. Empty tables give no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import bpe, decontam, langid, ngram_join, secrets
from corpusmill.llm.common import ensure_checkpoint_dir, table
from corpusmill.llm.queries import tokenizer

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
NEAR = ngram_join.Settings(words=5, num=80, den=100)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.accept(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs, NEAR)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secrets.redact(docs, words=secrets.ranked_words(tokenizer()[0]))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, *tokenizer(), keep=("doc_id", "lang", "source"))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("secret_scans", secret_scans),
    ("byte_bpe", byte_bpe),
]

#: Language models, similarity components and BPE have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Stages are written in the shared folder of spark.checkpoint.dir."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
