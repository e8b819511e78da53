"""Chunks of whole sentences near rotating target lengths; a map over documents.

Each border depends on the one before, so a document is walked in a function; documents are
independent and stay in their partitions.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate, cycle

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions.batches import slices
from ..functions.scalars import TARGET_WORDS
from ..functions.sentences import corpus_sentences


def running(words: list[int]) -> list[int]:
    """Words before each sentence, and in all."""
    return [0, *accumulate(words)]


def nearest_end(sums: list[int], start: int, target: int) -> int:
    """The sentence before which a chunk from `start` ends: of the two borders around the place where the
    target is reached, found in the running sums, the nearer one; ties go to the longer chunk, and what
    never reaches the target is taken whole."""
    goal = sums[start] + target
    after = min(bisect_left(sums, goal, start + 1), len(sums) - 1)
    shorter_is_nearer = after - 1 > start and sums[after] - goal > goal - sums[after - 1]
    return after - 1 if shorter_is_nearer else after


def context_start(sums: list[int], at: int, most: int) -> int:
    """The first sentence of the context before `at`: as many as `most` words hold, but one at least."""
    return min(at - 1, bisect_left(sums, sums[at] - most)) if at else 0


def chunk_borders(sums: list[int], shift: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, target) of consecutive chunks; the targets rotate from `shift`."""
    at = 0
    for target in cycle(TARGET_WORDS[shift:] + TARGET_WORDS[:shift]):
        if at >= len(sums) - 1:
            return
        end = nearest_end(sums, at, target)
        yield at, end, target
        at = end


def chunks_of(text: str | None, document_id: str, deviation: float = 0.30, context_words: int = 120) -> list[dict]:
    """All chunks within the allowed deviation, but for a document's first; numbers count all."""
    sentences = corpus_sentences(text)
    sums = running([len(s.split()) for s in sentences])
    shift = int(hashlib.sha256(document_id.encode()).hexdigest()[:8], 16) % len(TARGET_WORDS)
    out = []
    for number, (at, end, target) in enumerate(chunk_borders(sums, shift), 1):
        if number > 1 and abs(sums[end] - sums[at] - target) <= deviation * target:
            before = sentences[context_start(sums, at, context_words) : at]
            out.append({"chunk_number": number, "target_length": target, "chunk": " ".join(sentences[at:end]), "context_before": " ".join(before)})
    return out


SCHEMA = "document_id string, chunk_number int, target_length int, chunk string, context_before string"


def chunk_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_chunks: int | None = 3) -> DataFrame:
    """One row per chunk, with spacing fixed; at most `max_chunks` evenly spaced ones per document."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("document_id", pa.string()), ("chunk_number", pa.int32()), ("target_length", pa.int32()), ("chunk", pa.string()), ("context_before", pa.string())])
        for p in parts:
            for s in slices(p, p["text"]):
                rows = [{"document_id": i, **c} for i, t in zip(s["document_id"].to_pylist(), s["text"].to_pylist(), strict=True) for c in chunks_of(t, i)]
                yield pa.RecordBatch.from_pylist(rows, kinds)

    src = docs.select(F.col(id_col).cast("string").alias("document_id"), F.col(text_col).alias("text")).where("document_id is not null")
    out = src.mapInArrow(run, SCHEMA)
    tidy = lambda c: T.fix_spacing(T.flatten_whitespace(F.col(c)))
    out = out.withColumn("chunk", tidy("chunk")).withColumn("context_before", tidy("context_before")).where("chunk <> ''")
    return out if max_chunks is None else evenly_spaced(out, ["document_id"], "chunk_number", max_chunks)


def evenly_spaced(df: DataFrame, by: list[str], order: str, limit: int) -> DataFrame:
    """At most `limit` rows of each group, evenly spaced in order; halves round to even."""
    w = Window.partitionBy(*by)
    ranked = df.withColumn("_i", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    if limit == 1:
        keep = F.col("_i") == F.floor(F.col("_n") / 2)
    else:
        wanted = F.transform(F.sequence(F.lit(0), F.lit(limit - 1)), lambda k: F.bround(k * (F.col("_n") - 1) / F.lit(float(limit - 1))).cast("int"))
        keep = F.array_contains(wanted, F.col("_i"))
    return ranked.where((F.col("_n") <= limit) | keep).drop("_i", "_n")


def report(chunks: DataFrame) -> DataFrame:
    """Chunks, documents and least, median and most words of each target length."""
    words = T.word_count(F.col("chunk"))
    return chunks.groupBy("target_length").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("document_id").alias("documents"), F.min(words).alias("min_words"), F.median(words).alias("median_words"), F.max(words).alias("max_words"))


def summarize(chunks: DataFrame, dims: tuple[str, ...] = ("source", "split", "year")) -> DataFrame:
    """(dim, value, n, documents): rows and distinct documents by each dimension, in one pass."""
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("value")) for d in dims]))
    return chunks.select("document_id", each.alias("x")).groupBy("x.dim", "x.value").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("document_id").alias("documents"))


def most_common(df: DataFrame, column: str, k: int = 5) -> DataFrame:
    """The k most common values; ties in order of value."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(k)
