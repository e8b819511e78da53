"""Importance resampling towards a target distribution, with hashed n-grams.

1. Features (runs of words) of all documents are counted globally: each task sums those of a batch, a
   shuffle those of all. Each distinct feature is then hashed once, in this dictionary.
2. Counts are summed by bucket, for documents and target alike; a bucket's gain is the log ratio of its
   smoothed shares. The buckets are a parameter, so this table is bounded.
3. The gains are joined by feature to each document's feature counts. Fewer than `most_hot` features can
   have more than that share of all occurrences: the tasks hold these and sum them at once. All other
   features meet the dictionary in a shuffled join, in which no key holds more than that share.
4. weight is the floored mean of a document's gains; score adds Gumbel noise that its id decides, and the
   highest scores are a sample without replacement. Ranks come from sorted ranges.

Null, empty and wordless texts have no feature and weight 0. A null id has no noise: no score, no rank.
Ties of scores go to the lesser id, then the text's hash. Rows of one id and one text are equal: their
counts are summed and shared out, and each gets a row. Extra columns are ignored. Long texts are counted
whole, in pieces. An empty table gives no rows; an empty target leaves T and t at 0.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, share, spill, text_batches

#: Bytes as they are after folding A-Z, and a space for whatever ends a word.
FOLDED = bytes(b if b >= 0x80 else ord(" ") if not chr(b).isalnum() else ord(chr(b).lower()) for b in range(256))


@dataclass(frozen=True)
class Settings:
    low: int = 1  # words of the shortest and longest runs
    high: int = 1
    buckets: int = 10_000
    seed: int = 2024
    min_words: int = 20
    percent: int = 10
    most_hot: int = 20_000


def features(data: bytes, s: Settings) -> tuple[Counter, int]:
    """The runs of `low` to `high` words with their counts, and the number of words."""
    words = data.translate(FOLDED).split()
    out = Counter(words) if s.low <= 1 <= s.high else Counter()
    for n in range(max(2, s.low), s.high + 1):
        out.update(map(b" ".join, zip(*(words[k:] for k in range(n)), strict=False)))
    return out, len(words)


def _binary(text: Column) -> Column:
    return text.cast("string").cast("binary")


def dictionary(docs: DataFrame, s: Settings = Settings(), text_col: str = "text") -> DataFrame:
    """(feature, n, bucket): each distinct feature of all texts, its count, and its one hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            for t in b.column(0):
                total.update(features(t.as_py() or b"", s)[0])
                if len(total) > 200_000:  # a task's sums stay bounded
                    yield told(total)
                    total.clear()
        yield told(total)

    def told(total: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.binary()), pa.array(total.values(), pa.int64())], names=["feature", "n"])

    text_batches(docs.sparkSession)
    counts = docs.select(_binary(docs[text_col]).alias("text")).mapInArrow(run, "feature binary, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    return counts.withColumn("bucket", F.crc32("feature") % s.buckets)


def gains(source: DataFrame, target: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(bucket, gain) for the buckets of two dictionaries; at most `buckets` rows."""
    a = source.groupBy("bucket").agg(F.sum("n").alias("s"))
    b = target.groupBy("bucket").agg(F.sum("n").alias("t"))
    both = a.join(b, "bucket", "full").select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t"))
    total = both.agg(F.sum("s"), F.sum("t")).first()
    large_s, large_t = (float((x or 0) + s.buckets) for x in total)
    ratio = (F.col("t") + F.lit(1.0)) * large_s / ((F.col("s") + F.lit(1.0)) * large_t)
    return both.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain"))


def weights(docs: DataFrame, lexicon: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, n_words, n_features, weight: one row for each id and text, with `copies`.
    `lexicon` has feature, n, gain for every feature of `docs`."""
    total = lexicon.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * s.most_hot > total
    held = share(docs.sparkSession, {bytes(r["feature"]): r["gain"] for r in lexicon.where(hot).collect()})  # fewer than most_hot

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held()
        for whole in batches:
            for i in range(0, whole.num_rows, 64):
                b = whole.slice(i, 64)
                keys, found, n, gain, words, rows = [], [], [], [], [], []
                for k, (doc_id, mark, t) in enumerate(zip(b.column(0), b.column(1), b.column(2), strict=True)):
                    counts, size = features(t.as_py() or b"", s)
                    here = [(c, known[f]) for f, c in counts.items() if f in known]
                    rare = [f for f in counts if f not in known]
                    # a blank starts no feature: this row meets nothing in the join and is no hot key
                    found += [b" %d" % zlib.crc32(b"%d %d" % (doc_id.as_py() or 0, mark.as_py())), *rare]
                    n += [sum(c for c, _ in here), *map(counts.__getitem__, rare)]
                    gain += [sum(c * g for c, g in here), *[None] * len(rare)]
                    words += [size, *[0] * len(rare)]
                    rows += [1, *[0] * len(rare)]
                    keys += [k] * (1 + len(rare))
                at = pa.array(keys, pa.int32())
                longs = [pa.array(x, pa.int64()) for x in (n, gain, words, rows)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(found, pa.binary()), *longs], names=["doc_id", "text_hash", "feature", "c", "sum", "words", "rows"])

    src = docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(docs[text_col].cast("string")).alias("text_hash"), _binary(docs[text_col]).alias("text"))
    counted = src.mapInArrow(run, "doc_id long, text_hash long, feature binary, c long, sum long, words long, rows long")
    tail = lexicon.where(~hot).select("feature", "gain")
    summed = counted.join(tail, "feature", "left").groupBy("doc_id", "text_hash").agg(
        F.sum("c").alias("c"), F.sum(F.coalesce("sum", F.col("c") * F.col("gain"))).alias("g"), F.sum("words").alias("w"), F.sum("rows").alias("copies")
    )
    floored = F.expr("CASE WHEN c = 0 THEN 0 ELSE (g - pmod(g, c)) DIV c END")
    return summed.select("doc_id", "text_hash", F.expr("w DIV copies").alias("n_words"), F.expr("c DIV copies").alias("n_features"), floored.alias("weight"), "copies")


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, by the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (null if not drawn) for each row."""
    words = spill(dictionary(docs, s, text_col))
    lexicon = spill(words.join(F.broadcast(gains(words, dictionary(target, s), s)), "bucket").select("feature", "n", "gain"))
    rows = weights(docs, lexicon, s, id_col, text_col).withColumn("score", F.col("weight") + noise(F.col("doc_id"), s.seed))
    able = (F.col("n_words") >= s.min_words) & F.col("score").isNotNull()
    each = rows.withColumn("able", able).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    out = numbered(each, [F.desc("able"), F.desc_nulls_last("score"), F.asc("doc_id"), F.asc("text_hash"), F.asc("copy")], "number")
    drawn = s.percent * out.where("able").count() // 100
    return out.select("doc_id", "n_words", "n_features", "weight", "score", F.when(F.col("number") <= drawn, F.col("number")).alias("rank"))


def resample_digest(docs: DataFrame, target: DataFrame) -> DataFrame:
    """The contract's columns."""
    return resample(docs, target).drop("n_words")
