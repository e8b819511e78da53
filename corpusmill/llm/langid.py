"""Language identification by Bayesian evidence fusion.

Evidence of a row: the text (hashed byte trigrams under one multinomial per language), the language
that its markup declares, the suffix of its address and its host. Text models are counts summed over
all rows that declare a language, smoothed towards those of all languages, so that every declared
language has a model, however few its rows; host priors are grouped counts, smoothed towards the host's
suffix, which is smoothed towards all rows. Languages are rows of tables, never columns, and only pairs
that occur are stored; what executors hold of a language is at most 2 ** bits weights and its name.

A row is rejected if it has no letters, if its text is long enough to tell (`enough` trigrams) and the
posterior is at least `against` for a language other than the declared one, or if no known language
is declared and the best has less than `sure` of the posterior. Missing evidence is neutral: a null
or unknown declared language, host or suffix says nothing. Null and empty texts have no letters.
Repeated rows each count and are each judged. If no row declares a language, all rows are rejected;
an empty table gives no rows. Of languages that tie the first by name is taken. Extra columns are kept
by `accept`, whatever they are called, and ignored elsewhere. A very long text counts in full towards
its language's model, and as evidence like one of `length` trigrams.

The source of a document is its host; the suffix is what follows the host's last dot, and a source
without a dot has none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, is_small, lookup_join, share, text_batches

# letters stay (also bytes of longer characters); all else is a space
LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


@dataclass(frozen=True)
class Settings:
    bits: int = 13  # trigram buckets: 2 ** bits
    smooth: float = 4096.0  # trigrams' worth of smoothing of a language towards all languages
    trust: float = 0.9  # that a declared language is right
    pull: float = 20.0  # rows' worth of smoothing of a host or suffix
    length: float = 60.0  # trigrams that a long text's evidence counts as
    sure: float = 0.6
    against: float = 0.95
    enough: int = 40
    broadcast_pairs: int = 500_000  # of a host or suffix and a language


def buckets(text: str | None, bits: int) -> np.ndarray:
    """The bucket of each byte trigram that has a letter."""
    data = b" ".join((text or "").lower().encode("utf-8", "replace").translate(LETTERS).split())
    if not data:
        return np.zeros(0, np.int64)
    b = np.frombuffer(b" " + data + b" ", np.uint8).astype(np.uint32)
    h = (b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(0x9E3779B1)
    return (h >> np.uint32(32 - bits)).astype(np.int64)


def page_evidence(pages: DataFrame) -> DataFrame:
    """Pages as rows with text, declared, host and suffix."""
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    declared = F.lower(F.regexp_extract("html", r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1))
    text = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style|nav)\b.*?</\1\s*>|<!--.*?-->", " "), r"(?s)<[^>]*>|&[a-zA-Z#0-9]+;", " ")
    none = lambda c: F.when(c != "", c)
    return pages.select("page_id", text.alias("text"), none(declared).alias("declared"), none(host).alias("host"), suffix_of(host).alias("suffix"))


class TextModel:
    """log P(trigrams | language) for all languages at once. Smoothed counts are the share of all languages
    and, where a language has trigrams of its own, a weight on top, so only those pairs of bucket and
    language are held: at most 2 ** bits a language, and no more than its rows have trigrams."""

    def __init__(self, n_languages: int, lang: np.ndarray, bucket: np.ndarray, n: np.ndarray, s: Settings):
        size = 1 << s.bits
        whole = np.bincount(bucket, weights=n, minlength=size) + 0.5
        share = s.smooth * whole / whole.sum()
        order = np.lexsort((lang, bucket))
        self.bits, self.base = s.bits, np.log(share)
        self.total = np.log(np.bincount(lang, weights=n, minlength=n_languages) + s.smooth)
        self.lang, self.weight = lang[order].astype(np.int32), np.log1p(n[order] / share[bucket[order]])
        self.start = np.searchsorted(bucket[order], np.arange(size + 1))

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        counts = np.bincount(grams, minlength=len(self.base))
        k = np.flatnonzero(counts)
        low, length = self.start[k], self.start[k + 1] - self.start[k]
        ends = np.cumsum(length)
        at = np.repeat(low - (ends - length), length) + np.arange(ends[-1] if len(k) else 0)
        own = np.bincount(self.lang[at], weights=self.weight[at] * np.repeat(counts[k], length), minlength=len(self.total))
        return own + counts[k] @ self.base[k] - len(grams) * self.total


def fit_text(rows: DataFrame, languages: list[str], s: Settings) -> TextModel:
    """The model of counts summed over all declaring rows."""
    order, size = {lang: i for i, lang in enumerate(languages)}, 1 << s.bits

    def table(sums: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for i, v in sums.items():
            k = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), i, np.int32)), pa.array(k.astype(np.int32)), pa.array(v[k])], names=["lang", "bucket", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for lang, t in zip(b.column(0), b.column(1), strict=True):
                if (i := order.get(lang.as_py())) is not None:
                    if i not in sums:
                        if len(sums) == 1024:  # what a task holds does not grow with the languages
                            yield from table(sums)
                            sums = {}
                        sums[i] = np.zeros(size, np.int64)
                    sums[i] += np.bincount(buckets(t.as_py(), s.bits), minlength=size)
        yield from table(sums)

    text_batches(rows.sparkSession)
    parts = rows.where("declared is not null").select("declared", "text").mapInArrow(run, "lang int, bucket int, n long")
    sums = parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    return TextModel(len(languages), *[sums[c].to_numpy(np.int64) for c in ("lang", "bucket", "n")], s)


def host_counts(rows: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """(host, suffix, declared, n), declared null included, and the rows of each declared language."""
    counts = cut(rows.groupBy("host", "suffix", "declared").agg(F.count(F.lit(1)).alias("n")))
    declared = counts.where("declared is not null").groupBy("declared").agg(F.sum("n").alias("n"))
    return counts, {r["declared"]: r["n"] for r in sorted(declared.collect())}


def _own(counts: DataFrame, keys: list[str], name: str) -> DataFrame:
    """keys and the array `name` of (declared, n): as long as the key has languages."""
    pair = F.when(F.col("declared").isNotNull(), F.struct("declared", "n"))
    return counts.groupBy(*keys, "declared").agg(F.sum("n").alias("n")).groupBy(*keys).agg(F.sort_array(F.collect_list(pair)).alias(name))


def _dense(pairs: pa.ListArray, names: pa.Array) -> np.ndarray:
    """rows x languages, from lists of (declared, n); a null list is empty."""
    lengths, flat = pc.list_value_length(pairs).fill_null(0).to_numpy(), pairs.flatten()
    out = np.zeros((len(pairs), len(names)))
    at = pc.index_in(flat.field("declared"), value_set=names).to_numpy(zero_copy_only=False)
    out[np.repeat(np.arange(len(pairs)), lengths), at.astype(np.int64)] = flat.field("n").to_numpy(zero_copy_only=False)
    return out


def identify(rows: DataFrame, keep: list[str], s: Settings = Settings(), keep_text: bool = False) -> DataFrame:
    """keep, language, posterior, n_grams, accepted for each of `rows` (text, declared, host, suffix).

    The host's and the suffix's counts of languages are joined to the rows as short lists; the posterior is
    taken over all languages, in blocks of rows that bound its memory."""
    counts, known = host_counts(rows)
    texts = ["text"] if keep_text else []
    if not known:
        return rows.select(*keep, *texts, F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("posterior"), F.lit(0).cast("long").alias("n_grams"), F.lit(False).alias("accepted"))
    languages = list(known)
    model = share(rows.sparkSession, fit_text(rows, languages, s))
    overall = np.array(list(known.values()), np.float64) + 1
    overall = share(rows.sparkSession, (languages, overall / overall.sum()))
    width = len(languages)
    block = max(1, min(1024, 2_000_000 // width))

    def likelihoods(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_p = model()
        for whole in batches:
            for start in range(0, whole.num_rows, block):
                b = whole.slice(start, block)
                at = b.schema.get_field_index("text")
                n, scores = [], []
                for t in b.column(at):  # one text's trigrams at a time
                    grams = buckets(t.as_py(), s.bits)
                    n.append(len(grams))
                    scores.append(log_p(grams) * min(1.0, s.length / max(1, len(grams))))
                ll = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * width), pa.array(np.concatenate(scores)))
                cols = [(f.name, b.column(i)) for i, f in enumerate(b.schema) if keep_text or i != at]
                yield pa.RecordBatch.from_arrays([*[c for _, c in cols], pa.array(n, pa.int64()), ll], names=[*[name for name, _ in cols], "n_grams", "ll"])

    kept = [f"k_{c}" for c in keep] + texts

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, prior = overall()
        names = pa.array(names, pa.string())
        for whole in batches:
            for start in range(0, whole.num_rows, block):
                b = whole.slice(start, block)
                column = lambda c: b.column(b.schema.get_field_index(c))  # noqa: E731, B023
                p = np.broadcast_to(prior, (b.num_rows, width))
                for c in ("of_suffix", "of_host"):
                    x = _dense(column(c), names)
                    p = (x + s.pull * p) / (x.sum(axis=1, keepdims=True) + s.pull)
                total = column("ll").flatten().to_numpy().reshape(b.num_rows, width) + np.log(p)
                declared = pc.index_in(column("declared"), value_set=names, skip_nulls=True).fill_null(-1).to_numpy()
                has = np.flatnonzero(declared >= 0)
                total[has] += math.log((1 - s.trust) / max(1, width - 1))
                total[has, declared[has]] += math.log(s.trust) - math.log((1 - s.trust) / max(1, width - 1))
                best = total.argmax(axis=1)
                posterior = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                n = column("n_grams").to_numpy()
                against = (declared >= 0) & (best != declared) & (posterior >= s.against) & (n >= s.enough)
                accepted = (n > 0) & ~against & ((declared >= 0) | (posterior >= s.sure))
                language = names.take(pa.array(best, mask=n == 0))
                yield pa.RecordBatch.from_arrays([*map(column, kept), language, pa.array(posterior), column("n_grams"), pa.array(accepted)], names=[*kept, "language", "posterior", "n_grams", "accepted"])

    named = rows.select(*[F.col(c).alias(f"k_{c}") for c in keep], "text", "declared", "host", "suffix")
    kinds = lambda df: ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    verdict = f"{kinds(named.select(*kept)) + ', ' if kept else ''}language string, posterior double, n_grams long, accepted boolean"
    # a row without a host or suffix gets empty lists, which leave the wider prior as it is
    most = max(1, s.broadcast_pairs // width)
    lists = [(keys, cut(_own(counts.where(F.col(keys[0]).isNotNull()), keys, name))) for keys, name in ((["suffix"], "of_suffix"), (["host", "suffix"], "of_host"))]
    of = lambda df: reduce(lambda d, x: lookup_join(d, x[1], x[0], most), lists, df)
    if all(is_small(x, most) for _, x in lists):  # lists come to the rows, and one map does both steps
        out = of(named).mapInArrow(lambda batches: judge(likelihoods(batches)), verdict)
    else:  # no join that may shuffle takes texts along, unless they are kept
        scored = named.mapInArrow(likelihoods, f"{kinds(named if keep_text else named.drop('text'))}, n_grams long, ll array<double>")
        out = of(scored).select(*kept, "declared", "n_grams", "ll", "of_suffix", "of_host").mapInArrow(judge, verdict)
    return out.select(*[F.col(f"k_{c}").alias(c) for c in keep], *texts, "language", "posterior", "n_grams", "accepted")


def suffix_of(host: Column) -> Column:
    """What follows the last dot, in lower case; null without one."""
    return F.when(F.contains(host, F.lit(".")), F.lower(F.substring_index(host, ".", -1)))


def document_evidence(docs: DataFrame) -> DataFrame:
    """Documents declare `lang`; `source` is the host."""
    return docs.select("*", F.col("lang").alias("declared"), F.col("source").alias("host"), suffix_of(F.col("source")).alias("suffix"))


def langid_digest(docs: DataFrame) -> DataFrame:
    out = identify(document_evidence(docs.select("doc_id", "text", "lang", "source")), ["doc_id", "lang"])
    return out.select("doc_id", F.col("lang").alias("declared"), "language", F.round("posterior", 6).alias("posterior"), "n_grams", F.col("accepted").alias("kept"))


def accept(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The rows of `docs`, all columns, that are accepted. Rows are judged in place, so no id is needed."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns) if c != "text"}  # whatever the columns are called
    evidence = [docs["text"].cast("string").alias("text"), docs["lang"].alias("declared"), docs["source"].alias("host"), suffix_of(docs["source"]).alias("suffix")]
    rows = docs.select(*[docs[c].alias(n) for c, n in names.items()], *evidence)
    out = identify(rows, list(names.values()), s, keep_text=True).where("accepted")
    return out.select(*[F.col(names.get(c, "text")).alias(c) for c in docs.columns])
