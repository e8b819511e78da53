"""Quality rules with thresholds from mergeable quantile sketches; DataFrame operations only.

Measures are integers (per mille, or hundredths), so a sketch of a measure is a table of counts by
bucket: partial sketches merge by adding, in any order, to the same result. Quantiles are read per
language and source; a group of few documents uses its language's sketch, then that of all. Each
measure's limit is a quartile plus a multiple of the interquartile range, which is taken as `slack`
at least. The narrow table of measures is then joined with the limits and filtered.

Null texts count as empty and fail the base rule. Null language or source is a group of its own.
Repeated rows each count, and values that tie share a bucket. Other columns are ignored, and an empty
table gives no rows. A very long text is held as arrays of its words by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, lookup_join

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"
#: measure -> slack; "low" measures have a lower limit too.
MEASURES = {"symbol_pm": 12, "dup_line_pm": 100, "repeat_pm": 60, "word_len_c": 60}
BOTH_SIDES = ("word_len_c",)
REACH, MIN_GROUP = 6, 50


def _let(value: Column, body) -> Column:
    """body(value) with value computed once inside higher-order functions."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeat_words(hashes: Column) -> Column:
    """Words in three-word windows that occur twice or more, from the windows' hashes in order.

    Sorted (hash, place) pairs bring equal windows together; the sorted places of windows with an
    equal neighbour then cover min(3, gap to the next) words each.
    """
    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(s: Column) -> Column:
        same = lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"])
        kept = F.filter(F.transform(s, lambda x, i: F.when(F.coalesce(same(x, i), F.lit(False)), x["i"])), lambda v: v.isNotNull())
        return F.array_sort(kept)

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda v, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - v, F.lit(3))).cast("long"))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, b: a + b)

    return _let(_let(pairs, places), covered)


def measure(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """The base counts and the integer measures of each row."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    words = F.array_remove(F.split(text, SPACE + "+"), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    df = docs.select(*[docs[c] for c in keep], text.alias("__t"), words.alias("__w"), lines.alias("__l"))
    df = df.withColumn("__h", F.transform("__w", lambda w: F.xxhash64(w)))
    df = df.withColumn("n_words", F.size("__w").cast("long"))
    triples = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("__h") - 2)), lambda i: F.xxhash64(F.get("__h", i - 1), F.get("__h", i), F.get("__h", i + 1)))
    df = df.withColumn("__3", F.when(F.col("n_words") >= 3, triples).otherwise(F.array().cast("array<bigint>")))
    df = df.select(
        *keep,
        "n_words",
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.regexp_count("__t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.size("__l").cast("long").alias("n_lines"),
        F.when(F.size(F.array_distinct("__3")) == F.size("__3"), F.lit(0).cast("long")).otherwise(repeat_words(F.col("__3"))).alias("n_repeat_words"),
    )
    share = lambda a, b, times: F.coalesce(F.floor(F.try_divide(F.lit(times) * F.col(a), F.col(b))), F.lit(0)).cast("long")
    return df.select(
        "*",
        share("n_symbols", "word_chars", 1000).alias("symbol_pm"),
        share("n_dup_lines", "n_lines", 1000).alias("dup_line_pm"),
        share("n_repeat_words", "n_words", 1000).alias("repeat_pm"),
        share("word_chars", "n_words", 100).alias("word_len_c"),
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
    )


def bucket(v: Column) -> Column:
    """A measure with four digits left, the rest zero; so there are 9,000 buckets at most for each
    further power of ten."""
    unit = F.pow(F.lit(10.0), F.length(v.cast("string")) - 4).cast("long")
    return F.when(v < 10_000, v).otherwise(v - v % unit)


def sketch(measured: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n). Rows are bounded by groups times buckets."""
    stack = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), bucket(F.col(m)).alias("bucket")) for m in MEASURES]))
    return measured.select("lang", "source", stack.alias("x")).groupBy("lang", "source", "x.measure", "x.bucket").agg(F.count(F.lit(1)).alias("n"))


def merge(*sketches: DataFrame) -> DataFrame:
    """Sketches of parts of a corpus add up to the sketch of the whole."""
    out = sketches[0]
    for s in sketches[1:]:
        out = out.unionByName(s)
    return out.groupBy("lang", "source", "measure", "bucket").agg(F.sum("n").alias("n"))


def quantiles(buckets: DataFrame, by: list[str]) -> DataFrame:
    """n, q25 and q75 of each group and measure: the least bucket that holds that share of the rows."""
    sums = buckets.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*by, "measure")
    cum = F.sum("n").over(w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    ranked = sums.select(*by, "measure", "bucket", cum.alias("cum"), F.sum("n").over(w).alias("total"))
    least = lambda q: F.min(F.when(F.col("cum") * 4 >= F.col("total") * q, F.col("bucket")))
    return ranked.groupBy(*by, "measure").agg(F.max("total").alias("n"), least(1).alias("q25"), least(3).alias("q75"))


def limits(buckets: DataFrame) -> DataFrame:
    """(lang, source, <measure>_low, <measure>_high): one row per group."""
    own, langs, everything = (quantiles(buckets, by) for by in (["lang", "source"], ["lang"], []))
    few = lambda c: F.col(c) < MIN_GROUP
    l = langs.select(F.col("lang").alias("l_lang"), F.col("measure").alias("l_measure"), *[F.col(c).alias(f"l_{c}") for c in ("n", "q25", "q75")])  # noqa: E741
    a = everything.select(F.col("measure").alias("a_measure"), *[F.col(c).alias(f"a_{c}") for c in ("q25", "q75")])
    j = own.join(l, F.col("lang").eqNullSafe(F.col("l_lang")) & (F.col("measure") == F.col("l_measure"))).join(F.broadcast(a), F.col("measure") == F.col("a_measure"))
    pick = lambda q: F.when(~few("n"), F.col(q)).when(~few("l_n"), F.col(f"l_{q}")).otherwise(F.col(f"a_{q}"))
    slack = F.element_at(F.create_map(*[x for m, s in MEASURES.items() for x in (F.lit(m), F.lit(s))]), F.col("measure"))
    j = j.select("lang", "source", "measure", pick("q25").alias("q25"), pick("q75").alias("q75"), slack.alias("slack"))
    iqr = F.greatest(F.col("q75") - F.col("q25"), F.col("slack"))
    j = j.select("lang", "source", "measure", (F.col("q25") - REACH * iqr).alias("low"), (F.col("q75") + REACH * iqr).alias("high"))
    wide = [F.max(F.when(F.col("measure") == m, F.col(side))).alias(f"{m}_{side}") for m in MEASURES for side in ("low", "high") if side == "high" or m in BOTH_SIDES]
    return j.groupBy("lang", "source").agg(*wide)


def judge(measured: DataFrame, most_broadcast_rows: int = 20_000) -> DataFrame:
    """measured with its group's limits and `kept`: false if the base rule failed, else whether
    every measure is within its limits (comparisons with a missing limit count as within)."""
    # the sketch serves three levels, and the limits a count and a join: each is computed once
    joined = lookup_join(measured, cut(limits(cut(sketch(measured)))), ["lang", "source"], most_broadcast_rows)
    within = ~F.col("base_failed")
    for m in MEASURES:
        within = within & F.coalesce(F.col(m) <= F.col(f"{m}_high"), F.lit(True))
        if m in BOTH_SIDES:
            within = within & F.coalesce(F.col(m) >= F.col(f"{m}_low"), F.lit(True))
    return joined.withColumn("kept", within)


def rules_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns, then the measures with their limits."""
    out = judge(cut(measure(docs)))
    extra = [c for m in MEASURES for c in (m, f"{m}_high")] + [f"{m}_low" for m in BOTH_SIDES]
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *extra)
