"""Dates, ids, hashes, bins and probabilities as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Length bins (upper edge, label) and similarity bins.
LENGTH_BINS = [(70, "≤70"), (150, "71–150"), (300, "151–300"), (500, "301–500"), (750, "501–750"), (None, "751+")]
SIMILARITY_BINS = [(0.6, "≤60%"), (0.7, "60–70%"), (0.8, "70–80%"), (0.9, "80–90%"), (None, ">90%")]
CLASSES = ("human", "ai_generated", "ai_assisted")
SPLITS = ((800, "train"), (900, "validation"), (1000, "test"))
TARGET_WORDS = (50, 150, 300, 600, 1000)


def parse_date(c: Column) -> Column:
    """The first of YYYY-MM-DD, DD.MM.YYYY and a year (its 31 December) that is a date; else null."""
    whole = lambda p, i: F.regexp_extract(c, p, i)
    iso = F.try_to_date(whole(r"(?U)\b(\d{4}-\d{2}-\d{2})\b", 1), "yyyy-MM-dd")
    dotted = r"(?U)\b(\d{1,2})\.(\d{1,2})\.(\d{4})\b"
    german = F.try_to_date(F.concat_ws("-", whole(dotted, 3), F.lpad(whole(dotted, 2), 2, "0"), F.lpad(whole(dotted, 1), 2, "0")), "yyyy-MM-dd")
    year = F.try_to_date(F.concat(whole(r"(?U)\b(1[5-9]\d{2}|20\d{2})\b", 1), F.lit("-12-31")), "yyyy-MM-dd")
    return F.coalesce(iso, german, year)


def choose_publication_date(values: Column) -> Column:
    """The earliest date of an array of strings."""
    return F.array_min(F.transform(values, parse_date))


def hash_number(c: Column) -> Column:
    """The first 8 hex digits of SHA-256 as a number."""
    return F.conv(F.substring(F.sha2(c, 256), 1, 8), 16, 10).cast("long")


def assign_split(document_id: Column) -> Column:
    """train, validation or test by the document's hash, so that a document's parts stay together."""
    k = hash_number(document_id) % 1000
    return reduce(lambda a, s: a.when(k < s[0], s[1]), SPLITS[1:], F.when(k < SPLITS[0][0], SPLITS[0][1]))


def chunk_seed(document_id: Column) -> Column:
    return (hash_number(document_id) % len(TARGET_WORDS)).cast("int")


def _bin(c: Column, bins, none_below: Column | None = None) -> Column:
    out = F.when(c.isNull() if none_below is None else c.isNull() | none_below, F.lit(None).cast("string"))
    for edge, label in bins:
        out = out.otherwise(label) if edge is None else out.when(c <= edge, label)
    return out


def length_bin(words: Column, zero_is_null: bool = False) -> Column:
    """Right-closed; `zero_is_null` gives null for texts of no words."""
    return _bin(words, LENGTH_BINS, (words <= 0) if zero_is_null else None)


def similarity_bin(c: Column) -> Column:
    return _bin(c, SIMILARITY_BINS)


def bin_order(label: Column, bins=LENGTH_BINS) -> Column:
    return F.array_position(F.array(*[F.lit(b) for _, b in bins]), label).cast("int")


def id_number(c: Column) -> Column:
    """46, 46.0, '46' and 'human-46' give 46; anything else is null (see require_id)."""
    s = F.trim(c.cast("string"))
    prefixed = F.regexp_extract(s, r"^(?:human|assisted|generated)-(\d+)$", 1)
    plain = F.regexp_extract(s, r"^(\d+)(?:\.0+)?$", 1)
    return F.coalesce(F.when(prefixed != "", prefixed).try_cast("long"), F.when(plain != "", plain).try_cast("long"))


def require_id(c: Column) -> Column:
    return F.coalesce(id_number(c), F.raise_error(F.concat(F.lit("Unrecognised id: "), F.coalesce(c.cast("string"), F.lit("NULL")))).cast("long"))


def original_number(row_id: Column, seed: Column) -> Column:
    """The seed's number if set, else that of a prefixed row id."""
    given = seed.cast("string").isNotNull() & (F.trim(seed.cast("string")) != "") & (F.lower(seed.cast("string")) != "nan")
    prefixed = F.when(F.trim(row_id.cast("string")).rlike(r"^(?:human|assisted|generated)-\d+$"), id_number(row_id))
    return F.when(given, id_number(seed)).otherwise(prefixed)


def softmax(logits: list[Column], temperature: float | Column = 1.0) -> list[Column]:
    t = F.lit(temperature) if not isinstance(temperature, Column) else temperature
    top = F.greatest(*logits)
    e = [F.exp((x - top) / t) for x in logits]
    total = reduce(lambda a, b: a + b, e)
    return [x / total for x in e]


def argmax(p: list[Column]) -> Column:
    """The first index of the largest value."""
    out = F.when(reduce(lambda a, b: a & b, [p[0] >= x for x in p[1:]]), 0)
    for i in range(1, len(p) - 1):
        out = out.when(reduce(lambda a, b: a & b, [p[i] >= x for x in p[i + 1 :]]), i)
    return out.otherwise(len(p) - 1)


def human_vs_ai(p_human: Column, p_ai: Column) -> Column:
    """1 (AI) if p_ai / (p_human + p_ai) >= 0.5, else 0; a sum of 0 gives 0."""
    return F.coalesce((F.try_divide(p_ai, p_human + p_ai) >= 0.5).cast("int"), F.lit(0))


PREDICTION = "label INT, human_probability DOUBLE, ai_probability DOUBLE, ai_assisted_probability DOUBLE"


def parse_prediction(answer: Column) -> Column:
    """A struct of a model's JSON answer with an `error`: null, or why it does not count."""
    body = F.trim(F.regexp_replace(answer, "```(?:json)?", ""))
    p = F.from_json(body, PREDICTION, {"mode": "PERMISSIVE"})
    probs = [p["human_probability"], p["ai_probability"], p["ai_assisted_probability"]]
    missing = reduce(lambda a, b: a | b, [x.isNull() for x in [p["label"], *probs]])
    total = reduce(lambda a, b: a + b, probs)
    error = (
        F.when(p.isNull() | missing, "not_json")
        .when(~p["label"].isin(0, 1, 2), "label_unknown")
        .when(F.abs(total - 1) > 0.03 + 1e-5, "probabilities_do_not_sum_to_1")
        .when(p["label"] != argmax(probs), "label_is_not_the_largest")
    )
    return F.struct(F.when(error.isNull(), p["label"]).alias("label"), *[F.when(error.isNull(), x).alias(n) for x, n in zip(probs, ("p_human", "p_ai_generated", "p_ai_assisted"), strict=True)], error.alias("error"))


def length_range(target: Column, strategy: Column) -> Column:
    """The words that a prompt allows: within a fifth of the target, at least 1 for topics."""
    low, high = F.floor(target * 0.8), F.floor(target * 1.2)
    topics = strategy == "topics"
    least = F.when(topics, F.greatest(F.lit(1), low)).otherwise(low)
    return F.struct(least.cast("long").alias("min_words"), F.when(topics, F.greatest(least, high)).otherwise(high).cast("long").alias("max_words"))


def utc_stamp(c: Column) -> Column:
    """A time (of the session's zone, which is UTC) in ISO form, to the second."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
