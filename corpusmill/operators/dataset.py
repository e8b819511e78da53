"""Assembly of the three-class dataset and its invariants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import text as T
from .tables import written

GENERATORS = "first_id long, last_id long, model string, company string, strategy string"
# Id ranges of the generators; aliases of their names.
RANGES = [(1, 2499, "gpt-5.6-luna", "OpenAI", "source_based"), (2500, 4999, "gemini-3.8-flash", "Google", "source_based"), (5000, 7499, "deepseek-flash", "DeepSeek", "topics"), (7500, 10227, "gpt-6-luna", "OpenAI", "source_based")]
DISPLAY = {"gpt-5.6-luna": "GPT-5.6", "gemini-3.8-flash": "Gemini", "gemini": "Gemini", "deepseek-flash": "DeepSeek", "gpt-6-luna": "GPT-6"}


def generator_ranges(spark: SparkSession, ranges=None) -> DataFrame:
    return spark.createDataFrame(RANGES if ranges is None else ranges, GENERATORS)


def with_generator(df: DataFrame, seed: str, ranges: DataFrame, strict: bool = False) -> DataFrame:
    """A range join with the few rows of `ranges`; `strict` fails on an id that no range holds."""
    out = df.join(F.broadcast(ranges), F.col(seed).between(F.col("first_id"), F.col("last_id")), "left").drop("first_id", "last_id")
    if strict:
        message = F.concat(F.lit("No generator configured for sample "), F.col(seed).cast("string"))
        out = out.withColumn("model", F.coalesce("model", F.raise_error(message).cast("string")))
    return out


def display_name(model: Column, names: dict[str, str] = DISPLAY) -> Column:
    """A name from a small map; unknown ones pass through."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), model), model)


def shared_fields(author: Column, date: Column) -> dict[str, Column]:
    """The author list as one string, and the year of an ISO date if it begins with one."""
    head = F.substring(date, 1, 4)
    return {"author": F.array_join(author, "; "), "publication_year": F.when(head.rlike(r"^\d{4}$"), head).try_cast("int")}


def assemble(human: DataFrame, assisted: DataFrame, generated: DataFrame, ranges: DataFrame, least_words: int = 20, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows, skipped) from human (sample_id, text, split, ...) and AI texts (seed_id, text).

    A human row and its two partners share a split. Missing, short or unchanged AI texts are skipped
    with a reason. An id that no generator's range holds fails, or, if not `strict`, has its AI texts
    skipped. The three branches are a union; each join is on the seed id and takes a human text's hash along,
    not the text.
    """
    h = human.withColumn("text", T.strip(F.col("text")))
    gen = with_generator(h.withColumn("human_hash", F.unhex(F.sha2("text", 256))).drop("text"), "sample_id", ranges, strict=strict)
    others = [c for c in human.columns if c not in ("sample_id", "text")]
    none = F.lit(None).cast("string")

    def row(df: DataFrame, kind: str, label: int, model: Column, company: Column, strategy: Column, seed: Column) -> DataFrame:
        return df.select(F.concat(F.lit(f"{kind}-"), F.col("sample_id").cast("string")).alias("id"), "text", F.lit(label).alias("label"), seed.cast("long").alias("seed_sample_id"), *others, T.word_count(F.col("text")).alias("word_count"), model.alias("generator_model"), company.alias("generator_company"), strategy.alias("strategy"))

    rows = row(h, "human", 0, none, none, none, F.lit(None))
    skipped = None
    for kind, label, texts, strategy in (("assisted", 2, assisted, F.lit("rewrite")), ("generated", 1, generated, F.col("strategy"))):
        j = gen.join(texts.select(F.col("seed_id").alias("sample_id"), T.strip(F.col("text")).alias("text")), "sample_id", "left")
        why = F.when(F.col("model").isNull(), f"no_generator_{kind}").when(F.col("text").isNull(), f"missing_{kind}").when(T.word_count(F.col("text")) < least_words, f"refused_{kind}").when(F.unhex(F.sha2("text", 256)) == F.col("human_hash"), f"unchanged_{kind}")
        j = j.withColumn("skip_reason", why)
        rows = rows.unionByName(row(j.where("skip_reason is null"), kind, label, F.col("model"), F.col("company"), strategy, F.col("sample_id")))
        s = j.where("skip_reason is not null").select("skip_reason", F.col("sample_id").alias("seed_id"))
        skipped = s if skipped is None else skipped.unionByName(s)
    return rows, skipped


def skip_report(skipped: DataFrame, most: int = 15) -> DataFrame:
    from .dedup import cap_per_group

    few = cap_per_group(skipped, "skip_reason", ["seed_id"], most).groupBy("skip_reason").agg(F.array_sort(F.collect_list("seed_id")).alias("first_ids"))
    return skipped.groupBy("skip_reason").agg(F.count(F.lit(1)).alias("n")).join(few, "skip_reason")


def problems(rows: DataFrame, least_words: int = 20) -> DataFrame:
    """(problem, key): the dataset is sound if this is empty. The rows are made once; what is looked at of each
    is narrow and kept as a table."""
    each = F.array_compact(
        F.array(
            F.when(F.trim("text") == "", "empty_text"),
            F.when(F.col("word_count") != T.word_count(F.col("text")), "wrong_word_count"),
            F.when((F.coalesce("license_name", F.lit("")) == "") | (F.coalesce("source_url", F.lit("")) == ""), "missing_licence_or_source"),
            F.when((F.col("label") == 0) & F.col("generator_model").isNotNull(), "human_row_with_generator"),
            F.when((F.col("label") > 0) & (F.col("word_count") < least_words), "ai_text_too_short"),
        )
    )
    seen = written(rows.select("id", "split", "document_id", F.sha2("text", 256).alias("hash"), each.alias("found")))
    ids = seen.groupBy("id").count().where("count > 1").select(F.lit("duplicate_id").alias("problem"), F.col("id").alias("key"))
    texts = seen.groupBy("hash").count().where("count > 1").select(F.lit("identical_texts").alias("problem"), F.col("hash").alias("key"))
    by_row = seen.select(F.explode("found").alias("problem"), F.col("id").alias("key"))
    return ids.unionByName(texts).unionByName(by_row).unionByName(leaks(seen, "document_id", "document_in_two_splits")).unionByName(leaks(seen.withColumn("grp", S.id_number(F.col("id")).cast("string")), "grp", "group_in_two_splits"))


def date_range(rows: DataFrame, day: str, by: list[str]) -> DataFrame:
    """The first and last day and the number of rows of each group of a merged set."""
    return rows.groupBy(*by).agg(F.min(F.to_date(day)).alias("first_day"), F.max(F.to_date(day)).alias("last_day"), F.count(F.lit(1)).alias("n"))


def leaks(rows: DataFrame, key: str, problem: str) -> DataFrame:
    """Keys that occur in more than one split."""
    two = rows.groupBy(key).agg(F.min("split").alias("a"), F.max("split").alias("b")).where("a <> b")
    return two.select(F.lit(problem).alias("problem"), F.col(key).cast("string").alias("key"))


def contingency(rows: DataFrame, labels: tuple = (0, 1, 2)) -> DataFrame:
    """Counts of split by label with a totals row (split null)."""
    return rows.rollup("split").agg(*[F.count_if(F.col("label") == i).alias(f"label_{i}") for i in labels], F.count(F.lit(1)).alias("total"))


def match_originals(assisted: DataFrame, humans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs, missing): AI rows with their human original's text, in either id format."""
    a = assisted.withColumn("original", S.original_number(F.col("id"), F.col("seed_sample_id")))
    h = humans.select(S.require_id(F.col("id")).alias("original"), F.col("text").alias("original_text"))
    return a.join(h, "original"), a.join(h, "original", "left_anti").select("id")
