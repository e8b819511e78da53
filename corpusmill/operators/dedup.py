"""First-wins deduplication, merging, caps, samples and set operations. Orders are explicit and by
hash, so that every plan gives the same rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ordering import hash_order, stratified_order  # noqa: F401
from .tables import number_rows  # noqa: F401


def first_of_each(df: DataFrame, key: Column | str, order: Sequence[Column | str]) -> DataFrame:
    """One row of each key: the least by `order`. The grouped minimum is combined before the shuffle,
    so a key that a third of all rows share is no hot group."""
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    least = df.groupBy((F.col(key) if isinstance(key, str) else key).alias("_k")).agg(F.min_by(F.struct(*df.columns), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(cols)])).alias("_r"))
    return least.select("_r.*")


def merge_folders(parts: list[DataFrame], hash_col: str, id_col: str) -> DataFrame:
    """The union of parts in order; of equal hashes the first part's least id stays."""
    out = None
    for i, p in enumerate(parts):
        tagged = p.withColumn("downloaded_in", F.lit(i))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return first_of_each(out, hash_col, ["downloaded_in", id_col])


def only_new(rows: DataFrame, existing: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key `existing` lacks: resuming, or skipping what is there."""
    return rows.join(existing.select(*on).distinct(), on, "left_anti")


def known(rows: DataFrame, existing: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key `existing` has."""
    return rows.join(existing.select(*on).distinct(), on, "left_semi")


def cap_per_group(df: DataFrame, group: str, order: Sequence[str | Column], limit: int) -> DataFrame:
    """The first `limit` rows of each group. Spark keeps only so many per task before it shuffles."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def stratified_sample(df: DataFrame, stratum: str, id_col: str, per_stratum: int, seed: int = 17) -> DataFrame:
    """`per_stratum` rows of each stratum, by hash order."""
    return cap_per_group(df, stratum, [hash_order(id_col, seed=seed), F.col(id_col)], per_stratum)


def random_rows(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    return df.orderBy(hash_order(id_col, seed=seed), id_col).limit(n)


def two_pass_order(df: DataFrame, source: str, page: str, window: str, id_col: str, per_page: int = 2, per_window: int = 4, seed: int = 42) -> DataFrame:
    """`pass` (1 or 2) and `ingest_rank` per source: first a few documents of each page and window,
    then all others. Apply it after the gates, as only accepted documents count."""
    mix = hash_order(id_col, seed=seed)
    on_page = F.row_number().over(Window.partitionBy(source, window, page).orderBy(mix, id_col))
    df = df.withColumn("_page", on_page)
    in_window = F.sum((F.col("_page") <= per_page).cast("int")).over(Window.partitionBy(source, window).orderBy(mix, id_col).rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("pass", F.when((F.col("_page") <= per_page) & (in_window <= per_window), 1).otherwise(2)).drop("_page")
    return df.withColumn("ingest_rank", F.row_number().over(Window.partitionBy(source).orderBy("pass", mix, id_col)))


def take_until(df: DataFrame, source: str, rank: str, parts: str, target: int) -> DataFrame:
    """`take`: how many of a document's `parts` fit before the source's target is reached."""
    before = F.coalesce(F.sum(parts).over(Window.partitionBy(source).orderBy(rank).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("take", F.least(F.col(parts), F.greatest(F.lit(0), F.lit(target) - before))).where("take > 0")


def duplicate_groups(df: DataFrame, key: Column, id_col: str) -> DataFrame:
    return df.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("copies"), F.min(id_col).alias("first_id")).where("copies > 1")


def subset_sizes(n: int, fractions: Sequence[float]) -> list[int]:
    """Sizes of nested subsets: rounded (halves to even), between 1 and n, ascending, ending in n."""
    sizes = sorted({min(n, max(1, round(f * n))) for f in fractions})
    return [*[s for s in sizes if s < n], n]
