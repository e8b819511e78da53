"""Evaluation of predictions: grouped aggregates over a long table.

Predictions have id, model, label, pred, p0, p1, p2, word_count, source and generator_model; a row
per text and model. Averages of nothing are null, never NaN.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S

EPS = 2.220446049250313e-16  # Fixed value: probabilities are kept this far from 0 and 1


def right() -> Column:
    return F.col("pred") == F.col("label")


def valid(preds: DataFrame) -> DataFrame:
    """Failed predictions (null) do not count."""
    return preds.where("pred is not null").withColumn("pred", F.col("pred").cast("int"))


def confusion(preds: DataFrame, by: list[str] | None = None, classes: int = 3) -> DataFrame:
    """true_label, then n_0, n_1 ... in a fixed order, zero-filled."""
    by = by or []
    counts = preds.groupBy(*by, F.col("label").alias("true_label")).agg(*[F.count_if(F.col("pred") == k).alias(f"n_{k}") for k in range(classes)])
    grid = preds.select(*by).distinct() if by else preds.sparkSession.range(1).select()
    grid = grid.withColumn("true_label", F.explode(F.array(*map(F.lit, range(classes)))))
    return grid.join(counts, [*by, "true_label"], "left").na.fill(0, [f"n_{k}" for k in range(classes)])


BINARY = {
    "strict": (lambda: F.col("label").isin(0, 1) & F.col("pred").isin(0, 1), lambda: F.col("pred")),
    "renorm": (lambda: F.col("label") != 2, lambda: S.human_vs_ai(F.col("p0"), F.col("p1"))),
    "any_ai": (lambda: F.col("label").isin(0, 1), lambda: F.when(F.col("pred") == 0, 0).otherwise(1)),
}


def binary(preds: DataFrame, variant: str) -> DataFrame:
    """Rows of a Human-vs-AI reading, pred being 0 or 1: `strict` keeps rows whose true and predicted
    class is 0 or 1, `renorm` drops class 2 and compares p1 / (p0 + p1) with 0.5, `any_ai` counts
    every prediction other than human as AI."""
    keep, pred = BINARY[variant]
    return preds.where(keep()).withColumn("pred", pred().cast("int"))


def binary_confusion(preds: DataFrame, variant: str, by: list[str] | None = None) -> DataFrame:
    y, p = F.col("label"), F.col("pred")
    cell = lambda a, b: F.count_if((y == a) & (p == b))
    out = binary(preds, variant).groupBy(*(by or [])).agg(cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp"), F.avg(right().cast("int")).alias("accuracy"))
    return out.withColumn("variant", F.lit(variant))


def class_report(preds: DataFrame, by: list[str], classes: int = 3) -> DataFrame:
    """precision, recall, f1 and support of each class (0 where undefined), and macro_f1."""
    one = preds.withColumn("k", F.explode(F.array(*map(F.lit, range(classes)))))
    y, p = F.col("label") == F.col("k"), F.col("pred") == F.col("k")
    g = one.groupBy(*by, "k").agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"))
    tp, zero = F.col("tp"), F.lit(0.0)
    g = g.select(*by, F.col("k").alias("class"), F.coalesce(F.try_divide(tp, tp + F.col("fp")), zero).alias("precision"), F.coalesce(F.try_divide(tp, tp + F.col("fn")), zero).alias("recall"), F.coalesce(F.try_divide(2 * tp, 2 * tp + F.col("fp") + F.col("fn")), zero).alias("f1"), (tp + F.col("fn")).alias("support"))
    return g.withColumn("macro_f1", F.avg("f1").over(Window.partitionBy(*by)))


def brier(label: str = "label", p: tuple[str, ...] = ("p0", "p1", "p2")) -> Column:
    return F.avg(reduce(lambda a, b: a + b, [F.pow(F.col(c) - (F.col(label) == k).cast("int"), 2) for k, c in enumerate(p)]))


def binary_brier(p: Column, y: Column) -> Column:
    return F.avg(F.pow(p - y, 2))


def log_loss(label: str = "label", p: tuple[str, ...] = ("p0", "p1", "p2")) -> Column:
    own = F.get(F.array(*[F.col(c) for c in p]), F.col(label))
    return -F.avg(F.ln(F.least(F.greatest(own, F.lit(EPS)), F.lit(1 - EPS))))


def error_rates(classes: int = 3) -> list[Column]:
    return [F.avg(F.when(F.col("label") == k, (F.col("pred") != k).cast("int"))).alias(f"error_{k}") for k in range(classes)]


def split_metrics(preds: DataFrame, by: list[str]) -> DataFrame:
    """n, accuracy, macro_f1, Brier score, log loss and errors of each group: one row each."""
    main = preds.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(right().cast("int")).alias("accuracy"), brier().alias("brier"), log_loss().alias("log_loss"), *error_rates())
    return main.join(class_report(preds, by).groupBy(*by).agg(F.max("macro_f1").alias("macro_f1")), by)


def length_bias(preds: DataFrame, by: list[str]) -> DataFrame:
    """Per length bin: counts of each class, accuracy, own-class score in per cent, error per class."""
    k3 = range(3)
    b = preds.withColumn("length_bin", S.length_bin(F.col("word_count")))
    own = [(F.avg(F.when(F.col("label") == k, F.col(f"p{k}"))) * 100).alias(f"score_{k}") for k in k3]
    return b.groupBy(*by, "length_bin").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("label") == k).alias(f"n_{k}") for k in k3], F.avg(right().cast("int")).alias("accuracy"), *own, *error_rates())


def error_by_group(preds: DataFrame, group: str, models: list[str]) -> DataFrame:
    """samples, then each model's error."""
    errors = [F.avg(F.when(F.col("model") == m, (~right()).cast("int"))).alias(m) for m in models]
    return preds.groupBy(group).agg(F.count_if(F.col("model") == models[0]).alias("samples"), *errors)


def per_text(preds: DataFrame) -> DataFrame:
    return preds.groupBy("id").agg(F.every(right()).alias("all_right"), F.every(~right()).alias("all_wrong"), F.count_if(~right()).alias("models_wrong"), F.min("word_count").alias("word_count"), F.min("label").alias("label"), F.min("source").alias("source"))


def agreement_summary(preds: DataFrame) -> DataFrame:
    t = per_text(preds)
    return t.agg(F.count(F.lit(1)).alias("texts"), F.count_if("all_right").alias("all_correct"), F.count_if("all_wrong").alias("all_wrong"), F.count_if(~F.col("all_right") & ~F.col("all_wrong")).alias("disagree"))


def hardest(preds: DataFrame) -> DataFrame:
    """Texts that every model gets wrong, shortest first."""
    return per_text(preds).where("all_wrong").select("id", "label", "word_count", "source").orderBy("word_count", "id")


def wide(preds: DataFrame, value: Column, models: list[str]) -> DataFrame:
    """A column for each model: one grouped pass in place of a self-join."""
    return preds.groupBy("id").agg(*[F.max(F.when(F.col("model") == m, value)).alias(m) for m in models])


def pairwise_agreement(preds: DataFrame, models: list[str]) -> DataFrame:
    """Per cent of texts with equal predictions for each pair of models, in both orders."""
    w = wide(preds, F.col("pred"), models)
    pairs = [F.round(F.avg((F.col(a) == F.col(b)).cast("int")) * 100, 2).alias(f"{a}|{b}") for a in models for b in models]
    row = w.agg(*pairs)
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("model_a"), F.lit(b).alias("model_b"), F.col(f"`{a}|{b}`").alias("agreement")) for a in models for b in models]))
    return row.select(each.alias("x")).select("x.*")


def confidence_table(preds: DataFrame) -> DataFrame:
    conf = F.greatest("p0", "p1", "p2")
    ok, bad = F.when(right(), conf), F.when(~right(), conf)
    return preds.groupBy("model").agg(F.avg(ok).alias("mean_right"), F.avg(bad).alias("mean_wrong"), F.median(bad).alias("median_wrong"), F.avg((bad >= 0.9).cast("int")).alias("wrong_over_90"))


def histogram(df: DataFrame, bin_col: Column, bins: list[str], subset: Column) -> DataFrame:
    """Shares of all rows and of a subset in each bin, empty bins kept."""
    g = df.groupBy(bin_col.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.count_if(subset).alias("n_subset"))
    dim = df.sparkSession.createDataFrame([(b, i) for i, b in enumerate(bins)], "bin string, bin_ord int")
    j = dim.join(g, "bin", "left").na.fill(0, ["n", "n_subset"])
    every = Window.partitionBy()  # the few rows of the bins
    return j.select("bin", "bin_ord", F.try_divide(F.col("n"), F.sum("n").over(every)).alias("share"), F.try_divide(F.col("n_subset"), F.sum("n_subset").over(every)).alias("share_subset"))


def label_counts(df: DataFrame, by: str, label: str = "label", labels: tuple = (0, 1, 2)) -> DataFrame:
    return df.groupBy(by).pivot(label, list(labels)).count().na.fill(0)


def check_alignment(preds: DataFrame) -> DataFrame:
    """Ids that not every model has once, or whose labels differ: empty if predictions line up."""
    models = preds.select("model").distinct().count()
    g = preds.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("model").alias("m"), F.min("label").alias("a"), F.max("label").alias("b"))
    why = F.when((F.col("n") != models) | (F.col("m") != models), "ids are not aligned").when(F.col("a") != F.col("b"), "labels are not aligned")
    return g.select("id", why.alias("problem")).where("problem is not null")


def synthetic_predictions(docs: DataFrame, models: dict[str, int]) -> DataFrame:
    """Reproducible predictions from hashes, for tests and the bench: model -> per cent of errors."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(e).alias("err")) for m, e in models.items()]))
    d = docs.select(F.col("doc_id").alias("id"), F.regexp_count("text", F.lit(r"(?U)\S+")).cast("long").alias("word_count"), "source", (F.col("doc_id") % 3).cast("int").alias("label"), each.alias("m")).select("*", "m.*").drop("m")
    h = S.hash_number(F.concat(F.col("id").cast("string"), F.lit(":"), F.col("model")))
    d = d.withColumn("h", h)
    wrong = (F.col("h") % 100 < F.col("err")) | (F.col("id") % 37 == 0)
    d = d.withColumn("pred", F.when(wrong, (F.col("label") + 1 + F.floor(F.col("h") / 100) % 2) % 3).otherwise(F.col("label")).cast("int"))
    d = d.withColumn("conf", 0.5 + (F.floor(F.col("h") / 1000) % 500) / F.lit(1000.0))
    for k in range(3):
        d = d.withColumn(f"p{k}", F.when(F.col("pred") == k, F.col("conf")).otherwise((1 - F.col("conf")) / 2))
    generator = F.when(F.col("label") > 0, F.element_at(F.array(*map(F.lit, ("deepseek-flash", "gemini", "gpt-5.6-luna", "gpt-6-luna"))), (F.col("id") % 4 + 1).cast("int")))
    return d.withColumn("generator_model", generator).drop("h", "err", "conf")
