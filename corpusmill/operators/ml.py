"""The classical baseline on MLlib: TF-IDF of 1- and 2-grams, multinomial regression, grouped folds."""

from __future__ import annotations

import math
import time

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .ordering import group_folds
from .tables import written


ROWS = 5_000  # of a partition that the solver reads, at least
BLOCK = 0.25  # MB of the rows that the solver keeps as one: its arrays stay below half a region of a small heap


def tokens(df: DataFrame, text: str = "text") -> DataFrame:
    """Lower-case words of two characters or more, and their pairs, as one array."""
    words = F.filter(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"(?U)\w\w+"), F.lit(0)), lambda w: w != "")
    df = df.withColumn("words", words)
    pairs = F.when(F.size("words") > 1, F.transform(F.sequence(F.lit(0), F.size("words") - 2), lambda i: F.concat_ws(" ", F.get("words", i), F.get("words", i + 1)))).otherwise(F.array().cast("array<string>"))
    return df.withColumn("terms", F.concat("words", pairs)).drop("words")


class SublinearCounts(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """`counts` -> `logs`: each count above 0 becomes 1 + ln(count)."""

    def _transform(self, df: DataFrame) -> DataFrame:
        @F.arrow_udf(VectorUDT())
        def logs(v: pa.Array) -> pa.Array:
            values = v.field("values")
            flat = np.log(values.values.to_numpy(zero_copy_only=False)) + 1
            values = pa.ListArray.from_arrays(values.offsets, pa.array(flat))
            return pa.StructArray.from_arrays([v.field("type"), v.field("size"), v.field("indices"), values], names=["type", "size", "indices", "values"])

        return df.withColumn("logs", logs("counts"))


def vocabulary(df: DataFrame, least: float, most: float, features: int) -> list[Row]:
    """The `features` most counted terms that `least` to `most` texts have, ties by term, and those texts' number.
    Rows of all terms and of each once are summed by hash, which spills, without an object for each term."""
    both = df.select(F.posexplode(F.array("terms", F.array_distinct("terms"))).alias("once", "some")).select("once", F.explode("some").alias("term"))
    seen = both.groupBy("term").agg(F.sum(1 - F.col("once")).alias("counted"), F.sum("once").alias("texts"))
    return seen.where(F.col("texts").between(least, most)).orderBy(F.desc("counted"), "term").limit(features).select("term", "texts").collect()


def counter(spark: SparkSession, terms: list[str]) -> CountVectorizerModel:
    """`terms` -> `counts`. As from_vocabulary, which takes half a minute for 200,000 terms as it hands over one at
    a time; they go as one string here (no term has a line end)."""
    split = spark.sparkContext._jvm.org.apache.commons.lang3.StringUtils.splitPreserveAllTokens("\n".join(terms), "\n")
    model = CountVectorizerModel._create_from_java_class("org.apache.spark.ml.feature.CountVectorizerModel", split)
    return model.setInputCol("terms").setOutputCol("counts")


def fit(df: DataFrame, c: float = 3.0, min_df: float = 5.0, max_df: float = 0.98, features: int = 200_000, iterations: int = 1_000, tolerance: float = 1e-4, label: str = "label") -> PipelineModel:
    """(1 + ln count) x (ln((1 + n) / (1 + df)) + 1) -> L2 norm -> regression until a step gains
    less than `tolerance`, in `iterations` at most; the penalty is 1 / (c n)."""
    df = df.select(label, "terms")
    n, top = df.agg(F.count(F.lit(1)), F.max(label)).first()
    n = max(1, n)
    least = min(min_df if min_df >= 1 else min_df * n, float(n))
    most = max_df if max_df >= 1 else max_df * n
    found = vocabulary(df, least, most if most >= least else float(n), features)
    if not found:
        raise ValueError("no term is in as many texts as min_df and max_df ask for")
    counts = counter(df.sparkSession, [r.term for r in found])
    weigh = ElementwiseProduct(scalingVec=Vectors.dense([math.log((1 + n) / (1 + r.texts)) + 1 for r in found]), inputCol="logs", outputCol="weighted")
    norm = Normalizer(inputCol="weighted", outputCol="features", p=2.0)
    logs = SublinearCounts()
    # a step of the solver sums a dense vector for each partition, so few rows are read in few partitions
    counted = written(logs.transform(counts.transform(df)).select(label, "logs")).coalesce(-(-n // ROWS))
    train = norm.transform(weigh.transform(counted)).select(label, "features")
    # of two classes the weights are opposite: their difference alone is sought, whose penalty is half
    family, penalty = ("binomial", 0.5 / (c * n)) if top == 1 else ("multinomial", 1.0 / (c * n))
    model = LogisticRegression(labelCol=label, family=family, regParam=penalty, standardization=False, maxIter=iterations, tol=tolerance, maxBlockSizeInMB=BLOCK).fit(train)
    return PipelineModel([counts, logs, weigh, norm, model])


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    out = model.transform(df).withColumn("_p", vector_to_array("probability"))
    return out.withColumn("pred", F.col("prediction").cast("int")).withColumns({f"p{k}": F.coalesce(F.get("_p", F.lit(k)), F.lit(0.0)) for k in range(3)}).drop("_p", "rawPrediction", "probability", "prediction", "counts", "logs", "weighted", "features")


def accuracy(preds: DataFrame, label: str = "label") -> float:
    return preds.agg(F.avg((F.col("pred") == F.col(label)).cast("int"))).first()[0] or 0.0


def grid_search(df: DataFrame, group: str, grid: list[dict], folds: int = 3, label: str = "label") -> list[dict]:
    """Each setting's mean accuracy over folds that keep a group's rows together and spread the classes
    evenly, best first."""
    fold = written(group_folds(df, group, label, folds).withColumnsRenamed({group: "_g", "fold": "_fold"}))
    d = df.join(fold, F.col(group).eqNullSafe(F.col("_g"))).drop("_g").cache()
    out = []
    for setting in grid:
        scores = [accuracy(predict(fit(d.where(F.col("_fold") != k), label=label, **setting), d.where(F.col("_fold") == k)), label) for k in range(folds)]
        out.append({**setting, "mean_accuracy": sum(scores) / folds, "scores": scores})
    d.unpersist()
    return sorted(out, key=lambda r: -r["mean_accuracy"])


def learning_curve(train: DataFrame, validation: DataFrame, order: str, sizes: list[int], label: str = "label", **settings) -> DataFrame:
    """A row per nested prefix of `order`: accuracy on it and on the validation rows, gap and seconds."""
    rows = []
    for n in sizes:
        part = train.where(F.col(order) < n).cache()
        began = time.time()
        model = fit(part, label=label, **settings)
        seconds = time.time() - began
        a, b = accuracy(predict(model, part), label), accuracy(predict(model, validation), label)
        rows.append((n, a, b, a - b, seconds))
        part.unpersist()
    return train.sparkSession.createDataFrame(rows, "texts int, train_accuracy double, validation_accuracy double, gap double, training_runtime_seconds double")


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
