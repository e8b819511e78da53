"""Language detection by letter trigrams: a multinomial profile of each language, fitted by grouped counts.

`fit` counts the trigrams of labelled texts (partial counts in the tasks, one shuffle of distinct ones);
the most frequent make the model, whose size is a parameter. `Languages.detect` judges a column in Arrow
arrays. Texts are folded first: lower case, runs of other characters than letters become one space.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRAMS, LANGUAGES = 20_000, 64  # of a model at most
SAMPLE, LEAST = 4000, 100  # fixed values: characters of a text that are judged, and below which it is not


def folded(text: Column) -> Column:
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"\P{L}+", " ")), F.lit(" "))


def trigrams(text: str | None) -> np.ndarray:
    """The code of each trigram of a folded text: three code points of 21 bits."""
    points = np.frombuffer((text or "").encode("utf-32-le", "replace"), "<u4").astype(np.int64)
    return points[:-2] << 42 | points[1:-1] << 21 | points[2:] if len(points) > 2 else points[:0]


def counts(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, gram, n) over whole texts; rows without a language count for none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total: dict[str, Counter] = {}
            for name, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                own = total.setdefault(name, Counter())
                grams, n = np.unique(trigrams(t.as_py()), return_counts=True)
                own.update(dict(zip(grams.tolist(), n.tolist(), strict=True)))
            for name, own in total.items():
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(own), pa.string()), pa.array(own.keys(), pa.int64()), pa.array(own.values(), pa.int64())], names=["lang", "gram", "n"])

    src = docs.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), folded(F.col(text)).alias("t"))
    return src.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, lang: str = "lang", text: str = "text", grams: int = GRAMS, languages: int = LANGUAGES) -> Languages:
    """The model of the `grams` most frequent trigrams and the `languages` with most text."""
    from ..operators.tables import written

    table = written(counts(docs, lang, text))
    top = table.groupBy("gram").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "gram").limit(grams).select("gram")
    names = table.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).select("lang")
    rows = table.join(F.broadcast(top), "gram").join(F.broadcast(names), "lang").select("lang", "gram", "n").collect()
    return Languages([tuple(r) for r in rows])


class Languages:
    """A model: `langs` and, for each known trigram, a row of log shares of the languages."""

    def __init__(self, rows: list[tuple[str, int, int]]):
        self.rows = rows
        self.langs = sorted({r[0] for r in rows})
        self.grams = np.array(sorted({r[1] for r in rows}), np.int64)
        n = np.zeros((len(self.grams), len(self.langs)))
        if rows:
            n[np.searchsorted(self.grams, [r[1] for r in rows]), [self.langs.index(r[0]) for r in rows]] = [r[2] for r in rows]
        self.logs = np.log(n + 0.5) - np.log(n.sum(axis=0) + 0.5 * len(self.grams))

    def __getstate__(self):
        return self.rows

    def __setstate__(self, rows):
        self.__init__(rows)

    def best(self, text: str | None) -> str | None:
        """The language of a folded text, the first of equal ones; None if it holds no known trigram."""
        keys = trigrams(text)
        if not len(self.grams) or not len(keys):
            return None
        at = np.minimum(np.searchsorted(self.grams, keys), len(self.grams) - 1)
        at = at[self.grams[at] == keys]
        return self.langs[int(self.logs[at].sum(axis=0).argmax())] if len(at) else None

    def detect(self, text: Column) -> Column:
        model = self

        @F.arrow_udf("string")
        def judge(t: pa.Array) -> pa.Array:
            return pa.array([model.best(x.as_py()) for x in t], pa.string())

        return judge(folded(text))

    def is_language(self, text: Column, lang: str = "de") -> Column:
        """Whether a text's first characters are of the language; short texts are not."""
        sample = F.regexp_replace(F.substring(F.coalesce(text, F.lit("")), 1, SAMPLE), r"(?U)^\s+|\s+$", "")
        return (F.length(sample) >= LEAST) & F.coalesce(self.detect(sample) == lang, F.lit(False))

    def not_other(self, text: Column, lang: str = "de") -> Column:
        """Whether nothing speaks for another language; for paragraphs."""
        return F.coalesce(self.detect(text) == lang, F.lit(True))

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame(self.rows, "lang string, gram long, n long").write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Languages:
        return cls([tuple(r) for r in spark.read.parquet(path).select("lang", "gram", "n").collect()])
