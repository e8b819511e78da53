"""Quality classifier: ridge regression on random Fourier features, isotonic calibration.

Document statistics are standardised and mapped to cosines of random projections, whose inner
products approximate a Gaussian kernel. Each partition of labelled rows adds up its part of the
normal equations, by fold; the sums, of fixed size, merge in levels. Every fold's model comes from
the sums of the others, so the penalty is chosen and the calibration is fitted on scores of rows
that the scoring model has not seen. Calibration pools adjacent violators over a fixed grid of scores.

Labels are read only of rows whose crc32(id as text) mod 5 is not 0. Null and empty texts have
statistics of 0 and are scored as any other. Repeated labels of an id are averaged, null ones left
out; with no usable label all scores are 0.5. Null ids are scored, not held out and not trained on.
Extra columns are ignored; an empty table gives no rows. Whole texts are measured, however long. So
that one odd row cannot bend the fit, words per line count as 400 at most and a standardised
statistic as 8 at most; every row is scored all the same. Sums arrive in any order, so scores of two
runs may differ in their last digits.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, reduce_blobs, share, text_batches

NAMES = (
    "log_chars log_words word_len letters digits uppers spaces stops symbols high entropy distinct top_word "
    "adjacent dup_lines line_words capital_words long_words distinct_pairs ends"
).split()


def _classes(chars: str) -> np.ndarray:
    return np.isin(np.arange(256), np.frombuffer(chars.encode(), np.uint8))


UPPER, LOWER = _classes("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _classes("abcdefghijklmnopqrstuvwxyz")
DIGIT, SPACE, STOP = _classes("0123456789"), _classes(" \t\n\r\x0b\f"), _classes(".,;:!?'\"()-")
SYMBOL, HIGH, END = _classes("#*$%&|<>@^~_=+/\\{}[]`"), np.arange(256) >= 128, _classes(".!?")


def statistics(text: str | None) -> list[float]:
    """The numbers called NAMES."""
    data = (text or "").encode("utf-8", "replace")
    words = data.split()
    if not words:
        return [0.0] * len(NAMES)
    n, k = len(data), len(words)
    hist = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    p = hist[hist > 0] / n
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in data.split(b"\n") if x.strip()]
    share = lambda mask: float(hist[mask].sum()) / n
    return [
        np.log1p(n), np.log1p(k), (n - hist[SPACE].sum()) / k, share(UPPER | LOWER), share(DIGIT), share(UPPER), share(SPACE), share(STOP), share(SYMBOL), share(HIGH),
        float(-(p * np.log2(p)).sum()), len(counts) / k, max(counts.values()) / k, sum(map(eq, words, words[1:])) / k, 1 - len(set(lines)) / len(lines), min(k / len(lines), 400.0),
        sum(map(bytes.istitle, words)) / k, sum(len(w) > 12 for w in words) / k, len(set(zip(words, words[1:]))) / k, hist[END].sum() / k,
    ]


@dataclass(frozen=True)
class Settings:
    cosines: int = 160
    width: float = 1.0  # of the kernel, in units of the square root of the number of statistics
    penalties: tuple[float, ...] = (1e-4, 1e-3, 1e-2, 1e-1)
    bins: int = 400
    seed: int = 7


class Features:
    def __init__(self, mean: np.ndarray, spread: np.ndarray, s: Settings):
        rng = np.random.default_rng(s.seed)
        d = len(mean)
        self.mean, self.spread = mean, spread
        self.w = rng.normal(0, 1 / (s.width * np.sqrt(d)), (d, s.cosines))
        self.b = rng.uniform(0, 2 * np.pi, s.cosines)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -8, 8)
        return np.hstack([np.ones((len(z), 1)), z, np.sqrt(2 / self.w.shape[1]) * np.cos(z @ self.w + self.b)])


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fold, x binary): the statistics of each row; fold is crc32(id as text) mod 5."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [np.array(statistics(t.as_py()), np.float64).tobytes() for t in b.column(1)]
            fold = [None if i.as_py() is None else zlib.crc32(str(i.as_py()).encode()) % 5 for i in b.column(0)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fold, pa.int32()), pa.array(x, pa.binary())], names=["doc_id", "fold", "x"])

    text_batches(docs.sparkSession)
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, "doc_id long, fold int, x binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def _merge(parts):
    """Adds up blobs of float64 by key."""
    sums: dict[int, np.ndarray] = {}
    for p in parts:
        for k, v in zip(p["key"], p["blob"], strict=True):
            x = np.frombuffer(v, np.float64)
            sums[k] = sums[k] + x if k in sums else x.copy()
    import pandas as pd

    yield pd.DataFrame({"key": list(sums), "blob": [v.tobytes() for v in sums.values()]})


def _summed(df: DataFrame, add) -> dict[int, np.ndarray]:
    """Sums over all rows of what `add` returns for a batch: {key: array}."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, v in add(b).items() if b.num_rows else ():
                sums[k] = sums[k] + v if k in sums else v
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["key", "blob"])

    rows = reduce_blobs(df.mapInArrow(run, "key int, blob binary"), _merge, "key int, blob binary")
    out: dict[int, np.ndarray] = {}
    for r in rows:
        x = np.frombuffer(r["blob"], np.float64)
        out[r["key"]] = out[r["key"]] + x if r["key"] in out else x
    return out


def isotonic(weight: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Non-decreasing means of bins (weights, sums of labels), by pooling; empty bins take the
    line between their neighbours."""
    at = np.flatnonzero(weight)
    blocks: list[list[float]] = []
    for i in at:
        blocks.append([weight[i], total[i], 1])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][0] >= blocks[-1][1] / blocks[-1][0]:
            w, t, k = blocks.pop()
            blocks[-1][0] += w
            blocks[-1][1] += t
            blocks[-1][2] += k
    means = np.repeat([b[1] / b[0] for b in blocks], [int(b[2]) for b in blocks])
    return np.interp(np.arange(len(weight)), at, means)


class Model:
    """Weights over features, and the calibration over a grid of raw scores from -0.5 to 1.5."""

    def __init__(self, feature: Features, weights: np.ndarray, curve: np.ndarray):
        self.feature, self.weights, self.curve = feature, weights, curve

    @staticmethod
    def place(raw: np.ndarray, bins: int) -> np.ndarray:
        return (np.clip(raw, -0.5, 1.5) + 0.5) / 2 * (bins - 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated; a thousandth of the raw order keeps equal levels apart."""
        raw = self.feature(x) @ self.weights
        level = np.interp(self.place(raw, len(self.curve)), np.arange(len(self.curve)), self.curve)
        return 0.999 * level + 0.001 / (1 + np.exp(-4 * (raw - 0.5)))


def fit(labelled: DataFrame, s: Settings = Settings()) -> Model | None:
    """A model from rows (fold 1 to 4, x, y)."""
    moments = _summed(labelled, lambda b: {0: np.concatenate([[b.num_rows], (x := _matrix(b.column(1))).sum(0), (x**2).sum(0)])})
    if not moments or moments[0][0] == 0:
        return None
    n, d = moments[0][0], len(NAMES)
    mean = moments[0][1 : d + 1] / n
    spread = np.sqrt(np.maximum(moments[0][d + 1 :] / n - mean**2, 0))
    feature = Features(mean, np.where(spread > 1e-9, spread, 1.0), s)

    def add(b: pa.RecordBatch) -> dict[int, np.ndarray]:
        fold, y = b.column(0).to_numpy(), b.column(2).to_numpy()
        phi = np.hstack([feature(_matrix(b.column(1))), y[:, None]])  # the last row and column hold the labels' sums
        return {int(f): (phi[fold == f].T @ phi[fold == f]).ravel() for f in np.unique(fold)}

    grams = {f: g.reshape(int(len(g) ** 0.5), -1) for f, g in _summed(labelled, add).items()}
    whole = sum(grams.values())

    def solve(g: np.ndarray, penalty: float) -> np.ndarray:
        a = g[:-1, :-1] + penalty * max(g[0, 0], 1) * np.eye(len(g) - 1)
        a[0, 0] -= penalty * max(g[0, 0], 1) * 0.999  # the constant is hardly held back
        return np.linalg.solve(a, g[:-1, -1])

    def missed(penalty: float) -> float:
        total = 0.0
        for g in grams.values():
            w = np.append(solve(whole - g, penalty), -1.0)
            total += w @ g @ w
        return total

    penalty = min(s.penalties, key=missed)
    others = {f: solve(whole - g, penalty) for f, g in grams.items()}

    def bins(b: pa.RecordBatch) -> dict[int, np.ndarray]:
        fold, y, phi = b.column(0).to_numpy(), b.column(2).to_numpy(), feature(_matrix(b.column(1)))
        raw = np.array([p @ others[int(f)] for f, p in zip(fold, phi, strict=True)])
        at = np.rint(Model.place(raw, s.bins)).astype(np.int64)
        return {0: np.concatenate([np.bincount(at, minlength=s.bins), np.bincount(at, weights=y, minlength=s.bins)]).astype(np.float64)}

    sums = _summed(labelled, bins)[0]
    return Model(feature, solve(whole, penalty), isotonic(sums[: s.bins], sums[s.bins :]))


def labelled_rows(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(fold, x, y) of the rows with a label that are not held out."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isNotNull()).where(crc != 0)
    known = known.groupBy("doc_id").agg(F.avg("y").alias("y"))
    return rows.where("fold <> 0").join(known, "doc_id").select("fold", "x", "y")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, s: Settings = Settings()) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row. Texts are read once; the statistics are kept."""
    rows = cut(features(docs))
    fitted = share(docs.sparkSession, fit(cut(labelled_rows(rows, labels)), s))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = fitted()
        for b in batches:
            if not b.num_rows:
                continue
            score = np.full(b.num_rows, 0.5) if model is None else np.clip(model.score(_matrix(b.column(2))), 0, 1)
            held = [f == 0 for f in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(held, pa.bool_()), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
