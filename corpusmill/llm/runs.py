"""Periodic runs of words, by probing a harmonic grid of places.

A run is a maximal stretch of words with least period q and at least max(6, 4 q) words. In a text of n
words only periods up to n / 4 can have one, and a run of period p holds the words at jp and (j + 1)p for
at least three j in a row. So for each p only the n / p places on its grid are probed, n ln n in all. What
passes three probes in a row is extended to both sides by comparing chunks of the word array with itself,
shifted by p. Grid points inside a run already found whose period divides p are skipped: what has period p
there is that same run. Periods rise, so a stretch that is not inside such a run has no lesser period.

Words are compared by exact numbers, not by hashes. Whole texts are searched: memory grows with the words
of one text, and blocks of the grid are bounded. Null, empty and blank texts have no word and no run; a
null id takes part and alters no text. Repeated rows each get their row; extra columns are ignored. An
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import PIECE, pieces, text_batches

LEAST, TIMES = 6, 4  # words of a run, and periods
BLOCK = 1 << 18  # grid points probed at once


def number_words(data: bytes) -> tuple[np.ndarray, list[bytes]]:
    """Each word's number, equal words having the same, and the words by number."""
    number: dict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    parts = []
    for piece in pieces(data, PIECE):
        words = piece.split()  # bytes split at the six ASCII blanks alone
        parts.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
    return np.concatenate(parts) if parts else np.zeros(0, np.int32), list(number)


def same(x: np.ndarray, y: np.ndarray) -> int:
    """How many first elements of two arrays of one length agree; in chunks that double."""
    at, step = 0, 32
    while at < len(x):
        differs = x[at : at + step] != y[at : at + step]
        if differs.any():
            return at + int(differs.argmax())
        at += step
        step = min(2 * step, 1 << 16)
    return len(x)


def survivors(w: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(p, places): the grid points jp at which three probes in a row find equal words, by rising p."""
    n = len(w)
    periods = np.arange(1, n // TIMES + 1)
    probes = (n - 1) // periods
    upto = np.cumsum(probes)
    done = 0
    while done < len(periods):
        end = max(done + 1, int(np.searchsorted(upto, (upto[done - 1] if done else 0) + BLOCK, "right")))
        count = probes[done:end]
        p = np.repeat(periods[done:end], count)
        left = (np.arange(len(p)) - np.repeat(np.cumsum(count) - count, count)) * p
        equal = w[left] == w[left + p]
        at = np.flatnonzero(equal[:-2] & equal[1:-1] & equal[2:] & (p[:-2] == p[2:]))
        if at.size:
            p, left = p[at], left[at]
            borders = [0, *(np.flatnonzero(np.diff(p)) + 1), len(p)]
            for a, b in zip(borders, borders[1:], strict=False):
                yield int(p[a]), left[a:b]
        done = end


def find_runs(w: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start, then period."""
    found: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # starts and ends of the runs by period; runs of one period overlap by less than it
    for p, points in survivors(w):
        for q in [q for q in found if p % q == 0]:
            starts, ends = found[q]
            run = np.searchsorted(starts, points, "right") - 1
            points = points[(run < 0) | (points + p >= ends[run])]
        own, at = [], 0
        while at < len(points):
            x = int(points[at])
            start = x - same(w[:x][::-1], w[p : x + p][::-1])
            end = x + p + same(w[x : len(w) - p], w[x + p :])
            if end - start >= max(LEAST, TIMES * p):
                own.append((start, end))
            at = int(np.searchsorted(points, end - p))
        if own:
            found[p] = tuple(np.array(own).T)
    rows = [(s, e - s, q) for q, (starts, ends) in found.items() for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
    return np.array(sorted(rows, key=lambda r: (r[0], r[2])), np.int64).reshape(-1, 3)


def planted(w: np.ndarray, doc_id: int | None) -> np.ndarray:
    """The words with the period that the query's contract plants by the id's CRC."""
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return w
    g = h // 10
    a = g % n
    return np.concatenate([w[:a], w[a + np.arange(n - a) % (1 + (n - a) // (3 + g % 8))]])


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """The numbers of the words that no run holds after its first period."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, runs[:, 0] + runs[:, 2], 1)
    np.add.at(step, runs[:, 0] + runs[:, 1], -1)
    return np.flatnonzero(np.cumsum(step)[:n] == 0)


def joined(w: np.ndarray, words: list[bytes], step: int = 1 << 16) -> Iterator[bytes]:
    """The words in order with single spaces between, in pieces."""
    for i in range(0, len(w), step):
        yield (b" " if i else b"") + b" ".join(map(words.__getitem__, w[i : i + step].tolist()))


DIGEST = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
RUNS = "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def _rows(docs: DataFrame, id_col: str, text_col: str, one, schema: str, arrow: pa.Schema) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                b = whole.slice(i, 256)
                rows = [one(d.as_py(), t.as_py() or b"") for d, t in zip(b.column(0), b.column(1), strict=True)]
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    text_batches(docs.sparkSession)
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").cast("binary").alias("text")).mapInArrow(run, schema)


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The runs of each text and the text with each run collapsed to its first period."""

    def one(doc_id, data):
        w, words = number_words(data)
        runs = find_runs(w)
        text = b"".join(joined(w[kept_words(len(w), runs)], words)).decode("utf-8", "replace")
        return {"doc_id": doc_id, "runs": [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs.tolist()], "collapsed": text}

    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    return _rows(docs, id_col, text_col, one, RUNS, pa.schema([("doc_id", pa.int64()), ("runs", pa.list_(run)), ("collapsed", pa.string())]))


def runs_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The contract's columns: of each text with the planted periods the number of runs, the longest and two hashes."""

    def one(doc_id, data):
        w, words = number_words(data)
        w = planted(w, doc_id)
        runs = find_runs(w)
        out = {"doc_id": doc_id, "n_runs": len(runs), "runs_sha256": hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs.tolist()).encode()).hexdigest()}
        if len(runs):
            start, length, period = runs[np.argmax(runs[:, 1])].tolist()  # the first of the longest
            out |= {"start": start, "length": length, "period": period, "exponent_milli": 1000 * length // period}
        digest = hashlib.sha256()
        for part in joined(w[kept_words(len(w), runs)], words):
            digest.update(part)
        return out | {"collapsed_sha256": digest.hexdigest()}

    longs = [(k, pa.int64()) for k in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli")]
    return _rows(docs, id_col, text_col, one, DIGEST, pa.schema([*longs, ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())]))
