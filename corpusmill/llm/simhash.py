"""SimHash fingerprints of word shingles, their links within a Hamming radius, and components.

1. A text's fingerprint has the bits that over half of its shingles' hashes have (repeats count).
2. Equal fingerprints collapse to one print with its least id and its number of rows.
3. The bits are cut into radius + 1 parts. Two prints within the radius agree on a part at least, so each
   print goes into a bucket for each part. A bucket beyond `bucket` prints is split by the same rule over
   the bits that its prints may still differ in, and so on; once at most log2(bucket) bits are left there
   cannot be more prints. Every bucket is bounded by construction, whatever the data.
4. In a bucket the prints' bit planes lie vertically, 64 prints to a word. A print is compared with whole
   words: carry-save adders sum three planes' differences at a time into bitwise counters that run over
   when a distance exceeds the radius; words whose lanes have all run over are abandoned.
5. A bucket yields a spanning forest of its links, never all pairs; components join the forests.

Null, empty and blank texts have fingerprint 0 and link like any other. A null id takes part and counts as
no id when the least is taken. Repeated rows each get their row. Extra columns are ignored. Long texts are
hashed whole, their bits summed in blocks. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_join, lookup_join, spill, text_batches
from .components import components

BITS = 64
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


@dataclass(frozen=True)
class Settings:
    words: int = 3
    radius: int = 2
    seed: int = 42
    bucket: int = 4096  # prints that one task compares with each other
    chunk: int = 1 << 17  # (print, word of lanes) pairs compared at once
    group: int = 6  # planes between two looks at what can be abandoned; a multiple of three


def fingerprint(data: bytes, s: Settings = Settings()) -> int:
    """The unsigned fingerprint of a text's bytes."""
    words = data.lower().split()  # both know ASCII alone, for bytes
    if not words:
        return 0
    text = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts, ends = [0, *ends[:-1]], ends[s.words - 1 :] or ends[-1:]
    of, seed, n, total = xxhash.xxh64_intdigest, s.seed, len(ends), np.zeros(BITS, np.int64)
    for i in range(0, n, 1 << 14):
        own = [of(text[a : b - 1], seed) for a, b in zip(starts[i : i + (1 << 14)], ends[i : i + (1 << 14)], strict=False)]
        total += np.unpackbits(np.array(own, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, print) for each row; `print` has the fingerprint's bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = np.array([fingerprint(t.as_py() or b"", s) for t in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "print"])

    text_batches(docs.sparkSession)
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").cast("binary").alias("text")).mapInArrow(run, "doc_id long, print long")


# ---- bit-sliced comparison -------------------------------------------------------------------------


class Counters:
    """Bitwise counters of the lanes of many words, started so that they run over beyond the radius."""

    def __init__(self, valid: np.ndarray, radius: int):
        width = radius.bit_length() if radius else 0
        first = (1 << width) - 1 - radius
        self.over = ~valid  # lanes that are not to be compared have run over from the start
        self.levels = [np.full(len(valid), FULL if first >> k & 1 else 0, np.uint64) for k in range(width)]

    def add(self, x: np.ndarray, level: int = 0) -> None:
        """Adds 2 ** level where `x` has a bit."""
        for k in range(level, len(self.levels)):
            x, self.levels[k] = self.levels[k] & x, self.levels[k] ^ x
        self.over |= x

    def add3(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> None:
        """A carry-save adder: three planes become a sum and a carry."""
        ab = a ^ b
        self.add((a & b) | (ab & c), 1)
        self.add(ab ^ c)

    def keep(self, alive: np.ndarray) -> None:
        self.over, self.levels = self.over[alive], [x[alive] for x in self.levels]


def near_pairs(prints: np.ndarray, sizes: np.ndarray, bits: list[int], s: Settings) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (a, b), a < b, of prints of one bucket that differ in at most `radius` of `bits`. Buckets of
    `sizes` prints follow each other; their lanes too, so that small ones share words."""
    n = len(prints)
    padded = np.zeros(-(-n // 64) * 64, np.uint64)
    padded[:n] = prints
    one = np.uint64(1)
    planes = [np.packbits(((padded >> np.uint64(k)) & one).astype(np.uint8), bitorder="little").view("<u8") for k in bits]
    last = np.repeat(np.cumsum(sizes), sizes)  # the end of each print's bucket
    at = np.arange(n)
    words = np.where(at + 1 < last, (last - 1) // 64 - (at + 1) // 64 + 1, 0)
    upto = np.cumsum(words)
    done = 0
    while done < n:
        end = max(done + 1, int(np.searchsorted(upto, (upto[done - 1] if done else 0) + s.chunk, "right")))
        count = words[done:end]
        q = np.repeat(at[done:end], count)
        done = end
        if not q.size:
            continue
        word = (q + 1) // 64 + np.arange(len(q)) - np.repeat(np.cumsum(count) - count, count)
        low, high = np.maximum(q + 1 - 64 * word, 0), np.minimum(last[q] - 64 * word, 64)  # lanes low .. high - 1
        valid = (FULL << low.astype(np.uint64)) & (FULL >> (64 - high).astype(np.uint64))
        sums = Counters(valid, s.radius)
        for g in range(0, len(bits), s.group):
            own = prints[q]
            differ = [planes[k][word] ^ (np.uint64(0) - ((own >> np.uint64(bits[k])) & one)) for k in range(g, min(g + s.group, len(bits)))]
            while len(differ) >= 3:
                sums.add3(differ.pop(), differ.pop(), differ.pop())
            for x in differ:
                sums.add(x)
            alive = sums.over != FULL
            if not alive.all():
                q, word = q[alive], word[alive]
                sums.keep(alive)
            if not q.size:
                break
        if q.size:
            row, lane = np.nonzero(np.unpackbits((~sums.over).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            yield q[row], 64 * word[row] + lane


def joined_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Makes the labels of linked places equal, in place: the least one's."""
    while a.size:
        x, y = label[a], label[b]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label[:] = label[label]
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]


def _forests(buckets: DataFrame, s: Settings) -> DataFrame:
    """(a, b): a spanning forest of the links of each bucket (mask, prints)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks = batch.column(0).to_numpy().view(np.uint64)
            for mask in np.unique(masks):
                own = batch.column(1).filter(pa.array(masks == mask))
                prints, sizes = own.flatten().to_numpy().view(np.uint64), np.diff(own.offsets.to_numpy())
                label = np.arange(len(prints))
                for a, b in near_pairs(prints, sizes, bits_of(~int(mask)), s):
                    joined_labels(label, a, b)
                linked = np.flatnonzero(label != np.arange(len(label)))
                yield pa.RecordBatch.from_arrays([pa.array(prints[label[linked]].view(np.int64)), pa.array(prints[linked].view(np.int64))], names=["a", "b"])

    return buckets.mapInArrow(run, "a long, b long")


# ---- buckets ---------------------------------------------------------------------------------------


def bits_of(mask: int) -> list[int]:
    return [k for k in range(BITS) if mask >> k & 1]


def finer(mask: int, radius: int) -> list[int]:
    """`mask` with each of radius + 1 parts of the other bits: two numbers that agree on `mask` and differ
    in at most `radius` bits agree on one of these."""
    rest, parts = bits_of(~mask), radius + 1
    cuts = [len(rest) * i // parts for i in range(parts + 1)]
    return [mask | sum(1 << k for k in rest[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(prints: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(a, b): links between the distinct values of `prints.print` that join all that lie within the radius."""
    spark = prints.sparkSession
    if s.bucket < 1 << s.radius + 1:
        raise ValueError("bucket must hold the prints of more bits than radius")
    masks = finer(0, s.radius)
    rows, out = prints.select("print", F.explode(F.array(*[F.lit(signed(m)) for m in masks])).alias("mask")), None
    while True:
        keyed = rows.withColumn("value", F.col("print").bitwiseAND(F.col("mask")))
        crowded = None
        if any(1 << len(bits_of(~m)) > s.bucket for m in masks):
            crowded = spill(keyed.groupBy("mask", "value").count().where(F.col("count") > s.bucket).select("mask", "value", F.lit(True).alias("crowded")))
            crowded = None if crowded.isEmpty() else crowded
        if crowded is not None:
            keyed = spill(lookup_join(keyed, crowded, ["mask", "value"], 100_000))
        few = keyed if crowded is None else keyed.where("crowded is null")
        buckets = few.groupBy("mask", "value").agg(F.collect_list("print").alias("prints")).where(F.size("prints") > 1)
        found = _forests(buckets.select("mask", "prints"), s)
        out = found if out is None else out.unionByName(found)
        if crowded is None:
            return out
        children = {m: finer(m, s.radius) for m in masks}
        masks = sorted({c for own in children.values() for c in own})
        of = F.create_map(*[x for m, own in children.items() for x in (F.lit(signed(m)), F.array(*[F.lit(signed(c)) for c in own]))])
        rows = keyed.where("crowded").select("print", F.explode(of[F.col("mask")]).alias("mask")).distinct()  # two masks may share a finer one


def classes(docs: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, print and component_id (the least id reachable by links) for each row."""
    rows = spill(fingerprints(docs, s, id_col, text_col))
    prints = spill(rows.groupBy("print").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n")))
    label = components(links(prints, s)).select(F.col("node").alias("print"), "label")
    known = spill(prints.join(label, "print", "left"))
    linked = known.where("label is not null")
    least = linked.groupBy("label").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("members"))
    many = hot_join(linked, spill(least), "label", "members").select("print", "n", "component_id")
    alone = known.where("label is null").select("print", "n", F.col("low").alias("component_id"))
    return hot_join(rows, spill(many.unionByName(alone)), "print", "n").select("doc_id", "print", "component_id")


def simhash_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns; the fingerprint as 16 hexadecimal digits."""
    out = classes(docs)
    return out.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")
