"""Training-order materialisation of token sequences.

Texts are put in the order of id (null first) and text hash, encoded, and cut into sequences of a
fixed length; that order numbers them from 0 to N - 1, whatever the files and partitions they come
from. A keyed Feistel permutation with cycle-walking maps that number to a global slot: a bijection
that any task computes for itself, so there is no table of random numbers. Slots are dealt to range
partitions and written as shards of equal stride: sequence `slot` lies in shard slot // per_shard at
byte (slot mod per_shard) * stride, so a reader resumes at any slot by seeking in a file.

`write` puts a file of bytes for each shard, a table of shards with checksums and a manifest (key,
rounds, N, length, shard size) under a path; a task that runs again writes the same bytes.

Null and empty texts give one sequence of the end token alone, as every row ends with one. Repeated
rows give sequences each, in any order among themselves, as they are equal. An empty table gives no
shards. Extra columns are ignored. A very long text is encoded whole by one task.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import read_ranks
from .common import spill, text_batches


@dataclass(frozen=True)
class Settings:
    length: int = 512  # tokens of a sequence; two bytes each, little-endian
    per_shard: int = 1024
    key: int = 20240229
    rounds: int = 6
    shards_per_task: int = 8

    @property
    def stride(self) -> int:
        return 2 * self.length


class Feistel:
    """A bijection of 0 .. n - 1 chosen by a key: a balanced network over the next even number of
    bits, applied again while the value lies outside (less than four times on average)."""

    def __init__(self, n: int, key: int, rounds: int = 6):
        self.n = n
        self.half = max(1, -(-max(n - 1, 1).bit_length() // 2))
        self.mask = np.uint64((1 << self.half) - 1)
        self.keys = [np.uint64(int.from_bytes(hashlib.blake2b(f"{key}:{i}".encode(), digest_size=8).digest(), "little")) for i in range(rounds)]

    def _f(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (x ^ key) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return (x ^ (x >> np.uint64(29))) & self.mask

    def _once(self, x: np.ndarray, keys: list[np.uint64]) -> np.ndarray:
        left, right = x >> np.uint64(self.half), x & self.mask
        for k in keys:
            left, right = right, left ^ self._f(right, k)
        return right << np.uint64(self.half) | left  # halves swapped: the inverse is the same walk with keys reversed

    def _walk(self, x: np.ndarray, keys: list[np.uint64]) -> np.ndarray:
        x = self._once(np.asarray(x).astype(np.uint64), keys)
        while (out := x >= np.uint64(self.n)).any():
            x[out] = self._once(x[out], keys)
        return x.astype(np.int64)

    def slot(self, index: np.ndarray) -> np.ndarray:
        return self._walk(index, self.keys)

    def index(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, self.keys[::-1])


def encoded(docs: DataFrame, vocabulary: str, pattern: str, end_token: int, s: Settings, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, before, doc_id, tokens): uint16 ids with the end token, a row for each row. Parts are ranges
    of the corpus order; `before` counts the sequences before the row in its part."""
    ranks = read_ranks(vocabulary)
    if max(ranks.values()) >= 1 << 16 or end_token >= 1 << 16:
        raise ValueError("ids must fit two bytes")
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        coder = tiktoken.Encoding("own", pat_str=shared.value[1], mergeable_ranks=shared.value[0], special_tokens={})
        part, before = TaskContext.get().partitionId(), 0
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                b = whole.slice(i, 256)
                tokens = [np.array([*coder.encode_ordinary(t.as_py() or ""), end_token], "<u2").tobytes() for t in b.column(1)]
                ends = before + np.cumsum([-(-len(t) // s.stride) for t in tokens])
                starts = np.append(before, ends[:-1])
                before = int(ends[-1])
                cols = [pa.array(np.full(len(tokens), part, np.int32)), pa.array(starts), b.column(0), pa.array(tokens, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["part", "before", "doc_id", "tokens"])

    text_batches(docs.sparkSession)
    text = docs[text_col].cast("string")
    src = docs.select(docs[id_col].cast("long").alias("doc_id"), text.alias("text"), F.md5(F.coalesce(text, F.lit("")).cast("binary")).alias("hash"))
    # equal rows may be many: they are dealt over parts by where they come from
    src = src.withColumn("tie", F.monotonically_increasing_id())
    order = [F.col("doc_id").asc_nulls_first(), "hash", "tie"]
    ranged = src.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    return ranged.mapInArrow(run, "part int, before long, doc_id long, tokens binary")


SHARD = "shard long, first_slot long, n_sequences int, stride int, n_tokens long, payload_sha256 string, doc_ids array<long>, payload binary"


def materialise(docs: DataFrame, vocabulary: str, pattern: str, end_token: int, s: Settings = Settings()) -> DataFrame:
    """One row per shard with its bytes, in slot order; see `write` for files."""
    spark = docs.sparkSession
    rows = spill(encoded(docs, vocabulary, pattern, end_token, s))
    per_doc = F.ceil(F.octet_length("tokens") / F.lit(s.stride))
    counts = {r["part"]: r["n"] for r in rows.groupBy("part").agg(F.sum(per_doc).alias("n")).collect()}  # as many as parts
    first, total = {}, 0
    for p in sorted(counts):
        first[p] = total
        total += counts[p]
    if not total:
        return spark.createDataFrame([], SHARD)
    starts, walk = spark.sparkContext.broadcast(first), Feistel(total, s.key, s.rounds)
    shards = -(-total // s.per_shard)
    tasks = min(shards, max(spark.sparkContext.defaultParallelism, -(-shards // s.shards_per_task)))

    def cutter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                b = whole.slice(i, 256)
                ids, blobs, index = [], [], []
                for part, before, doc, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    cuts = range(0, len(t), s.stride)
                    blobs += [t[k : k + s.stride] for k in cuts]
                    ids += [doc] * len(cuts)
                    index += range(starts.value[part] + before, starts.value[part] + before + len(cuts))
                slots = walk.slot(np.array(index, np.int64))
                task = ((slots // s.per_shard) * tasks // shards).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(task), pa.array(ids, pa.int64()), pa.array(blobs, pa.binary())], names=["slot", "task", "doc_id", "tokens"])

    pad = np.array([end_token], "<u2").tobytes()

    def writer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, blobs, shard, real = [], [], None, 0

        def done():
            data = b"".join(blobs)
            return pa.RecordBatch.from_pylist([{"shard": shard, "first_slot": shard * s.per_shard, "n_sequences": len(blobs), "stride": s.stride, "n_tokens": real, "payload_sha256": hashlib.sha256(data).hexdigest(), "doc_ids": ids, "payload": data}], schema=arrow)

        arrow = pa.schema([("shard", pa.int64()), ("first_slot", pa.int64()), ("n_sequences", pa.int32()), ("stride", pa.int32()), ("n_tokens", pa.int64()), ("payload_sha256", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("payload", pa.binary())])
        for b in batches:
            for slot, doc, t in zip(b.column(0), b.column(1), b.column(2), strict=True):
                if (k := slot.as_py() // s.per_shard) != shard:
                    if blobs:
                        yield done()
                    ids, blobs, shard, real = [], [], k, 0
                t = t.as_py()
                real += len(t) // 2
                ids.append(doc.as_py())
                blobs.append(t + pad * ((s.stride - len(t)) // 2))
        if blobs:
            yield done()

    placed = rows.mapInArrow(cutter, "slot long, task int, doc_id long, tokens binary").repartitionById(tasks, "task")
    return placed.sortWithinPartitions("slot").select("slot", "doc_id", "tokens").mapInArrow(writer, SHARD)


def _files(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def shard_name(shard: int) -> str:
    return f"{shard:010d}.bin"


def write(shards: DataFrame, path: str, s: Settings = Settings()) -> dict:
    """Writes each shard's bytes as a file under `path` (which all executors reach), then the table of
    shards and the manifest, which it returns. A file takes its name when it is whole."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _files(path)
        files.create_dir(f"{root}/data")
        for b in batches:
            for shard, payload in zip(b.column(0).to_pylist(), b.column(5), strict=True):
                name = f"{root}/data/{shard_name(shard)}"
                new = f"{name}.{TaskContext.get().taskAttemptId()}"
                with files.open_output_stream(new) as out:
                    out.write(payload.as_buffer())
                files.move(new, name)
            yield pa.RecordBatch.from_arrays([*b.columns[:5]], names=names)

    names = ["shard", "first_slot", "n_sequences", "n_tokens", "payload_sha256"]
    table = shards.select(*names, "payload").mapInArrow(put, "shard long, first_slot long, n_sequences int, n_tokens long, payload_sha256 string")
    table.write.mode("errorifexists").parquet(f"{path}/shards")
    total = shards.sparkSession.read.parquet(f"{path}/shards").agg(F.sum("n_sequences")).first()[0] or 0
    manifest = {"n": total, "key": s.key, "rounds": s.rounds, "length": s.length, "stride": s.stride, "per_shard": s.per_shard, "data": "data"}
    files, root = _files(path)
    files.create_dir(root)
    with files.open_output_stream(f"{root}/manifest.json") as out:
        out.write(json.dumps(manifest).encode())
    return manifest


class Reader:
    """Sequences of a written order, by seeking."""

    def __init__(self, path: str):
        self.files, self.root = _files(path)
        with self.files.open_input_file(f"{self.root}/manifest.json") as f:
            self.manifest = json.loads(f.read())
        self.walk = Feistel(max(1, self.manifest["n"]), self.manifest["key"], self.manifest["rounds"])

    def index(self, slot: int) -> int:
        """The number in corpus order of the sequence at `slot`."""
        return int(self.walk.index(np.array([slot]))[0])

    def read_from(self, slot: int) -> Iterator[tuple[int, np.ndarray]]:
        """(slot, token ids) from `slot` on, in training order."""
        m = self.manifest
        while slot < m["n"]:
            shard, at = divmod(slot, m["per_shard"])
            with self.files.open_input_file(f"{self.root}/{m['data']}/{shard_name(shard)}") as f:
                f.seek(at * m["stride"])
                while slot < m["n"] and slot // m["per_shard"] == shard:
                    yield slot, np.frombuffer(f.read(m["stride"]), "<u2")
                    slot += 1
