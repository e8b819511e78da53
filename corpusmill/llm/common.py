"""What the operators of this subpackage share: tables, the shared folder, block reductions."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The cluster names the shared folder in spark.checkpoint.dir; only where it names none
    (tests on one machine) a temporary folder is set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="corpusmill-"))


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spill(df: DataFrame) -> DataFrame:
    """Writes `df` as a table in the shared folder and reads it back: the lineage is cut, columns are
    compressed and later reads are pruned. `discard` removes it; what a returned DataFrame still
    reads stays until the folder is cleared."""
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._spilled_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables that `spill` wrote and nothing reads any more."""
    for t in tables:
        sc = t.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(t._spilled_path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts go to Python in batches of `rows` at most, so that long ones do not add up."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def give_back() -> None:
    """Returns a worker's freed memory to the system."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def share(spark: SparkSession, value) -> Callable:
    """Broadcasts a value of bounded size; the result returns it. A worker process builds it once and
    keeps it from task to task, with whatever it has remembered, until it meets another such value;
    then it gives the old one's memory back."""
    text_batches(spark)
    data, key = spark.sparkContext.broadcast(cloudpickle.dumps(value)), uuid.uuid4().hex

    def get():
        import pyspark

        kept = pyspark.__dict__.setdefault("_shared_values", {})
        if key not in kept:
            if kept:
                kept.clear()
                give_back()
            kept[key] = cloudpickle.loads(data.value)
        return kept[key]

    return get


def reduce_blobs(df: DataFrame, merge, schema: str, fan_in: int = 16, final: int = 4) -> list:
    """Merges rows of partial sums in levels of `fan_in` partitions, then collects what is left.

    `df` has one bounded blob row for each key and partition; `merge` is a mapInPandas function that
    merges the rows it sees and yields one for each key. At most `final` partitions reach the
    driver, so its memory does not depend on the number of partitions of the input.
    """
    n = df.rdd.getNumPartitions()
    while n > final:
        n = max(final, -(-n // fan_in))
        df = df.repartition(n).mapInPandas(merge, schema)
    return df.collect()


def is_small(df: DataFrame, most_rows: int) -> bool:
    """Whether `df` has at most `most_rows` rows, found without counting further than that."""
    return df.limit(most_rows + 1).count() <= most_rows


def lookup_join(facts: DataFrame, dim: DataFrame, keys: list[str], most_rows: int, salts: int = 32) -> DataFrame:
    """Left join of a large, skewed side with one row per key, nulls in keys being equal.

    Up to `most_rows` rows of `dim` are broadcast (their count is checked). Beyond that each row of
    `dim` is repeated for `salts` salts, and a hot key of `facts` is dealt over as many tasks.
    """
    d = dim.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in dim.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    if is_small(dim, most_rows):
        out = facts.join(F.broadcast(d), on, "left")
    else:
        d = d.withColumn("__salt_d", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        facts = facts.withColumn("__salt", F.pmod(F.xxhash64(*facts.columns), F.lit(salts)).cast("int"))
        out = facts.join(d, [*on, F.col("__salt") == F.col("__salt_d")], "left").drop("__salt", "__salt_d")
    return out.drop(*[f"__{k}" for k in keys])


def numbered(df: DataFrame, order: list, name: str, start: int = 1) -> DataFrame:
    """`df` with consecutive numbers in `order`, which should leave few ties: ranges of it are sorted and
    written once with each row's place in its range, so that the counts taken next are of these rows. Only
    one count per range reaches the driver."""
    ranged = spill(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    first, total = [], start
    for p, n in sorted(ranged.groupBy(part.alias("p")).count().collect()):
        first.append((p, total - (p << 33)))
        total += n
    starts = F.broadcast(df.sparkSession.createDataFrame(first, "__p long, __first long"))
    return ranged.join(starts, part == F.col("__p")).withColumn(name, F.col("__at") + F.col("__first")).drop("__at", "__p", "__first")


def hot_join(facts: DataFrame, dim: DataFrame, key: str, count: str, most: int = 1000) -> DataFrame:
    """Inner join of `facts` with `dim`, which has one row per key and the number of its facts in `count`.

    Fewer than `most` keys can hold more than a `most`-th of all facts: those rows of `dim` are broadcast,
    so that a hot key stays where it lies. The others are joined by a shuffle. Both sides are read twice.
    """
    total = dim.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) * most > total
    few = F.broadcast(dim.where(hot).drop(count))
    rest = facts.join(F.broadcast(dim.where(hot).select(key)), key, "left_anti")
    return facts.join(few, key).unionByName(rest.join(dim.where(~hot).drop(count), key))


SPACES = np.isin(np.arange(256), np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8))
BASE = 0x9E3779B97F4A7C15
PIECE = 1 << 20


def finish(x: np.ndarray) -> np.ndarray:
    """Mixes 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pieces(data: bytes, size: int = PIECE) -> Iterator[bytes]:
    """`data` in pieces of about `size` bytes that end at spaces, so that no word is cut."""
    at = 0
    while at < len(data):
        end = at + size
        while end < len(data) and not SPACES[data[end]]:
            end += 1
        yield data[at:end]
        at = end


class Words:
    """64-bit hashes of the words of bytes, in order: polynomials mod 2 ** 64 from running sums."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        size = 1 << max(12, n.bit_length())
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            setattr(self, name, np.multiply.accumulate(p))

    def __call__(self, data: bytes) -> np.ndarray:
        if len(data) > PIECE:  # a long text in pieces that end at spaces, so that memory is bounded by words
            return np.concatenate([self._hash(p) for p in pieces(data)])
        return self._hash(data)

    def _hash(self, data: bytes) -> np.ndarray:
        n = len(data)
        if n > len(self.up):
            self._powers(n)
        b = np.frombuffer(data, np.uint8)
        gap = np.ones(n + 2, np.int8)
        gap[1:-1] = SPACES[b]
        edges = np.flatnonzero(gap[1:] != gap[:-1])
        start, end = edges[0::2], edges[1::2]
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=sums[1:])
        return finish((sums[end] - sums[start]) * self.down[start] + (end - start).astype(np.uint64))


class WordHashes(dict):
    """64-bit hashes of words (bytes or text), remembered; call `trim` between texts."""

    def __missing__(self, w):
        h = self[w] = xxhash.xxh3_64_intdigest(w if isinstance(w, bytes) else w.encode("utf-8", "surrogatepass"))
        return h

    def trim(self, most: int = 200_000) -> None:
        if len(self) > most:
            self.clear()
