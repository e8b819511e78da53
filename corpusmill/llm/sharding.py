"""Sharding by fixed virtual slots; DataFrame operations only.

Records hash into a fixed number of virtual slots. One grouped pass sums rows and bytes per slot;
from those (a bounded table, whatever the corpus) a versioned slot-to-shard map is planned and
stored, and a rebalance edits the stored map instead of rehashing records. A record's place in its
shard follows from its slot's offset and its rank in the slot, so that no task orders a whole shard.

Equal records (id and text) share a virtual slot and so a shard; equal texts of different ids are
dealt apart, as the law is by bytes and copies may hold a third of them.

A null text has no bytes (size 1, CRC 0). Null or repeated ids are allowed: equal records collapse
into a count before the shuffle and come out again, one row each; records of one slot are in order of
id (null first), size and CRC. Extra columns are ignored; an empty table gives no rows. Of a very long
text only its size and CRC go on.
"""

from __future__ import annotations

import heapq
import uuid
from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ensure_checkpoint_dir

SLOTS = 4096
BLOCK = 4096
MAP_SCHEMA = "version int, n_shards int, virtual_slot int, shard int, rows long, bytes long, first long"


def with_slots(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and virtual_slot of each record. Records of one id but different
    texts hash apart, so an id that is often repeated does not fill one slot."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    out = docs.select(docs[id_col].alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return out.withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slots)).cast("int"))


def slot_loads(records: DataFrame) -> dict[int, tuple[int, int]]:
    """virtual slot -> (rows, bytes): at most as many entries as there are slots."""
    rows = records.groupBy("virtual_slot").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b")).collect()
    return {r["virtual_slot"]: (r["n"], r["b"]) for r in rows}


def plan(loads: dict[int, tuple[int, int]], n_shards: int, slots: int = SLOTS) -> dict[int, int]:
    """slot -> shard: the heaviest slots first, each to the lightest shard."""
    heap = [(0, s) for s in range(n_shards)]
    owner = {}
    for slot in sorted(range(slots), key=lambda v: (-loads.get(v, (0, 0))[1], v)):
        load, shard = heapq.heappop(heap)
        owner[slot] = shard
        heapq.heappush(heap, (load + loads.get(slot, (0, 0))[1], shard))
    return owner


def rebalance(owner: dict[int, int], loads: dict[int, tuple[int, int]], n_shards: int, tolerance: float = 0.02) -> dict[int, int]:
    """An edited copy of the map: slots of shards that no longer exist move, and heavy shards hand
    over slots that fit until no shard is more than `tolerance` over the mean; all others stay. Where
    every slot is too heavy to move, the heaviest and the lightest shard exchange two, so that the
    loads come nearer than the lightest slot."""
    weight = lambda v: loads.get(v, (0, 0))[1]
    owner = dict(owner)
    load = [0] * n_shards
    members: list[list[int]] = [[] for _ in range(n_shards)]
    homeless = []
    for slot, shard in owner.items():
        if shard < n_shards:
            load[shard] += weight(slot)
            members[shard].append(slot)
        else:
            homeless.append(slot)

    def give(slot: int, shard: int) -> None:
        owner[slot] = shard
        load[shard] += weight(slot)
        members[shard].append(slot)

    def take(slot: int) -> None:
        load[owner[slot]] -= weight(slot)
        members[owner[slot]].remove(slot)

    for slot in sorted(homeless, key=lambda v: (-weight(v), v)):
        give(slot, min(range(n_shards), key=lambda s: (load[s], s)))
    mean = sum(load) / n_shards
    while True:
        high, low = max(range(n_shards), key=lambda s: (load[s], -s)), min(range(n_shards), key=lambda s: (load[s], s))
        if load[high] <= mean * (1 + tolerance) and load[low] >= mean * (1 - tolerance):
            return owner
        spread, want = load[high] - load[low], min(load[high] - mean, mean - load[low])
        fits = [(abs(weight(v) - want), v, None) for v in members[high] if 0 < weight(v) < spread]
        if not fits:  # pairs nearest to what is wanted, found among the lightest shard's slots in order of weight
            light = sorted((weight(v), v) for v in members[low])
            near = [(v, k) for v in members[high] for k in {bisect_left(light, (weight(v) - want, -1)) + d for d in (-1, 0)} if 0 <= k < len(light)]
            fits = [(abs(weight(v) - light[k][0] - want), v, light[k][1]) for v, k in near if 0 < weight(v) - light[k][0] < spread]
        if not fits:
            return owner
        _, slot, back = min(fits, key=lambda x: x[:2])
        take(slot)
        if back is not None:
            take(back)
            give(back, high)
        give(slot, low)


def map_table(spark: SparkSession, owner: dict[int, int], loads: dict[int, tuple[int, int]], n_shards: int, version: int) -> DataFrame:
    """The map as a table; `first` is the place of the slot's first record in its shard."""
    first = [0] * n_shards
    rows = []
    for slot in sorted(owner):
        shard, (n, b) = owner[slot], loads.get(slot, (0, 0))
        rows.append((version, n_shards, slot, shard, n, b, first[shard]))
        first[shard] += n
    return spark.createDataFrame(rows, MAP_SCHEMA)


def store_map(slot_map: DataFrame, path: str) -> None:
    """Each version is a folder of its own; older versions stay readable."""
    version = slot_map.first()["version"]
    slot_map.coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={version:06d}")


def load_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema(MAP_SCHEMA).parquet(f"{path}/version={version:06d}")


def edit_map(spark: SparkSession, path: str, version: int, loads: dict[int, tuple[int, int]], n_shards: int, tolerance: float = 0.02) -> int:
    """Reads a stored version, rebalances it for `loads` and stores the next version if slots moved;
    the version that holds now."""
    owner = {r["virtual_slot"]: r["shard"] for r in load_map(spark, path, version).collect()}  # a row per virtual slot
    edited = rebalance(owner, loads, n_shards, tolerance)
    if edited == owner:
        return version
    store_map(map_table(spark, edited, loads, n_shards, version + 1), path)
    return version + 1


def place(records: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Every record with its shard and its place there, gapless from 0.

    Equal records are counted before the shuffle; a window per virtual slot ranks the counts. The
    map has one row per virtual slot, a fixed number, and is broadcast.
    """
    ranked = Window.partitionBy("virtual_slot").orderBy(F.col("doc_id").asc_nulls_first(), "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    counted = records.groupBy("virtual_slot", "doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    before = counted.withColumn("before", F.coalesce(F.sum("n").over(ranked), F.lit(0)))
    # a record repeated often comes out in blocks, so that no row holds an array of all its numbers
    blocks = before.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {BLOCK}"))))
    first = F.col("block") * BLOCK
    one_each = blocks.withColumn("k", F.explode(F.sequence(first, F.least(first + (BLOCK - 1), F.col("n") - 1))))
    joined = one_each.join(F.broadcast(slot_map.select("virtual_slot", "shard", "first", "version")), "virtual_slot")
    return joined.select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("before") + F.col("k")).alias("slot"), "virtual_slot", F.col("version").alias("map_version"))


def assign(docs: DataFrame, n_shards: int = 16, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """Plans version 1 of the map for `docs` by the slots' rows, stores it under `path` (by default a
    new folder in the shared one), edits it by the slots' bytes and places every record by the
    version that holds."""
    spark = docs.sparkSession
    records = with_slots(docs, slots=slots)
    loads = slot_loads(records)
    if path is None:
        ensure_checkpoint_dir(spark)
        path = f"{spark.sparkContext.getCheckpointDir()}/slot-map-{uuid.uuid4().hex}"
    by_rows = {v: (n, n) for v, (n, _) in loads.items()}
    store_map(map_table(spark, plan(by_rows, n_shards, slots), loads, n_shards, 1), path)
    version = edit_map(spark, path, 1, loads, n_shards, 0.0)
    return place(records, load_map(spark, path, version))


def shard_digest(docs: DataFrame, n_shards: int = 16) -> DataFrame:
    """The contract's columns; the law is `bytes`, as the map weighs slots by their bytes."""
    out = assign(docs, n_shards)
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")
