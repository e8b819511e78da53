"""Exact Jaccard self-join on word n-grams by grouped prefixes, and its connected components.

1. Each text becomes the set of hashes of its n-grams; texts of equal sets collapse to one set.
2. Grams are put in one order: grams that are common by a bounded table of counts come last, equal
   ones by hash. Any order gives the same links; the table only makes prefixes rare.
3. Sets with the same prefix and size form one group, led by its least set. Groups that share a
   prefix gram are paired under the size and position filters; a gram with many groups pairs all of
   them with one pivot. Only the heads of paired groups, and each head with its group's members, are
   compared, so the work grows with groups and members and never with their product.
4. What that leaves in different components goes on as units: a head with the members that it links
   to (its ball), and each other member alone. Units that share a gram, or a group, are compared. Where
   many do, as in a passage that other texts share, their whole sets are counted against each other and
   get prefixes by exact counts, in which the passage comes last. Set difference is a metric, so two
   balls whose heads are too far apart hold no link; only balls that are near without a link are opened,
   first against the other's head.
5. Each comparison meets parity bitmaps first (the bits in which two sets' bitmaps differ are at most
   the elements in which the sets differ): one of 256 bits, then one in proportion to the set. Only
   what passes both has its sets fetched and compared.

No step caps or samples: every pair of sets that reaches the similarity is linked or already
connected. Sets are compared as sets of 64-bit hashes of words and n-grams: two that collide count as
equal. Null, empty and blank texts have no set and link with nothing; a null id takes part, and
counts as no id when the least is taken. Repeated rows each get their row. Extra columns are ignored.
A very long text is hashed in pieces; its set is held by one task. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from hashlib import blake2b, md5
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, cut, discard, finish, hot_join, is_small, lookup_join, share, spill, text_batches
from .components import components, joined

MIX = [np.uint64(int.from_bytes(blake2b(bytes([i]), digest_size=8).digest(), "little") | 1) for i in range(64)]


@dataclass(frozen=True)
class Settings:
    words: int = 3
    num: int = 90  # similarity num / den or more
    den: int = 100
    pivot_over: int = 32  # lists with more groups are first paired with a pivot
    crowd: int = 512  # units of a key that are compared with each other; beyond, their sets get other prefixes
    table_rows: int = 200_000  # of the broadcast table of common grams
    block: int = 2_000_000  # grams counted at a time


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word n-grams."""

    def __init__(self, n: int):
        self.n, self.words = n, Words()

    def __call__(self, text: str | None) -> np.ndarray:
        # bytes.lower changes A-Z alone; words are what the spaces 20 and 09-0D leave
        h = self.words((text or "").encode("utf-8", "surrogatepass").lower())
        if len(h) == 0:
            return h
        if len(h) < self.n:
            return finish(np.array([sum(int(x) * int(MIX[i + 8]) for i, x in enumerate(h)) + len(h) & 0xFFFFFFFFFFFFFFFF], np.uint64))
        x = h[: len(h) - self.n + 1] * MIX[0]
        for k in range(1, self.n):
            x = x + h[k : len(h) - self.n + 1 + k] * MIX[k]
        x = finish(x)
        x.sort()
        return x[np.append(True, x[1:] != x[:-1])]


def fingerprint(grams: np.ndarray) -> bytes:
    return blake2b(grams.tobytes(), digest_size=16).digest()


def bitmap(grams: np.ndarray) -> np.ndarray:
    """256 parities."""
    odd = np.bincount((grams >> np.uint64(8)).astype(np.int64) & 255, minlength=256) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def wide_bitmap(grams: np.ndarray) -> bytes:
    """Two to four parities for each element; halves of a longer one fold onto a shorter one."""
    bits = 1 << max(8, (2 * len(grams) - 1).bit_length())
    odd = np.bincount((grams >> np.uint64(20)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def wide_difference(x: np.ndarray, y: np.ndarray) -> int:
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _digest(docs: DataFrame, id_col: str, text_col: str, s: Settings) -> DataFrame:
    """Rows of two kinds: a row of the input (id, n, fp, text_md5), and a gram that recurs within a block."""
    names = ["kind", "id", "n", "fp", "text_md5", "gram", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, pending, size, known = Shingler(s.words), [], 0, set()

        def counted():
            grams, times = np.unique(np.concatenate(pending), return_counts=True)
            grams, times = grams[times > 2], times[times > 2]
            k, none = len(grams), pa.nulls
            return pa.RecordBatch.from_arrays([pa.array(np.ones(k, np.int32)), none(k, pa.int64()), none(k, pa.int64()), none(k, pa.binary()), none(k, pa.binary()), pa.array(grams.view(np.int64)), pa.array(times.astype(np.int64))], names=names)

        for b in batches:
            n, fps, texts = [], [], []
            for t in b.column(1):
                t = t.as_py()
                texts.append(md5((t or "").encode("utf-8", "surrogatepass"), usedforsecurity=False).digest())
                grams = shingle(t)
                n.append(len(grams))
                fps.append(fingerprint(grams) if len(grams) else None)
                if len(grams) and fps[-1] not in known:
                    known.add(fps[-1])
                    pending.append(grams)
                    size += len(grams)
            k = len(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(k, np.int32)), b.column(0), pa.array(n, pa.int64()), pa.array(fps, pa.binary()), pa.array(texts, pa.binary()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64())], names=names)
            if size >= s.block:
                yield counted()
                pending, size, known = [], 0, set()
        if pending:
            yield counted()

    text_batches(docs.sparkSession)
    src = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    return src.mapInArrow(run, "kind int, id long, n long, fp binary, text_md5 binary, gram long, times long")


def _common(recurring: DataFrame, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """The most common grams, `table_rows` at most, with their counts."""
    sums = spill(recurring.groupBy("gram").agg(F.sum("times").alias("times")))
    level = F.floor(F.log2("times")).cast("int")
    sizes = {r["level"]: r["k"] for r in sums.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("k")).collect()}
    least, total = 64, 0
    for lv in sorted(sizes, reverse=True):
        if total + sizes[lv] > s.table_rows:
            break
        least, total = lv, total + sizes[lv]
    rows = sums.where(level >= least).toPandas()
    grams = rows["gram"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(grams)
    discard(sums)
    return grams[order], rows["times"].to_numpy(np.int64)[order]


def _prefixes(docs: DataFrame, text_col: str, table: tuple[np.ndarray, np.ndarray], s: Settings) -> DataFrame:
    """A row for each set: its fp, size, group, bitmaps, and its prefix with as many grams that follow it;
    a set may come once for each partition."""
    shared = share(docs.sparkSession, table)
    names = ["fp", "n", "grp", "ordered", "b0", "b1", "b2", "b3", "wide"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, (common, times), known = Shingler(s.words), shared(), set()
        for b in batches:
            heads, bits, wides, prefixes = [], [], [], []
            for t in b.column(0):
                grams = shingle(t.as_py())
                n = len(grams)
                if not n or (fp := fingerprint(grams)) in known:
                    continue
                if len(known) > 500_000:
                    known.clear()
                known.add(fp)
                weight = np.zeros(n, np.int64)
                if len(common):
                    at = np.minimum(np.searchsorted(common, grams), len(common) - 1)
                    weight = np.where(common[at] == grams, times[at], 0)
                keep = n - -(-n * s.num // s.den) + 1
                ordered = grams[np.argsort(weight, kind="stable")[: 2 * keep]]  # grams are in order of hash
                prefix = ordered[:keep]
                heads.append((fp, n, int.from_bytes(blake2b(prefix.tobytes() + n.to_bytes(8, "little"), digest_size=8).digest(), "little", signed=True)))
                bits.append(bitmap(grams))
                wides.append(n.to_bytes(8, "little") + wide_bitmap(grams))
                prefixes.append(ordered)
            if heads:
                ends = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(prefixes).view(np.int64)))
                bits = np.array(bits)
                yield pa.RecordBatch.from_arrays([pa.array([h[0] for h in heads], pa.binary()), pa.array([h[1] for h in heads], pa.int64()), pa.array([h[2] for h in heads], pa.int64()), lists, *[pa.array(np.ascontiguousarray(bits[:, j])) for j in range(4)], pa.array(wides, pa.binary())], names=names)

    return docs.select(docs[text_col].cast("string").alias("text")).mapInArrow(run, "fp binary, n long, grp long, ordered array<long>, b0 long, b1 long, b2 long, b3 long, wide binary")


BITS = ["b0", "b1", "b2", "b3"]


def _keep(s: Settings) -> Column:
    """The length of a set's prefix."""
    return F.expr(f"n - (n * {s.num} + {s.den - 1}) div {s.den} + 1").cast("int")


def _side(df: DataFrame, side: str, columns: list[str]) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{side}_{c}") for c in columns])


def _may_link(s: Settings) -> Column:
    """For sides x and y that share a gram at x_pos and y_pos: the size filter, the smaller side's own
    prefix, and the position filter. Sides of equal size come in either order."""
    reach = F.least(F.col("x_n") - F.col("x_pos"), F.col("y_n") - F.col("y_pos"))
    size = s.den * F.least("x_n", "y_n") >= s.num * F.greatest("x_n", "y_n")
    return size & ((s.num + s.den) * reach >= s.num * (F.col("x_n") + F.col("y_n")))


def _bits_fit(s: Settings, times: Column | int = 1) -> Column:
    """Whether sides x and y may differ in few enough elements by their 256 parities."""
    differ = sum(F.bit_count(F.col(f"x_{b}").bitwiseXOR(F.col(f"y_{b}"))) for b in BITS)
    return (s.num + s.den) * differ <= (s.den - s.num) * times * (F.col("x_n") + F.col("y_n"))


def _candidates(sides: DataFrame, s: Settings, times: Column | int = 1) -> DataFrame:
    """Distinct (a, b, times), a < b, of pairs of sides that pass the bitmap filter."""
    times = F.lit(times) if isinstance(times, int) else times
    kept = sides.where((F.col("x_fp") != F.col("y_fp")) & _bits_fit(s, times))
    pairs = kept.select(F.least("x_fp", "y_fp").alias("a"), F.greatest("x_fp", "y_fp").alias("b"), times.alias("times"))
    return pairs.groupBy("a", "b").agg(F.max("times").alias("times"))


WANTED_BITS = 1 << 27  # of the bitmap that a pass over the texts holds


def _sets(docs: DataFrame, text_col: str, wanted: DataFrame, s: Settings) -> DataFrame:
    """(fp, grams) of the wanted sets. A bitmap keeps most others out; more sets than it can tell apart
    are fetched in several passes, each for the sets of one remainder."""
    n = wanted.count()
    passes = max(1, -(-16 * n // WANTED_BITS))
    bits = 1 << max(16, min(WANTED_BITS.bit_length() - 1, (16 * max(n, 1) // passes).bit_length()))
    out = None
    for k in range(passes):
        part = _one_pass(docs, text_col, wanted, s, bits, passes, k)
        out = part if out is None else out.unionByName(part)
    found = out.join(wanted.select("fp"), "fp", "left_semi")
    return found.groupBy("fp").agg(F.first("grams").alias("grams"))


def _bit_table(keys: DataFrame, places, bits: int) -> np.ndarray:
    """A bitmap of `bits` bits with the bits that `places` gives for each value of the one column."""

    def build(parts):
        have = np.zeros(bits // 8, np.uint8)
        for b in parts:
            for v in b.column(0).to_pylist():
                for k in places(v):
                    have[k >> 3] |= 1 << (k & 7)
        yield pa.RecordBatch.from_arrays([pa.array([have.tobytes()], pa.binary())], names=["have"])

    have = np.zeros(bits // 8, np.uint8)
    for r in keys.repartition(4).mapInArrow(build, "have binary").toLocalIterator():
        have |= np.frombuffer(r["have"], np.uint8)
    return have


def _one_pass(docs: DataFrame, text_col: str, wanted: DataFrame, s: Settings, bits: int, passes: int, turn: int) -> DataFrame:
    place = lambda fp: int.from_bytes(fp[:8], "little") & (bits - 1)
    mine = lambda fp: passes == 1 or int.from_bytes(fp[8:], "little") % passes == turn
    have = _bit_table(wanted.select("fp"), lambda fp: [place(fp)] if mine(fp) else [], bits)
    shared = docs.sparkSession.sparkContext.broadcast(have.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, known, table = Shingler(s.words), set(), np.frombuffer(shared.value, np.uint8)

        def batch(fps, sets):
            return pa.RecordBatch.from_arrays([pa.array(fps, pa.binary()), pa.array(sets, pa.binary())], names=["fp", "grams"])

        for b in batches:
            fps, sets, size = [], [], 0
            for t in b.column(0):
                grams = shingle(t.as_py())
                if not len(grams):
                    continue
                fp = fingerprint(grams)
                k = place(fp)
                if table[k >> 3] >> (k & 7) & 1 and mine(fp) and fp not in known:
                    if len(known) > 500_000:
                        known.clear()
                    known.add(fp)
                    fps.append(fp)
                    sets.append(grams.tobytes())
                    size += len(sets[-1])
                if size > 8 << 20:
                    yield batch(fps, sets)
                    fps, sets, size = [], [], 0
            if fps:
                yield batch(fps, sets)

    return docs.select(docs[text_col].cast("string").alias("text")).mapInArrow(run, "fp binary, grams binary")


def _compare(pairs: DataFrame, values: DataFrame, differ, s: Settings) -> DataFrame:
    """(a, b, times, linked) of the pairs whose sets differ in few enough elements, `times` times as
    many as a link may. `differ` gives two values' sizes and, at least, the elements that differ."""
    left = values.select(F.col("fp").alias("a"), F.col("v").alias("va"))
    right = values.select(F.col("fp").alias("b"), F.col("v").alias("vb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near, linked = [], []
            for x, y, times in zip(b.column(3), b.column(4), b.column(2).to_pylist(), strict=True):
                n, d = differ(x.as_buffer(), y.as_buffer())
                near.append((s.num + s.den) * d <= (s.den - s.num) * times * n)
                linked.append((s.num + s.den) * d <= (s.den - s.num) * n)
            near = pa.array(near, pa.bool_())
            cols = [b.column(0), b.column(1), b.column(2), pa.array(linked, pa.bool_())]
            yield pa.RecordBatch.from_arrays([c.filter(near) for c in cols], names=["a", "b", "times", "linked"])

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "times", "va", "vb")
    return joined.mapInArrow(run, "a binary, b binary, times int, linked boolean")


def _verify(pairs: DataFrame, members: DataFrame, docs: DataFrame, text_col: str, s: Settings) -> DataFrame:
    """(a, b, times, linked) of the pairs (a, b, times) that are near enough, as a spilled table."""

    def wide(x, y) -> tuple[int, int]:  # each bitmap comes with its set's size before it
        n = int.from_bytes(x[:8].to_pybytes(), "little") + int.from_bytes(y[:8].to_pybytes(), "little")
        return n, wide_difference(np.frombuffer(x, np.uint8, offset=8), np.frombuffer(y, np.uint8, offset=8))

    def exact(x, y) -> tuple[int, int]:
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        both = len(np.intersect1d(x, y, assume_unique=True))
        return len(x) + len(y), len(x) + len(y) - 2 * both

    near = spill(_compare(pairs, members.select("fp", F.col("wide").alias("v")), wide, s).select("a", "b", "times"))
    if near.isEmpty():
        return near.withColumn("linked", F.lit(True))
    wanted = spill(near.select(F.col("a").alias("fp")).union(near.select("b")).distinct())
    sets = spill(_sets(docs, text_col, wanted, s))
    out = spill(_compare(near, sets.select("fp", F.col("grams").alias("v")), exact, s))
    discard(near, wanted, sets)
    return out


def _group_pairs(lists: DataFrame, s: Settings) -> DataFrame:
    """(x_grp, y_grp): groups that share a prefix gram; all of a short list, with its pivot for a long one."""
    few, many = lists.where(F.col("size") <= s.pivot_over), lists.where(F.col("size") > s.pivot_over)
    cols = ["gram", "grp", "n", "pos"]
    plain = _side(few, "x", cols).join(_side(few, "y", cols), (F.col("x_gram") == F.col("y_gram")) & (F.col("x_grp") < F.col("y_grp")))
    spokes = many.select(*[F.col(f"p_{c}").alias(f"x_{c}") for c in cols[1:]], *[F.col(c).alias(f"y_{c}") for c in cols[1:]]).where("x_grp <> y_grp")
    found = plain.where(_may_link(s)).select("x_grp", "y_grp").unionByName(spokes.where(_may_link(s)).select("x_grp", "y_grp"))
    return found.select(F.least("x_grp", "y_grp").alias("x_grp"), F.greatest("x_grp", "y_grp").alias("y_grp")).distinct()


def _mixed(keyed: DataFrame, key: list[str]) -> DataFrame:
    """The rows of keys that hold more than one component, with the rows of each key (held); least,
    greatest and count combine before the shuffle."""
    ends = keyed.groupBy(*key).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("held"))
    return keyed.join(cut(ends.where("lo <> hi").select(*key, "held")), key)


def _rare_first(mine: DataFrame, docs: DataFrame, text_col: str, s: Settings) -> DataFrame:
    """(unit, gram, pos): the prefixes of the sets `mine` (unit, m_fp) with grams in the order of how many of
    these sets hold them. A gram of one set alone comes first and pairs with none, so it is only counted."""
    wanted = spill(mine.select(F.col("m_fp").alias("fp")).distinct())
    sets = spill(_sets(docs, text_col, wanted, s))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 64):
                b = whole.slice(i, 64)
                grams = [np.frombuffer(x.as_buffer(), np.int64) for x in b.column(1)]
                n = np.array([len(g) for g in grams])
                at = pa.array(np.repeat(np.arange(len(n)), n))
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array(np.repeat(n, n)), pa.array(np.concatenate(grams))], names=["fp", "n", "gram"])

    grams = sets.select("fp", "grams").mapInArrow(each, "fp binary, n long, gram long")
    counts = spill(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("times")).where("times > 1").withColumn("freq", F.col("times")))
    shared = hot_join(grams, counts, "gram", "times").groupBy("fp", "n").agg(F.sort_array(F.collect_list(F.struct("freq", "gram"))).alias("g"))
    alone = (F.col("n") - F.size("g")).cast("int")
    first = F.slice("g", F.lit(1), F.greatest(_keep(s) - alone, F.lit(0)))
    prefix = shared.select("fp", alone.alias("alone"), F.posexplode(first).alias("at", "x")).select("fp", F.col("x.gram").alias("gram"), (F.col("alone") + F.col("at")).alias("pos"))
    out = spill(mine.join(prefix, F.col("m_fp") == F.col("fp")).groupBy("unit", "gram").agg(F.min("pos").alias("pos")))
    discard(wanted, sets, counts)
    return out


def _apart(lists: DataFrame, units: DataFrame, many: DataFrame, inside: DataFrame, docs: DataFrame, text_col: str, s: Settings) -> DataFrame:
    """Candidate pairs of units of different components that share a gram or a group.

    The least gram that two linked sets share lies in both prefixes. A ball has its head's prefix, which
    all its members share. Keys of at most `crowd` units pair them all, so a row meets so many others at
    most, by its numbers alone. Of two linked sets in a key of more units both are among all units of such keys, whose sets then get prefixes of another order, and share a gram there
    as well; a ball has its members' prefixes, and the least place of a gram in them.
    """
    info = ["fp", "n", "comp", "ball", *BITS]
    deep = lists.join(many, "gram", "left_semi").select("gram", "grp", "pos")
    in_lists = deep.join(units, "grp").select(F.col("gram").alias("key"), F.lit(False).alias("in_group"), "pos", *info)
    in_groups = units.where("many").select(F.col("grp").alias("key"), F.lit(True).alias("in_group"), F.lit(0).cast("int").alias("pos"), *info)
    rest = spill(_mixed(in_lists.unionByName(in_groups), ["key", "in_group"]))
    apart = (F.col("x_comp") != F.col("y_comp")) & (F.col("x_fp") < F.col("y_fp"))
    times = F.when(F.col("x_ball") | F.col("y_ball"), 3).otherwise(1)

    def paired(rows: DataFrame, keys: list[str]) -> DataFrame:
        cols = [*keys, "pos", *info]
        same = [F.col(f"x_{k}") == F.col(f"y_{k}") for k in keys]
        return _candidates(_side(rows, "x", cols).join(_side(rows, "y", cols), reduce(and_, same) & apart).where(_may_link(s)), s, times)

    out = paired(rest.where(F.col("held") <= s.crowd), ["key", "in_group"])
    long = rest.where(F.col("held") > s.crowd).select(*info).distinct()
    if not long.isEmpty():
        long = spill(long)
        prefixes = _rare_first(inside.select("unit", F.col("fp").alias("m_fp")).join(long.select("fp"), F.col("unit") == F.col("fp"), "left_semi").distinct(), docs, text_col, s)
        keyed = _mixed(prefixes.join(long, F.col("unit") == F.col("fp")).drop("unit"), ["gram"]).drop("held")
        out = out.unionByName(paired(spill(keyed), ["gram"]))
    return spill(out)


def _with_comp(df: DataFrame, label: DataFrame, fp: str = "fp", name: str = "comp") -> DataFrame:
    """`df` with the component of its column `fp`; a set without links is its own."""
    own = label.select(F.col("node").alias("_node"), F.col("label").alias("_label"))
    return df.join(own, F.col(fp) == F.col("_node"), "left").withColumn(name, F.coalesce("_label", fp)).drop("_node", "_label")


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", s: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """(rows, label): rows has id, n, fp and text_md5 for each row of the input; label has the component
    (label) of each set (node) with links."""
    first = spill(_digest(docs, id_col, text_col, s))
    rows = first.where("kind = 0").select("id", "n", "fp", "text_md5")
    second = spill(_prefixes(docs, text_col, _common(first.where("kind = 1").select("gram", "times"), s), s))

    # counts of repeated rows may call a short list long, which changes its way and not its links
    grams = second.select("grp", "n", F.posexplode(F.slice("ordered", F.lit(1), _keep(s))).alias("pos", "gram"))
    first_place = F.col("pos") * F.lit(1 << 31) + F.col("n")  # a list's pivot: the least place, then size
    sizes = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("size"), F.min(first_place).alias("p"), F.min_by("grp", first_place).alias("p_grp"))
    sizes = spill(sizes.where("size > 1").select("gram", "size", F.expr("p div 2147483648").alias("p_pos"), F.expr("p % 2147483648").alias("p_n"), "p_grp"))
    lists = spill(grams.join(sizes, "gram").distinct())
    members = spill(second.select("grp", "n", "fp", *BITS, "wide").dropDuplicates(["fp"]))
    info = ["grp", "fp", "n", *BITS]
    groups = members.groupBy("grp").agg(F.min(F.struct("fp", "n", *BITS)).alias("h"), F.count(F.lit(1)).alias("peers"))
    groups = spill(groups.select("grp", "h.*", "peers"))

    big = groups.where("peers > 1")
    inner = _side(big, "x", info).join(_side(members, "y", info), F.col("x_grp") == F.col("y_grp")).where("x_fp <> y_fp")
    heads = _group_pairs(lists, s).join(_side(groups, "x", info), "x_grp").join(_side(groups, "y", info), "y_grp")
    sides = [f"{side}_{c}" for side in "xy" for c in info[1:]]
    near = spill(_candidates(heads.select(*sides).unionByName(inner.select(*sides)), s))
    found = _verify(near, members, docs, text_col, s)
    edges = found.select("a", "b")
    label = spill(components(edges))

    # what that left apart
    ends = [F.least("x_fp", "y_fp").alias("a"), F.greatest("x_fp", "y_fp").alias("b")]
    loose = inner.select("*", *ends).join(edges, ["a", "b"], "left_anti").select(*[F.col(f"y_{c}").alias(c) for c in info])
    loose = spill(loose)
    many = sizes.where(F.col("size") > s.pivot_over).select("gram")
    has_big = lists.join(big.select("grp"), "grp", "left_semi").select("gram")
    deep = spill(many.union(has_big).distinct())
    if not deep.isEmpty():
        crowded = loose.select("grp").distinct().withColumn("many", F.lit(True))
        lead = groups.select(*info, (F.col("peers") > 1).alias("ball"))
        units = lead.unionByName(loose.select(*info, F.lit(False).alias("ball"))).join(crowded, "grp", "left")
        units = spill(_with_comp(units.withColumn("many", F.coalesce("many", F.lit(False))), label))
        balls = units.where("ball").select("grp", F.col("fp").alias("unit"))
        inside = members.join(loose.select("fp"), "fp", "left_anti").join(balls, "grp").select("unit", *info[1:])
        inside = inside.unionByName(units.where("not ball").select(F.col("fp").alias("unit"), *info[1:]))
        apart = _apart(lists, units, deep, inside, docs, text_col, s)
        if not apart.isEmpty():
            close = _verify(apart, members, docs, text_col, s)
            label = joined(label, close.where("linked").select("a", "b"))
            label = _open(close.where("times > 1 and not linked").select("a", "b"), label, inside, members, docs, text_col, s)
        discard(units)
    discard(second, sizes, lists, members, groups, near, loose, deep)
    return rows, label


def _open(close: DataFrame, label: DataFrame, inside: DataFrame, members: DataFrame, docs: DataFrame, text_col: str, s: Settings) -> DataFrame:
    """`label` with the links between members of the units `close` (a, b): first of each head with the
    other's members, then, where two are still apart, between their members. `inside` has the members
    (fp) of each unit."""
    cols = ["unit", "fp", "n", *BITS]
    x, y = _side(inside, "x", cols), _side(inside, "y", cols)
    lead = inside.where("fp = unit")
    for whole in (False, True):
        close = _with_comp(_with_comp(close.select("a", "b"), label, "a", "ca"), label, "b", "cb")
        close = cut(close.where("ca <> cb").select("a", "b"))
        if close.isEmpty():
            break
        both = lambda p, q: close.join(p, F.col("a") == F.col("x_unit")).join(q, F.col("b") == F.col("y_unit"))  # noqa: B023, E731
        if whole:
            sides = both(x, y).where("x_fp <> x_unit and y_fp <> y_unit")
        else:
            sides = both(_side(lead, "x", cols), y).unionByName(both(x, _side(lead, "y", cols)))
        pairs = spill(_candidates(sides, s))
        if not pairs.isEmpty():
            label = joined(label, _verify(pairs, members, docs, text_col, s).select("a", "b"))
        discard(pairs)
    return label


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", s: Settings = Settings()) -> DataFrame:
    """(id, n_grams, component): one row per input row."""
    rows, label = links(docs, id_col, text_col, s)
    least = rows.where("fp is not null").groupBy("fp").agg(F.min("id").alias("low"))
    named = least.join(label, least["fp"] == label["node"], "left").select("fp", "low", F.coalesce("label", "fp").alias("comp"))
    linked = named.join(label.select(F.col("label").alias("comp")).distinct(), "comp", "left_semi")
    comps = linked.groupBy("comp").agg(F.min("low").alias("component"))
    of_fp = named.join(comps, "comp", "left").select(F.col("fp").alias("s_fp"), F.coalesce("component", "low").alias("component"))
    out = rows.join(of_fp, rows["fp"] == of_fp["s_fp"], "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_grams"), F.coalesce("component", "id").alias("component"))


def _fresh(name: str, taken: list[str]) -> str:
    """`name`, or with underscores until no column is called so in any case."""
    low = {c.lower() for c in taken}
    while name in low:
        name += "_"
    return name


def _without(docs: DataFrame, go: DataFrame, key: str, most_broadcast_rows: int) -> DataFrame:
    """The rows of `docs` whose column `key` is not in the one column of `go`.

    A small `go` is broadcast. Beyond that a broadcast bitmap of bounded size tells most rows that
    stay, which do not move; the rest meet `go` in a shuffled join.
    """
    gone = go.columns[0]
    if is_small(go, most_broadcast_rows):
        return docs.join(F.broadcast(go), F.col(key) == F.col(gone), "left_anti")
    bits = min(WANTED_BITS, 1 << max(16, (16 * go.count()).bit_length()))
    hashed = go.select(F.xxhash64(gone).alias("h"))
    have = _bit_table(hashed, lambda h: [h & (bits - 1), (h >> 32) & (bits - 1)], bits)
    shared = docs.sparkSession.sparkContext.broadcast(have.tobytes())

    @F.pandas_udf("boolean")
    def may_go(h: pd.Series) -> pd.Series:
        table, h = np.frombuffer(shared.value, np.uint8), h.to_numpy(np.int64)
        hit = lambda k: (table[k >> 3] >> (k & 7).astype(np.uint8)) & 1
        return pd.Series((hit(h & (bits - 1)) & hit((h >> 32) & (bits - 1))).astype(bool))

    hit = may_go(F.xxhash64(key))
    return docs.where(~hit).unionByName(docs.where(hit).join(go, F.col(key) == F.col(gone), "left_anti"))


def keep_one(docs: DataFrame, s: Settings = Settings(), most_broadcast_rows: int = 100_000) -> DataFrame:
    """All columns of one row of each component: the one of least id (nulls last), then least text
    hash; of rows that repeat both, one. Rows without words all stay, repeated ones too.

    The keys (id and text hash) of the rows to go are joined away, see `_without`.
    """
    rows, label = links(docs, "doc_id", "text", s)
    worded = rows.where("fp is not null")
    tagged = worded.join(label, rows["fp"] == label["node"], "left").select("id", "text_md5", F.coalesce("label", "fp").alias("comp"))
    order = F.struct(F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), F.col("text_md5").alias("text_md5"))
    first = tagged.groupBy("comp").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("size")).where("size > 1")
    marked = lookup_join(tagged, first, ["comp"], most_broadcast_rows).where("size is not null")
    named = lambda i, text: F.concat(F.coalesce(i.cast("string"), F.lit("")), F.lit(":"), F.hex(text))
    other = ~(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("text_md5") == F.col("first.text_md5")))
    key, gone = _fresh("row_key", docs.columns), _fresh("gone_key", docs.columns)
    go = cut(marked.where(other).select(named(F.col("id"), F.col("text_md5")).alias(gone)).distinct())
    again = cut(worded.groupBy("id", "text_md5").count().where("count > 1").select(named(F.col("id"), F.col("text_md5")).alias(gone)))
    text_md5 = F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")))
    keyed = docs.withColumn(key, named(F.col("doc_id").cast("long"), text_md5))
    kept = _without(keyed, go, key, most_broadcast_rows)
    if again.limit(1).count():  # of rows that are repeated whole, one
        once = kept.join(again, F.col(key) == F.col(gone), "left_semi").dropDuplicates([key])
        kept = _without(kept, again, key, most_broadcast_rows).unionByName(once)
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def join_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    out = classes(docs)
    return out.select("doc_id", F.col("n_grams").alias("n_shingles"), F.col("component").alias("component_id"))
