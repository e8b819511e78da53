"""Balanced orders and folds: the greedy largest-deficit order of classes, and group folds of even classes.

Both depend on counts alone. The greedy order is found for ranges of positions at once: each range starts
from a guessed state of its classes, and is run again from the true one where the range before it ends
elsewhere. Group folds are decided over patterns, the distinct vectors of class counts, not over groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import number_rows, written

RANGE = 1 << 19


def hash_order(*keys: Column | str, seed: int = 42) -> Column:
    """A reproducible shuffle's sort key."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]), 256)


# ---- greedy order ----------------------------------------------------------------------------------


def guessed(sizes: Sequence[int], at: int) -> list[int]:
    """Rows of each class among the first `at`: the quotas' floors, and one more for the largest rests."""
    total = sum(sizes)
    out = [n * at // total for n in sizes]
    rests = sorted(range(len(sizes)), key=lambda c: (-(sizes[c] * at % total), c))
    for c in rests[: at - sum(out)]:
        out[c] += 1
    return out


def picks(sizes: Sequence[int], taken: Sequence[int], at: int, end: int) -> Iterator[int]:
    """The classes at positions at .. end - 1: each time the class that is furthest behind its share, the
    first of several. `taken` rows of each class stand before; all is in whole numbers."""
    total = sum(sizes)
    behind = [n * at - total * k for n, k in zip(sizes, taken, strict=True)]
    for _ in range(at, end):
        behind = [b + n for b, n in zip(behind, sizes, strict=True)]
        c = behind.index(max(behind))
        behind[c] -= total
        yield c


def class_places(spark: SparkSession, sizes: Sequence[int], size: int = RANGE) -> DataFrame:
    """(cls, nth, place): where in one period of the order the nth row of each class comes.

    When every share of the position is whole, no class is behind, so the order repeats after
    sum / gcd positions and only that period is laid out, in ranges of `size`.
    """
    common = math.gcd(*sizes) or 1
    sizes = [n // common for n in sizes]
    period = sum(sizes)
    cuts = [*range(0, period, size), period]
    starts = [guessed(sizes, at) for at in cuts[:-1]]

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r, at, end, taken in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for c in picks(sizes, taken, at, end):
                    taken[c] += 1
                rows.append({"r": r, "taken": taken})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("r", pa.int32()), ("taken", pa.list_(pa.int64()))]))

    def ranges(which: list[int]) -> DataFrame:
        rows = [(r, cuts[r], cuts[r + 1], starts[r]) for r in which]
        return spark.createDataFrame(rows, "r int, at long, upto long, taken array<long>").repartition(max(1, len(rows)), "r")

    unsure = list(range(len(starts) - 1))
    while unsure:  # the first range is sure; each round makes at least one more so, mostly all
        found = {x["r"]: list(x["taken"]) for x in ranges(unsure).mapInArrow(ends, "r int, taken array<long>").collect()}
        unsure = []
        for r, state in found.items():
            if starts[r + 1] != state:
                starts[r + 1] = state
                unsure += [r + 1] if r + 2 < len(cuts) - 1 else []

    def laid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, at, end, taken in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for low in range(at, end, 1 << 16):
                    high, nth = min(end, low + (1 << 16)), []
                    classes = list(picks(sizes, taken, low, high))
                    for c in classes:
                        nth.append(taken[c])
                        taken[c] += 1
                    yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int32()), pa.array(nth, pa.int64()), pa.array(range(low, high), pa.int64())], names=["cls", "nth", "place"])

    return ranges(list(range(len(starts)))).mapInArrow(laid, "cls int, nth long, place long")


def stratified_order(df: DataFrame, label: str, id_col: str, seed: int = 42, size: int = RANGE, most_broadcast: int = 100_000) -> DataFrame:
    """`position` from 0: at each place the class that is furthest behind its share, so that nested
    prefixes keep the classes' shares. Within a class rows come in hash order. Null is a class too."""
    counts = sorted(((r[label], r["count"]) for r in df.groupBy(label).count().collect()), key=lambda x: (x[0] is not None, x[0]))
    spark = df.sparkSession
    if not counts:
        return df.withColumn("position", F.lit(None).cast("long"))
    common = math.gcd(*(n for _, n in counts))
    sizes, firsts = [n for _, n in counts], [sum(n for _, n in counts[:c]) for c in range(len(counts))]
    period = sum(sizes) // common
    kinds = F.broadcast(spark.createDataFrame([(v, c, n // common, f) for c, ((v, n), f) in enumerate(zip(counts, firsts, strict=True))], f"_v {df.schema[label].dataType.simpleString()}, _c int, _n long, _f long"))
    ranked = number_rows(df, [F.col(label).asc_nulls_first(), hash_order(id_col, seed=seed), F.col(id_col)], 0, "_i").join(kinds, F.col(label).eqNullSafe(F.col("_v")))
    rank = F.col("_i") - F.col("_f")
    ranked = ranked.withColumn("_nth", rank % F.col("_n")).withColumn("_turn", F.expr("(_i - _f) DIV _n"))
    places = class_places(spark, sizes, size)
    places = F.broadcast(places) if period <= most_broadcast else places
    out = ranked.join(places, (F.col("_c") == F.col("cls")) & (F.col("_nth") == F.col("nth")))
    return out.withColumn("position", F.col("_turn") * period + F.col("place")).select(*df.columns, "position")


# ---- group folds -----------------------------------------------------------------------------------


def leftover_folds(patterns: list[tuple[list[int], int]], totals: Sequence[int], folds: int) -> list[list[int]]:
    """Folds for the groups of each pattern (class counts, groups) that do not go round evenly: those of
    the widest spread first, each to the fold where the squared shares of its classes grow least."""
    scale = [n * n if n else 1 for n in totals]
    held, rows = [[0] * len(totals) for _ in range(folds)], [0] * folds
    out: list[list[int]] = [[] for _ in patterns]

    def spread(v: Sequence[int]) -> int:
        return len(v) * sum(x * x for x in v) - sum(v) ** 2

    for k in sorted(range(len(patterns)), key=lambda k: (-spread(patterns[k][0]), [-x for x in patterns[k][0]])):
        v, groups = patterns[k]
        for _ in range(groups % folds):
            f = min(range(folds), key=lambda f: (sum(held[f][c] * x / scale[c] for c, x in enumerate(v)), rows[f], f))
            held[f] = [a + b for a, b in zip(held[f], v, strict=True)]
            rows[f] += sum(v)
            out[k].append(f)
    return out


def group_folds(df: DataFrame, group: str, label: str, folds: int = 3, seed: int = 42, most_patterns: int = 100_000) -> DataFrame:
    """(group, fold): no group in two folds, and every class spread evenly over them.

    Groups of equal class counts are dealt round the folds in hash order, which leaves fewer than `folds` of
    each pattern; a greedy pass over the patterns places those, so that a fold's rows of a class differ
    from the even share by about one group's. Beyond `most_patterns` distinct vectors their counts are
    rounded down to ever fewer leading bits: groups of one rounded pattern are dealt in the order of
    their true counts. Null groups and labels count as a group and a class. Only patterns reach the driver.
    """
    labels = sorted((r[0] for r in df.select(label).distinct().collect()), key=lambda x: (x is not None, x))  # classes are few
    cols = [f"_c{i}" for i in range(len(labels))]
    if not labels:
        return df.select(group).withColumn("fold", F.lit(0))
    vectors = df.groupBy(group).agg(*[F.count_if(F.col(label).eqNullSafe(F.lit(v))).alias(c) for c, v in zip(cols, labels, strict=True)])
    # rounded vectors come first in the order, so that rows of one pattern have consecutive numbers at any precision
    bits = 64
    while True:
        keep = lambda c: F.col(c) if bits >= 64 else F.expr(f"shiftleft(shiftright({c}, greatest(0, length(bin({c})) - {bits})), greatest(0, length(bin({c})) - {bits}))")  # noqa: B023, E731
        rounded = written(vectors.select(group, *cols, *[keep(c).alias(f"_r{c}") for c in cols]))
        keys = [f"_r{c}" for c in cols]
        few = bits == 1 or rounded.select(*keys).distinct().limit(most_patterns + 1).count() <= most_patterns
        if few:
            break
        bits = {64: 4, 4: 2, 2: 1}[bits]
    numbered = number_rows(rounded, [*keys, *cols, hash_order(group, seed=seed), F.col(group)], 0, "_i")
    rows = sorted(numbered.groupBy(*keys).agg(F.min("_i").alias("first"), F.count(F.lit(1)).alias("m")).collect(), key=lambda r: r["first"])
    totals = [int(x or 0) for x in vectors.agg(*[F.sum(c) for c in cols]).first()]
    extra = leftover_folds([([int(r[k]) for k in keys], r["m"]) for r in rows], totals, folds)
    table = df.sparkSession.createDataFrame([(*[int(r[k]) for k in keys], r["first"], r["m"] - r["m"] % folds, e) for r, e in zip(rows, extra, strict=True)], ", ".join(f"k{c} long" for c in cols) + ", first long, even long, extra array<int>")
    rank = F.col("_i") - F.col("first")
    fold = F.when(rank < F.col("even"), (rank % folds).cast("int")).otherwise(F.get("extra", (rank - F.col("even")).cast("int")))
    joined = numbered.join(F.broadcast(table), [F.col(f"_r{c}") == F.col(f"k{c}") for c in cols])
    return joined.select(group, fold.alias("fold"))
