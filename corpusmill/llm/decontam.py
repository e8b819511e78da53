"""Benchmark decontamination by template windows.

Texts become templates: numbers, names and units turn into typed placeholders, all else is lower
case words. Every window of `words` template words of a benchmark item is hashed; a document's
windows are looked up in that table (a map-side hash join: no document text is shuffled). Hits of an
item form occurrences; in an occurrence each of the item's slot values must stand for one document
value throughout, and windows that disagree do not count. A document is contaminated by an item if
the agreeing windows reach `share` of the item's windows.

Names are told by their capitals, so a copy in other capitals has other templates. Beside them, every
window of `words` plain case-folded words is looked up too, and half of an item's plain windows also
contaminate; a pair that both find has the numbers of the template windows.

An item of fewer words is one window of its own length: its whole template, if that has `literal`
words that are no placeholders, and its whole plain words, so an item of numbers alone matches on
equal numbers. An item without a word matches nothing. Items that share a window cost no more than
their postings: only those of whose windows enough occur are followed to their places.

A benchmark of at most `most_blocks` blocks of `block_chars` characters is held by executors as a table of
windows, one pass per block; its size is checked, not assumed. A larger one is joined by hash: each item
gives its rarest windows, so many that no document which lacks them all can reach the share; of the
documents' windows those that a bitmap of these may know are shuffled to them, each hash being salted by
how many items have it; and the texts of the pairs found meet for the same comparison. Both ways give the
same pairs.

Null or empty texts match nothing. Repeated documents are each judged, in place, so a null doc_id is
kept as null. Repeated items count once; all items that match a document are reported, in order of
item. Empty tables give no pairs and `clean` all rows. Extra columns are ignored by `matches` and kept
by `clean`, whatever they are called. A very long text is hashed in pieces.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Words, share, spill, text_batches
from .ngram_join import WANTED_BITS, _bit_table, _fresh

# Units that stand after a number.
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg gram grams kilogram kilograms lb lbs oz ton tons "
    "ml l liter liters litre litres s sec second seconds min minute minutes h hour hours day days week weeks month months year years "
    "mph kmh hz khz mhz ghz w kw v a j kj cal kcal c f k usd eur gbp dollar dollars cent cents euro euros percent degrees".split()
)
NUM, NAME, UNIT = "\x00num", "\x00name", "\x00unit"
UPPER = "[A-ZÀ-ÖØ-ÞŒŠŽΑ-ΩА-Я]"
#: A number with the unit after it, or capitalised words after a word or comma and a space. The
#: branches follow a first character, so that a search need not stop anywhere else.
SLOT = re.compile(
    rf"[0-9{UPPER[1:]}(?:(?<=[0-9])(?P<num>[0-9]*(?:[.,:/][0-9]+)*)(?:[ -]?(?P<unit>(?i:{'|'.join(sorted(UNITS, key=lambda u: (-len(u), u)))}))\b)?"
    rf"|(?<=[\w,] .)(?P<name>[^\W\d_]+(?: {UPPER}[^\W\d_]+)*))"
)
#: What stands between words beyond ASCII.
MARKS = re.compile("[\u00a0-\u00bf\u2000-\u206f\u3000-\u303f]")
#: Bytes of words stay, all else is a space; templates have no digits outside placeholders.
PLAIN = bytes(b if b >= 128 or chr(b).isalnum() or b == 95 else 32 for b in range(256))
LETTERS = bytes(b if b >= 128 or chr(b).isalpha() or b == 0 else 32 for b in range(256))
MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Settings:
    words: int = 5
    share: float = 0.5
    literal: int = 2  # words of a window that are no placeholders, at least
    block_chars: int = 8_000_000
    most_blocks: int = 4  # beyond these a hash join takes over


def template(text: str) -> tuple[bytes, list[str]]:
    """(template words between spaces, the values of their placeholders in order). Names are capitalised
    words within a sentence, neighbouring ones one name; words in capitals throughout are plain words."""
    values: list[str] = []

    def slot(m: re.Match) -> str:
        if m["name"]:
            if not all(w[1:].islower() for w in m[0].split()):
                return m[0]
            values.append(m[0].lower())
            return f" {NAME} "
        values.append(m[0][0] + m["num"])
        if m["unit"]:
            values.append(m["unit"].lower())
            return f" {NUM} {UNIT} "
        return f" {NUM} "

    return spaced(SLOT.sub(slot, text.replace("\x00", " ")).lower(), LETTERS), values


def spaced(text: str, keep: bytes) -> bytes:
    if not text.isascii():
        text = MARKS.sub(" ", text)
    return text.encode("utf-8", "surrogatepass").translate(keep)


def by_word(data: bytes, values: list[str]) -> list[str | None]:
    """The slot value of each word, or None."""
    it = iter(values)
    return [next(it) if w[0] == 0 else None for w in data.split()]


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """A hash for each window of n words, from the words' hashes."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = (out ^ (out >> np.uint64(29))) * MIX + h[k : len(h) - n + 1 + k]
    return (out ^ (out >> np.uint64(32))) * MIX


class Postings:
    """Sorted distinct window hashes, with the (item << 32 | window) of each."""

    def __init__(self, hashes: np.ndarray, places: np.ndarray):
        order = np.argsort(hashes, kind="stable")
        self.places = places[order]
        self.keys, self.first, self.count = np.unique(hashes[order], return_index=True, return_counts=True)

    def of(self, k: int) -> np.ndarray:
        return self.places[self.first[k] : self.first[k] + self.count[k]]


class Table:
    """Windows of a block of benchmark items."""

    def __init__(self, items: list[tuple[int, str]], s: Settings):
        self.s, self.items, hashed = s, {}, Words()
        found: dict[tuple[bool, int], list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
        for place, (item_id, text) in enumerate(items):
            for plain in (False, True):
                data, values = self.read(text or "", plain)
                own = by_word(data, values)
                n, key = min(s.words, len(own)), 2 * place + plain
                if not n:
                    continue
                hashes = windows(hashed(data), n)
                literals = np.convolve([v is None for v in own], np.ones(n, np.int64), "valid")
                at = np.flatnonzero(literals >= min(s.literal, n))
                if len(at):
                    self.items[key] = (item_id, n, len(at), own)
                    found[plain, n].append((hashes[at], np.int64(key) << 32 | at))
        self.tables = {kind: Postings(*map(np.concatenate, zip(*parts, strict=True))) for kind, parts in found.items()}

    @staticmethod
    def read(text: str, plain: bool) -> tuple[bytes, list[str]]:
        return (spaced(text.casefold(), PLAIN), []) if plain else template(text)

    def match(self, text: str | None, hashed: Words) -> list[tuple[int, int, int]]:
        """(item, agreeing windows, windows of the item) for each contaminating item."""
        if not text:
            return []
        found: dict[int, tuple[int, int, int]] = {}
        for plain in (False, True):
            data, values = self.read(text, plain)
            words, slots = hashed(data), None
            for (kind, n), table in self.tables.items():
                if kind != plain or not len(h := windows(words, n)):
                    continue
                where = np.minimum(np.searchsorted(table.keys, h), len(table.keys) - 1)
                at = np.flatnonzero(table.keys[where] == h)
                if not len(at):
                    continue
                keys, counts = np.unique(np.concatenate([table.of(k) for k in np.unique(where[at])]) >> 32, return_counts=True)
                enough = {int(k) for k, c in zip(keys, counts, strict=True) if c >= self.need(int(k)) and int(k) >> 1 not in found}
                if not enough:
                    continue
                kept = {k: [(int(x) >> 32, int(x) & 0xFFFFFFFF) for x in table.of(k) if int(x) >> 32 in enough] for k in np.unique(where[at])}
                hits: dict[int, list[tuple[int, int]]] = defaultdict(list)  # item -> (place, window)
                for p in at:
                    for key, w in kept[where[p]]:
                        hits[key].append((int(p), w))
                slots = slots or by_word(data, values)
                for key, pairs in hits.items():
                    item_id, n, total, own = self.items[key]
                    best = max(self.agreeing(part, own, slots, n) for part in self.occurrences(pairs, len(own)))
                    if best >= self.need(key):
                        found[key >> 1] = (item_id, best, total)
        return [found[k] for k in sorted(found)]

    def need(self, key: int) -> float:
        return max(1, self.s.share * self.items[key][2])

    @staticmethod
    def occurrences(pairs: list[tuple[int, int]], length: int) -> list[list[tuple[int, int]]]:
        """Hits whose implied starts (place less window) are near each other, in order of start."""
        pairs = sorted(pairs, key=lambda x: (x[0] - x[1], x[0]))
        parts = [[pairs[0]]]
        for p in pairs[1:]:
            if (p[0] - p[1]) - (parts[-1][-1][0] - parts[-1][-1][1]) > max(8, length // 2):
                parts.append([])
            parts[-1].append(p)
        return parts

    @staticmethod
    def agreeing(pairs: list[tuple[int, int]], own: list[str | None], values: list[str | None], n: int) -> int:
        """Distinct windows whose slots all have the document value that most hits give that slot value."""
        votes: dict[str, dict[str, int]] = defaultdict(lambda: defaultdict(int))
        for p, w in pairs:
            for k in range(n):
                if own[w + k] is not None:
                    votes[own[w + k]][values[p + k]] += 1
        means = {a: min(b, key=lambda v: (-b[v], v)) for a, b in votes.items()}
        return len({w for p, w in pairs if all(own[w + k] is None or means[own[w + k]] == values[p + k] for k in range(n))})


def _n_blocks(bench: DataFrame, s: Settings) -> int:
    total = bench.agg(F.sum(F.length("text"))).first()[0] or 0
    return max(1, -(-total // s.block_chars))


def _blocks(bench: DataFrame, n: int) -> Iterator[list[tuple[int, str]]]:
    """The items in `n` blocks by a hash of the item, each block small enough to hold."""
    for k in range(n):
        part = bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [(r["item_id"], r["text"]) for r in part.collect()]


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()


def _text_key(text: Column) -> Column:
    return F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))


def _tagged(h: np.ndarray, plain: bool, n: int) -> np.ndarray:
    """Hashes of windows of n template or plain words, told apart."""
    return ((h ^ np.uint64(2 * n + plain)) * MIX).view(np.int64)


def joined_matches(docs: DataFrame, bench: DataFrame, s: Settings) -> DataFrame:
    """(text_key, item_id, n_windows, item_windows) for each distinct text of `docs`, by a join on window hashes.

    Whether a text is contaminated depends on the text alone, so it is judged once for all rows that hold it.
    """

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                one = Table([(item, text)], s)
                for (plain, n), table in one.tables.items():
                    need = one.need(int(plain))
                    rows += [(int(h), item, text, plain, n, int(c), need) for h, c in zip(_tagged(table.keys, plain, n), table.count, strict=True)]
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=arrow)

    names = ["h", "item_id", "text", "plain", "n", "c", "need"]
    arrow = pa.schema([("h", pa.int64()), ("item_id", pa.int64()), ("text", pa.string()), ("plain", pa.bool_()), ("n", pa.int32()), ("c", pa.int64()), ("need", pa.float64())])
    windows_of = bench.mapInArrow(of_items, "h long, item_id long, text string, plain boolean, n int, c long, need double")
    items = spill(windows_of.withColumn("item_key", F.md5(F.concat_ws(":", F.col("item_id").cast("string"), "text").cast("binary"))))
    freq = spill(items.groupBy("h").agg(F.count(F.lit(1)).alias("freq")))
    # an item's rarest windows until those that are left, all found, would not be enough
    order = Window.partitionBy("item_key", "plain").orderBy(F.desc("freq"), "h")
    ranked = items.select("h", "item_key", "plain", "n", "c", "need").join(freq, "h").withColumn("left", F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    keys = spill(ranked.where(F.col("left") >= F.col("need")).select("h", "item_key", "n", "plain", "freq"))
    kinds = [(bool(r["plain"]), int(r["n"])) for r in keys.select("plain", "n").distinct().collect()]  # ten at most
    bits = min(WANTED_BITS, 1 << max(16, (16 * keys.count()).bit_length()))
    have = _bit_table(keys.select("h").distinct(), lambda h: [h & (bits - 1), (h >> 32) & (bits - 1)], bits)
    known_bits = docs.sparkSession.sparkContext.broadcast(have.tobytes())

    def of_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, hashed, seen = np.frombuffer(known_bits.value, np.uint8), Words(), set()
        hit = lambda k: table[k >> 3] >> (k & 7).astype(np.uint8) & 1
        for b in batches:
            keys, found = [], []
            for text, key in zip(b.column(0), b.column(1), strict=True):
                text, key = text.as_py(), key.as_py()
                if not text or key in seen:
                    continue
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(key)
                for plain in (False, True):
                    words = hashed(Table.read(text, plain)[0])
                    for kind, n in kinds:
                        if kind == plain and len(h := windows(words, n)):
                            h = np.unique(_tagged(h, plain, n))
                            h = h[(hit(h & (bits - 1)) & hit((h >> 32) & (bits - 1))).astype(bool)]
                            keys += [key] * len(h)
                            found.append(h)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))], names=["text_key", "h"])

    texts = docs.select(F.col("text").cast("string").alias("text"), _text_key(F.col("text")).alias("text_key"))
    asked = texts.mapInArrow(of_docs, "text_key string, h long").distinct()
    # adaptive execution splits the documents' side of a hot window; its items are spread over the salts of their number
    salts = F.greatest(F.lit(1), F.least(F.lit(64), F.ceil(F.col("freq") / 1000))).cast("int")
    dealt = keys.withColumn("salts", salts).withColumn("salt", F.pmod(F.xxhash64("item_key"), F.col("salts")).cast("int"))
    many = dealt.where("salts > 1").select("h", "salts").distinct()
    asked = asked.join(many, "h", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    pairs = spill(asked.join(dealt.select("h", "item_key", "salt"), ["h", "salt"]).select("text_key", "item_key").distinct())

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, tables = Words(), {}
        for b in batches:
            rows = []
            for key, text, item, own in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (item, own) not in tables:
                    if len(tables) > 1000:
                        tables.clear()
                    tables[item, own] = Table([(item, own)], s)
                rows += [(key, *m) for m in tables[item, own].match(text, hashed)]
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *[pa.array(c, pa.int64()) for c in cols[1:]]], names=["text_key", "item_id", "n_windows", "item_windows"])

    wanted = texts.join(pairs.select("text_key").distinct(), "text_key", "left_semi").groupBy("text_key").agg(F.first("text").alias("text"))
    both = pairs.join(wanted, "text_key").join(items.select("item_key", "item_id", F.col("text").alias("item_text")).dropDuplicates(["item_key"]), "item_key")
    text_batches(docs.sparkSession)
    return both.select("text_key", "text", "item_id", "item_text").mapInArrow(compare, "text_key string, item_id long, n_windows long, item_windows long")


def matches(docs: DataFrame, benchmark: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, item_id, n_windows, item_windows): the pairs of contaminated document and item."""
    bench = _items(benchmark)
    if (n := _n_blocks(bench, s)) > s.most_blocks:
        texts = docs.select("doc_id", F.col("text").cast("string").alias("text"), _text_key(F.col("text")).alias("text_key"))
        return texts.join(joined_matches(docs, bench, s), "text_key").select("doc_id", "item_id", "n_windows", "item_windows")
    out = None
    for items in _blocks(bench, n):
        shared = share(docs.sparkSession, Table(items, s))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            table, known = shared(), Words()
            for b in batches:
                rows = [(b.column(0)[i], m) for i, t in enumerate(b.column(1)) for m in table.match(t.as_py(), known)]
                ids = pa.array([r[0].as_py() for r in rows], b.column(0).type)
                yield pa.RecordBatch.from_arrays([ids, *[pa.array([r[1][k] for r in rows], pa.int64()) for k in range(3)]], names=["doc_id", "item_id", "n_windows", "item_windows"])

        id_type = docs.schema["doc_id"].dataType.simpleString()
        part = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {id_type}, item_id long, n_windows long, item_windows long")
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The rows of `docs`, all columns, that no item contaminates; one map over the rows per block."""
    bench = _items(benchmark)
    if (n := _n_blocks(bench, s)) > s.most_blocks:
        bad_key = _fresh("bad_key", docs.columns)
        bad = joined_matches(docs, bench, s).select(F.col("text_key").alias(bad_key)).distinct()
        return docs.join(bad, _text_key(docs["text"]) == F.col(bad_key), "left_anti")
    for items in _blocks(bench, n):
        shared = share(docs.sparkSession, Table(items, s))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            table, known = shared(), Words()
            for b in batches:
                at = b.schema.get_field_index("text")
                yield b.filter(pa.array([not table.match(t.as_py(), known) for t in b.column(at)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
