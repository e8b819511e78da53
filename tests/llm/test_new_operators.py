"""SimHash links, importance resampling and periodic runs against brute force, and their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import importance, runs, simhash
from corpusmill.llm.queries import QUERIES

LONG = "word" * 20_000 + " " + "lorem ipsum dolor " * 4_000
EDGES = [(0, None), (1, ""), (2, " \t\n"), (3, "a"), (4, "a b"), (5, "\x00\x1f"), (6, "İstanbul ſtraße K"), (7, "x y　z w"), (8, "a\r\nb\x0bc\x0cd"), (9, LONG), (10, "same text here now"), (11, "same text here now"), (11, "same text here now"), (11, "another text of that id"), (None, "a text without an id"), (None, "a text without an id"), (12, "tick tock " * 9)]
CLASHES = ["print", "label", "node", "a", "b", "mask", "value", "count", "n", "low", "feature", "bucket", "gain", "text_hash", "c", "g", "w", "copies", "copy", "able", "number", "score", "rank", "weight", "runs", "start", "length", "period", "__at", "__p", "id"]


def documents(spark, rows, parts=3):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)


def clashing(df):
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHES)])


def split(text, pattern=r"[^\x20\x09-\x0D]+"):
    return re.findall(pattern, text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# ---- 11 SimHash


def brute_print(spark, text):
    w = split(lower(text))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
    if not shingles:
        return 0
    hashes = spark.createDataFrame([(s,) for s in shingles], "s string").select(F.xxhash64("s").alias("h")).toPandas()["h"]
    ones = Counter(k for h in hashes for k in range(64) if h >> k & 1)
    return sum(1 << k for k in range(64) if 2 * ones[k] > len(shingles))


def brute_classes(prints, radius=2):
    """The least id of each row's component, by plain comparison."""
    values = sorted(set(prints.values()))
    label = {v: v for v in values}

    def root(v):
        while label[v] != v:
            v = label[v]
        return v

    for i, x in enumerate(values):
        for y in values[:i]:
            if (x ^ y).bit_count() <= radius:
                label[root(x)] = root(y)
    least = {}
    for k, v in prints.items():
        least[root(v)] = min(k, least.get(root(v), k))
    return {k: least[root(v)] for k, v in prints.items()}


def test_fingerprints_equal_the_definition(spark):
    for text in [t for _, t in EDGES if t != LONG] + ["One two THREE four five one two three four six"]:
        assert simhash.fingerprint((text or "").encode()) == brute_print(spark, text), text


def test_simhash_query_equals_brute_force(spark, sf_dir):
    rows = {r.doc_id: r for r in QUERIES["op11_simhash"](spark, sf_dir).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    assert rows.keys() == texts.keys()
    prints = {k: int(r.fingerprint, 16) for k, r in rows.items()}
    assert prints == {k: simhash.fingerprint((t or "").encode()) for k, t in texts.items()}
    assert {k: r.component_id for k, r in rows.items()} == brute_classes(prints)


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 7])
def test_bit_sliced_pairs(radius):
    rng = random.Random(radius)
    for chunk in (1, 7, 1 << 17):
        sizes = [rng.randrange(1, 150) for _ in range(5)]
        base = [rng.getrandbits(64) for _ in range(4)]
        prints = []
        for _ in range(sum(sizes)):
            x = rng.choice(base)
            for _ in range(rng.randrange(radius + 2)):
                x ^= 1 << rng.randrange(64)
            prints.append(x)
        s = simhash.Settings(radius=radius, chunk=chunk)
        got = {p for a, b in simhash.near_pairs(np.array(prints, np.uint64), np.array(sizes), list(range(64)), s) for p in zip(a.tolist(), b.tolist(), strict=True)}
        want, at = set(), 0
        for m in sizes:
            want |= {(i, j) for i in range(at, at + m) for j in range(i + 1, at + m) if (prints[i] ^ prints[j]).bit_count() <= radius}
            at += m
        assert got == want


def test_finer_parts_keep_all_near_pairs():
    rng = random.Random(1)
    mask = 0
    for _ in range(4):
        parts = simhash.finer(mask, 2)
        assert all(p & mask == mask for p in parts) and sum((p & ~mask).bit_count() for p in parts) == 64 - mask.bit_count()
        for _ in range(300):
            x = rng.getrandbits(64)
            free = simhash.bits_of(~mask)
            y = x ^ sum(1 << k for k in rng.sample(free, 2))
            assert any(x & p == y & p for p in parts)
        mask = parts[rng.randrange(3)]


@pytest.mark.parametrize("bucket", [8, 64, 4096])
def test_crowded_buckets_are_split_without_loss(spark, bucket):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(3)]
    prints = {b ^ sum(1 << k for k in rng.sample(range(40), rng.randrange(7))) for b in base for _ in range(250)} | {0, 1, (1 << 64) - 1}
    df = spark.createDataFrame([(simhash.signed(p),) for p in prints], "print long").repartition(4)
    s = simhash.Settings(bucket=bucket)
    edges = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(df, s).collect()]
    assert all(a != b and (a ^ b).bit_count() <= 20 for a, b in edges)
    joined = {p: p for p in prints}

    def root(v):
        while joined[v] != v:
            v = joined[v]
        return v

    for a, b in edges:
        joined[root(a)] = root(b)
    want = brute_classes({p: p for p in prints})
    groups = {}
    for p in prints:
        groups.setdefault(root(p), set()).add(want[p])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want.values()))


def test_simhash_edges(spark):
    rows = simhash.simhash_digest(clashing(documents(spark, EDGES))).collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in rows) == sorted((i is None, i) for i, _ in EDGES)
    by = {r.doc_id: r for r in rows}
    assert {by[i].fingerprint for i in (0, 1, 2)} == {"0" * 16} and {by[i].component_id for i in (0, 1, 2)} == {0}
    assert by[10].fingerprint in {r.fingerprint for r in rows if r.doc_id == 11} and by[10].component_id == 10
    assert {r.component_id for r in rows if r.doc_id is None} == {None}
    assert simhash.simhash_digest(documents(spark, [])).collect() == []


def test_hot_prints(spark):
    rows = [(i, "one text that a third of all rows share") for i in range(400)] + [(1000 + i, f"text number {i} of many others") for i in range(800)]
    out = {r.doc_id: r.component_id for r in simhash.simhash_digest(documents(spark, rows, 8)).collect()}
    assert out == brute_classes({i: simhash.fingerprint(t.encode()) for i, t in rows})


# ---- 12 importance resampling


def brute_resample(rows, target, s=importance.Settings()):
    """(doc_id, n_features, weight, score, rank) of each row, by id."""

    def count(text):
        w = split(lower(text), r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
        return Counter(" ".join(w[i : i + n]) for n in range(s.low, s.high + 1) for i in range(len(w) - n + 1)), len(w)

    bucket = lambda f: zlib.crc32(f.encode()) % s.buckets
    source, wanted = Counter(), Counter()
    for out, texts in ((source, [t for _, t in rows]), (wanted, target)):
        for t in texts:
            for f, n in count(t)[0].items():
                out[bucket(f)] += n
    big_s, big_t = source.total() + s.buckets, wanted.total() + s.buckets
    gain = {b: math.floor(1000 * math.log((wanted[b] + 1) * big_s / ((source[b] + 1) * big_t))) for b in source}
    out, able = [], []
    for k, (doc_id, text) in enumerate(rows):
        features, words = count(text)
        n = features.total()
        weight = sum(c * gain[bucket(f)] for f, c in features.items()) // n if n else 0
        score = None
        if doc_id is not None:
            h = int(hashlib.sha256(f"{s.seed}:{doc_id}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
            if words >= s.min_words:
                able.append((-score, doc_id, k))
        out.append([doc_id, n, weight, score, None])
    for r, (_, _, k) in enumerate(sorted(able)[: s.percent * len(able) // 100], 1):
        out[k][4] = r
    return sorted(map(tuple, out), key=str)


def rows_of(df):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()), key=str)


def test_resampling_query_equals_brute_force(spark, small_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{small_dir}/benchmark.parquet").select("text").collect()]
    assert rows_of(QUERIES["op12_importance_resampling"](spark, small_dir)) == brute_resample(rows, target)


@pytest.mark.parametrize("s", [importance.Settings(percent=100, min_words=1), importance.Settings(low=1, high=2, buckets=50, most_hot=3, percent=40, min_words=2), importance.Settings(low=2, high=3, most_hot=1)])
def test_resampling_settings_and_edges(spark, s):
    rng = random.Random(7)
    rows = [*EDGES, *((100 + i, " ".join(f"w{int(rng.paretovariate(0.7))}" for _ in range(rng.randrange(40)))) for i in range(150))]
    target = ["w1 w2 w3 w90", None, "lorem ipsum", ""]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id int, text string")
    got = rows_of(importance.resample(clashing(documents(spark, rows)), bench, s))
    want = brute_resample(rows, target, s)
    # rows of one id tie; the text's hash decides between them
    same = lambda x: sorted(((r[:4] if r[0] == 11 else r) for r in x), key=str)
    assert same(got) == same(want)


def test_resampling_of_empty_tables(spark):
    none, some = documents(spark, []), documents(spark, [(1, "a b c " * 10), (2, None)])
    assert importance.resample_digest(none, some).collect() == []
    assert rows_of(importance.resample_digest(some, none)) == brute_resample([(1, "a b c " * 10), (2, None)], [])


# ---- 13 periodic runs


def brute_runs(w):
    out, n = [], len(w)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            e = i + q
            if e - s >= max(6, 4 * q) and not any(all(w[k] == w[k + r] for k in range(s, e - r)) for r in range(1, q)):
                out.append((s, e - s, q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_digest(doc_id, text):
    w = split(text)
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def digest_rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()), key=str)


def test_runs_equal_brute_force():
    rng = random.Random(1)
    cases = [[0, 1, 0, 0, 1, 0, 0, 1, 0, 0, 1] * 6]  # every probe of the long period lies in a run of three
    for _ in range(1500):
        k = rng.choice([1, 2, 2, 3, 5, 50])
        w = [rng.randrange(k) for _ in range(rng.randrange(100))]
        for _ in range(rng.randrange(3)):
            unit = [rng.randrange(k) for _ in range(rng.randrange(1, 13))]
            at = rng.randrange(len(w) + 1)
            w[at:at] = (unit * 9)[: rng.randrange(1, 8 * len(unit) + 1)]
        cases.append(w)
    for w in cases:
        assert [tuple(r) for r in runs.find_runs(np.array(w, np.int32)).tolist()] == brute_runs(w), w


def test_blocks_of_the_grid_give_the_same(monkeypatch):
    w = np.array(([1, 2, 3, 4] * 9 + [5]) * 7, np.int32)
    whole = runs.find_runs(w).tolist()
    monkeypatch.setattr(runs, "BLOCK", 10)
    assert runs.find_runs(w).tolist() == whole != []


def test_many_equal_words_take_little_time():
    assert runs.find_runs(np.zeros(100_000, np.int32)).tolist() == [[0, 100_000, 1]]
    assert len(runs.find_runs(np.repeat(np.arange(20_000) % 2, 6))) == 20_001  # a run for each word, and one over all


def test_runs_query_equals_brute_force(spark, small_dir):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text").collect()]
    short = [(i, t) for i, t in texts if len(split(t)) < 1500]
    got = {r[0]: r for r in digest_rows(QUERIES["op13_periodic_runs"](spark, small_dir))}
    assert got.keys() == {i for i, _ in texts}
    assert [got[i] for i, _ in short] == [brute_digest(i, t) for i, t in short]
    assert sum(r[1] > 0 for r in got.values()) > 10


def test_runs_edges(spark):
    rows = [r for r in EDGES if r[1] != LONG]
    assert digest_rows(runs.runs_digest(clashing(documents(spark, rows)))) == sorted((brute_digest(*r) for r in rows), key=str)
    assert runs.runs_digest(documents(spark, [])).collect() == []
    out = {r.doc_id: r for r in runs.detect(clashing(documents(spark, EDGES))).collect()}
    assert out[12].collapsed == "tick tock" and [tuple(r) for r in out[12].runs] == [(0, 18, 2)]
    assert out[9].collapsed.endswith(" lorem ipsum dolor") and out[9].runs[0].period == 3
