"""Language profiles, class-balanced orders and folds, matching blocks, temperature, reject reports."""

import difflib
import math
import random
import time
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from corpusmill.functions.language import Languages, fit
from corpusmill.functions.matching import ratio
from corpusmill.operators import chunking, gates, layout, ml, ordering, similarity, stats, tables
from corpusmill.plans.queries import QUERIES

# ---- language


@pytest.fixture(scope="module")
def split_docs(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text").withColumn("held", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    return d.cache()


@pytest.fixture(scope="module")
def model(split_docs):
    return fit(split_docs.where("not held"))


def test_language_of_held_out_texts(split_docs, model):
    rows = split_docs.where("held").select("lang", model.detect(F.col("text")).alias("d"), F.length("text").alias("n")).where("n >= 100").collect()
    assert len(rows) > 100 and sum(r.lang == r.d for r in rows) / len(rows) >= 0.97


def brute_language(rows, samples, grams=20_000):
    """The definition, with plain loops."""
    import re

    def fold(t):
        return " " + re.sub(r"[\W\d_]+", " ", (t or "").lower()).strip(" ") + " "

    counts: dict = {}
    for lang, t in rows:
        t = fold(t)
        for i in range(len(t) - 2):
            counts.setdefault(t[i : i + 3], {}).setdefault(lang, 0)
            counts[t[i : i + 3]][lang] += 1
    top = sorted(counts, key=lambda g: (-sum(counts[g].values()), g))[:grams]
    langs = sorted({x for x, _ in rows})
    size = {x: sum(counts[g].get(x, 0) for g in top) for x in langs}
    known = set(top)

    def best(t):
        own = [t[i : i + 3] for i in range(len(t) - 2) if t[i : i + 3] in known]
        score = {x: sum(math.log(counts[g].get(x, 0) + 0.5) - math.log(size[x] + 0.5 * len(top)) for g in own) for x in langs}
        return max(langs, key=score.get) if own else None

    return [best(fold(t)) for t in samples]


def test_language_equals_plain_loops(spark):
    rows = [("de", "Die Straße war lang, und der Wald schwieg."), ("en", "The road was long and the wood was silent."), ("de", "Es war einmal ein König"), ("en", "Once upon a time"), ("fr", "Il était une fois un roi"), (None, "zzz zzz zzz"), ("fr", None)]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    for grams in (20_000, 12):
        m = fit(df, grams=grams)
        samples = ["der lange Weg", "a long way", "une route", "", None, "123 !", "qqq", "ß", "der"]
        got = [r.d for r in spark.createDataFrame(list(enumerate(samples)), "i int, t string").coalesce(1).select(m.detect(F.col("t")).alias("d")).collect()]
        assert got == brute_language([r for r in rows if r[0]], samples, grams)


def test_language_model_is_kept(spark, model, tmp_path):
    model.save(spark, str(tmp_path / "m"))
    again = Languages.load(spark, str(tmp_path / "m"))
    assert again.langs == model.langs and again.best(" der wald ") == model.best(" der wald ")
    assert Languages([]).best("abc") is None


def test_gates_detect_what_is_not_declared(spark, split_docs, model):
    german = split_docs.where("lang = 'de' and length(text) > 400").first().text
    english = split_docs.where("lang = 'en' and length(text) > 400").first().text
    from corpusmill.sources.harvest import SCHEMA

    base = {"header": ("id", None), "title": ["T"], "creator": [], "type": ["article"], "date": ["2010"], "rights": ["CC BY 4.0"], "language": [], "identifier": [], "description": []}
    variants = [{"description": [german]}, {"description": [english]}, {"description": [english], "language": ["deu"]}, {"description": ["too short"]}, {"description": ["12345 " * 20]}]
    df = spark.createDataFrame([tuple((base | v).values()) for v in variants], SCHEMA).coalesce(1)
    assert [r.reject_reason for r in gates.record_gate(df, model).collect()] == [None, "record_not_german", None, None, "record_not_german"]
    docs = spark.createDataFrame([(1, german * 9, "en"), (2, english * 9, "de"), (3, "kurz", "de")], "doc_id long, text string, lang string")
    got = {r.doc_id: r.reject_reason for r in gates.gate_documents(docs, min_words=60, languages=model).collect()}
    assert got[1] != "document_not_german" and got[2] == "document_not_german" and got[3] == "document_too_short_after_cleaning"
    assert [r.g for r in spark.createDataFrame([(german[:99],), (german,), (None,)], "t string").coalesce(1).select(model.is_language(F.col("t")).alias("g")).collect()] == [False, True, False]


def test_paragraphs_of_another_language_go(spark, split_docs, model):
    words = {x: " ".join(split_docs.where(f"lang = '{x}' and length(text) > 900").first().text.split()[:60]) + "." for x in ("de", "en")}
    lines = [("d", 0, b, 0, 0, t, 10.0, False, 0.0, 100.0) for b, t in enumerate([words["de"], words["en"], "Ein kurzer Satz steht auch noch hier im Text drin."])]
    spans = spark.createDataFrame(lines, "doc_id string, page int, block int, line int, span int, text string, size double, bold boolean, x0 double, x1 double")
    pages = spark.createDataFrame([("d", 1)], "doc_id string, n_pages int")
    kept = [r.paragraph[:20] for r in layout.paragraphs(spans, pages, model).collect()]
    all_of = [r.paragraph[:20] for r in layout.paragraphs(spans, pages).collect()]
    assert len(all_of) - len(kept) == 1 and not any(p == words["en"][:20] for p in kept)


# ---- greedy order


def plain_greedy(sizes):
    """One position after another, in exact shares."""
    total, taken, out = sum(sizes), [0] * len(sizes), []
    for step in range(total):
        open_ = [c for c in range(len(sizes)) if taken[c] < sizes[c]]
        c = max(open_, key=lambda c: Fraction(sizes[c], total) * (step + 1) - taken[c])
        taken[c] += 1
        out.append(c)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_order_equals_the_greedy_loop(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.randrange(1, 90) * rng.choice([1, 1, 6]) for _ in range(rng.randrange(1, 6))]
    rows = [(i, c) for i, c in enumerate(c for c, n in enumerate(sizes) for _ in range(n))]
    df = spark.createDataFrame(rows, "id long, label int").repartition(3)
    out = ordering.stratified_order(df, "label", "id", size=rng.choice([7, 64, 10_000]), most_broadcast=rng.choice([0, 100_000])).collect()
    assert [r.position for r in sorted(out, key=lambda r: r.position)] == list(range(len(rows)))
    assert [r.label for r in sorted(out, key=lambda r: r.position)] == plain_greedy(sizes)


def test_ranges_agree_whatever_their_size(spark):
    sizes = [977, 311, 450, 13]
    want = plain_greedy(sizes)
    for size in (5, 100, 1751):
        got = sorted((r.place, r.cls) for r in ordering.class_places(spark, sizes, size).collect())
        assert [c for _, c in got] == want


def test_order_of_odd_tables(spark):
    df = spark.createDataFrame([(i, None if i % 4 == 0 else "x") for i in range(20)], "id long, label string")
    assert sorted(r.position for r in ordering.stratified_order(df, "label", "id").collect()) == list(range(20))
    assert ordering.stratified_order(df.where("false"), "label", "id").collect() == []


# ---- group folds


def fold_table(df, folds):
    cells: dict = {}
    for r in df:
        cells.setdefault(r.label, [0] * folds)[r.fold] += 1
    return cells


@pytest.mark.parametrize("most_patterns", [100_000, 20])
@pytest.mark.parametrize("seed", range(3))
def test_folds_spread_every_class(spark, seed, most_patterns):
    rng = random.Random(seed)
    rows, group = [], 0
    for _ in range(300):
        kind = rng.choice([(1, 0, 0), (0, 2, 0), (1, 1, 1), (rng.randrange(12), rng.randrange(5), 1), (0, 0, 30)])
        rows += [(f"g{group}", c) for c, n in enumerate(kind) for _ in range(n)]
        group += 1
    df = spark.createDataFrame(rows, "g string, label int").repartition(4)
    folds = ordering.group_folds(df, "g", "label", 3, most_patterns=most_patterns)
    assert folds.count() == folds.select("g").distinct().count() == df.select("g").distinct().count()
    cells = fold_table(df.join(folds, "g").collect(), 3)
    for label, own in cells.items():
        largest = max(sum(1 for g, c in rows if c == label and g == x) for x in {g for g, c in rows if c == label})
        assert max(own) - min(own) <= (largest + 3 if most_patterns > 20 else 3 * max(3, largest)), (label, own)


def test_one_pattern_holds_most_groups(spark):
    df = spark.range(3000).select(F.col("id").alias("g"), F.lit(1).alias("label")).unionByName(spark.createDataFrame([(None, 1), (None, None), (7, None)], "g long, label int"))
    out = ordering.group_folds(df, "g", "label").collect()
    sizes = [sum(r.fold == f for r in out) for f in range(3)]
    assert len(out) == 3001 and max(sizes) - min(sizes) <= 1
    assert ordering.group_folds(df.where("false"), "g", "label").collect() == []


def test_grid_search_uses_the_folds(spark):
    rows = [(i // 4, i % 2, ("gut schön hell " if i % 2 else "schlecht dunkel trüb ") * 3 + f"wort{i % 7}") for i in range(120)]
    t = ml.tokens(spark.createDataFrame(rows, "g long, label int, text string"))
    best = ml.grid_search(t, "g", [{"c": 3.0, "min_df": 1.0}], 3)
    assert len(best[0]["scores"]) == 3 and best[0]["mean_accuracy"] == 1.0


def test_rank_in_groups(spark):
    df = spark.range(500).select("id", F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 2).alias("g")).repartition(5)
    got: dict = {}
    for r in tables.rank_in_groups(df, "g", ["id"], "rank").orderBy("id").collect():
        got.setdefault(r.g, []).append(r["rank"])
    assert all(v == list(range(1, len(v) + 1)) for v in got.values()) and len(got) == 3


# ---- matching blocks


def test_ratio_equals_difflib():
    rng = random.Random(2)
    for _ in range(2500):
        k = rng.choice([1, 2, 3, 8, 40])
        a = [str(rng.randrange(k)) for _ in range(rng.randrange(90))]
        b = list(a) if rng.random() < 0.5 else [str(rng.randrange(k)) for _ in range(rng.randrange(90))]
        for _ in range(rng.randrange(6)):
            if b:
                b[rng.randrange(len(b))] = str(rng.randrange(k))
                i = rng.randrange(len(b))
                b = b[i:] + b[:i] if rng.random() < 0.3 else b
        assert ratio(a, b) == difflib.SequenceMatcher(None, a, b, autojunk=False).ratio(), (a, b)


@pytest.mark.parametrize("kind", ["zipf", "two", "one"])
def test_long_pairs_take_bounded_time(kind):
    rng = random.Random(1)
    draw = {"zipf": lambda: str(int(rng.paretovariate(1.0))), "two": lambda: rng.choice("ab"), "one": lambda: "a"}[kind]
    a = [draw() for _ in range(20_000)]
    b = [draw() if rng.random() < 0.2 else w for w in a]
    began = time.time()
    assert 0.5 < ratio(a, b) <= 1 and 0 < ratio(a, [draw() for _ in range(20_000)]) <= 1
    assert time.time() - began < 30  # 0.3 to 0.4 s each, alone on a core


def test_similarity_query_equals_difflib(spark, small_dir):
    pairs = QUERIES["q36_similarity_user_assistant"](spark, small_dir).collect()
    texts = {(r.conv_id, r.turn): r.text for r in spark.read.parquet(f"{small_dir}/conversations.parquet").collect()}
    assert pairs
    for r in pairs:
        a, b = (similarity.WORD.findall(texts[r.conv_id, r.turn + k].lower()) for k in (0, 1))
        want = round(difflib.SequenceMatcher(None, a, b, autojunk=False).ratio(), 6)
        assert r.similarity == pytest.approx(want, abs=1e-6)


# ---- temperature


def test_newton_equals_a_fine_grid(spark):
    rng = random.Random(4)
    for sharp in (0.3, 1.0, 4.0):
        rows = []
        for _ in range(400):
            z = [rng.gauss(0, 1) * sharp for _ in range(3)]
            weights = [math.exp(x / sharp) for x in z]
            rows.append((*z, rng.choices(range(3), weights)[0]))
        df = spark.createDataFrame(rows, "z0 double, z1 double, z2 double, label int").cache()
        t = stats.fit_temperature(df)
        grid = [t + i / 20_000 for i in range(-20, 21)]
        best = min(stats.temperature_grid(df, grid).collect(), key=lambda r: r.nll)
        assert abs(best.temperature - t) <= 1e-4


def test_temperature_of_odd_tables(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1.0, 0)], "z0 double, z1 double, z2 double, label int")
    assert stats.fit_temperature(df) == 1.0 and stats.fit_temperature(df.where("false")) == 1.0
    sure = spark.createDataFrame([(5.0, 0.0, 0.0, 0)] * 3, df.schema)
    assert stats.fit_temperature(sure) == pytest.approx(0.05, rel=0.1)
    wrong = spark.createDataFrame([(5.0, 0.0, 0.0, 1)] * 3, df.schema)
    assert stats.fit_temperature(wrong) == pytest.approx(20.0, rel=0.1)


# ---- reject reports


@pytest.mark.parametrize("parts", [1, 4, 40])
def test_reports_of_clean_and_empty_partitions(spark, parts):
    df = spark.createDataFrame([(i, "r" if i in (3, 5) else None) for i in range(12)], "doc_id long, reject_reason string").repartition(parts)
    assert [tuple(r) for r in gates.reject_report(df).collect()] == [("r", 2, "3,5")]
    assert gates.reject_report(df.where("reject_reason is null")).collect() == []
    assert gates.reject_report(df.where("false")).collect() == []


def test_chunks_equal_a_plain_walk():
    """Against the definition: of all ends, the one nearest the target; ties to the longer."""
    rng = random.Random(0)
    for _ in range(300):
        words = [rng.randrange(1, 60) for _ in range(rng.randrange(1, 60))]
        sums, shift, at = chunking.running(words), rng.randrange(5), 0
        for start, end, target in chunking.chunk_borders(sums, shift):
            assert start == at
            totals = {e: sum(words[at:e]) for e in range(at + 1, len(words) + 1)}
            reached = [e for e in totals if totals[e] >= target]
            want = len(words) if not reached else min((e for e in totals if e <= reached[0]), key=lambda e: (abs(totals[e] - target), -e))
            assert end == want
            at = end
        assert at == len(words)
