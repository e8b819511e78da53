"""Golden cases of the text and scalar functions."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import scalars as S
from corpusmill.functions import sentences as Z
from corpusmill.functions import text as T


def apply(spark, f, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


CASES = [
    (T.clean_whitespace, ["a  b\r\nc \n\n\n\n d ", None, "  "], ["a b\n\nc\n\nd", "", ""]),
    (T.flatten_whitespace, [" a\n\tb  c "], ["a b c"]),
    (T.word_count, ["a b c", "", " "], [3, 0, 0]),
    (T.real_word_count, ["Größe Übung ß 42 3,5 % – (z.B.)"], [4]),
    (T.fix_hyphenation, ["Wirt- schaft", "Berufs- und Wirtschaft", "Covid- 19", "Online- Plattformen", "Ein- unter", "Ein- als ob"], ["Wirtschaft", "Berufs- und Wirtschaft", "Covid-19", "Online-Plattformen", "Einunter", "Ein- als ob"]),
    (T.remove_footnote_numbers, ["gearbeitet30.", "(Storytelling)29 dar", "werden.12 Die", "COVID-19", "CO2", "Abb.1", "S. 45"], ["gearbeitet.", "(Storytelling) dar", "werden. Die", "COVID-19", "CO2", "Abb.1", "S. 45"]),
    (T.fix_spacing, ["(s.o. II. 3.) .", "( Abb. 2)", "… sind. “ Ein"], ["(s.o. II. 3.).", "(Abb. 2)", "… sind.“ Ein"]),
    (T.normalize_characters, ["Infra­ struktur", "ﬁn​al", "a\x07b‐c", " x ▪ y"], ["Infrastruktur", "final", "ab-c", "• x • y"]),
    (T.clean_plain_text, ["a https://x.y/z b\n 12 \n=====\nc"], ["a b\n\nc"]),
    (T.glued_word_count, ["ImgesamtenProzesswerden YouTube AssistentInnenvertretung", "aufweist,sondern b", "kommunikationswissenschaftlichen"], [1, 1, 0]),
    (T.document_damage, ["� " * 6, "ok text", "abweist,sondern " * 6], ["document_broken_characters", None, "document_missing_spaces"]),
    (T.uses_old_spelling, ["daß er muß", "daß er muss und dass", "daß"], [True, False, False]),
    (T.html_escape, ["<a href=\"x\">&'"], ["&lt;a href=&quot;x&quot;&gt;&amp;&#x27;"]),
    (T.word_tokens, ["Größe, Übung; ß!"], [["größe", "übung", "ß"]]),
    (T.sha256_text, ["a"], ["ca978112ca1bbdcafac231b39a23dc4da786eff8147c4e72b9807785afee48bb"]),
    (S.parse_date, ["2019-03-04", "am 3.5.2010", "3.13.2010", "2019-02-30 x", "um 1789", "1499", "o. J.", None], [dt.date(2019, 3, 4), dt.date(2010, 5, 3), dt.date(2010, 12, 31), dt.date(2019, 12, 31), dt.date(1789, 12, 31), None, None, None]),
    (S.id_number, ["46", "46.0", " 46 ", "human-46", "assisted-46", "46.5", "student-46", "human-", "abc", None], [46, 46, 46, 46, 46, None, None, None, None, None]),
]


@pytest.mark.parametrize("f, given, want", CASES, ids=[c[0].__name__ for c in CASES])
def test_golden(spark, f, given, want):
    assert apply(spark, f, given) == want


def test_bins(spark):
    assert apply(spark, S.length_bin, [0, 70, 71, 750, 751, None], "int") == ["≤70", "≤70", "71–150", "501–750", "751+", None]
    assert apply(spark, lambda c: S.length_bin(c, True), [0, 1], "int") == [None, "≤70"]
    want = ["≤60%", "≤60%", "60–70%", "60–70%", "70–80%", "80–90%", ">90%", ">90%"]
    assert apply(spark, S.similarity_bin, [0.0, 0.6, 0.6001, 0.7, 0.75, 0.9, 0.95, 1.0], "double") == want


def test_perturbations(spark):
    p = lambda kind, *texts: apply(spark, lambda c: T.perturb(c, kind), list(texts))
    assert p("double_spaces", "A. B! C") == ["A.  B!  C"]
    assert p("quotes", "„a“ und “b”", "none") == ["“a” und „b“", None]
    assert p("numbers", "2019 und 7", "x") == ["2021 und 8", None]
    assert p("cited_name", "Esser (1999) und Esser", "Müller 2001", "x") == ["Müller (1999) und Müller", "Schmidt 2001", None]
    assert p("newline", "x") == ["x\n"]


def test_probabilities(spark):
    df = spark.createDataFrame([(1, 0.2, 0.4, 0.4), (2, 0.5, 0.5, 0.0), (3, 0.0, 0.0, 1.0)], "i int, a double, b double, c double")
    r = df.select("i", S.argmax([F.col(x) for x in "abc"]).alias("k"), S.human_vs_ai(F.col("a"), F.col("b")).alias("h"), F.array(*S.softmax([F.col(x) for x in "abc"], 0.5)).alias("s")).orderBy("i").collect()
    assert [x.k for x in r] == [1, 0, 2] and [x.h for x in r] == [1, 1, 0]
    assert all(abs(sum(x.s) - 1) < 1e-12 for x in r)


def test_parse_prediction(spark):
    ok = '```json\n{"label": 1, "human_probability": 0.2, "ai_probability": 0.7, "ai_assisted_probability": 0.1}\n```'
    bad = [ok.replace('"label": 1', '"label": 0'), ok.replace("0.7", "0.9"), ok.replace('"label": 1', '"label": 7'), "no", None]
    r = apply(spark, S.parse_prediction, [ok, *bad])
    assert r[0]["label"] == 1 and r[0]["p_ai_generated"] == 0.7 and r[0]["error"] is None
    assert [x["error"] for x in r[1:5]] == ["label_is_not_the_largest", "probabilities_do_not_sum_to_1", "label_unknown", "not_json"] and all(x["label"] is None for x in r[1:])


def test_original_number(spark):
    rows = [("assisted-46", "47.0"), ("assisted-46", None), ("9", None), ("x", "46")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, id string, seed string")
    assert [r.o for r in df.select("i", S.original_number(F.col("id"), F.col("seed")).alias("o")).orderBy("i").collect()] == [47, 46, None, 46]
    with pytest.raises(Exception, match="Unrecognised id"):
        df.select(S.require_id(F.col("id"))).collect()


def test_length_range(spark):
    df = spark.createDataFrame([(300, "source_based"), (1, "topics"), (1, "source_based")], "n int, s string")
    assert [tuple(r.r) for r in df.select(S.length_range(F.col("n"), F.col("s")).alias("r")).collect()] == [(240, 360), (1, 1), (0, 1)]


def test_corpus_sentences():
    s = Z.corpus_sentences
    assert s("Im 19. Jahrhundert war das so. Danach nicht mehr.") == ["Im 19. Jahrhundert war das so.", "Danach nicht mehr."]
    assert s("Siehe S. 45. Danach mehr.") == ["Siehe S. 45.", "Danach mehr."]
    assert s("Das gilt z.B. auch hier. Und bzw. dort.") == ["Das gilt z.B. auch hier.", "Und bzw. dort."]
    assert s("Pi ist 3.14 groß. Ende ohne Punkt") == ["Pi ist 3.14 groß."]
    assert s("(wirklich?) zum Beispiel. „Ja!“ Gut.") == ["(wirklich?) zum Beispiel.", "„Ja!“ Gut."] or s("A?! B...")
    assert s("A. Müller kam. So... Weiter!") == ["A. Müller kam.", "So...", "Weiter!"] and s(None) == s("") == []


def test_app_spans():
    cut = lambda t: [t[a:b] for a, b in Z.app_spans(t)]
    assert cut("Satz eins. Satz zwei! Satz drei?") == ["Satz eins.", "Satz zwei!", "Satz drei?"]
    assert cut("Das gilt z.B. auch hier.") == ["Das gilt z.B. auch hier."] and cut("Es war am 3. Mai soweit.") == ["Es war am 3. Mai soweit."]
    assert cut("Eins\n\nZwei ohne Ende") == ["Eins", "Zwei ohne Ende"] and cut("") == []


@pytest.mark.parametrize("seed", range(20))
def test_app_spans_keep_all_text(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(["Wort", " ", ". ", "! ", "\n\n", "z.B. ", "3. ", "»", "“ "]) for _ in range(60))
    spans = Z.app_spans(text)
    assert re.sub(r"\s", "", text) == re.sub(r"\s", "", "".join(text[a:b] for a, b in spans))
    assert all(a < b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))


def test_spelling(spark):
    rows = lambda *texts: [tuple(r.m) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(Z.modernize_spelling(F.col("t")).alias("m")).collect()]
    old = "daß läßt Prozeß bewußt mußte Mißbrauch müßte bißchen Mißerfolg".split()
    new = "dass lässt Prozess bewusst musste Missbrauch müsste bisschen Misserfolg"
    keep = "Maß Maßnahme gemäß Fuß Spaß saß heißt groß aß"
    assert rows(" ".join(old), keep, None, "", f"x-{old[0]}, 1ß!") == [(new, len(old)), (keep, 0), (None, 0), ("", 0), ("x-dass, 1ß!", 1)]


def test_splits_follow_the_hash(spark):
    import hashlib

    ids = [f"doc-{i}" for i in range(200)]
    k = [int(hashlib.sha256(i.encode()).hexdigest()[:8], 16) % 1000 for i in ids]
    assert apply(spark, S.assign_split, ids) == ["train" if x < 800 else "validation" if x < 900 else "test" for x in k]
