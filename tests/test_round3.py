"""Cases of the third round's findings: small tables on which queries once differed from their SQL, and bounds."""

import os
import tracemalloc

import duckdb
import pyarrow as pa
import pytest

import __spark_entry__
from corpusmill.llm import sharding


def both(spark, folder, name, texts):
    """The rows of a query and of its SQL over `documents` of these texts, in order."""
    docs = [(i, t, "de", "a", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(os.path.join(folder, "documents.parquet"))
    out = __spark_entry__.queries()[name](spark, str(folder))
    with duckdb.connect() as con:
        con.execute(f"create view documents as select * from read_parquet('{folder}/documents.parquet/*.parquet')")
        want = con.execute(__spark_entry__.oracle_sql()[name])
        names = [c[0] for c in want.description]
        return sorted(map(repr, map(tuple, out.select(*names).collect()))), sorted(map(repr, want.fetchall()))


WORDS = "Diese Zeile hat genug verschiedene Wörter damit das Tor nicht an der Länge scheitert und am Ende steht ein Punkt sowie noch vieles mehr was hier nur als Füllung dient weil fünfunddreißig Wörter nötig sind bevor andere Regeln gelten"
INDEXED = f"{WORDS} chérement 12, 13, 14 und réparer 3, 4, 5 und so weiter²."  # SQL sees a word begin after é


@pytest.mark.parametrize("name", ["q05_prose_metrics", "q05b_prose_gate"])
def test_prose_as_sql_has_it(spark, tmp_path, name):
    spark_rows, sql_rows = both(spark, tmp_path, name, [INDEXED, WORDS + ".", INDEXED.replace("é", "e"), f"{WORDS} ٣ ٤."])
    assert spark_rows == sql_rows


ODD = [
    None, "", ". . .", "Er sagt (siehe oben.). Dann . . kam er.", "Ende. ªb", "Ende! ⓐ ja", "m².5.", "Am ٣. Mai ist Ruhe.", "Vgl. bzw\n. Ja.", "Wort İ. Ja.", "Wort K. Ja.",
    f"{WORDS}\x1cnoch\x1fein 1\x1d2 Wort.\x1c", "Wort " * 33 + "a\x1cb.", f"{WORDS}. ", f"{WORDS}.\n", "\u3000 ", "ΣΑΣ σας " * 9 + "Wort ΣΑΣ σασ σας İa ia " * 5 + "Ende.",
]


@pytest.mark.parametrize("name", ["q05_prose_metrics", "q05b_prose_gate", "q17_sentences_per_doc"])
def test_odd_texts_as_sql_has_them(spark, tmp_path, name):
    """Marks after marks, small letters and digits beyond ASCII's, separators, edges and case of single letters."""
    spark_rows, sql_rows = both(spark, tmp_path, name, ODD)
    assert spark_rows == sql_rows and len(sql_rows) == len(ODD)


def test_chunk_gate_as_sql_has_it(spark, tmp_path):
    letters = "abcdefghij"
    word = lambda n: "w" + "".join(letters[int(d)] for d in str(n))
    sentence = lambda i, x: f"Der {' '.join(word(9 * i + k) for k in range(9))} {x} {word(7000 + i)}."
    texts = [" ".join(sentence(i, x) for i in range(300)) for x in ("réments. dann geht", "éISBN", "éEUR 5", "éMüller, A. und éMaier, C.", "ein@ort.é", "nichts")]
    spark_rows, sql_rows = both(spark, tmp_path, "q19_chunk_gate", texts)
    assert spark_rows == sql_rows and len(sql_rows) > 2


def test_cited_names_as_sql_has_them(spark, tmp_path):
    texts = ["Nach Ältere (2001) und Maier (2002) gilt das, sagt Maier.", "Nach Ältere (2001).", "éÄltere 2001, xÄltere 2002", "Müller et al., 2001 und éMüller und Müllers"]
    spark_rows, sql_rows = both(spark, tmp_path, "q66b_perturbed_quotes_numbers_names", texts)
    assert spark_rows == sql_rows


@pytest.mark.parametrize("mean", [250_000, 1_500_000])
def test_shards_are_even_where_slots_outweigh_the_largest_record(mean):
    loads = {v: (100, mean + v * 7919 % 80_000) for v in range(sharding.SLOTS)}
    edited = sharding.rebalance(sharding.plan({v: (n, n) for v, (n, _) in loads.items()}, 16), loads, 16, 0.0)
    bytes_of = [sum(loads[v][1] for v, s in edited.items() if s == k) for k in range(16)]
    assert sorted(edited) == sorted(loads) and max(bytes_of) - min(bytes_of) < 1_000


LONG = "Ein Satz geht hier zu Ende. " * 200


def test_sentences_of_many_texts_are_split_in_slices():
    from corpusmill.functions import sentences

    texts = pa.array([None, "", *[LONG] * 2000])
    for f in (sentences._sentences, sentences._spans):
        tracemalloc.start()
        out = f.func(texts)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert [len(x) for x in out.to_pylist()] == [0, 0, *[200] * 2000] and peak < 20e6


def outputs(monkeypatch, make, rows):
    """What the map that `make` adds to a table gives for one batch of rows, batch by batch."""
    found = []
    monkeypatch.setattr("pyspark.sql.classic.dataframe.DataFrame.mapInArrow", lambda self, f, schema: found.append(f) or self.sparkSession.createDataFrame([], schema))
    make()
    return list(found[0](iter([rows])))


def test_windows_come_in_slices(spark, monkeypatch):
    from corpusmill.operators import detect

    docs = spark.createDataFrame([(0, "a")], "doc_id long, text string")
    rows = pa.RecordBatch.from_pydict({"id": list(range(1000)), "t": [LONG.strip()] * 1000})
    for with_text in (True, False):
        out = outputs(monkeypatch, lambda: detect.windows(docs, with_text=with_text), rows)  # noqa: B023
        assert max(len(set(b["id"].to_pylist())) for b in out) < 110 and [i for b in out for i in b["id"].to_pylist()] == sorted(i for b in out for i in b["id"].to_pylist())
        assert {i for b in out for i in b["id"].to_pylist()} == set(range(1000)) and ("window_text" in out[0].schema.names) == with_text


def test_chunks_come_in_slices(spark, monkeypatch):
    from corpusmill.operators import chunking

    docs = spark.createDataFrame([(0, "a")], "doc_id long, text string")
    rows = pa.RecordBatch.from_pydict({"document_id": [str(i) for i in range(1000)], "text": [LONG] * 1000})
    out = outputs(monkeypatch, lambda: chunking.chunk_documents(docs), rows)
    assert max(len(set(b["document_id"].to_pylist())) for b in out) < 110 and sum(b.num_rows for b in out) == sum(len(chunking.chunks_of(LONG, str(i))) for i in range(1000))


def test_the_assembly_shuffles_no_human_text(spark):
    from corpusmill.operators import dataset

    human = spark.createDataFrame([(1, "ein  mensch schrieb " * 10, "train"), (2, "gleich " * 30, "train")], "sample_id long, text string, split string")
    ai = spark.createDataFrame([(1, "eine maschine schrieb " * 10), (2, " " + "gleich " * 30)], "seed_id long, text string")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows, skipped = dataset.assemble(human, ai, ai, dataset.generator_ranges(spark))
        assert sorted(r["id"] for r in rows.collect()) == ["assisted-1", "generated-1", "human-1", "human-2"]
        assert sorted(r["skip_reason"] for r in skipped.collect()) == ["unchanged_assisted", "unchanged_generated"]
        assert "human_text" not in rows._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_similarity_is_computed_once(spark, small_dir):
    plan = __spark_entry__.queries()["q36b_misses_by_similarity"](spark, small_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_files_of_the_sink_are_read_by_part(spark, tmp_path):
    from corpusmill.sources import files, sinks

    spark.dataSource.register(sinks.TextFiles)
    texts = {f"{i}.txt": f"Zeile {i}\nnoch ü" * (i % 4) for i in range(40)}
    spark.createDataFrame(list(texts.items()), "name string, text string").repartition(3).write.format("one_file_per_row").mode("append").save(str(tmp_path / "out"))
    back = files.read_parts(spark, str(tmp_path / "out"), together=7)
    assert dict(map(tuple, back.collect())) == texts and back.rdd.getNumPartitions() == 3


def test_scored_sentences_come_in_slices(spark, monkeypatch):
    from corpusmill.operators import detect

    docs = spark.createDataFrame([(0, "a")], "doc_id long, text string")
    rows = pa.RecordBatch.from_pydict({"id": list(range(300)), "t": ["Ein z.B. kurzer Satz.\n \nNoch einer?) Und  Schluss", "a\nb"] + [LONG.strip()] * 298})
    out = outputs(monkeypatch, lambda: detect.scored_sentences(docs, detect.lexical_scorer), rows)
    table = pa.Table.from_batches(out).to_pylist()
    assert len(out) >= 3 and [(r["start"], r["end"], r["words"]) for r in table[:4]] == [(0, 21, 4), (24, 36, 2), (37, 49, 2), (0, 3, 2)]
    assert len(table) == 4 + 298 * 200 and all(abs(r["p0"] + r["p1"] + r["p2"] - 1) < 1e-9 for r in table)


def test_spans_are_not_sorted_for_sizes(spark):
    from corpusmill.operators import layout

    big = 2**31 - 1
    rows = [(1, big, big, big, big, "vier", 8.0), (1, big, big, big, big - 1, "fünf", 9.0), (1, big, big, big, 0, " ", 7.0), (2, 0, 1, 0, 0, "abc", 8.0), (2, 0, 0, big, big, "abc", 9.0), (3, 1, 0, 0, 0, "abcd", 8.0), (3, 0, big, 0, 0, "abc", 9.0)]
    spans = spark.createDataFrame([(*r, False, 0.0, 1.0) for r in rows], "doc_id long, page int, block int, line int, span int, text string, size double, bold boolean, x0 double, x1 double")
    assert {r.doc_id: r.body_size for r in layout.body_size(spans).collect()} == {1: 9.0, 2: 9.0, 3: 8.0}
    plan = layout.lines_of(spans)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "SortAggregate(key=[doc_id#" in plan and ", size#" not in "".join(x for x in plan.split("\n") if "SortAggregate" in x)


def test_a_commit_covers_a_file_for_each_core(spark, tmp_path, monkeypatch):
    from corpusmill.streaming import scoring

    docs = spark.createDataFrame([(i, "ein Wort " * (i % 5)) for i in range(400)], "doc_id long, text string")
    docs.repartition(32).write.parquet(str(tmp_path / "documents.parquet"))
    files, found, queue, scored = [], [], scoring.queue, scoring.scored
    monkeypatch.setattr(scoring, "queue", lambda rows, path, every: (queue(rows, path, 20), files.extend(f for f in os.listdir(path.removeprefix("file:")) if f.startswith("part-"))))
    monkeypatch.setattr(scoring, "scored", lambda spark, out: found.append(out) or scored(spark, out))
    rows = __spark_entry__.queries()["q71_scored_in_batches"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, rows)) == [(i, 9 * (i % 5), 2 * (i % 5)) for i in range(400)]
    batches = [f for f in os.listdir(found[0].removeprefix("file:")) if f.startswith("batch=")]
    assert len(files) >= 20 and len(batches) == -(-len(files) // spark.sparkContext.defaultParallelism)


def test_two_classes_are_fitted_by_their_difference(spark):
    from pyspark.ml.classification import LogisticRegression

    from corpusmill.operators import ml

    texts = [f"wort{i % 7} text{i % 5} rest{i % 3} {'gut' if i % 3 else 'übel'}" for i in range(60)]
    for classes, rows in ((2, 1), (3, 3)):
        df = ml.tokens(spark.createDataFrame([(t, (i + i // 4) % classes) for i, t in enumerate(texts)], "text string, label int"))
        model = ml.fit(df, min_df=1.0, tolerance=1e-12)
        features = model.transform(df).drop("rawPrediction", "probability", "prediction")
        plain = LogisticRegression(family="multinomial", regParam=1.0 / (3.0 * len(texts)), standardization=False, maxIter=1_000, tol=1e-12).fit(features)
        both = [[r.probability.toArray().tolist() for r in m.transform(f).orderBy("text", "label").collect()] for m, f in ((plain, features), (model, df))]
        assert model.stages[-1].coefficientMatrix.numRows == rows and len(both[0]) == len(texts)
        assert all(a == pytest.approx(b, abs=1e-4) for a, b in zip(*both, strict=True))
