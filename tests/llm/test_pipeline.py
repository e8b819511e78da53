"""The pipeline against the stages' brute-force versions."""

import corpus_pipeline
from pyspark.sql import functions as F

from tests.llm.test_llm import EDGES, ITEM, OTHER, base_secrets, bench, brute_components, documents, reference


def test_pipeline(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    columns, seen, at = docs.columns, {}, docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, small_dir).cache()
        seen[name] = (at, out)
        if name != "byte_bpe":
            assert out.columns == columns
        at = out
    rows = lambda df: {r.doc_id: r for r in df.collect()}

    before, after = map(rows, seen["ngram_jaccard_join"])
    classes = brute_components({i: r.text for i, r in before.items()}, 5, 80)
    assert set(after) == {i for i, (n, c) in classes.items() if c == i}

    before, after = map(rows, seen["benchmark_decontamination"])
    items = [r.text for r in spark.read.parquet(f"{small_dir}/benchmark.parquet").collect()]
    assert not any(x in r.text for r in after.values() for x in items)
    assert len(before) - len(after) < 0.1 * len(before)

    before, after = map(rows, seen["secret_scans"])
    assert set(before) == set(after)
    for i, r in after.items():
        assert not base_secrets(r.text) and r.n_chars == len(r.text)
        if not base_secrets(before[i].text):
            assert r.text == before[i].text or "CREDENTIAL_REMOVED" in r.text

    before, after = map(rows, seen["byte_bpe"])
    coder = reference()
    assert all(list(r.ids) == coder.encode_ordinary(before[i].text) for i, r in after.items()) and set(before) == set(after)

    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, small_dir).collect()) == sorted(after)
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "language_id" and corpus_pipeline.ORACLE_SQL is None


CLASHES = ("row_key", "gone_key", "text_md5", "posterior", "k_c0", "declared", "id", "secrets", "__text")


def test_pipeline_edges(spark, tmp_path):
    """Nulls, empty and very long texts, ties, repeated rows and extra columns of clashing names."""
    prose = "the house of the old man stands by the river and the water runs under the bridge in the evening"
    texts = [*EDGES, *[f"{prose} {i} {i * 7} {i * 31} and then a {i} th of these" for i in range(40)], f"note {OTHER} end", "see token=abcdefgh12 in this text of the house", prose, prose]
    docs = documents(spark, texts, [None, None, *range(len(texts) - 4), 7, 7])
    docs = docs.withColumns({c: F.lit("x") for c in CLASHES})
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    bench(spark, [(1, ITEM), (2, None), (3, "")]).write.parquet(str(tmp_path / "benchmark.parquet"))
    seen, at = {}, spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, at, str(tmp_path))
        assert out.columns == docs.columns
        at = out.cache()
        seen[name] = [r.text for r in at.collect()]
    assert None not in seen["language_id"] and "" not in seen["language_id"]
    assert seen["ngram_jaccard_join"].count(prose) == seen["ngram_jaccard_join"].count("same text here now") == 1
    assert any(OTHER in t for t in seen["ngram_jaccard_join"]) and not any(OTHER in t for t in seen["benchmark_decontamination"])
    assert not any("abcdefgh12" in t for t in seen["secret_scans"]) and len(seen["secret_scans"]) == len(seen["benchmark_decontamination"])
    coder = reference()
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(tuple(r.ids) for r in rows) == sorted(tuple(coder.encode_ordinary(t)) for t in seen["secret_scans"])


def test_pipeline_of_empty_tables(spark, tmp_path):
    documents(spark, ["x"]).limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    bench(spark, []).write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
