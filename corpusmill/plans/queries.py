"""The catalogue of queries with the SQL that DuckDB checks them by.

A query takes (spark, sf_dir). Where SQL cannot express one, it has none and is tested by hand-made
or brute-force cases.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import language
from ..functions import scalars as S
from ..functions import text as T
from ..functions.sentences import modernize_spelling, split_sentences_app, split_sentences_corpus
from ..operators import chunking, dataset, dedup, detect, gates, generate, layout, metrics, ml, ordering, similarity, stats
from ..operators.tables import shared_folder, written
from ..sources import files, sinks, store
from ..sources import pages as P
from ..streaming import ingest, scoring
from . import sentence_sql as chain

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
MODELS = {"a": 4, "b": 5, "c": 7, "d": 9, "e": 12}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.synthetic_predictions(table(spark, sf_dir, "documents"), MODELS)


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


# ---- SQL building blocks: the same meaning, written for DuckDB

HASH = "('0x' || substr(sha256({}), 1, 8))::BIGINT"
SPLIT = "CASE WHEN k < 800 THEN 'train' WHEN k < 900 THEN 'validation' ELSE 'test' END"
DOCS = f"d AS (SELECT *, len(regexp_extract_all(text, '\\S+'))::BIGINT AS words, {HASH.format('doc_id::VARCHAR')} % 1000 AS k FROM documents), docs AS (SELECT *, {SPLIT} AS split FROM d)"
BIN = "CASE WHEN {0} <= 70 THEN '≤70' WHEN {0} <= 150 THEN '71–150' WHEN {0} <= 300 THEN '151–300' WHEN {0} <= 500 THEN '301–500' WHEN {0} <= 750 THEN '501–750' ELSE '751+' END"
PREDS = f"""m AS (SELECT * FROM (VALUES {', '.join(f"('{m}', {e})" for m, e in MODELS.items())}) t(model, err)),
h AS (SELECT doc_id AS id, len(regexp_extract_all(text, '\\S+'))::BIGINT AS word_count, source, (doc_id % 3)::INT AS label, model, err, {HASH.format("doc_id::VARCHAR || ':' || model")} AS h FROM documents, m),
g AS (SELECT *, (CASE WHEN h % 100 < err OR id % 37 = 0 THEN (label + 1 + (h // 100) % 2) % 3 ELSE label END)::INT AS pred, 0.5::DOUBLE + ((h // 1000) % 500)::DOUBLE / 1000.0::DOUBLE AS conf FROM h),
p AS (SELECT id, word_count, source, label, model, pred, conf, CASE WHEN pred = 0 THEN conf ELSE (1 - conf) / 2 END AS p0, CASE WHEN pred = 1 THEN conf ELSE (1 - conf) / 2 END AS p1, CASE WHEN pred = 2 THEN conf ELSE (1 - conf) / 2 END AS p2,
CASE WHEN label > 0 THEN (['deepseek-flash', 'gemini', 'gpt-5.6-luna', 'gpt-6-luna'])[id % 4 + 1] END AS generator_model FROM g)"""
ERRORS = ", ".join(f"round(avg((pred <> {k})::INT) FILTER (WHERE label = {k}), 6) AS error_{k}" for k in range(3))


# ---- corpus


@query(f"WITH {DOCS} SELECT split, lang, count(*) AS n, sum(words)::BIGINT AS words FROM docs GROUP BY ROLLUP(split, lang)")
def q01_split_lang_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(S.assign_split(F.col("doc_id").cast("string")).alias("split"), "lang", T.word_count(F.col("text")).cast("long").alias("w"))
    return d.rollup("split", "lang").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("words"))


@query(f"WITH {DOCS} SELECT lang, count(*) AS n, min(words) AS min_words, median(words) AS median_words, max(words) AS max_words, max(length(text))::BIGINT AS max_chars FROM docs GROUP BY lang")
def q02_word_char_stats_by_lang(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("w", T.word_count(F.col("text")).cast("long"))
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("w").alias("min_words"), F.median("w").alias("median_words"), F.max("w").alias("max_words"), F.max(T.character_count(F.col("text"))).cast("long").alias("max_chars"))


@query(f"WITH {DOCS}, b AS (SELECT source, {BIN.format('words')} AS length_bin FROM docs) SELECT source, length_bin, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY source), 6) AS share FROM b GROUP BY source, length_bin")
def q03_length_bins_by_source(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", S.length_bin(T.word_count(F.col("text"))).alias("length_bin"))
    g = d.groupBy("source", "length_bin").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("source")), 6))


@query(f"""WITH {DOCS}, r AS (SELECT doc_id, CASE WHEN words < 400 THEN 'document_too_short_after_cleaning' WHEN lang <> 'de' THEN 'document_not_german' END AS reject_reason FROM docs),
k AS (SELECT reject_reason, doc_id, row_number() OVER (PARTITION BY reject_reason ORDER BY doc_id) AS i, count(*) OVER (PARTITION BY reject_reason) AS n FROM r WHERE reject_reason IS NOT NULL)
SELECT reject_reason, max(n)::BIGINT AS n, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS examples FROM k WHERE i <= 3 GROUP BY reject_reason""")
def q04_reject_funnel(spark, sf_dir):
    return gates.reject_report(gates.gate_documents(table(spark, sf_dir, "documents")))


W = "list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda x: x <> '')"


PLAIN = "list_filter(list_transform(w, lambda x: regexp_replace(lower(x), '[^\\p{L}\\p{M}\\p{N}_]+', '', 'g')), lambda x: x <> '')"


@query(f"""WITH w AS (SELECT doc_id, text, {W} AS w FROM documents), c AS (SELECT doc_id, len(w)::INT AS n_words, regexp_matches(text, '[.!?]["''»”’)\\]}}]*$') AS ends_with_mark,
len(list_filter(w, lambda x: regexp_matches(x, '\\d')))::INT AS n_numeric, len(list_filter(w, lambda x: regexp_matches(x, '\\d') AND regexp_matches(x, '[A-Za-zÄÖÜäöüß]')))::INT AS n_mixed, len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-zÄÖÜäöüß]')))::INT AS n_alphabetic,
len(regexp_extract_all(text, '[,;:/|]'))::INT AS n_punctuation, len(regexp_extract_all(text, '\\b[A-Za-zÄÖÜäöüß\\-]{{3,}}\\s+\\d+(?:\\s*[,.;]\\s*\\d+){{2,}}'))::INT AS n_index, len(regexp_extract_all(text, '\\d+\\s*,\\s*\\d+\\s*,\\s*\\d+'))::INT AS n_number_runs,
len({PLAIN})::INT AS n_plain, len(list_distinct({PLAIN}))::INT AS n_distinct FROM w)
SELECT *, CASE WHEN n_words < 35 THEN 'under_35_words' WHEN NOT ends_with_mark THEN 'no_end_mark' WHEN n_numeric > 0.15 * n_words THEN 'numeric' WHEN n_mixed > 0.03 * n_words THEN 'mixed_tokens' WHEN n_alphabetic < 0.72 * n_words THEN 'not_alphabetic' WHEN n_index >= 2 THEN 'index' WHEN n_number_runs >= 2 THEN 'number_runs' WHEN n_punctuation > 0.30 * n_words THEN 'punctuation' WHEN n_distinct < 0.22 * n_plain THEN 'repetitive' END AS reason FROM c""")
def q05_prose_metrics(spark, sf_dir):
    """All measures and rules of the prose gate but the two about sentences, which SQL cannot split."""
    m = gates.prose_measures(table(spark, sf_dir, "documents").select("doc_id", "text"), with_sentences=False)
    return m.withColumn("reason", gates.prose_reason(sentences=False)).drop("text")


@query(chain.PROSE_GATE)
def q05b_prose_gate(spark, sf_dir):
    """The whole prose gate."""
    m = gates.prose_measures(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return m.select("doc_id", F.size("sentence_words").alias("n_sentences"), gates.prose_reason().alias("reason"))


@query("SELECT doc_id, lang, source, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def q06_exact_dedup_first_wins(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", F.sha2("text", 256).alias("hash"))
    return dedup.first_of_each(d, "hash", ["doc_id"]).drop("hash")


@query("SELECT doc_id, source, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents) WHERE rank <= 20")
def q07_source_cap_topn(spark, sf_dir):
    return dedup.cap_per_group(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", ["doc_id"], 20)


@query("SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY sha256('17:' || doc_id::VARCHAR), doc_id) AS r FROM documents) WHERE r <= 7")
def q08_stratified_sample_by_lang(spark, sf_dir):
    return dedup.stratified_sample(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", 7).drop("rank")


@query("""WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT doc_id, source FROM r WHERE n <= 3 OR i IN (0, round_even((n - 1) / 2.0, 0)::BIGINT, n - 1)""")
def q09_evenly_spaced_docs_per_source(spark, sf_dir):
    return chunking.evenly_spaced(table(spark, sf_dir, "documents").select("doc_id", "source"), ["source"], "doc_id", 3)


@query("SELECT sha256(text) AS key, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def q10_duplicate_text_groups(spark, sf_dir):
    return dedup.duplicate_groups(table(spark, sf_dir, "documents"), F.sha2("text", 256), "doc_id")


@query(f"WITH {DOCS} SELECT 'text_in_two_splits' AS problem, sha256(text) AS key FROM docs GROUP BY 2 HAVING min(split) <> max(split)")
def q11_split_leakage(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("hash"), S.assign_split(F.col("doc_id").cast("string")).alias("split"))
    return dataset.leaks(d, "hash", "text_in_two_splits")


@query("SELECT d.source, count(*) AS n, count(l.doc_id) AS labelled, count(*) FILTER (WHERE l.doc_id IS NULL) AS missing FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.source")
def q12_label_coverage(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("has")), "doc_id", "left")
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("has").alias("labelled"), F.count_if(F.col("has").isNull()).alias("missing"))


@query("SELECT quality, count(*) FILTER (WHERE toxic = 0) AS toxic_0, count(*) FILTER (WHERE toxic = 1) AS toxic_1 FROM labels GROUP BY ROLLUP(quality)")
def q13_quality_toxic_contingency(spark, sf_dir):
    return table(spark, sf_dir, "labels").rollup("quality").agg(F.count_if(F.col("toxic") == 0).alias("toxic_0"), F.count_if(F.col("toxic") == 1).alias("toxic_1"))


CLEAN = "trim(regexp_replace(regexp_replace(regexp_replace(text, '[ \\t]+', ' ', 'g'), ' *\\n *', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10))"


@query(f"SELECT doc_id, sha256({CLEAN}) AS clean_hash, length({CLEAN})::INT AS clean_chars, sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS flat_hash FROM documents")
def q14_clean_whitespace(spark, sf_dir):
    c = T.clean_whitespace(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(c, 256).alias("clean_hash"), F.length(c).alias("clean_chars"), F.sha2(T.flatten_whitespace(F.col("text")), 256).alias("flat_hash"))


SPACED = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(text || ' ', '\\s+([,.;:!?])(\\s)', '\\1\\2', 'g'), '([(\\[„])\\s+', '\\1', 'g'), '([.!?,;:])\\s+“(\\s)', '\\1“\\2', 'g'), '\\s+([)\\]])', '\\1', 'g')"


@query(f"SELECT doc_id, sha256(rtrim({SPACED}, ' ')) AS spaced_hash FROM documents")
def q15_spacing_fixed(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.regexp_replace(T.fix_spacing(F.col("text")), " +$", ""), 256).alias("spaced_hash"))


SPELLING = "(^|[^aeiouäöüAEIOUÄÖÜ])[aäeiuAÄEIU]ß([bcdfghjklmnpqrstvwxz]|$)|^[Mm]iß|[MmKk]üß(t|te|ten|test|tet)$|bißchen"


@query(f"""WITH r AS (SELECT doc_id, list_filter(regexp_extract_all(text, '[A-Za-zÄÖÜäöüß]+'), lambda w: contains(w, 'ß') AND NOT regexp_matches(lower(w), '^aß$|maß|mäß|spaß|fraß|saß|gefäß|gesäß|fuß|gruß|buß|straß')) AS w FROM documents)
SELECT doc_id, len(list_filter(w, lambda x: regexp_matches(x, '{SPELLING}')))::INT AS changed FROM r""")
def q16_spelling_modernised(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", modernize_spelling(F.col("text"))["changed"].alias("changed"))


@query(chain.SENTENCE_COUNTS)
def q17_sentences_per_doc(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(split_sentences_corpus(F.col("text"))).alias("corpus_sentences"), F.size(split_sentences_app(F.col("text"))).alias("app_sentences"))


@query(chain.CHUNK_ROWS)
def q18_chunks(spark, sf_dir):
    return chunking.chunk_documents(table(spark, sf_dir, "documents")).drop("context_before")


@query(chain.CHUNK_GATE)
def q19_chunk_gate(spark, sf_dir):
    c = chunking.chunk_documents(table(spark, sf_dir, "documents"))
    g = gates.gate_chunks(c)
    return g.select("document_id", "chunk_number", "target_length", T.word_count(F.col("chunk")).alias("words"), T.word_count(F.col("context_before")).alias("context_words"), "reject_reason")


# ---- evaluation of predictions


@query(f"WITH {PREDS} SELECT model, label AS true_label, count(*) FILTER (WHERE pred = 0) AS n_0, count(*) FILTER (WHERE pred = 1) AS n_1, count(*) FILTER (WHERE pred = 2) AS n_2 FROM p GROUP BY ALL")
def q20_confusion_matrix(spark, sf_dir):
    return metrics.confusion(preds(spark, sf_dir), ["model"])


VARIANTS = {"strict": ("label < 2 AND pred < 2", "pred"), "renorm": ("label <> 2", "(p1 / (p0 + p1) >= 0.5)::INT"), "any_ai": ("label < 2", "(pred <> 0)::INT")}


@query(f"WITH {PREDS}, b AS (" + " UNION ALL ".join(f"SELECT '{v}' AS variant, model, label AS y, {x} AS q FROM p WHERE {w}" for v, (w, x) in VARIANTS.items()) + ") SELECT variant, model, count(*) FILTER (WHERE y = 0 AND q = 0) AS tn, count(*) FILTER (WHERE y = 0 AND q = 1) AS fp, count(*) FILTER (WHERE y = 1 AND q = 0) AS fn, count(*) FILTER (WHERE y = 1 AND q = 1) AS tp, round(avg((y = q)::INT), 6) AS accuracy FROM b GROUP BY variant, model")
def q21_binary_confusion_variants(spark, sf_dir):
    p = preds(spark, sf_dir)
    out = [metrics.binary_confusion(p, v, ["model"]) for v in metrics.BINARY]
    return rounded(out[0].unionByName(out[1]).unionByName(out[2]), "accuracy")


REPORT = f"""{PREDS}, k AS (SELECT unnest([0, 1, 2])::INT AS class), t AS (SELECT model, class, count(*) FILTER (WHERE label = class AND pred = class) AS tp, count(*) FILTER (WHERE label <> class AND pred = class) AS fp, count(*) FILTER (WHERE label = class AND pred <> class) AS fn FROM p, k GROUP BY ALL),
r AS (SELECT model, class, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS precision, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall, coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0)::DOUBLE AS f1, tp + fn AS support FROM t)"""


@query(f"WITH {REPORT} SELECT model, class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support, round(avg(f1) OVER (PARTITION BY model), 6) AS macro_f1 FROM r")
def q22_class_report(spark, sf_dir):
    return rounded(metrics.class_report(preds(spark, sf_dir), ["model"]), "precision", "recall", "f1", "macro_f1")


@query(f"""WITH {REPORT}, f AS (SELECT model, round(avg(f1), 6) AS macro_f1 FROM r GROUP BY model),
s AS (SELECT model, count(*) AS n, round(avg((pred = label)::INT), 6) AS accuracy, round(avg(pow(p0 - (label = 0)::INT, 2) + pow(p1 - (label = 1)::INT, 2) + pow(p2 - (label = 2)::INT, 2)), 6) AS brier, round(-avg(ln([p0, p1, p2][label + 1])), 6) AS log_loss, {ERRORS} FROM p GROUP BY model) SELECT s.*, f.macro_f1 FROM s JOIN f USING (model)""")
def q23_metrics_by_model(spark, sf_dir):
    return rounded(metrics.split_metrics(preds(spark, sf_dir), ["model"]), "accuracy", "brier", "log_loss", "error_0", "error_1", "error_2", "macro_f1")


@query(f"WITH {PREDS} SELECT model, {BIN.format('word_count')} AS length_bin, count(*) AS n, " + ", ".join(f"count(*) FILTER (WHERE label = {k}) AS n_{k}, round(avg(p{k}) FILTER (WHERE label = {k}) * 100, 6) AS score_{k}" for k in range(3)) + f", round(avg((pred = label)::INT), 6) AS accuracy, {ERRORS} FROM p GROUP BY model, length_bin")
def q24_length_bias(spark, sf_dir):
    return rounded(metrics.length_bias(preds(spark, sf_dir), ["model"]), "accuracy", *[f"{x}_{k}" for x in ("score", "error") for k in range(3)])


def _by(group: str) -> str:
    return f"WITH {PREDS} SELECT {group}, count(*) FILTER (WHERE model = 'a') AS samples, " + ", ".join(f"round(avg((pred <> label)::INT) FILTER (WHERE model = '{m}'), 6) AS {m}" for m in MODELS) + f" FROM p GROUP BY {group}"


@query(_by("generator_model"))
def q25_error_by_generator(spark, sf_dir):
    return rounded(metrics.error_by_group(preds(spark, sf_dir), "generator_model", list(MODELS)), *MODELS)


@query(_by("source"))
def q26_error_by_source(spark, sf_dir):
    return rounded(metrics.error_by_group(preds(spark, sf_dir), "source", list(MODELS)), *MODELS)


@query(f"WITH {PREDS}, t AS (SELECT id, bool_and(pred = label) AS r, bool_and(pred <> label) AS w FROM p GROUP BY id) SELECT count(*) AS texts, count(*) FILTER (WHERE r) AS all_correct, count(*) FILTER (WHERE w) AS all_wrong, count(*) FILTER (WHERE NOT r AND NOT w) AS disagree FROM t")
def q27_agreement_summary(spark, sf_dir):
    return metrics.agreement_summary(preds(spark, sf_dir))


@query(f"WITH {PREDS} SELECT x.model AS model_a, y.model AS model_b, round(avg((x.pred = y.pred)::INT) * 100, 2) AS agreement FROM p x JOIN p y USING (id) GROUP BY 1, 2")
def q28_pairwise_agreement(spark, sf_dir):
    return metrics.pairwise_agreement(preds(spark, sf_dir), list(MODELS))


@query(f"""WITH {PREDS}, c AS (SELECT x.model AS model_a, y.model AS model_b, count(*) FILTER (WHERE x.pred = x.label AND y.pred <> y.label) AS b, count(*) FILTER (WHERE x.pred <> x.label AND y.pred = y.label) AS c FROM p x JOIN p y ON x.id = y.id AND x.model < y.model GROUP BY 1, 2),
k AS (SELECT *, unnest(range(0, least(b, c) + 1)) AS k FROM c),
v AS (SELECT model_a, model_b, b, c, CASE WHEN b + c = 0 THEN 1.0 ELSE least(1.0, 2 * sum(exp(lgamma(b + c + 1) - lgamma(k + 1) - lgamma(b + c - k + 1) - (b + c) * ln(2.0)))) END AS p_value FROM k GROUP BY model_a, model_b, b, c),
o AS (SELECT *, row_number() OVER (ORDER BY p_value, model_a, model_b) AS r, count(*) OVER () AS m FROM v),
h2 AS (SELECT *, max(least(1.0, (m - r + 1) * p_value)) OVER (ORDER BY r ROWS UNBOUNDED PRECEDING) AS p_holm FROM o)
SELECT model_a, model_b, b AS only_a_right, c AS only_b_right, round(p_value, 6) AS p_value, round(p_holm, 6) AS p_holm, p_holm < 0.05 AS significant, CASE WHEN p_holm >= 0.05 THEN 'no significant difference' WHEN b > c THEN model_a || ' better' ELSE model_b || ' better' END AS result FROM h2""")
def q29_mcnemar_holm(spark, sf_dir):
    return rounded(stats.mcnemar(preds(spark, sf_dir), list(MODELS)), "p_value", "p_holm")


@query(f"WITH {PREDS} SELECT model, round(avg(conf) FILTER (WHERE pred = label), 6) AS mean_right, round(avg(conf) FILTER (WHERE pred <> label), 6) AS mean_wrong, round(median(conf) FILTER (WHERE pred <> label), 6) AS median_wrong, round(avg((conf >= 0.9)::INT) FILTER (WHERE pred <> label), 6) AS wrong_over_90 FROM p GROUP BY model")
def q30_confidence_table(spark, sf_dir):
    return rounded(metrics.confidence_table(preds(spark, sf_dir)), "mean_right", "mean_wrong", "median_wrong", "wrong_over_90")


@query(f"WITH {PREDS} SELECT id, min(label) AS label, min(word_count) AS word_count, min(source) AS source FROM p GROUP BY id HAVING bool_and(pred <> label) ORDER BY word_count, id")
def q31_hardest_texts(spark, sf_dir):
    return metrics.hardest(preds(spark, sf_dir))


GRID = [0.5, 0.75, 1.0, 1.5, 2.0, 3.0]


@query(f"WITH {PREDS}, g2 AS (SELECT unnest({GRID})::DOUBLE AS temperature), z AS (SELECT temperature, label, ln(p0) / temperature AS z0, ln(p1) / temperature AS z1, ln(p2) / temperature AS z2 FROM p, g2 WHERE model = 'e') SELECT temperature, round(avg(ln(exp(z0) + exp(z1) + exp(z2)) - [z0, z1, z2][label + 1]), 6) AS nll FROM z GROUP BY temperature")
def q32_temperature_grid(spark, sf_dir):
    p = preds(spark, sf_dir).where("model = 'e'").withColumns({f"z{k}": F.ln(f"p{k}") for k in range(3)})
    return rounded(stats.temperature_grid(p, GRID), "nll")


def _newton(k: int) -> str:
    """A Newton step on ln T, as SQL."""
    u, e = f"exp(-(SELECT x FROM n{k}))", "exp(z{0} * u)"
    mean = "(e0 * z0 + e1 * z1 + e2 * z2) / (e0 + e1 + e2)"
    square = "(e0 * z0 * z0 + e1 * z1 * z1 + e2 * z2 * z2) / (e0 + e1 + e2)"
    return f"""n{k + 1} AS MATERIALIZED (SELECT (SELECT x FROM n{k}) + max(u) * g / (max(u) * max(u) * h + max(u) * g) AS x FROM (SELECT u, avg({mean} - [z0, z1, z2][label + 1]) OVER () AS g, avg({square} - pow({mean}, 2)) OVER () AS h
FROM (SELECT *, {', '.join(f'{e.format(i)} AS e{i}' for i in range(3))} FROM (SELECT *, {u} AS u FROM z))) GROUP BY g, h)"""


@query(f"WITH {PREDS}, z AS MATERIALIZED (SELECT label, ln(p0) AS z0, ln(p1) AS z1, ln(p2) AS z2 FROM p WHERE model = 'e'), n0 AS (SELECT 0.0::DOUBLE AS x), {', '.join(_newton(k) for k in range(8))} SELECT round(exp(x), 4) AS temperature FROM n8")
def q32b_fit_temperature(spark, sf_dir):
    p = preds(spark, sf_dir).where("model = 'e'").select("label", *[F.ln(f"p{k}").alias(f"z{k}") for k in range(3)])
    return spark.createDataFrame([(round(stats.fit_temperature(p), 4),)], "temperature double")


@query(f"""WITH {PREDS}, t AS (SELECT {BIN.format('word_count')} AS bin, count(*) FILTER (WHERE generator_model = 'deepseek-flash' AND pred <> label)::DOUBLE AS a, count(*) FILTER (WHERE generator_model = 'deepseek-flash' AND pred = label)::DOUBLE AS b, count(*) FILTER (WHERE generator_model <> 'deepseek-flash' AND pred <> label)::DOUBLE AS c, count(*) FILTER (WHERE generator_model <> 'deepseek-flash' AND pred = label)::DOUBLE AS d FROM p WHERE label = 2 AND model = 'e' GROUP BY bin),
n AS (SELECT *, a + b + c + d AS n FROM t WHERE a + b + c + d >= 2), s AS (SELECT sum(a * d / n) AS num, sum(b * c / n) AS den, sum(a - (a + b) * (a + c) / n) AS dev, sum((a + b) * (c + d) * (a + c) * (b + d) / (n * n * (n - 1))) AS var FROM n)
SELECT round(num / den, 6) AS odds_ratio, round(pow(abs(dev) - 0.5, 2) / var, 6) AS statistic FROM s""")
def q33_mantel_haenszel(spark, sf_dir):
    p = preds(spark, sf_dir).where("label = 2 and model = 'e'")
    one, bad = F.col("generator_model") == "deepseek-flash", ~metrics.right()
    t = p.groupBy(S.length_bin(F.col("word_count"))).agg(F.count_if(one & bad).alias("a"), F.count_if(one & ~bad).alias("b"), F.count_if(~one & bad).alias("c"), F.count_if(~one & ~bad).alias("d"))
    return rounded(stats.mantel_haenszel(t), "odds_ratio", "statistic").drop("p_value")


# ---- dataset assembly, similarity, detection

CASES = " ".join(f"WHEN doc_id BETWEEN {a} AND {b} THEN '{m}'" for a, b, m, *_ in dataset.RANGES)


@query(f"SELECT model, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM (SELECT doc_id, CASE {CASES} END AS model FROM documents) GROUP BY model")
def q34_generator_range_join(spark, sf_dir):
    d = dataset.with_generator(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", dataset.generator_ranges(spark))
    return d.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


def _assembled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    split = S.assign_split(F.col("doc_id").cast("string"))
    human = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample_id"), "text", split.alias("split"), F.col("doc_id").cast("string").alias("document_id"), F.lit("CC BY").alias("license_name"), F.col("source").alias("source_url"))
    talk = table(spark, sf_dir, "conversations").where("turn in (1, 3)")
    ai = lambda turn: talk.where(F.col("turn") == turn).select((F.col("conv_id") + 1).alias("seed_id"), "text")
    return dataset.assemble(human, ai(1), ai(3), dataset.generator_ranges(spark), strict=False)


STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
ASSEMBLY = f"""{DOCS}, h AS (SELECT doc_id, {STRIP.format('text')} AS text, split FROM docs),
ai AS (SELECT conv_id + 1 AS seed_id, turn, {STRIP.format('text')} AS text, len(regexp_extract_all(text, '\\S+')) AS n FROM conversations WHERE turn IN (1, 3)),
k AS (SELECT * FROM (VALUES ('assisted', 1, 2), ('generated', 3, 1)) t(kind, turn, label)),
j AS (SELECT h.doc_id, h.split, k.kind, k.label, CASE WHEN h.doc_id NOT BETWEEN 1 AND 10227 THEN 'no_generator_' || kind WHEN ai.text IS NULL THEN 'missing_' || kind WHEN n < 20 THEN 'refused_' || kind WHEN ai.text = h.text THEN 'unchanged_' || kind END AS skip_reason FROM h CROSS JOIN k LEFT JOIN ai ON ai.seed_id = h.doc_id AND ai.turn = k.turn)"""


@query(f"WITH {ASSEMBLY}, r AS (SELECT split, 0 AS label FROM h UNION ALL SELECT split, label FROM j WHERE skip_reason IS NULL) SELECT split, count(*) FILTER (WHERE label = 0) AS label_0, count(*) FILTER (WHERE label = 1) AS label_1, count(*) FILTER (WHERE label = 2) AS label_2, count(*) AS total FROM r GROUP BY ROLLUP(split)")
def q35_seed_assembly(spark, sf_dir):
    return dataset.contingency(_assembled(spark, sf_dir)[0])


@query(f"WITH {ASSEMBLY}, s AS (SELECT *, row_number() OVER (PARTITION BY skip_reason ORDER BY doc_id) AS i FROM j WHERE skip_reason IS NOT NULL) SELECT skip_reason, count(*) AS n, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) FILTER (WHERE i <= 15) AS first_ids FROM s GROUP BY skip_reason")
def q35b_skipped(spark, sf_dir):
    return dataset.skip_report(_assembled(spark, sf_dir)[1]).withColumn("first_ids", F.array_join("first_ids", ","))


@query(f"""WITH {ASSEMBLY}, r AS (SELECT 'human-' || h.doc_id AS id, h.text, h.split, h.doc_id, d.source FROM h JOIN documents d USING (doc_id) UNION ALL
SELECT j.kind || '-' || j.doc_id, ai.text, j.split, j.doc_id, d.source FROM j JOIN k USING (kind) JOIN ai ON ai.seed_id = j.doc_id AND ai.turn = k.turn JOIN documents d ON d.doc_id = j.doc_id WHERE skip_reason IS NULL)
SELECT 'duplicate_id' AS problem, id AS key FROM r GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'identical_texts', sha256(text) FROM r GROUP BY 2 HAVING count(*) > 1 UNION ALL SELECT 'empty_text', id FROM r WHERE trim(text) = ''
UNION ALL SELECT 'missing_licence_or_source', id FROM r WHERE coalesce(source, '') = '' UNION ALL SELECT 'document_in_two_splits', doc_id::VARCHAR FROM r GROUP BY doc_id HAVING min(split) <> max(split) UNION ALL SELECT 'group_in_two_splits', doc_id::VARCHAR FROM r GROUP BY doc_id HAVING min(split) <> max(split)""")
def q35c_dataset_problems(spark, sf_dir):
    return dataset.problems(_assembled(spark, sf_dir)[0])


def _rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    pair = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("a")).join(c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b")), ["conv_id", "turn"])
    return pair.withColumn("similarity", similarity.similarity("a", "b")).withColumn("generator_model", dataset.display_name(F.element_at(F.array(*map(F.lit, dataset.DISPLAY)), (F.col("conv_id") % 5 + 1).cast("int"))))


@query()
def q36_similarity_user_assistant(spark, sf_dir):
    return rounded(_rewrites(spark, sf_dir).select("conv_id", "turn", "similarity", S.similarity_bin(F.col("similarity")).alias("bin")), "similarity")


@query()
def q36b_misses_by_similarity(spark, sf_dir):
    t = _rewrites(spark, sf_dir)
    return similarity.one_against_rest(t, F.col("conv_id") % 3 == 0, F.col("generator_model") == "DeepSeek")


@query()
def q36c_fisher_against_others(spark, sf_dir):
    t = _rewrites(spark, sf_dir)
    return rounded(similarity.pairwise_fisher(t.withColumn("half", F.col("conv_id") % 2), F.col("conv_id") % 3 == 0, "generator_model", "DeepSeek", ["half"]), "p_fisher")


@query("""WITH a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<a\\b[^>]*\\bhref\\s*=\\s*["''][^"'']*["''][^>]*>.*?</a>')) AS a FROM pages),
l AS (SELECT page_id, url, regexp_extract(a, '(?is)<a\\b[^>]*\\bhref\\s*=\\s*["'']([^"'']*)["'']', 1) AS href, lower(trim(regexp_replace(regexp_replace(a, '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))) AS label FROM a),
s AS (SELECT page_id, regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) || href AS u, CASE WHEN contains(lower(href), '.pdf') THEN 3 ELSE 0 END + CASE WHEN regexp_matches(label, 'volltext|download|full text|pdf') THEN 3 ELSE 0 END + CASE WHEN regexp_matches(lower(href), 'cover|deckblatt|titelblatt') THEN -10 ELSE 0 END AS score FROM l WHERE href LIKE '/%' AND contains(href, '/')),
b AS (SELECT page_id, max((score, u)) AS m FROM s GROUP BY page_id) SELECT p.page_id, m[2] AS pdf_url, m[1]::INT AS score FROM pages p LEFT JOIN b USING (page_id)""")
def q37_best_link(spark, sf_dir):
    return P.find_pdf_url(table(spark, sf_dir, "pages"), ("/",))


@query(chain.WINDOW_ROWS)
def q38_sentence_windows(spark, sf_dir):
    return detect.windows(table(spark, sf_dir, "documents"), with_text=False)


@query(chain.OVERALL)
def q39_detect_overall_and_shares(spark, sf_dir):
    overall, _ = detect.detect(table(spark, sf_dir, "documents"))
    return rounded(overall, *[f"{x}{k}" for x in ("p", "share_") for k in range(3)])


@query(chain.SPANS)
def q39b_detect_spans(spark, sf_dir):
    return rounded(detect.detect(table(spark, sf_dir, "documents"))[1], "p0", "p1", "p2")


@query(f"WITH {DOCS} SELECT doc_id AS seed_id, words::INT AS target_words, floor(words * 0.8::DOUBLE)::BIGINT AS min_words, floor(words * 1.2::DOUBLE)::BIGINT AS max_words FROM docs")
def q40_prompt_length_range(spark, sf_dir):
    return generate.prompts(table(spark, sf_dir, "documents"), "doc_id", F.lit("source_based")).drop("prompt")


# ---- more operators of the inventory


@query(f"WITH {DOCS}, x AS (SELECT *, length(text) - length(replace(text, chr(65533), '')) AS broken FROM docs) SELECT lang, count(*) AS n, count(*) FILTER (WHERE broken >= 5) AS damaged FROM x GROUP BY lang")
def q41_document_damage(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("damage", T.document_damage(F.col("text")))
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("damage") == "document_broken_characters").alias("damaged"))


@query("SELECT doc_id, CASE WHEN trim(text) = '' THEN 'empty' WHEN len(list_filter(regexp_extract_all(text, '\\S+'), lambda x: regexp_matches(x, '\\p{L}'))) < 50 THEN 'too_short' WHEN len(regexp_extract_all(text, '\\S+')) > 3000 THEN 'too_long' END AS status FROM documents")
def q42_detection_gate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", gates.detection_gate(F.col("text")).alias("status"))


@query("SELECT d.doc_id AS seed_id, k.kind FROM documents d CROSS JOIN (SELECT unnest(['assisted', 'generated']) AS kind) k LEFT JOIN labels l ON l.doc_id = d.doc_id AND k.kind = CASE l.quality WHEN 0 THEN 'assisted' ELSE 'generated' END WHERE l.doc_id IS NULL")
def q43_find_missing(spark, sf_dir):
    kind = F.when(F.col("quality") == 0, "assisted").otherwise("generated")
    log = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("seed_id"), kind.alias("kind"), F.lit("x").alias("text"))
    return generate.find_missing(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seed_id")), log)


@query("SELECT doc_id FROM documents SEMI JOIN labels USING (doc_id)")
def q44_ids_in_both(spark, sf_dir):
    return dedup.known(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("""WITH u AS (SELECT doc_id, text, source, (doc_id % 3)::INT AS downloaded_in FROM documents) SELECT doc_id, downloaded_in, source FROM (SELECT *, row_number() OVER (PARTITION BY sha256(text) ORDER BY downloaded_in, doc_id) AS r FROM u) WHERE r = 1""")
def q45_merge_folders(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("hash"), "source")
    return dedup.merge_folders([d.where(F.col("doc_id") % 3 == k) for k in range(3)], "hash", "doc_id").select("doc_id", "downloaded_in", "source")


@query("""WITH x AS (SELECT doc_id, source, lang, sha256('42:' || doc_id::VARCHAR) AS mix FROM documents), a AS (SELECT *, row_number() OVER (PARTITION BY source, lang, doc_id % 7 ORDER BY mix, doc_id) AS r FROM x),
b AS (SELECT *, sum((r <= 2)::INT) OVER (PARTITION BY source, lang ORDER BY mix, doc_id ROWS UNBOUNDED PRECEDING) AS w FROM a), c AS (SELECT *, CASE WHEN r <= 2 AND w <= 4 THEN 1 ELSE 2 END AS pass FROM b)
SELECT doc_id, source, pass, row_number() OVER (PARTITION BY source ORDER BY pass, mix, doc_id)::INT AS ingest_rank FROM c""")
def q46_two_pass_sampling(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", (F.col("doc_id") % 7).alias("page"))
    return dedup.two_pass_order(d, "source", "page", "lang", "doc_id").select("doc_id", "source", "pass", "ingest_rank")


@query("SELECT doc_id, (row_number() OVER (ORDER BY source, doc_id))::BIGINT AS sample_id FROM documents")
def q47_sequential_ids(spark, sf_dir):
    return dedup.number_rows(table(spark, sf_dir, "documents").select("doc_id", "source"), ["source", "doc_id"]).select("doc_id", "sample_id")


@query("""WITH RECURSIVE c AS (SELECT doc_id, (doc_id % 3)::INT AS label, sha256('42:' || doc_id::VARCHAR) AS mix FROM documents), k AS (SELECT list(n ORDER BY label) AS n, list(label ORDER BY label) AS labels, sum(n)::BIGINT AS total FROM (SELECT label, count(*) AS n FROM c GROUP BY label)),
r(t, pick, taken) AS (SELECT 0::BIGINT, 0::BIGINT, list_transform(n, lambda x: 0::BIGINT) FROM k
UNION ALL SELECT t + 1, p, list_transform(range(1, len(n) + 1), lambda i: taken[i] + (i = p)::BIGINT) FROM (SELECT t, taken, n, list_position(behind, list_max(behind))::BIGINT AS p FROM (SELECT t, taken, n, list_transform(range(1, len(n) + 1), lambda i: n[i] * (t + 1) - total * taken[i]) AS behind FROM r, k WHERE t < total))),
o AS (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY mix, doc_id) AS nth FROM c)
SELECT doc_id, label, (t - 1)::BIGINT AS position FROM o JOIN (SELECT t, labels[pick] AS label, taken[pick] AS nth FROM r, k WHERE t > 0) USING (label, nth)""")
def q48_stratified_order(spark, sf_dir):
    return dedup.stratified_order(table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 3).cast("int").alias("label")), "label", "doc_id")


@query(f"WITH {PREDS}, t AS (SELECT id, bool_and(pred <> label) AS hard, min(word_count) AS w FROM p GROUP BY id), b AS (SELECT {BIN.format('w')} AS bin, count(*) AS n, count(*) FILTER (WHERE hard) AS h FROM t GROUP BY 1), d AS (SELECT * FROM (VALUES ('≤70', 0), ('71–150', 1), ('151–300', 2), ('301–500', 3), ('501–750', 4), ('751+', 5)) t(bin, bin_ord)) SELECT bin, bin_ord, round(coalesce(n, 0)::DOUBLE / sum(coalesce(n, 0)) OVER (), 6) AS share, round(coalesce(h, 0)::DOUBLE / sum(coalesce(h, 0)) OVER (), 6) AS share_subset FROM d LEFT JOIN b USING (bin)")
def q49_hard_histogram(spark, sf_dir):
    t = metrics.per_text(preds(spark, sf_dir))
    return rounded(metrics.histogram(t, S.length_bin(F.col("word_count")), [b for _, b in S.LENGTH_BINS], F.col("all_wrong")), "share", "share_subset")


@query(f"WITH {PREDS} SELECT models_wrong, count(*) AS texts FROM (SELECT id, count(*) FILTER (WHERE pred <> label) AS models_wrong FROM p GROUP BY id) GROUP BY models_wrong")
def q50_models_wrong_per_text(spark, sf_dir):
    return metrics.per_text(preds(spark, sf_dir)).groupBy("models_wrong").agg(F.count(F.lit(1)).alias("texts"))


@query("SELECT doc_id, upper(substr(sha256('x'), 1, 0)) || CASE doc_id % 5 WHEN 0 THEN 'human-' || doc_id WHEN 1 THEN doc_id::VARCHAR WHEN 2 THEN ' ' || doc_id || ' ' WHEN 3 THEN doc_id || '.0' ELSE 'student-' || doc_id END AS raw, CASE WHEN doc_id % 5 < 4 THEN doc_id END AS number FROM documents")
def q51_id_formats(spark, sf_dir):
    i = F.col("doc_id").cast("string")
    k = F.col("doc_id") % 5
    raw = F.when(k == 0, F.concat(F.lit("human-"), i)).when(k == 1, i).when(k == 2, F.concat(F.lit(" "), i, F.lit(" "))).when(k == 3, F.concat(i, F.lit(".0"))).otherwise(F.concat(F.lit("student-"), i))
    return table(spark, sf_dir, "documents").select("doc_id", raw.alias("raw"), S.id_number(raw).alias("number"))


@query("""WITH s AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'am 3.5.' || (1600 + doc_id % 500) WHEN 1 THEN '2020-02-' || (10 + doc_id % 25) WHEN 2 THEN 'ca. ' || (1500 + doc_id % 600) ELSE 'o. J.' END AS raw FROM documents)
SELECT doc_id, raw, CASE doc_id % 4 WHEN 0 THEN make_date(1600 + (doc_id % 500)::INT, 5, 3) WHEN 1 THEN coalesce(try_cast(raw AS DATE), make_date(2020, 12, 31)) WHEN 2 THEN make_date(1500 + (doc_id % 600)::INT, 12, 31) END AS day FROM s""")
def q52_dates(spark, sf_dir):
    i, k = F.col("doc_id"), F.col("doc_id") % 4
    raw = F.when(k == 0, F.concat(F.lit("am 3.5."), (1600 + i % 500).cast("string"))).when(k == 1, F.concat(F.lit("2020-02-"), (10 + i % 25).cast("string"))).when(k == 2, F.concat(F.lit("ca. "), (1500 + i % 600).cast("string"))).otherwise("o. J.")
    return table(spark, sf_dir, "documents").select("doc_id", raw.alias("raw"), S.parse_date(raw).alias("day"))


@query("""WITH s AS (SELECT doc_id, lower(text) AS t FROM documents) SELECT doc_id, CASE WHEN contains(t, 'by-nc') OR contains(t, 'noncommercial') THEN NULL WHEN contains(t, 'cc0') THEN 'CC0 1.0' WHEN contains(t, 'cc by-sa') THEN 'CC BY-SA' WHEN contains(t, 'cc by') OR contains(t, 'creative commons attribution') THEN 'CC BY' WHEN contains(t, 'public domain') THEN 'Public Domain' END AS licence FROM s""")
def q53_open_license(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", gates.detect_open_license(F.array("text"))["name"].alias("licence"))


@query("SELECT doc_id, len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}\\p{M}_]+'))::INT AS tokens FROM documents")
def q54_word_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.word_tokens(F.col("text"))).alias("tokens"))


@query("SELECT doc_id, sha256(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')) AS escaped FROM documents")
def q55_html_escape(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.html_escape(F.col("text")), 256).alias("escaped"))


@query("SELECT conv_id, count(*) AS turns, string_agg(role, '>' ORDER BY turn) AS roles, sum(len(regexp_extract_all(text, '\\S+')))::BIGINT AS words FROM conversations GROUP BY conv_id")
def q56_conversation_turns(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), ">").alias("roles"), F.sum(T.word_count(F.col("text")).cast("long")).alias("words"))


@query()
def q57_tfidf_logreg(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", F.col("quality").alias("label"), F.col("text"), S.assign_split(F.col("doc_id").cast("string")).alias("split"))
    t = ml.tokens(written(d))  # read for the vocabulary, to be counted and to be predicted
    model = ml.fit(t.where("split = 'train'"))
    return metrics.confusion(ml.predict(model, t.where("split <> 'train'")).select("split", "label", "pred"), ["split"], 2)


@query("SELECT CASE WHEN k < 800 THEN 'train' WHEN k < 900 THEN 'validation' ELSE 'test' END AS split, count(*) FILTER (WHERE quality = 0) AS label_0, count(*) FILTER (WHERE quality = 1) AS label_1 FROM (SELECT quality, ('0x' || substr(sha256(doc_id::VARCHAR), 1, 8))::BIGINT % 1000 AS k FROM labels) GROUP BY 1")
def q58_label_counts(spark, sf_dir):
    d = table(spark, sf_dir, "labels").select(S.assign_split(F.col("doc_id").cast("string")).alias("split"), F.col("quality").alias("label"))
    return metrics.label_counts(d, "split", labels=(0, 1)).withColumnsRenamed({"0": "label_0", "1": "label_1"})


@query(f"""WITH {PREDS}, z AS (SELECT label, ln(p0) AS z0, ln(p1) AS z1, ln(p2) AS z2 FROM p WHERE model = 'e'), t AS (SELECT * FROM (VALUES ('before', 1.0::DOUBLE), ('after', 1.5::DOUBLE)) t(stage, temperature)),
e AS (SELECT stage, temperature, label, exp(z0 / temperature) AS e0, exp(z1 / temperature) AS e1, exp(z2 / temperature) AS e2 FROM z, t), s AS (SELECT stage, temperature, label, e0 / (e0 + e1 + e2) AS p0, e1 / (e0 + e1 + e2) AS p1, e2 / (e0 + e1 + e2) AS p2 FROM e)
SELECT stage, temperature, count(*) AS n, round(avg((CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END = label)::INT), 6) AS accuracy, round(avg(pow(p0 - (label = 0)::INT, 2) + pow(p1 - (label = 1)::INT, 2) + pow(p2 - (label = 2)::INT, 2)), 6) AS brier, round(-avg(ln([p0, p1, p2][label + 1])), 6) AS log_loss FROM s GROUP BY stage, temperature""")
def q59_calibration_table(spark, sf_dir):
    p = preds(spark, sf_dir).where("model = 'e'").select("label", *[F.ln(f"p{k}").alias(f"z{k}") for k in range(3)])
    return rounded(stats.calibration_table(p, 1.5), "accuracy", "brier", "log_loss")


@query(f"WITH {DOCS}, u AS (SELECT 'source' AS dim, source AS value, doc_id FROM docs UNION ALL SELECT 'split', split, doc_id FROM docs UNION ALL SELECT 'lang', lang, doc_id FROM docs) SELECT dim, value, count(*) AS n, count(DISTINCT doc_id) AS documents FROM u GROUP BY dim, value")
def q60_corpus_summary(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), "source", "lang", S.assign_split(F.col("doc_id").cast("string")).alias("split"))
    return chunking.summarize(d, ("source", "split", "lang"))


@query("SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 5")
def q61_most_common_sources(spark, sf_dir):
    return chunking.most_common(table(spark, sf_dir, "documents"), "source")


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def q62_set_difference(spark, sf_dir):
    return dedup.only_new(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), ["doc_id"]).distinct()


@query("SELECT event_type, min(ts::DATE)::VARCHAR AS first_day, max(ts::DATE)::VARCHAR AS last_day, count(*) AS n FROM events GROUP BY event_type")
def q63_date_range(spark, sf_dir):
    r = dataset.date_range(table(spark, sf_dir, "events"), "ts", ["event_type"])
    return r.withColumns({c: F.col(c).cast("string") for c in ("first_day", "last_day")})


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM events")
def q64_utc_stamps(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", S.utc_stamp(F.col("ts")).alias("stamp"))


ANSWER = '{"label": %s, "human_probability": %s, "ai_probability": %s, "ai_assisted_probability": 0.1}'


@query("SELECT doc_id, (CASE WHEN doc_id % 5 = 0 THEN 0 END)::INT AS label, CASE doc_id % 5 WHEN 1 THEN 'not_json' WHEN 2 THEN 'probabilities_do_not_sum_to_1' WHEN 3 THEN 'label_unknown' WHEN 4 THEN 'label_is_not_the_largest' END AS error FROM documents")
def q65_parsed_predictions(spark, sf_dir):
    k = F.col("doc_id") % 5
    answer = F.when(k == 0, F.concat(F.lit("```json\n"), F.lit(ANSWER % (0, 0.7, 0.2)), F.lit("\n```"))).when(k == 1, F.lit("nein"))
    answer = answer.when(k == 2, F.lit(ANSWER % (0, 0.7, 0.7))).when(k == 3, F.lit(ANSWER % (7, 0.7, 0.2))).otherwise(F.lit(ANSWER % (1, 0.7, 0.2)))
    p = S.parse_prediction(answer)
    return table(spark, sf_dir, "documents").select("doc_id", F.when(p["error"].isNull(), p["label"]).cast("int").alias("label"), p["error"].alias("error"))


@query("""WITH d AS (SELECT doc_id, text FROM documents) SELECT doc_id, sha256(text || chr(10)) AS newline, sha256(regexp_replace(text, '([.!?]) (\\S)', '\\1  \\2', 'g')) AS double_spaces FROM d""")
def q66_perturbed_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", *[F.sha2(T.perturb(F.col("text"), k), 256).alias(k) for k in ("newline", "double_spaces")])


# ---- engine extras: not in the inventory


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY CUBE(lang, source)")
def x01_cube(spark, sf_dir):
    return table(spark, sf_dir, "documents").cube("lang", "source").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT sha256(text) AS hash FROM documents WHERE doc_id % 2 = 0 INTERSECT SELECT sha256(text) FROM documents WHERE doc_id % 2 = 1")
def x02_intersect(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    h = lambda k: d.where(F.col("doc_id") % 2 == k).select(F.sha2("text", 256).alias("hash"))
    return h(0).intersect(h(1))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def x03_tumbling_windows(spark, sf_dir):
    return rounded(ingest.tumbling(table(spark, sf_dir, "events")), "total", digits=4)


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM s GROUP BY user_id, k""")
def x04_sessions(spark, sf_dir):
    return ingest.sessions(table(spark, sf_dir, "events"))


@query("SELECT user_id, max_by(event_type, (ts, event_id)) AS event_type, max(ts) AS ts FROM events GROUP BY user_id")
def x05_last_event(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"), F.max("ts").alias("ts"))


# ---- language, folds


FOLDED = "' ' || trim(regexp_replace(lower({}), '[^\\p{{L}}]+', ' ', 'g')) || ' '"
GRAMS_OF = "list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2])"


@query(f"""WITH f AS (SELECT doc_id, lang, {FOLDED.format("coalesce(text, '')")} AS t, {FOLDED.format("substr(coalesce(text, ''), 1, 4000)")} AS s, length(trim(substr(coalesce(text, ''), 1, 4000))) >= 100 AS long_enough FROM documents),
n AS (SELECT lang, g, count(*) AS n FROM (SELECT lang, unnest({GRAMS_OF}) AS g FROM (SELECT lang, regexp_extract_all(t, '.') AS c FROM f)) GROUP BY lang, g), top AS (SELECT g FROM n GROUP BY g ORDER BY sum(n) DESC, g LIMIT 20000),
k AS (SELECT l.lang, top.g, coalesce(n.n, 0) AS n FROM (SELECT DISTINCT lang FROM n) l CROSS JOIN top LEFT JOIN n ON n.lang = l.lang AND n.g = top.g),
m AS (SELECT lang, g, ln(n + 0.5::DOUBLE) - ln(sum(n) OVER (PARTITION BY lang) + 0.5::DOUBLE * count(*) OVER (PARTITION BY lang)) AS w FROM k),
d AS (SELECT doc_id, g, count(*) AS n FROM (SELECT doc_id, unnest({GRAMS_OF}) AS g FROM (SELECT doc_id, regexp_extract_all(s, '.') AS c FROM f)) GROUP BY ALL),
v AS (SELECT doc_id, lang, sum(n * w) AS score FROM d JOIN m USING (g) GROUP BY ALL), b AS (SELECT doc_id, arg_max(lang, score) AS detected FROM v GROUP BY doc_id)
SELECT doc_id, f.lang, detected, long_enough AND coalesce(detected = 'de', false) AS is_german FROM f LEFT JOIN b USING (doc_id)""")
def q67_detected_language(spark, sf_dir):
    """The language of each document by a model of all documents, and the corpus gate's verdict on it."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    model = language.fit(d)
    return d.select("doc_id", "lang", model.detect(F.substring("text", 1, language.SAMPLE)).alias("detected"), model.is_language(F.col("text")).alias("is_german"))


# groups of equal counts go round the folds; the rest are placed one after another, the widest spread first
@query("""WITH RECURSIVE d AS (SELECT doc_id, doc_id // 7 AS collection, lang FROM documents), l AS (SELECT list(lang ORDER BY lang) AS langs, list(n ORDER BY lang) AS totals FROM (SELECT lang, count(*)::BIGINT AS n FROM d GROUP BY lang)),
v AS (SELECT collection, list_transform(langs, lambda x: len(list_filter(own, lambda y: y = x))) AS v FROM (SELECT collection, list(lang) AS own FROM d GROUP BY collection), l),
r AS (SELECT *, row_number() OVER (PARTITION BY v ORDER BY sha256('42:' || collection::VARCHAR), collection) - 1 AS nth, count(*) OVER (PARTITION BY v) AS m FROM v),
q AS (SELECT *, row_number() OVER (ORDER BY len(v) * list_sum(list_transform(v, lambda x: x * x)) - list_sum(v) * list_sum(v) DESC, v DESC, nth) AS turn FROM r WHERE nth >= m - m % 3),
s(turn, fold, held, n) AS (SELECT 0::BIGINT, 0::BIGINT, list_transform(range(3), lambda f: list_transform(totals, lambda x: 0::BIGINT)), [0, 0, 0]::BIGINT[] FROM l
UNION ALL SELECT turn + 1, fold, list_transform(range(1, 4), lambda f: list_transform(range(1, len(v) + 1), lambda c: held[f][c] + CASE WHEN f = fold THEN v[c] ELSE 0 END)), list_transform(range(1, 4), lambda f: n[f] + CASE WHEN f = fold THEN list_sum(v) ELSE 0 END)::BIGINT[] FROM
(SELECT s.turn, s.held, s.n, q.v, list_position(list_transform(range(1, 4), lambda f: struct_pack(cost := list_sum(list_transform(range(1, len(v) + 1), lambda c: held[f][c] * v[c] / (totals[c] * totals[c])::DOUBLE)), n := s.n[f])), list_min(list_transform(range(1, 4), lambda f: struct_pack(cost := list_sum(list_transform(range(1, len(v) + 1), lambda c: held[f][c] * v[c] / (totals[c] * totals[c])::DOUBLE)), n := s.n[f]))))::BIGINT AS fold FROM s JOIN q ON q.turn = s.turn + 1, l))
SELECT collection, CASE WHEN nth < m - m % 3 THEN nth % 3 ELSE s.fold - 1 END::INT AS fold FROM r LEFT JOIN (SELECT q.collection, s.fold FROM q JOIN s USING (turn)) s USING (collection)""")
def q68_group_folds(spark, sf_dir):
    """Folds of collections of seven documents, in which each language is spread evenly."""
    d = table(spark, sf_dir, "documents").select(F.expr("doc_id div 7").alias("collection"), "lang")
    return ordering.group_folds(d, "collection", "lang")


# ---- what goes on where it stopped


@query("""WITH a AS (SELECT sha256(text) AS h, min(doc_id) AS doc_id FROM documents WHERE doc_id % 2 = 0 GROUP BY 1),
b AS (SELECT sha256(text) AS h, min(doc_id) AS doc_id FROM documents WHERE sha256(text) NOT IN (SELECT h FROM a) GROUP BY 1)
SELECT doc_id, row_number() OVER (ORDER BY run, doc_id) AS sample_id FROM (SELECT doc_id, 1 AS run FROM a UNION ALL SELECT doc_id, 2 FROM b)""")
def q69_store_in_two_runs(spark, sf_dir):
    """The ids that a store gives all documents in two runs, first the even ids and then what is left."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.sha2("text", 256).alias("hash"), "source", S.assign_split(F.col("doc_id").cast("string")).alias("split"))
    s = store.SampleStore(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    s.add(d.where("document_id % 2 = 0"), ["document_id"])
    s.add(d, ["document_id"])
    return s.read().select(F.col("document_id").alias("doc_id"), "sample_id")


@query("SELECT doc_id || '.txt' AS file, sha256(text) AS hash FROM documents WHERE text <> ''")
def q70_one_file_per_row(spark, sf_dir):
    """Each text as a file of its own, written by the sink and read back."""
    spark.dataSource.register(sinks.TextFiles)
    path = f"{shared_folder(spark)}/texts-{uuid.uuid4().hex}"
    d = table(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), "text")
    d.write.format("one_file_per_row").mode("append").save(path.removeprefix("file:"))
    return files.read_parts(spark, path).where("text <> ''").select("file", F.sha2("text", 256).alias("hash"))


@query("SELECT doc_id, length(text)::INT AS n_chars, len(regexp_extract_all(text, '\\S+'))::INT AS words FROM documents")
def q71_scored_in_batches(spark, sf_dir):
    """All documents measured by a stream that commits a folder for each micro-batch."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = f"{shared_folder(spark)}/scoring-{uuid.uuid4().hex}"
    scoring.queue(d, f"{folder}/queue", 5000)
    scoring.score(spark, f"{folder}/queue", d.schema, lambda b: b.select("doc_id", F.length("text").alias("n_chars"), T.word_count(F.col("text")).cast("int").alias("words")), f"{folder}/out", f"{folder}/checkpoint", scoring.at_once(spark)).awaitTermination()
    return scoring.scored(spark, f"{folder}/out")


# ---- smaller operators of the chain and of the comparisons


@query(chain.GLUED_WORDS)
def q72_glued_words(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.glued_word_count(F.col("text")).alias("glued"))


@query(chain.CHUNK_CONTEXTS)
def q18b_chunk_contexts(spark, sf_dir):
    c = chunking.chunk_documents(table(spark, sf_dir, "documents"))
    return c.select("document_id", "chunk_number", T.word_count(F.col("chunk")).cast("int").alias("words"), T.word_count(F.col("context_before")).cast("int").alias("context_words"))


@query(f"WITH {ASSEMBLY} SELECT 'assisted-' || h.doc_id AS id, sha256(h.text) AS original FROM j JOIN h USING (doc_id) WHERE j.kind = 'assisted' AND skip_reason IS NULL")
def q73_match_originals(spark, sf_dir):
    """AI-assisted rows with the text that they were made from."""
    rows = _assembled(spark, sf_dir)[0]
    pairs, _ = dataset.match_originals(rows.where("label = 2").select("id", "seed_sample_id"), rows.where("label = 0").select("id", "text"))
    return pairs.select("id", F.sha2("original_text", 256).alias("original"))


@query(f"""WITH {PREDS}, e AS (SELECT unnest({[e or 1e9 for e, _ in S.SIMILARITY_BINS]!r})::DOUBLE AS upto, unnest({[b for _, b in S.SIMILARITY_BINS]!r}) AS bin, unnest(range({len(S.SIMILARITY_BINS)}))::INT AS bin_ord),
x AS (SELECT (SELECT min(bin_ord) FROM e WHERE conf <= upto) AS bin_ord, pred <> label AS missed FROM p WHERE model = 'e')
SELECT e.bin, e.bin_ord, count(x.bin_ord) AS texts, count(*) FILTER (WHERE x.missed) AS missed, count(*) FILTER (WHERE x.missed)::DOUBLE / nullif(count(x.bin_ord), 0) AS miss_rate FROM e LEFT JOIN x USING (bin_ord) GROUP BY ALL""")
def q74_misses_by_bin(spark, sf_dir):
    """Misses by bins of a value between 0 and 1, here a model's confidence."""
    p = preds(spark, sf_dir).where("model = 'e'").withColumn("similarity", F.greatest("p0", "p1", "p2"))
    return similarity.by_similarity(p, ~metrics.right())


@query(f"WITH {PREDS}, r AS (SELECT source, model, avg((pred <> label)::INT) AS rate FROM p GROUP BY ALL) SELECT source, coalesce(max(rate) FILTER (WHERE model = 'e') > max(rate) FILTER (WHERE model <> 'e'), false) AS above_all FROM r GROUP BY source")
def q75_above_all_others(spark, sf_dir):
    """Whether one model misses more than every other, for each source."""
    rates = preds(spark, sf_dir).groupBy("source", "model").agg(F.avg((~metrics.right()).cast("int")).alias("rate"))
    return similarity.above_all_others(rates, "source", "model", "rate", "e")


@query("SELECT DISTINCT least(n, greatest(1, round_even(f * n, 0)))::INT AS texts FROM (SELECT count(*) AS n FROM documents), (SELECT unnest([0.01, 0.05, 0.12, 0.175, 0.25, 0.5, 1.0])::DOUBLE AS f)")
def q76_subset_sizes(spark, sf_dir):
    n = table(spark, sf_dir, "documents").count()
    return spark.createDataFrame([(x,) for x in dedup.subset_sizes(n, [0.01, 0.05, 0.12, 0.175, 0.25, 0.5, 1.0])], "texts int")


_SCORE = "CASE WHEN contains(lower(href), '.pdf') THEN 3 ELSE 0 END + CASE WHEN regexp_matches(label, 'volltext|download|full text|pdf') THEN 3 ELSE 0 END + CASE WHEN regexp_matches(lower(href), 'cover|deckblatt|titelblatt') THEN -10 ELSE 0 END"


@query(f"""WITH a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<a\\b[^>]*\\bhref\\s*=\\s*["''][^"'']*["''][^>]*>.*?</a>')) AS a FROM pages),
l AS (SELECT page_id, url, regexp_extract(a, '(?is)<a\\b[^>]*\\bhref\\s*=\\s*["'']([^"'']*)["'']', 1) AS href, lower(trim(regexp_replace(regexp_replace(a, '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))) AS label FROM a),
s AS (SELECT page_id, CASE WHEN regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN href ELSE regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) || CASE WHEN starts_with(href, '/') THEN '' ELSE '/' END || href END AS u, {_SCORE} AS score FROM l WHERE contains(lower(href), '.pdf') OR contains(lower(href), 'bitstream')),
b AS (SELECT page_id, max((score, u)) AS m FROM s GROUP BY page_id) SELECT p.page_id, m[2] AS pdf_url, m[1]::INT AS score FROM pages p LEFT JOIN b USING (page_id)""")
def q37b_best_pdf_link(spark, sf_dir):
    """The full text that a page links to, by the operator's own filter."""
    return P.find_pdf_url(table(spark, sf_dir, "pages"))


_NAME = "regexp_extract(text, '\\b([A-ZÄÖÜ][a-zäöüß]+)(?: et al\\.)?,? \\(?\\d{4}', 1)"
_MOVED = "list_transform(regexp_extract_all(text, '\\d+|\\D+'), lambda x: CASE WHEN try_cast(x AS HUGEINT) IS NOT NULL AND regexp_matches(x, '^\\d+$') AND length(x) <= 38 THEN (x::HUGEINT + CASE WHEN x::HUGEINT BETWEEN 1900 AND 2099 THEN 2 ELSE 1 END)::VARCHAR ELSE x END)"
_SWAPPED = "replace(replace(regexp_replace(regexp_replace(text, '„([^„“”]*)“', chr(1) || '\\1' || chr(2), 'g'), '“([^„“”\\x01\\x02]*)”', '„\\1“', 'g'), chr(1), '“'), chr(2), '”')"


@query(f"""SELECT doc_id, CASE WHEN regexp_matches(text, '„[^„“”]*“|“[^„“”]*”') THEN sha256({_SWAPPED}) END AS quotes, CASE WHEN regexp_matches(text, '\\d') THEN sha256(array_to_string({_MOVED}, '')) END AS numbers,
CASE WHEN {_NAME} <> '' THEN sha256(regexp_replace(text, '\\b' || {_NAME} || '\\b', CASE WHEN {_NAME} = 'Müller' THEN 'Schmidt' ELSE 'Müller' END, 'g')) END AS cited_name FROM documents""")
def q66b_perturbed_quotes_numbers_names(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", *[F.sha2(T.perturb(F.col("text"), k), 256).alias(k) for k in ("quotes", "numbers", "cited_name")])


# ---- page layout: documents set in lines of eight words in two spans, four lines to a block, five blocks to a page


def laid_out(docs: DataFrame) -> DataFrame:
    """Spans as `layout` takes them. Odd lines have a gap between their spans, every ninth is small, every
    eleventh bold, and each page begins with the source's running head."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[ \t\n\r]+"), lambda w: w != "")
    d = docs.select("doc_id", "source", words.alias("w")).where(F.size("w") > 0)
    d = d.select("doc_id", "source", "w", F.explode(F.sequence(F.lit(0), ((F.size("w") - 1) / 4).cast("int"))).alias("s"))
    at, span = F.expr("s div 2").cast("int"), F.expr("s % 2")
    head = F.when(span == 0, F.concat(F.lit("Running head of "), F.coalesce("source", F.lit("")))).otherwise("in all")
    first = (at % 20) == 0
    return d.select(
        "doc_id", F.expr("(s div 2) div 20").cast("int").alias("page"), F.expr("((s div 2) div 4) % 5").cast("int").alias("block"), F.expr("(s div 2) % 4").cast("int").alias("line"), span.alias("span"),
        F.when(first, head).otherwise(F.array_join(F.slice("w", F.col("s") * 4 + 1, 4), " ")).alias("text"), F.when(at % 9 == 4, 8.0).otherwise(10.0).alias("size"), (at % 11 == 0).alias("bold"),
        (span * 100.0).alias("x0"), (span * 100.0 + F.when(at % 2 == 1, 95.0).otherwise(99.0)).alias("x1"),
    )


SPANS = """d AS (SELECT doc_id, source, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\r]+'), lambda x: x <> '') AS w FROM documents), e AS (SELECT *, unnest(range(0, (len(w) + 3) // 4)) AS s FROM d WHERE len(w) > 0),
sp AS (SELECT doc_id, ((s // 2) // 20)::INT AS page, (((s // 2) // 4) % 5)::INT AS block, ((s // 2) % 4)::INT AS line, (s % 2)::INT AS span, s // 2 AS n, CASE WHEN (s // 2) % 20 = 0 THEN CASE WHEN s % 2 = 0 THEN 'Running head of ' || coalesce(source, '') ELSE 'in all' END ELSE array_to_string(w[s * 4 + 1 : s * 4 + 4], ' ') END AS text FROM e),
sz AS (SELECT doc_id, arg_max(size, (chars, -first)) AS body FROM (SELECT doc_id, CASE WHEN n % 9 = 4 THEN 8.0 ELSE 10.0 END AS size, sum(length(text))::BIGINT AS chars, min(n * 2 + span) AS first FROM sp GROUP BY ALL) GROUP BY doc_id),
ln AS (SELECT doc_id, page, block, line, any_value(n) AS n, string_agg(text, chr(1) ORDER BY span) AS parts FROM sp GROUP BY doc_id, page, block, line),
li AS (SELECT doc_id, page, block, line, n, trim(replace(parts, chr(1), CASE WHEN n % 2 = 1 THEN ' ' ELSE '' END)) AS full_, abs(CASE WHEN n % 9 = 4 THEN 8.0 ELSE 10.0 END - body) <= 0.5 AS has_body FROM ln JOIN sz USING (doc_id))"""


@query(f"WITH {SPANS} SELECT doc_id, page, block, line, sha256(full_) AS full_hash, sha256(CASE WHEN has_body THEN full_ ELSE '' END) AS kept_hash, has_body, NOT has_body OR n % 11 = 0 AS bold FROM li")
def q77_page_lines(spark, sf_dir):
    """Lines from spans, a space where a gap shows, and what of them is in the body's size."""
    lines = layout.lines_of(laid_out(table(spark, sf_dir, "documents")))
    return lines.select("doc_id", "page", "block", "line", F.sha2("full", 256).alias("full_hash"), F.sha2("kept", 256).alias("kept_hash"), "has_body", "bold")


@query(f"WITH {SPANS}, pg AS (SELECT doc_id, max(page) + 1 AS n_pages FROM sp GROUP BY doc_id) SELECT doc_id, lower(full_) AS low FROM li JOIN pg USING (doc_id) GROUP BY doc_id, 2, n_pages HAVING n_pages >= 5 AND count(DISTINCT page) >= greatest(3, floor(n_pages * 0.25)) AND length(lower(full_)) <= 120")
def q78_repeated_page_lines(spark, sf_dir):
    spans = laid_out(table(spark, sf_dir, "documents"))
    return layout.repeated_lines(layout.lines_of(spans), spans.groupBy("doc_id").agg((F.max("page") + 1).alias("n_pages")))


_BROKEN = f"regexp_matches(a, '[A-Za-zÄÖÜäöüß]-$') AND regexp_matches(x, '^\\p{{Ll}}') AND NOT list_contains({list(T.HYPHEN_STAYS)!r}, regexp_replace(lower(regexp_extract(x, '^(\\S+)', 1)), '[,.;:]+$', ''))"


@query(f"WITH {SPANS} SELECT doc_id, page, block, sha256(list_reduce(list(full_ ORDER BY line), lambda a, x: CASE WHEN x = '' THEN a WHEN a = '' THEN x WHEN {_BROKEN} THEN left(a, length(a) - 1) || x ELSE a || ' ' || x END)) AS joined FROM li GROUP BY doc_id, page, block")
def q79_joined_lines(spark, sf_dir):
    """Blocks as paragraphs; words that a line's end broke are joined."""
    lines = layout.lines_of(laid_out(table(spark, sf_dir, "documents")))
    blocks = lines.groupBy("doc_id", "page", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "full"))), lambda x: x["full"]).alias("ls"))
    return blocks.select("doc_id", "page", "block", F.sha2(layout.join_lines(F.col("ls")), 256).alias("joined"))


@query("""WITH f AS (SELECT doc_id, length(text)::BIGINT * 40000 AS length, CASE WHEN doc_id % 7 = 0 THEN '<htm' ELSE '%PDF' END AS head, doc_id % 5 = 0 AS encrypted, (length(text) // 40)::INT AS n_pages, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE length(text) END AS chars FROM documents)
SELECT doc_id, CASE WHEN length > 100 * 1024 * 1024 THEN 'pdf_too_large' WHEN head <> '%PDF' THEN 'pdf_not_a_pdf' WHEN encrypted THEN 'pdf_encrypted' WHEN n_pages > 400 THEN 'pdf_too_many_pages' WHEN coalesce(chars, 0) < 20 * greatest(1, n_pages) THEN 'pdf_no_text_layer' END AS status FROM f""")
def q80_pdf_status(spark, sf_dir):
    """Why files are skipped, over file properties that follow from the documents."""
    n = F.length("text")
    files_ = table(spark, sf_dir, "documents").select("doc_id", (n.cast("long") * 40000).alias("length"), F.when(F.col("doc_id") % 7 == 0, "<htm").otherwise("%PDF").alias("head"), (F.col("doc_id") % 5 == 0).alias("encrypted"), F.floor(n / 40).cast("int").alias("n_pages"), F.when(F.col("doc_id") % 3 != 0, n).alias("chars"))
    return files_.select("doc_id", layout.pdf_status(files_).alias("status"))
