"""DuckDB SQL for the operators of this subpackage that SQL expresses over whole tables."""

from __future__ import annotations

from .licenses import BASE
from .rules import BOTH_SIDES, MEASURES, MIN_GROUP, REACH

GAP = r"[\x20\x09-\x0D]+"
WORDS = f"list_filter(string_split_regex(coalesce({{}}, ''), '{GAP}'), lambda w: w <> '')"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

NGRAM_JOIN = f"""WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(f"translate(text, '{UPPER}', '{LOWER}')")} AS w FROM documents),
g AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || chr(1) || w[i + 1] || chr(1) || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, chr(2))] ELSE [] END) AS g FROM w),
s AS (SELECT DISTINCT doc_id, g FROM g), n AS (SELECT d.doc_id, count(s.g) AS n FROM documents d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 90 * (nx.n + ny.n - c)),
l AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.y FROM r JOIN l ON r.b = l.x)
SELECT n.doc_id, n.n AS n_shingles, m.low AS component_id FROM n JOIN (SELECT a, min(b) AS low FROM r GROUP BY a) m ON m.a = n.doc_id"""

_share = "coalesce(floor({2}::DOUBLE * {0} / nullif({1}, 0)), 0)::BIGINT"
_bucket = "CASE WHEN {0} < 10000 THEN {0} ELSE {0} - {0} % pow(10, length({0}::VARCHAR) - 4)::BIGINT END"
_limits = ", ".join(f"max(q25 - {REACH} * iqr) FILTER (WHERE measure = '{m}')::BIGINT AS {m}_low, max(q75 + {REACH} * iqr) FILTER (WHERE measure = '{m}')::BIGINT AS {m}_high" for m in MEASURES)
_within = " AND ".join([f"{m} <= {m}_high" for m in MEASURES] + [f"{m} >= {m}_low" for m in BOTH_SIDES])


def _quantiles(by: str) -> str:
    keys = f"{by}, " if by else ""
    return f"""(SELECT {keys}measure, max(total) AS n, min(bucket) FILTER (WHERE cum * 4 >= total) AS q25, min(bucket) FILTER (WHERE cum * 4 >= total * 3) AS q75 FROM
(SELECT {keys}measure, bucket, sum(c) OVER (PARTITION BY {keys}measure ORDER BY bucket) AS cum, sum(c) OVER (PARTITION BY {keys}measure) AS total FROM (SELECT {keys}measure, bucket, count(*) AS c FROM b GROUP BY ALL)) GROUP BY {keys}measure)"""


QUALITY_RULES = f"""WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, {WORDS.format('text')} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents),
x AS (SELECT doc_id, len(w) AS n, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
y AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM x),
z AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM y, (SELECT unnest([0, 1, 2]) AS k) WHERE c > 1 GROUP BY doc_id),
a AS (SELECT w.doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l)::BIGINT AS n_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN z USING (doc_id)),
m AS (SELECT *, {_share.format('n_symbols', 'word_chars', 1000)} AS symbol_pm, {_share.format('n_dup_lines', 'n_lines', 1000)} AS dup_line_pm, {_share.format('n_repeat_words', 'n_words', 1000)} AS repeat_pm, {_share.format('word_chars', 'n_words', 100)} AS word_len_c, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a),
b AS ({' UNION ALL '.join(f"SELECT lang, source, '{k}' AS measure, {_bucket.format(k)} AS bucket, {v} AS slack FROM m" for k, v in MEASURES.items())}),
q AS (SELECT o.lang, o.source, o.measure, CASE WHEN o.n >= {MIN_GROUP} THEN o.q25 WHEN l.n >= {MIN_GROUP} THEN l.q25 ELSE e.q25 END AS q25, CASE WHEN o.n >= {MIN_GROUP} THEN o.q75 WHEN l.n >= {MIN_GROUP} THEN l.q75 ELSE e.q75 END AS q75
FROM {_quantiles('lang, source')} o JOIN {_quantiles('lang')} l ON o.lang = l.lang AND o.measure = l.measure JOIN {_quantiles('')} e ON o.measure = e.measure),
i AS (SELECT q.*, greatest(q75 - q25, s.slack) AS iqr FROM q JOIN (SELECT DISTINCT measure, slack FROM b) s USING (measure)),
f AS (SELECT lang, source, {_limits} FROM i GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {_within} AS kept, {', '.join(f'{m}, {m}_high' for m in MEASURES)}, {', '.join(f'{m}_low' for m in BOTH_SIDES)} FROM m JOIN f USING (lang, source)"""

SECRETS_BASE = """SELECT doc_id, len(list_filter(regexp_extract_all(text, '(?i)(password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 8))::BIGINT AS n_assign,
len(list_filter(regexp_extract_all(text, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 16))::BIGINT AS n_access, len(list_filter(regexp_extract_all(text, '[0-9a-f]+'), lambda x: length(x) >= 32))::BIGINT AS n_hex FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)"""

_places = " || ".join(f"list_filter(range(len(w)), lambda i: w[i + 1 : i + {len(p.split())}] = {p.split()!r})" for p in BASE.values())
_labels = ", ".join(f"CASE WHEN len(list_filter(range(len(w)), lambda i: w[i + 1 : i + {len(p.split())}] = {p.split()!r})) > 0 THEN '{k}' END" for k, p in sorted(BASE.items()))
LICENSES_BASE = f"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, len(w)::BIGINT AS n_words, {_places} AS found, concat_ws(',', {_labels}) AS base_labels FROM w)
SELECT doc_id, n_words, len(found)::BIGINT AS n_base, list_min(found)::BIGINT AS first_word, list_max(found)::BIGINT AS last_word, base_labels FROM p"""

SHARDING_LAW = """SELECT 'bytes' AS law, 16::BIGINT AS shards, count(*) AS n_rows, sum(octet_length(encode(coalesce(text, ''))) + 1)::BIGINT AS n_bytes, true AS gapless, true AS even FROM documents"""

_W = "list_filter(string_split_regex(translate(coalesce(text, ''), '" + UPPER + "', '" + LOWER + "'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
_step = "list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, {})"
IMPORTANCE = f"""WITH crc AS (SELECT list({_step.format("i")} ORDER BY i) AS m FROM (SELECT unnest(range(256)) AS i)),
d AS (SELECT doc_id, {_W} AS w FROM documents), f AS (SELECT doc_id, unnest(w) AS f FROM d),
b AS (SELECT unnest({_W}) AS f FROM benchmark),
u AS (SELECT f, sum(s)::BIGINT AS s, sum(t)::BIGINT AS t FROM (SELECT f, 1 AS s, 0 AS t FROM f UNION ALL SELECT f, 0, 1 FROM b) GROUP BY f),
h AS (SELECT u.*, xor(list_reduce(list_transform(range(1, octet_length(encode(f)) + 1), lambda i: ('0x' || substr(hex(encode(f)), 2 * i - 1, 2))::BIGINT), lambda c, x: xor(c >> 8, m[xor(c & 255, x) + 1]), 4294967295), 4294967295) % 10000 AS k FROM u, crc),
k AS (SELECT k, sum(s)::BIGINT AS s, sum(t)::BIGINT AS t FROM h GROUP BY k), a AS (SELECT sum(s)::BIGINT AS s, sum(t)::BIGINT AS t FROM k),
g AS (SELECT k.k, floor(1000 * ln((k.t + 1)::DOUBLE * (a.s + 10000) / ((k.s + 1)::DOUBLE * (a.t + 10000))))::BIGINT AS gain FROM k, a),
v AS (SELECT f.doc_id, count(*) AS n, sum(gain)::BIGINT AS total FROM f JOIN h USING (f) JOIN g USING (k) GROUP BY f.doc_id),
x AS (SELECT d.doc_id, len(w)::BIGINT AS n_features, coalesce((total - ((total % n) + n) % n) // n, 0)::BIGINT AS weight, ('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT AS h FROM d LEFT JOIN v USING (doc_id)),
y AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS r, count(*) FILTER (WHERE n_features >= 20) OVER () AS n FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND r <= 10 * n // 100 THEN r END AS rank FROM z"""

SHARDING_ROWS = f"""WITH crc AS (SELECT list({_step.format("i")} ORDER BY i) AS m FROM (SELECT unnest(range(256)) AS i)), b AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS b FROM documents)
SELECT doc_id, size::BIGINT AS size, xor(list_reduce(b, lambda c, x: xor(c >> 8, m[xor(c & 255, x) + 1]), 4294967295), 4294967295)::BIGINT AS text_crc32, 'bytes' AS law FROM b, crc"""
