"""DuckDB SQL for the chain of sentences, chunks, windows and scores.

The sentence rules look at what stands around a mark, so texts are cut into pieces that end with a run of
marks, or at gaps, and each piece tells whether a sentence ends with it. Chunks and windows depend on the
one before: they are recursive over lists of running sums.
"""

from __future__ import annotations

from ..functions import sentences as R
from ..functions import text as T
from ..functions.scalars import TARGET_WORDS


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(words)) + "]"


WHITE = r"\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0085}\x{001C}-\x{001F}\x{000B}"  # what a text function calls white space


def n_words(text: str) -> str:
    return f"len(regexp_extract_all({text}, '[^{WHITE}]+'))::INT"


def stripped(text: str) -> str:
    return f"regexp_replace(coalesce({text}, ''), '^[{WHITE}]+|[{WHITE}]+$', '', 'g')"


CLEANED = r"regexp_replace(regexp_replace(regexp_replace(replace(replace(coalesce(text, ''), chr(160), ' '), chr(13), chr(10)), '[ \t]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g')"
CLOSE = R"""["''»”’)\]}]"""
LETTERS = "[A-Za-zÄÖÜäöüß]"

def corpus(source: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """s: (key, k, words, sentence) of the corpus splitter, a table with its own names inside."""
    return rf"""s AS (WITH c AS (SELECT {key} AS id, {stripped(CLEANED.replace("text", text))} AS t FROM {source}),
p AS (SELECT id, t, unnest(g) AS g, generate_subscripts(g, 1) AS i FROM (SELECT *, regexp_extract_all(t, '[^.!?]*[.!?]+{CLOSE}*[{WHITE}]*') AS g FROM c)),
e AS (SELECT *, sum(length(g)) OVER (PARTITION BY id ORDER BY i)::BIGINT AS upto, length(regexp_extract(g, '^[^.!?]*[.!?]+')) AS body, length(regexp_extract(g, '^[^.!?]*[.!?]+{CLOSE}*')) AS closed FROM p),
m AS (SELECT *, upto - length(g) + body AS mark, substr(t, upto + 1, 1) AS nxt FROM e),
o AS (SELECT *, lower(regexp_extract(substr(t, greatest(1, mark - 200), least(200, mark - 1)), '[^{WHITE}()\[\]{{}}"„“”«»]*$')) || '.' AS token, lower(regexp_extract(substr(t, mark + 1, 80), '^(?:[{WHITE}]|{CLOSE})*({LETTERS}+)', 1)) AS follower FROM m),
f AS (SELECT *, CASE WHEN substr(t, mark, 1) <> '.' THEN NOT regexp_matches(nxt, '^\p{{Ll}}') WHEN regexp_matches(substr(t, mark - 1, 1), '^\d') AND mark > 1 AND regexp_matches(substr(t, mark + 1, 1), '^\d') THEN false WHEN nxt = '' THEN true
WHEN list_contains({_list(R.CORPUS_ABBREVIATIONS)}, token) OR regexp_matches(token, '^([a-zäöüß]\.)+$') OR regexp_matches(nxt, '^\p{{Ll}}') THEN false WHEN regexp_matches(token, '^\d{{1,3}}\.$') THEN NOT list_contains({_list(R.ORDINAL_FOLLOWERS)}, follower) ELSE true END AS ended FROM o),
q AS (SELECT *, coalesce(sum(ended::INT) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp FROM f),
u AS (SELECT id, grp, {stripped("string_agg(CASE WHEN ended THEN left(g, closed) ELSE g END, '' ORDER BY i)")} AS sentence FROM q GROUP BY id, grp HAVING bool_or(ended))
SELECT id AS {key}, row_number() OVER (PARTITION BY id ORDER BY grp) - 1 AS k, {n_words('sentence')} AS words, sentence FROM u WHERE sentence <> '')"""


CORPUS = corpus()

#: a: (doc_id, i, from_, to_, words) of the application's splitter over stripped texts, offsets from 0.
APP = rf"""t AS (SELECT doc_id, {stripped('text')} AS t FROM documents),
ap AS (SELECT doc_id, t, unnest(g) AS g, generate_subscripts(g, 1) AS j, len(g) AS n FROM (SELECT *, regexp_extract_all(t, '[^{WHITE}]+[{WHITE}]*') AS g FROM t)),
ae AS (SELECT *, sum(length(g)) OVER (PARTITION BY doc_id ORDER BY j)::BIGINT AS upto, regexp_extract(g, '^[^{WHITE}]+') AS w, regexp_extract(g, '[{WHITE}]*$') AS gap FROM ap),
af AS (SELECT *, lower(regexp_extract(w, '^(.*[.!?…])["''»«“”)\]]*$', 1)) AS token FROM ae),
ag AS (SELECT *, j < n AND ((token <> '' AND NOT list_contains({_list(R.APP_ABBREVIATIONS)}, token) AND NOT regexp_matches(token, '^\d+\.$')) OR regexp_matches(gap, '\n[{WHITE}]*\n')) AS ended FROM af),
ah AS (SELECT *, coalesce(sum(ended::INT) OVER (PARTITION BY doc_id ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS i FROM ag),
a AS (SELECT doc_id, i, min(upto - length(g))::BIGINT AS from_, max(upto - length(gap))::BIGINT AS to_, count(*)::INT AS words FROM ah GROUP BY doc_id, i)"""

SENTENCE_COUNTS = f"""WITH {CORPUS}, {APP} SELECT d.doc_id, coalesce(x.n, 0)::INT AS corpus_sentences, coalesce(y.n, 0)::INT AS app_sentences FROM documents d
LEFT JOIN (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id) x USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM a GROUP BY doc_id) y USING (doc_id)"""

_SUMS = "list_prepend(0::BIGINT, list(total ORDER BY {0}))"
_BELOW = "len(list_filter(l, lambda x: x < {}))"

#: h: (doc_id, number, start, stop, target, total) of all chunks; sentences start .. stop - 1.
CHUNKS = f"""{CORPUS}, l AS (SELECT doc_id, {_SUMS.format('k')} AS l, ('0x' || substr(sha256(doc_id::VARCHAR), 1, 8))::BIGINT % {len(TARGET_WORDS)} AS shift FROM (SELECT doc_id, k, sum(words) OVER (PARTITION BY doc_id ORDER BY k)::BIGINT AS total FROM s) GROUP BY doc_id),
h(doc_id, number, start, stop, target, total) AS (SELECT doc_id, 0, 0::BIGINT, 0::BIGINT, 0, 0::BIGINT FROM l
UNION ALL SELECT doc_id, number, start, stop, target, l[stop + 1] - l[start + 1] FROM (SELECT doc_id, number, start, target, l, CASE WHEN after - 1 > start AND l[after + 1] - goal > goal - l[after] THEN after - 1 ELSE after END AS stop FROM
(SELECT *, least({_BELOW.format('goal')}, len(l) - 1) AS after FROM (SELECT *, l[start + 1] + target AS goal FROM (SELECT h.doc_id, h.number + 1 AS number, h.stop AS start, ({list(TARGET_WORDS)})[(shift + h.number) % {len(TARGET_WORDS)} + 1] AS target, l FROM h JOIN l USING (doc_id) WHERE h.stop < len(l) - 1)))))"""
SPACED = "regexp_replace(regexp_replace(regexp_replace(regexp_replace({0} || ' ', '\\s+([,.;:!?])(\\s)', '\\1\\2', 'g'), '([(\\[„])\\s+', '\\1', 'g'), '([.!?,;:])\\s+“(\\s)', '\\1“\\2', 'g'), '\\s+([)\\]])', '\\1', 'g')"


def tidy(text: str) -> str:
    return f"rtrim({SPACED.format(stripped(f"regexp_replace({text}, '\\s+', ' ', 'g')"))}, ' ')"



KEPT = f"""{CHUNKS}, kept AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY number) - 1 AS r, count(*) OVER (PARTITION BY doc_id) AS n FROM h WHERE number > 1 AND abs(total - target) <= 0.3 * target),
few AS (SELECT * FROM kept WHERE n <= 3 OR r IN (0, round_even((n - 1) / 2.0, 0)::BIGINT, n - 1)),
x AS (SELECT f.doc_id, f.number, f.start, f.stop, any_value(f.target) AS target, string_agg(s.sentence, ' ' ORDER BY s.k) FILTER (WHERE s.k >= f.start) AS chunk,
string_agg(s.sentence, ' ' ORDER BY s.k) FILTER (WHERE s.k < f.start AND (s.k = f.start - 1 OR l.l[f.start + 1] - l.l[s.k + 1] <= 120)) AS before FROM few f JOIN l USING (doc_id) JOIN s ON s.doc_id = f.doc_id AND s.k < f.stop GROUP BY f.doc_id, f.number, f.start, f.stop)"""
CHUNK_ROWS = f"WITH RECURSIVE {KEPT} SELECT doc_id::VARCHAR AS document_id, number::INT AS chunk_number, target::INT AS target_length, {tidy('chunk')} AS chunk FROM x"
CHUNK_CONTEXTS = f"WITH RECURSIVE {KEPT} SELECT doc_id::VARCHAR AS document_id, number::INT AS chunk_number, {n_words('chunk')} AS words, {n_words('before')} AS context_words FROM x"

#: w: (doc_id, w, first, last) of the windows of 100 words every 20; the first row of a document is none.
WINDOWS = f"""{APP}, al AS (SELECT doc_id, {_SUMS.format('i')} AS l FROM (SELECT doc_id, i, sum(words) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS total FROM a) GROUP BY doc_id),
aw(doc_id, w, first, last, pos, again) AS (SELECT doc_id, -1, 0::BIGINT, 0::BIGINT, 0::BIGINT, true FROM al
UNION ALL SELECT doc_id, w, CASE WHEN stop < n THEN pos ELSE greatest(0, least(pos, len(list_filter(l, lambda x: x <= l[n + 1] - 100)) - 1)) END, stop, least(n - 1, {_BELOW.format('l[pos + 1] + 20')}), stop < n FROM
(SELECT *, least(n, {_BELOW.format('l[pos + 1] + 100')}) AS stop FROM (SELECT aw.doc_id, aw.w + 1 AS w, aw.pos, l, len(l) - 1 AS n FROM aw JOIN al USING (doc_id) WHERE again AND aw.pos < len(l) - 1)))"""
WINDOW_ROWS = f"WITH RECURSIVE {WINDOWS} SELECT doc_id, w::INT AS w, first::INT AS first, last::INT AS last FROM aw WHERE w >= 0"

_GATE = f"length(t) > 0 AND len(list_filter(regexp_extract_all(t, '[^{WHITE}]+'), lambda x: regexp_matches(x, '\\p{{L}}'))) >= 50 AND {n_words('t')} <= 3000"
#: z: (doc_id, i, from_, to_, words, p0, p1, p2): sentences with the weighted scores of their windows.
SCORED = f"""{WINDOWS}, al2 AS (SELECT doc_id, l FROM al), ok AS (SELECT doc_id, t FROM t WHERE {_GATE}),
wt AS (SELECT aw.doc_id, aw.w, aw.first, aw.last, list_filter(regexp_split_to_array(lower(substr(ok.t, x.from_ + 1, y.to_ - x.from_)), '[{WHITE}]+'), lambda v: v <> '') AS v FROM aw JOIN ok USING (doc_id) JOIN a x ON x.doc_id = aw.doc_id AND x.i = aw.first JOIN a y ON y.doc_id = aw.doc_id AND y.i = aw.last - 1 WHERE w >= 0),
wr AS (SELECT *, 1.0::DOUBLE + mean / 10 AS r0, 1.0::DOUBLE + 2 * rep AS r1, 1.0::DOUBLE + abs(mean - 5) / 5 AS r2 FROM (SELECT *, 1 - len(list_distinct(v)) / greatest(1, len(v))::DOUBLE AS rep, list_sum(list_transform(v, lambda x: length(x))) / greatest(1, len(v))::DOUBLE AS mean FROM wt)),
wz AS (SELECT doc_id, w, first, last, {', '.join(f'r{k} / (r0 + r1 + r2) AS p{k}' for k in range(3))} FROM wr),
ww AS (SELECT a.doc_id, a.i, a.from_, a.to_, a.words, wz.p0, wz.p1, wz.p2, greatest(1 - abs((l[a.i + 1] + l[a.i + 2]) / 2.0::DOUBLE - (l[first + 1] + l[last + 1]) / 2.0::DOUBLE) / greatest((l[last + 1] - l[first + 1]) / 2.0::DOUBLE, 1.0), 0.05::DOUBLE) AS g FROM wz JOIN al2 USING (doc_id) JOIN a ON a.doc_id = wz.doc_id AND a.i >= wz.first AND a.i < wz.last),
z0 AS (SELECT doc_id, i, from_, to_, words, {', '.join(f'sum(g * p{k}) / sum(g) AS p{k}' for k in range(3))} FROM ww GROUP BY ALL),
z AS (SELECT *, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS label FROM z0)"""
OVERALL = f"""WITH RECURSIVE {SCORED} SELECT doc_id, count(*) AS n_sentences, sum(words)::BIGINT AS words, {', '.join(f'round(sum(words * p{k}) / sum(words), 6) AS p{k}, round(coalesce(sum(words) FILTER (WHERE label = {k}), 0)::DOUBLE / sum(words), 6) AS share_{k}' for k in range(3))} FROM z GROUP BY doc_id"""
SPANS = f"""WITH RECURSIVE {SCORED}, y AS (SELECT *, (label IS DISTINCT FROM lag(label) OVER (PARTITION BY doc_id ORDER BY i))::INT AS new FROM z), v AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS span FROM y)
SELECT doc_id, span, min(from_)::INT AS start, max(to_)::INT AS "end", any_value(label)::INT AS label, sum(words)::BIGINT AS words, {', '.join(f'round(sum(words * p{k}) / greatest(sum(words), 1), 6) AS p{k}' for k in range(3))} FROM v GROUP BY doc_id, span"""


def share_of(rule: str) -> str:
    return f"len(list_filter(w, lambda x: {rule}))::DOUBLE / n"


DIGIT, LETTER = r"regexp_matches(x, '\d')", f"regexp_matches(x, '{LETTERS}')"
PLAIN = r"list_filter(list_transform(w, lambda x: regexp_replace(lower(x), '[^\p{L}\p{M}\p{N}_]+', '', 'g')), lambda x: x <> '')"


def prose(source: str, key: str, text: str) -> str:
    """v: (key, n_sentences, reason) of the whole prose gate."""
    words = f"list_filter(regexp_split_to_array({stripped(text)}, '[{WHITE}]+'), lambda x: x <> '')"
    return rf"""v AS (WITH {corpus(source, key, text)}, k AS (SELECT {key}, count(*) AS n_sentences, count(*) FILTER (WHERE words < 4) AS short FROM s GROUP BY {key}),
w AS (SELECT {key}, t, w, len(w) AS n, {PLAIN} AS plain FROM (SELECT {key}, {stripped(text)} AS t, {words} AS w FROM {source})),
g AS (SELECT w.*, coalesce(n_sentences, 0)::INT AS n_sentences, coalesce(short, 0) AS short FROM w LEFT JOIN k USING ({key}))
SELECT {key}, n_sentences, CASE WHEN n < 35 THEN 'under_35_words' WHEN NOT regexp_matches(t, '[.!?]["''»”’)\]}}]*$') THEN 'no_end_mark' WHEN n_sentences = 0 THEN 'no_sentence' WHEN {share_of(DIGIT)} > 0.15 THEN 'numeric' WHEN {share_of(f"{DIGIT} AND {LETTER}")} > 0.03 THEN 'mixed_tokens' WHEN {share_of(LETTER)} < 0.72 THEN 'not_alphabetic'
WHEN len(regexp_extract_all(t, '\b[A-Za-zÄÖÜäöüß\-]{{3,}}\s+\d+(?:\s*[,.;]\s*\d+){{2,}}')) >= 2 THEN 'index' WHEN len(regexp_extract_all(t, '\d+\s*,\s*\d+\s*,\s*\d+')) >= 2 THEN 'number_runs' WHEN len(regexp_extract_all(t, '[,;:/|]'))::DOUBLE / n > 0.30 THEN 'punctuation'
WHEN n_sentences >= 3 AND short::DOUBLE / n_sentences > 0.40 THEN 'short_sentences' WHEN len(list_distinct(plain))::DOUBLE / len(plain) < 0.22 THEN 'repetitive' END AS reason FROM g)"""


PROSE_GATE = f"WITH {prose('documents', 'doc_id', 'text')} SELECT doc_id, n_sentences, reason FROM v"

_CORE = "regexp_replace(x, '" + T.WORD_EDGES.replace("'", "''") + "', '', 'g')"


def glued(text: str) -> str:
    """How many words have a comma between letters, or are long with a capital inside."""
    return f"len(list_filter(list_transform(regexp_extract_all({text}, '[^{WHITE}]+'), lambda x: {_CORE}), lambda x: regexp_matches(x, '[a-zäöüß]{{2}},[a-zäöüß]{{2}}') OR (length(x) >= 18 AND regexp_matches(replace(x, 'Innen', 'innen'), '[a-zäöüß][A-ZÄÖÜ]'))))"


GLUED_WORDS = f"SELECT doc_id, {glued('text')}::INT AS glued FROM documents"
_REFERENCE = r"\b[A-ZÄÖÜ][a-zäöüß\-]+,\s(?:[A-ZÄÖÜ]\.\s?){1,3}|\b[A-ZÄÖÜ][a-zäöüß\-]+,\s[A-ZÄÖÜ][a-zäöüß]+\s\(\d{4}|\(\d{4}[a-z]?\)\s?:"
CHUNK_GATE = rf"""WITH RECURSIVE {KEPT}, y AS (SELECT doc_id || '#' || number AS id, doc_id, number, target, {tidy('chunk')} AS c, {n_words('before')} AS context_words FROM x), {prose('y', 'id', 'c')}
SELECT doc_id::VARCHAR AS document_id, number::INT AS chunk_number, target::INT AS target_length, {n_words('c')} AS words, context_words, CASE WHEN reason IS NOT NULL THEN 'chunk_not_prose' WHEN NOT regexp_matches(c, '^["''„“»(\[]?[A-ZÄÖÜ0-9]') THEN 'chunk_starts_mid_sentence'
WHEN regexp_matches(c, '\bISBN\b|€\s?\d|\d,\d\d\s?€|\bEUR\s?\d') THEN 'chunk_bibliographic_info' WHEN len(regexp_extract_all(c, '{_REFERENCE}')) >= greatest(2.0, {n_words('c')} * 0.01) THEN 'chunk_reference_list'
WHEN len(list_filter(regexp_extract_all(c, '[a-zäöüß]- ([a-zäöüß]+)', 1), lambda w: NOT list_contains({_list(T.HYPHEN_STAYS)}, w))) > 1 THEN 'chunk_broken_hyphenation' WHEN {glued('c')} >= 2 THEN 'chunk_missing_spaces' WHEN contains(c, chr(65533)) THEN 'chunk_broken_characters'
WHEN regexp_matches(c, '[\x{{00AD}}\x{{200B}}\x{{FB00}}-\x{{FB04}}]') THEN 'chunk_pdf_characters' WHEN contains(c, '•') THEN 'chunk_bullet_list'
WHEN len(list_filter(regexp_extract_all(c, '\b([A-Za-zÄÖÜäöüß]{{3,}})[.!?] ([a-zäöüß]{{3,}})', 1), lambda w: NOT list_contains({_list(R.CORPUS_ABBREVIATIONS)}, lower(w) || '.'))) > 0 THEN 'chunk_broken_sentence'
WHEN regexp_matches(c, 'www\.|https?:|doi\.org|\S+@\S+\.\w+') THEN 'chunk_url_or_email' END AS reject_reason FROM y JOIN v USING (id)"""
