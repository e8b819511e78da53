"""Secret scans: pattern matches, and guess costs of values in a credential context.

The guess cost of a value is the least sum, over its segmentations, of the log10 guesses of each
segment: a ranked word, a date, a repeat, a keyboard walk or sequence, a word of natural language, or
brute force. One dynamic program over prefixes finds it; spans are bounded, so its time is linear in
the value, which is costed whole, however long. Ranked words are a fixed list of what passwords are made
of, and then the words of a public tokenizer's vocabulary in its order (`ranked_words`); they are not
learnt from the corpus, in which a secret that is copied often would pass for a common word. Other words
of natural language are told by their pairs of letters.

A quoted value runs to its closing quote on the line, a bare one to a blank, quote, bracket, comma or
semicolon, a password in an address to its @. One cost model judges all: a value is reported if its guesses
reach `strong`, and after a blank, where prose may stand, if those of what is no word do, or if all reach
`prose`. Each further word of a value with blanks raises what it must reach by a word's guesses.

Nulls and empty texts have no spans; repeated rows are scanned each for itself; rows without an id
pass through; extra columns are ignored by `scan` and kept by `redact`, whatever they are called; an
empty table gives no rows. Of spans that start together the kinds come in the order of KINDS.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_batches

# The base kinds, in the order in which spans of equal start are listed.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "credential")

#: A wider credential context: more key words, URL user info and bearer headers; quoted and bare values.
CONTEXT = re.compile(
    r"""(?:(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|api[_-]?key|(?:access|private|auth|account)[_-]?key|auth)"""
    r"""["']?\s*(?:=>|[:=])\s*|\bbearer\s+)(?:(?P<quote>["'`])(?P<quoted>(?:\\.|(?!(?P=quote))[^\\\n])+)(?P=quote)|["'`]?(?P<bare>[^\s"'`<>,;]+))"""
    r"""|://[^\s:/@"']+:(?P<address>[^\s"'`<>,;@/]+)@?""",
    re.ASCII | re.IGNORECASE,
)
VALUES = ("quoted", "bare", "address")
PARAMETER = re.compile(r"&[\w.\[\]-]+=", re.ASCII)  # begins another value of a query string
CUES = ("pass", "pwd", "secret", "token", "credential", "key", "auth", "bearer", "://")

# Words that values are built of, most common first.
WORDS = (
    "password pass admin welcome secret letmein dragon monkey master login qwerty hello freedom "
    "shadow sunshine princess football baseball superman batman trustno iloveyou access flower "
    "summer winter spring autumn monday friday changeme default example sample test testing demo "
    "user root guest public private token key your my the one two three love money ninja star "
    "london paris berlin madrid computer internet server database backup company office phone "
    "alpha beta gamma delta orange apple banana cookie coffee tiger lion eagle silver gold black "
    "white green blue red placeholder redacted none null true false todo insert here value string"
).split()
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
LEET = str.maketrans("@4301!5$7", "aaeoiisst")
DATE = re.compile(
    r"(?:(?:19|20)\d\d[-/._]?[01]\d[-/._]?[0-3]\d|[0-3]?\d[-/._][01]?\d[-/._](?:19|20)?\d\d|[0-3]\d[01]\d(?:19|20)\d\d|(?:19|20)\d\d)"
)

# Common pairs of letters in English, German, French and Spanish, a first letter and those that follow it.
PAIRS = frozenset(p[0] + q for p in (
    "abcdgiklmnprstuvyz baeijlou cacehiklortu dadeiosu eacdefgilmnpqrstuvwxyz faefiortu gaehilnrsu haeioru "
    "iabcdefglmnoprstvz jaeou ke ladefilostuy mabeimopsu nacdegilnostuvyz obcdgilmnoprstuvw paefiloprty qu "
    "racdegikmnorstuyz sacehilopstuy taehilorstuyz uabcefgilmnprstx vaei waehiou xcept ynopst zaeou"
    " gns knsy phsy wnsl ysp gsr bslry awu ewu"
).split() for q in p[1:])
RUN = re.compile(r"[^\W\d_]+")
CASED = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
#: log10 guesses of a word of natural language that is in no list.
NATURAL = 5.5


def natural(word: str) -> bool:
    """Whether a run of letters reads as a word: one, or at most one in six, of its pairs of letters is rare."""
    low = word.lower()
    if not word.isascii():
        return True
    return 3 <= len(low) <= 24 and sum(low[i : i + 2] not in PAIRS for i in range(len(low) - 1)) <= max(1, (len(low) - 1) // 6)


def _neighbours() -> dict[str, set[str]]:
    near: dict[str, set[str]] = {}
    for y, row in enumerate(ROWS):
        for x, key in enumerate(row):
            for dy, dx in ((0, -1), (0, 1), (-1, 0), (-1, 1), (1, -1), (1, 0)):
                if 0 <= y + dy < len(ROWS) and 0 <= x + dx < len(ROWS[y + dy]):
                    near.setdefault(key, set()).add(ROWS[y + dy][x + dx])
    return near


NEAR = _neighbours()
STARTS, DEGREE = len(NEAR), sum(map(len, NEAR.values())) / len(NEAR)


class GuessCost:
    """log10 guesses of a value. `words` in rank order; a segment costs `overhead` besides its guesses.
    A run of letters that reads as a word is guessed from a large dictionary."""

    def __init__(self, words: tuple[str, ...] | list[str] = tuple(WORDS), overhead: float = 0.3, reach: int = 24):
        self.rank = {w: math.log10(i + 2) for i, w in reversed(list(enumerate(words)))}
        self.longest = max(map(len, words), default=0)
        self.overhead, self.reach = overhead, max(reach, self.longest)

    @staticmethod
    def brute(c: str) -> float:
        if c.isdigit():
            return 1.0
        if "a" <= c <= "z":
            return math.log10(26)
        if "A" <= c <= "Z":
            return math.log10(52)
        return math.log10(94)

    def segments(self, s: str) -> dict[int, list[tuple[int, float, str]]]:
        """Segments that beat brute force, by their end: (start, log10 guesses, kind)."""
        ends: dict[int, list[tuple[int, float, str]]] = {}

        def add(i, j, cost, kind):
            ends.setdefault(j, []).append((i, cost, kind))

        low = s.lower()
        plain = low.translate(LEET)
        n = len(s)
        for i in range(n):
            for j in range(i + 3, min(n, i + self.longest) + 1):
                for form, extra in ((low, 0.0), (plain, 0.5)):
                    if (r := self.rank.get(form[i:j])) is not None:
                        add(i, j, r + extra + (0.3 if s[i:j] != low[i:j] else 0.0), "word")
                        break
            if m := DATE.match(s, i):
                add(i, m.end(), math.log10(365 * 119) if m.end() - i > 4 else math.log10(119), "date")
        for run in RUN.finditer(s):
            for m in CASED.finditer(run[0]) if run[0].isascii() else (re.match(".*", run[0]),):
                if natural(m[0]):
                    add(run.start() + m.start(), run.start() + m.end(), NATURAL + (0.3 if m[0] != m[0].lower() else 0.0), "natural")
        for unit in (1, 2, 3, 4):  # a run of period `unit`; every end of it is a segment
            i = 0
            while i + unit < n:
                j = i + unit
                while j < n and s[j] == s[j - unit]:
                    j += 1
                if j - i >= max(3, 2 * unit):
                    base = sum(map(self.brute, s[i : i + unit]))
                    for e in {j, *range(i + max(3, 2 * unit), min(j, i + self.reach) + 1)}:
                        add(i, e, base + math.log10((e - i) / unit + 1), "repeat")
                    i = j - unit + 1
                else:
                    i += 1
        for kind, step in (("walk", lambda a, b: b in NEAR.get(a, ())), ("sequence", lambda a, b: a.isalnum() and b.isalnum() and abs(ord(a) - ord(b)) == 1)):
            i = 0
            while i < n - 2:
                j = i + 1
                while j < n and step(low[j - 1], low[j]):
                    j += 1
                for b in range(i, min(j - 2, i + self.reach)) if j - i >= 3 else ():
                    for e in range(b + 3, min(j, b + self.reach) + 1):
                        guesses = STARTS * (e - b) * DEGREE if kind == "walk" else STARTS * (e - b)
                        add(b, e, math.log10(guesses), kind)
                i = max(j - 1, i + 1)
        return ends

    def parts(self, s: str) -> tuple[float, float]:
        """Least log10 guesses of the whole value, and what words of natural language have in them."""
        best, words = [0.0] + [math.inf] * len(s), [0.0] * (len(s) + 1)
        ends = self.segments(s)
        single = [self.brute(c) for c in s]
        for j in range(1, len(s) + 1):
            low, prose, run = math.inf, 0.0, 0.0
            for i in range(j - 1, max(-1, j - 1 - self.reach), -1):
                run += single[i]
                if best[i] + run < low:
                    low, prose = best[i] + run, words[i]
            for i, c, kind in ends.pop(j, ()):
                if best[i] + c < low:
                    low, prose = best[i] + c, words[i] + (c + self.overhead if kind in ("natural", "word") else 0.0)
            best[j], words[j] = low + self.overhead, prose
        return best[-1], words[-1]

    def cost(self, s: str) -> float:
        return self.parts(s)[0]


def ranked_words(vocabulary: str) -> list[str]:
    """WORDS, then the whole words (a space and at least three letters) of a file of byte-pair ranks, by rank."""
    found = []
    with open(vocabulary, "rb") as f:
        for line in f:
            token, rank = line.split()
            word = base64.b64decode(token)
            if re.fullmatch(rb" [A-Za-z]{3,}", word):
                found.append((int(rank), word[1:].decode().lower()))
    return list(dict.fromkeys([*WORDS, *(w for _, w in sorted(found))]))


def strength(m: re.Match, start: int, value: str, model: GuessCost, strong: float, prose: float = 14.0) -> float | None:
    """log10 guesses of a context's value if they are enough."""
    cost, words = model.parts(value)
    more = NATURAL + 1.0 if any(c.isspace() for c in value) else 0.0
    more *= len(value.split()) - 1
    if not m.string[max(0, start - 2) : start].rstrip("\"'`")[-1:].isspace():
        return cost if cost >= strong + more else None
    return cost if cost - words >= strong + more or cost >= max(strong, prose) + more else None


def find(text: str | None, model: GuessCost, strong: float = 8.0) -> list[tuple[str, int, int, float | None]]:
    """Spans (kind, start, end, log10 guesses of a credential value or None), by start and kind."""
    if not text:
        return []
    spans = []
    low = text.lower() if text.isascii() else text.casefold()
    if "=" in text or ":" in text or "bearer" in low:
        if any(c in low for c in CUES):
            for m in ASSIGN.finditer(text):
                if m.end(2) - m.start(2) >= 8:
                    spans.append(("assign", m.start(), m.end(), model.cost(m[2])))
    if "AKIA" in text:
        spans += [("access", m.start(), m.end(), None) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    spans += [("hex", m.start(), m.end(), None) for m in HEX.finditer(text)]
    if any(c in low for c in CUES) and ("=" in text or ":" in text or "bearer" in low):
        base, pos = sorted(s[1:3] for s in spans), 0
        while m := CONTEXT.search(text, pos):
            a, b = next(m.span(v) for v in VALUES if m[v] is not None)
            over = [s for s in base if s[0] < b and a < s[1]]
            pos = max(s[1] for s in over) if over else b
            if over and pos < b:  # what exceeds the base spans, up to the next parameter or context
                ends = [x.start() for x in (PARAMETER.search(text, pos, b), CONTEXT.search(text, pos)) if x]
                b = min(b, *ends) if ends else b
            value = text[a:b].rstrip(".)")
            if (c := strength(m, a, value, model, strong)) is not None:
                at = a
                for s in [*over, (a + len(value),) * 2]:
                    if (not over and at < s[0]) or any(x.isalnum() for x in text[at : s[0]]):
                        spans.append(("credential", at, s[0], c))
                    at = max(at, s[1])
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def digest(spans: list) -> tuple[str, str]:
    joined = [",".join(f"{k}:{a}:{b}" for k, a, b, _ in part) for part in ([s for s in spans if s[0] != "credential"], spans)]
    return hashlib.sha256(joined[0].encode()).hexdigest(), joined[1]


SPAN = "array<struct<kind:string,start:int,end:int,log10_guesses:double>>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", strong: float = 8.0, words: list[str] | tuple[str, ...] = tuple(WORDS)) -> DataFrame:
    """(id, secrets): for each row its spans, code points, end exclusive. A narrow map; no shuffle."""
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("log10_guesses", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = GuessCost(words)
        for b in batches:
            found = [[dict(zip(("kind", "start", "end", "log10_guesses"), s, strict=True)) for s in find(t.as_py(), model, strong)] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, arrow)], names=["id", "secrets"])

    id_type = docs.schema[id_col].dataType.simpleString()
    text_batches(docs.sparkSession)
    src = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    return src.mapInArrow(run, f"id {id_type}, secrets {SPAN}").withColumnRenamed("id", id_col)


def scan_digest(docs: DataFrame, words: list[str] | tuple[str, ...] = tuple(WORDS)) -> DataFrame:
    """The contract's columns, derived per row from the same `find` as `scan`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = GuessCost(words)
        for b in batches:
            rows = [find(t.as_py(), model) for t in b.column(1)]
            both = [digest(r) for r in rows]
            count = lambda k: pa.array([sum(s[0] == k for s in r) for r in rows], pa.int64())  # noqa: B023, E731
            most = [max((s[3] for s in r if s[3] is not None), default=None) for r in rows]
            cols = [b.column(0), count("assign"), count("access"), count("hex"), pa.array([d[0] for d in both], pa.string()), pa.array([d[1] for d in both], pa.string()), count("credential"), pa.array(most, pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=NAMES)

    text_batches(docs.sparkSession)
    NAMES = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_credential", "max_log10_guesses"]
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_credential long, max_log10_guesses double"
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(run, schema)


def redact_text(text: str | None, model: GuessCost, strong: float = 8.0) -> str | None:
    """The text with each span (overlapping ones merged) replaced by a mark of its first kind."""
    spans = find(text, model, strong)
    if not spans:
        return text
    out, at = [], 0
    merged: list[list] = []
    for kind, a, b, _ in spans:
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([kind, a, b])
    for kind, a, b in merged:
        out += [text[at:a], f"<{kind.upper()}_REMOVED>"]
        at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text", strong: float = 8.0, words: list[str] | tuple[str, ...] = tuple(WORDS)) -> DataFrame:
    """All rows and columns, with secrets replaced in `text_col`."""
    @F.pandas_udf("string")
    def clean(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = GuessCost(words)
        for part in texts:
            yield part.map(lambda t: redact_text(t, model, strong) if isinstance(t, str) else None)

    text_batches(docs.sparkSession)
    return docs.withColumn(text_col, clean(F.col(text_col).cast("string")))
