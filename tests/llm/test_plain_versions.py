"""Quality scores and licence notices against plain versions of their definitions."""

import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import licenses, quality
from tests.llm.test_llm import EDGES, documents, real

# ---- quality: least squares on stacked rows, and isotonic means by their max-min form


def plain_scores(rows, labels, s=quality.Settings()):
    """A score for each (id, text); labels are (id, 0 or 1)."""
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    marks: dict[int, list[int]] = {}
    for i, q in labels:
        if i is not None and q is not None and fold(i):
            marks.setdefault(i, []).append(q)
    x = np.array([quality.statistics(t) for _, t in rows])
    train = [k for k, (i, _) in enumerate(rows) if i in marks]
    y = np.array([np.mean(marks[rows[k][0]]) for k in train])
    folds = np.array([fold(rows[k][0]) for k in train])
    spread = x[train].std(axis=0)
    phi = quality.Features(x[train].mean(axis=0), np.where(spread > 1e-9, spread, 1.0), s)(x)
    a = phi[train]

    def ridge(some, penalty):
        hold = np.full(a.shape[1], penalty * some.sum())
        hold[0] *= 0.001
        return np.linalg.lstsq(np.vstack([a[some], np.diag(np.sqrt(hold))]), np.concatenate([y[some], np.zeros(len(hold))]), rcond=None)[0]

    def out_of_fold(penalty):
        raw = np.zeros(len(y))
        for f in np.unique(folds):
            raw[folds == f] = a[folds == f] @ ridge(folds != f, penalty)
        return raw

    penalty = min(s.penalties, key=lambda p: ((out_of_fold(p) - y) ** 2).sum())
    place = lambda raw: (np.clip(raw, -0.5, 1.5) + 0.5) / 2 * (s.bins - 1)
    at = np.rint(place(out_of_fold(penalty))).astype(int)
    used = sorted(set(at))
    weight = np.array([(at == b).sum() for b in used])
    total = np.array([y[at == b].sum() for b in used])
    mean = lambda i, j: total[i : j + 1].sum() / weight[i : j + 1].sum()
    level = [max(min(mean(i, j) for j in range(k, len(used))) for i in range(k + 1)) for k in range(len(used))]
    raw = phi @ ridge(np.ones(len(y), bool), penalty)
    curve = np.interp(np.arange(s.bins), used, level)
    return np.clip(0.999 * np.interp(place(raw), np.arange(s.bins), curve) + 0.001 / (1 + np.exp(-4 * (raw - 0.5))), 0, 1)


def test_quality_equals_a_plain_fit(spark, small_dir):
    docs, labels = real(spark, small_dir), spark.read.parquet(f"{small_dir}/labels.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = plain_scores(rows, [(r.doc_id, r.quality) for r in labels.collect()])
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert len(got) == len(rows) and np.ptp(want) > 0.5
    for (i, _), score in zip(rows, want, strict=True):
        assert got[i].score == pytest.approx(score, abs=1e-6)
        assert got[i].predicted == (score >= 0.3) or abs(score - 0.3) < 1e-6


def test_quality_ignores_extra_columns(spark):
    docs = documents(spark, [*EDGES, *[f"a plain text of {i} words " * (i % 5 + 1) for i in range(30)]])
    labels = spark.createDataFrame([(i, i % 2) for i in range(len(EDGES), len(EDGES) + 30)], "doc_id long, quality int")
    clash = lambda df: df.withColumns({c: F.lit("x") for c in ("x", "fold", "y", "key", "blob", "score", "held_out")})
    a, b = ({r.doc_id: r.score for r in quality.classify(d, x).collect()} for d, x in ((docs, labels), (clash(docs), clash(labels))))
    assert a == pytest.approx(b) and len(a) == docs.count()


# ---- licences: every template at every place, by loops


def plain_notices(text, templates=licenses.TEMPLATES, rare=8, agree=0.75, drift=2):
    words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    held = {w: sum(w in t.split() for _, t, _ in templates) for _, t, _ in templates for w in t.split()}
    out = []
    for label, body, phrases in templates:
        body = body.split()
        ranked = sorted(set(body), key=lambda w: (-math.log((1 + len(templates)) / (1 + held[w])), w))
        indexed = sum(w in ranked[:rare] for w in body)
        chosen = [w for w in ranked if w in words][:rare]
        votes = [(i - p, p) for i, w in enumerate(words) if w in chosen for p, v in enumerate(body) if v == w]
        counts = {at: len({p for other, p in votes if at <= other <= at + 2 * drift}) for at, _ in votes}
        if not counts:
            continue
        n, start = max((n, -at) for at, n in counts.items())
        start = -start
        low, high = max(0, start - 2 * drift), max(0, start) + len(body) + 2 * drift
        inside = all(any(words[i : i + len(p.split())] == p.split() for i in range(low, high + 1)) for p in phrases)
        if sum(body.count(w) for w in chosen) >= math.ceil(agree * indexed) <= n and inside:
            out.append((label, start, min(1.0, n / indexed)))
    return out


def test_notices_equal_loops(spark, small_dir):
    rng = random.Random(5)
    filler = "the license of this work and that software is free under terms as they may be found in a copy with or without".split()
    texts = list(EDGES[:-3])
    for _ in range(150):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            parts += rng.choices(filler, k=rng.randrange(12))
            for w in rng.choice(licenses.TEMPLATES)[1].split():
                u = rng.random()
                parts += [] if u < 0.04 else [w, rng.choice(filler)] if u < 0.08 else [rng.choice(filler)] if u < 0.11 else [w.upper() if u > 0.9 else w]
        texts.append(rng.choice([" ", ", ", "\n"]).join(parts))
    texts += [r.text for r in real(spark, small_dir).select("text").collect()]
    got = {r.doc_id: [tuple(n) for n in r.notices] for r in licenses.scan(documents(spark, texts)).collect()}
    want = {i: plain_notices(t) for i, t in enumerate(texts)}
    assert sum(map(bool, want.values())) > 60
    for i, notices in want.items():
        assert [(label, start) for label, start, _ in got[i]] == [(label, start) for label, start, _ in notices], texts[i]
        assert [x for *_, x in got[i]] == pytest.approx([x for *_, x in notices])
