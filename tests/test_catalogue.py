"""Every query of the catalogue against DuckDB where it has SQL, else for rows and a stable schema."""

import math

import duckdb
import pandas as pd
import pytest

from corpusmill.plans.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small_dir):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small_dir}/{t}.parquet'")
    return c


def rows(df):
    def one(v):
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
            return None
        return str(v)[:19] if hasattr(v, "isoformat") else round(float(v), 9) if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)

    df = df[sorted(df.columns)].astype(object)
    return sorted(str(tuple(map(one, r))) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, small_dir, duck):
    got = QUERIES[name](spark, small_dir)
    frame = got.toPandas()
    assert list(frame.columns) == got.columns and len(set(got.columns)) == len(got.columns)
    if name in ORACLE_SQL:
        want = duck.sql(ORACLE_SQL[name]).df()
        assert sorted(frame.columns) == sorted(want.columns)
        days = [c for c in frame if c in ("day",)]
        for c in days:
            want[c] = pd.to_datetime(want[c]).dt.date.astype(object).where(want[c].notna(), None)
        assert rows(frame) == rows(want)
    else:
        assert len(frame) > 0


def test_detection_equals_loops(spark, small_dir):
    """q39 against plain loops over sentences and windows."""
    from corpusmill.functions.sentences import app_spans
    from corpusmill.operators.detect import lexical_scorer, make_windows

    score, want = lexical_scorer(), {}
    for d in spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text").collect():
        text = d.text.strip()
        if sum(any(c.isalpha() for c in w) for w in text.split()) < 50 or len(text.split()) > 3000:
            continue
        spans = app_spans(text)
        words = [len(text[a:b].split()) for a, b in spans]
        middle = [sum(words[:i]) + w / 2 for i, w in enumerate(words)]
        sums, weights = [[0.0] * 3 for _ in spans], [0.0] * len(spans)
        for a, b in make_windows(words):
            p = score([text[spans[a][0] : spans[b - 1][1]]])[0]
            low, high = sum(words[:a]), sum(words[:b])
            for i in range(a, b):
                w = max(1 - abs(middle[i] - (low + high) / 2) / max((high - low) / 2, 1), 0.05)
                weights[i] += w
                sums[i] = [x + w * y for x, y in zip(sums[i], p)]
        own = [[x / w for x in row] for row, w in zip(sums, weights)]
        total = sum(words)
        shares = [sum(w for w, p in zip(words, own) if p.index(max(p)) == k) / total for k in range(3)]
        want[d.doc_id] = [sum(w * p[k] for w, p in zip(words, own)) / total for k in range(3)] + shares
    got = {r.doc_id: [r.p0, r.p1, r.p2, r.share_0, r.share_1, r.share_2] for r in QUERIES["q39_detect_overall_and_shares"](spark, small_dir).collect()}
    assert set(got) == set(want)
    assert all(got[i] == pytest.approx(want[i], abs=2e-6) for i in want)


def test_entry_points():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) >= 60
