"""Cases of the fourth round's findings."""

import math
from collections import Counter

import pytest

from corpusmill.operators import ml


def test_terms_are_summed_by_hash_and_nothing_is_kept_in_memory(spark, monkeypatch):
    """Every term was a Java object of a cached table, and terms of equal counts were taken in any order."""
    texts = ["immer " + " ".join(f"w{(i * k) % 11:02d}" for k in range(1, 6)) + " doppelt doppelt" * (i % 3 == 0) for i in range(20)]
    df = ml.tokens(spark.createDataFrame([(t, i % 2) for i, t in enumerate(texts)], "text string, label int")).repartition(3)
    monkeypatch.setattr(type(df), "persist", lambda *a: pytest.fail("texts' terms are cached"))
    model = ml.fit(df, min_df=2.0, max_df=0.9, features=25, iterations=2)
    terms = [(w := t.split()) + [f"{a} {b}" for a, b in zip(w, w[1:])] for t in texts]
    counted, seen = Counter(x for t in terms for x in t), Counter(x for t in terms for x in set(t))
    want = sorted((x for x in counted if 2 <= seen[x] <= 18), key=lambda x: (-counted[x], x))
    assert len(want) > 25 and counted[want[24]] == counted[want[25]]  # the last place is one of several equal ones
    assert model.stages[0].vocabulary == want[:25] and "immer" not in want
    assert list(model.stages[2].getScalingVec()) == pytest.approx([math.log(21 / (1 + seen[x])) + 1 for x in want[:25]])


def test_few_texts_are_fitted(spark):
    """min_df is the number of texts where they are fewer, so max_df must leave terms that all of them have."""
    df = ml.tokens(spark.createDataFrame([("gut und schön", 1), ("gut oder übel", 0), ("gut so", 0)], "text string, label int"))
    assert ml.fit(df, iterations=2).stages[0].vocabulary == ["gut"]
    with pytest.raises(ValueError, match="min_df"):
        ml.fit(df.where("label = 2"))
