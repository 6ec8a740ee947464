"""Character TF-IDF by units of texts: the same rows as counted one by one, and nothing sent for a (text, gram)."""

from collections import Counter
from math import log, sqrt

import numpy as np
import pytest

from textlake.operators import ngrams as N


def _want(rows, minn, maxn):
    tf = {}
    for k, t in rows:
        t = (t or "").lower().replace("  ", " ")
        tf.setdefault(k, Counter()).update(t[i:i + n] for n in range(minn, maxn + 1) for i in range(len(t) - n + 1))
    df = Counter(g for c in tf.values() for g in c)
    want = {}
    for k, c in tf.items():
        w = {g: n * (log((1 + len(rows)) / (1 + df[g])) + 1) for g, n in c.items()}
        want |= {(k, g): x / sqrt(sum(v * v for v in w.values())) for g, x in w.items()}
    return want


@pytest.mark.parametrize("letters", ["abcd", "aé\U0001f600z", [chr(0x4E00 + 7 * i) for i in range(900)]])
@pytest.mark.parametrize("unit", [40, 1000])
def test_units_give_the_weights_of_every_text(spark, monkeypatch, letters, unit):
    """Numbers as keys, and byte strings where an alphabet is too large for them."""
    monkeypatch.setattr(N, "GRAM_UNIT", unit)
    monkeypatch.setattr(N, "LEAST_CHARS", 64)
    monkeypatch.setattr(N, "ROWS_A_BATCH", 50)
    monkeypatch.setattr(N, "BEST_ROWS", 60)
    rng = np.random.default_rng(3)
    rows = [(int(i % 37) or None, "".join(letters[j] for j in rng.zipf(1.3, int(rng.integers(0, 60))) % len(letters))) for i in range(60)]
    rows += [(1, None), (99, ""), (98, None), (97, "ab"), (96, "Abc  abd" * 9)]
    out = N.char_tfidf(spark.createDataFrame(rows, "k long, t string"), "k", "t", 2, 7)
    got = {(r["k"], r["gram"]): r["weight"] for r in out.collect()}
    want = _want(rows, 2, 7)
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-12 for x in want)
    top = {}
    for (_, g), w in want.items():
        top[g] = max(top.get(g, 0.0), w)
    found = {r["gram"]: r["max_weight"] for r in N.top_grams(out).collect()}
    assert found.keys() == top.keys() and all(abs(found[g] - top[g]) < 1e-12 for g in top)


def test_large_inputs_are_not_joined_by_gram(spark, monkeypatch):
    monkeypatch.setattr(N, "GRAM_UNIT", 10)
    docs = spark.createDataFrame([(1, "some text"), (2, "other text")], "k long, t string")
    plan = N.char_tfidf(docs, "k", "t")._jdf.queryExecution().executedPlan().toString()
    assert "gram" not in "".join(x for x in plan.splitlines() if "hashpartitioning" in x)


def test_top_grams_sends_tables_not_a_row_a_gram(spark):
    """A task's largest weights go out in compressed tables: no exchange by gram, and null grams stay a group."""
    rows = [("abc", 0.5), ("abc", 0.7), (None, 0.2), (None, 0.1), ("", 0.3)]
    top = N.top_grams(spark.createDataFrame(rows, "gram string, weight double").repartition(3))
    assert "hashpartitioning(gram" not in top._jdf.queryExecution().executedPlan().toString()
    assert {r["gram"]: r["max_weight"] for r in top.collect()} == {"abc": 0.7, None: 0.2, "": 0.3}
