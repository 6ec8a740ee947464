"""Sums of rows by units (``vectors.row_sums``) against plain loops, and what its plan exchanges."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from textlake.operators import evaluation as EV
from textlake.operators import vectors as VE

DIM = 3


def _rows(spark, ids):
    rng = np.random.default_rng(5)
    vec = {i: [float(x) for x in rng.normal(size=DIM)] for i in ids}
    return vec, spark.createDataFrame([(i, v, 2.0) for i, v in vec.items()], f"word {'long' if isinstance(ids[0], int) else 'string'}, vec array<double>, scale double")


@pytest.mark.parametrize("unit", [2, 7, 1 << 20])
@pytest.mark.parametrize("kind", ["string", "long"])
def test_sums_equal_a_loop_for_units_of_any_size(spark, unit, kind):
    words = ["a", "b", "é", "", "x\0y"] if kind == "string" else [3, 5, 7, -1, 1 << 40]
    vec, rows = _rows(spark, words)
    rng = np.random.default_rng(6)
    bags = [(k, [words[i] for i in rng.integers(0, 5, size=n)] + ([None] if k == 4 else [])) for k, n in enumerate([0, 1, 5, 40, 9, 3])]
    bags += [(6, None), (7, ["none"] if kind == "string" else [99]), (3, [words[0]])]      # a key may have several bags
    got = {r[0]: (r[1], r[2]) for r in VE.row_sums(spark.createDataFrame(bags, f"k long, t array<{kind}>"), "k", "t", rows, DIM, unit=unit).collect()}
    want = {}
    for k, t in bags:
        for w in t or []:
            if w in vec:
                s, n = want.get(k, (np.zeros(DIM), 0))
                want[k] = s + 2.0 * np.array(vec[w]), n + 1
    assert got.keys() == want.keys()
    for k, (s, n) in want.items():
        assert got[k][1] == n and np.allclose(got[k][0], s)


def test_word_with_two_rows_gives_both(spark):
    rows = spark.createDataFrame([("a", [1.0, 2.0], 1.0), ("a", [3.0, 4.0], 1.0), ("b", [5.0, 5.0], 1.0)], "word string, vec array<double>, scale double")
    bags = spark.createDataFrame([(1, ["a", "b", "a"])], "k long, t array<string>")
    assert VE.row_sums(bags, "k", "t", rows, 2).first().asDict() == {"k": 1, "vec": [13.0, 17.0], "n": 5}


@pytest.mark.parametrize("how", ["normed", "mean", "sumsq", "hidden"])
def test_vectors_meet_units_not_every_text(spark, how):
    """No join of the plan brings a vector to every (text, word)."""
    text = spark.range(50).select("id", F.array(*[F.lit(f"w{i}") for i in range(20)]).alias("t"))
    rows = spark.range(20).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("word"), F.array(F.lit(1.0), F.lit(2.0)).alias("vec"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = EV.sentence_hidden(text, "id", "t", rows, 2) if how == "hidden" else VE.text_vectors(text, "id", "t", rows, 2, how)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert len(df.collect()) == 50
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    joins = [l for l in plan.splitlines() if "Join" in l and "word" in l]
    assert "CoGroupsInArrow" in plan and joins
    assert not any("Summarizer" in l or "aggregate_metrics" in l for l in plan.splitlines())
