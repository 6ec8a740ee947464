"""Faults found in review: infinite scores, capped priors, missing columns, hot rows, queries through the driver."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import blank_words, by_id, docs
from textlake.llm import graph_ann, mixing, ngram_lm, simhash, toxicity


def kneser_ney(texts):
    """log10 probability of a text by the formulas of the method, with dictionaries."""
    rows = [blank_words(t) + ["</s>"] for t in texts]
    pairs = Counter(p for r in rows for p in zip(["<s>"] + r, r))
    contexts = Counter(w for _, w in pairs)

    def discounts(counts):
        n = [sum(c == k for c in counts) for k in (1, 2, 3, 4)]
        if min(n) <= 0:
            return [0, 0.5, 1.0, 1.5]
        y = n[0] / (n[0] + 2 * n[1])
        d = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]]
        return [0] + [x if 0 < x < k else k / 2 for k, x in zip((1, 2, 3), d)]

    d, dw = discounts(pairs.values()), discounts(contexts.values())
    vocabulary = {w for r in rows for w in r}
    gamma_w = sum(dw[min(c, 3)] for c in contexts.values()) / len(pairs)

    def score(text):
        seq, total = blank_words(text) + ["</s>"], 0.0
        for v, w in zip(["<s>"] + seq, seq):
            p = (contexts[w] - dw[min(contexts[w], 3)]) / len(pairs) + gamma_w / (len(vocabulary) + 1)
            after = [c for (a, _), c in pairs.items() if a == v]
            if after and (v in vocabulary or v == "<s>"):
                c = pairs[v, w]
                p = (c - d[min(c, 3)]) / sum(after) + sum(d[min(x, 3)] for x in after) / sum(after) * p
            total += math.log10(p)
        return total

    return score, d, dw


def test_scores_are_finite_where_copies_make_a_discount_vanish(spark):
    texts = [f"w{k % 40} v{k % 40}" for k in range(120)] + ["foo bar"] * 2 + ["lone pair", "four x"] + ["four x"] * 3
    score, d, dw = kneser_ney(texts)
    rows = [(k, t) for k, t in enumerate(texts)] + [(1000, "foo zzz"), (1001, "zzz"), (1002, "w1 v1 foo"), (1003, None)]
    out, model = ngram_lm.train_and_score(docs(spark, rows), F.col("doc_id") < 1000)
    assert np.allclose(model.discounts, d) and np.allclose(model.word_discounts, dw) and min(d[1:]) > 0
    got = by_id(out, "lm")
    for i, t in rows:
        assert math.isfinite(got[i]["score"]) and got[i]["score"] == pytest.approx(score(t or ""), abs=1e-9), (i, t)


@pytest.mark.parametrize("counts", [(1, 1, 100, 1), (5, 1, 1, 90), (3, 2, 1, 1), (1, 1, 1, 1), (100, 1, 50, 1), (0, 1, 1, 1)])
def test_every_discount_leaves_something(counts):
    d = ngram_lm.discounts(np.array(counts))
    assert d[0] == 0 and all(0 < x < k for k, x in zip((1, 2, 3), d[1:]))


def test_prior_is_the_labelled_share(spark):
    d = docs(spark, [(k, f"word{k}") for k in range(20)])
    for positives in (1, 14, 20):
        lab = spark.createDataFrame([(k, 1, int(k < positives)) for k in range(20)], "doc_id long, quality int, toxic int")
        _, prior = toxicity.training_rows(d, lab, "toxic", F.lit(True), F.lit(True), toxicity.Params())
        assert prior == pytest.approx(min(positives / 20, 1 - 0.5 / 20))


def test_mixing_refuses_a_missing_dimension(spark):
    d = docs(spark, [(1, "a b c")])
    with pytest.raises(ValueError, match="lang"):
        mixing.sample(d.drop("lang"))
    assert mixing.sample(d).count() == 1


def test_repeated_row_is_combined_before_its_texts_are_dealt(spark):
    """A third of all rows is one row: the shuffle of texts gets it once a task."""
    rows = [(7, "the same long row " * 20)] * 400 + [(None, "no id at all " * 10)] * 400 + [(k + 100, f"text {k} " + " ".join(f"w{k}x{j}" for j in range(20))) for k in range(400)]
    d = docs(spark, rows).repartition(4)
    out = simhash.dedup(d)
    assert out.count() == 402 and out.columns == d.columns
    plan = out._jdf.queryExecution().executedPlan().toString()
    # the texts are first combined by row key in the tasks that read them, then dealt
    assert re.search(r"Exchange hashpartitioning\(_k1#\d+L, _k2#\d+L[^\n]*\n[^\n]*SortAggregate[^\n]*partial_first\(text", plan)


def test_queries_meet_shards_in_blocks(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>").withColumn("shard", F.lit("x"))
    p = graph_ann.Params(shard_rows=200, query_block=20)
    out = graph_ann.nearest(df, F.col("vec_id") % 5 == 0, 3, p)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapCoGroupsInPandas") == 1 and "Union" not in plan
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hit = total = 0
    got = {}
    for r in out.collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    for q in range(0, 900, 5):
        s = u @ u[q]
        s[q] = -9
        want = set(np.argsort(-s)[:3].tolist())
        hit, total = hit + len(want & set(got[q])), total + 3
    assert len(got) == 180 and hit / total >= 0.95
