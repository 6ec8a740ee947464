"""Line features by units of lines against a plain loop."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from textlake.operators import models as M

MASK = 2 ** 32 - 1


def _fnv(s):
    h = 2166136261
    for b in s.encode():
        h = ((h ^ (b + 0xFFFFFF00 if b >= 128 else b)) * 16777619) & MASK
    return h


def _grams(word, minn, maxn):
    w = f"<{word}>"
    return [] if word == "</s>" else [w[i:i + n] for i in range(len(w)) for n in range(minn, maxn + 1) if i + n <= len(w)]


@pytest.mark.parametrize("unit", [3, 1 << 20])
@pytest.mark.parametrize("minn, maxn", [(0, 0), (3, 4)])
def test_features_equal_a_loop_for_units_of_any_size(spark, unit, minn, maxn):
    ids = {"</s>": 0, "word": 1, "é": 2, "other": 3, "__label__b": 4, "__label__a": 5}
    vocab = spark.createDataFrame([(i, w) for w, i in ids.items()], "id long, word string")
    rng = np.random.default_rng(1)
    pool = [*ids, "unknown", "__label__new"]
    data = [(k, [pool[i] for i in rng.integers(0, len(pool), size=n)]) for k, n in enumerate([1, 2, 5, 30, 0, 3])]
    data += [(10, ["__label__a"]), (11, None), (12, ["__label__b", "__label__b", "__label__a", "é"])]
    args = M.Args(word_ngrams=3, bucket=101, minn=minn, maxn=maxn)
    got = M.line_features(spark.createDataFrame(data, "k long, t array<string>"), "k", "t", vocab, args, 4, unit=unit).collect()
    got = {r["k"]: (r["features"], sorted(r["labels"])) for r in got}
    want = {}
    for k, t in data:
        words = [w for w in t or [] if not w.startswith("__label__")]
        if not words:
            continue
        f = [x for w in words for x in ([ids[w]] if w in ids else []) + [_fnv(g) % 101 + 4 for g in (_grams(w, minn, maxn) if maxn else [])]]
        hs = [_fnv(w) - 2 ** 32 if _fnv(w) >= 2 ** 31 else _fnv(w) for w in words]
        for n in (2, 3):
            for i in range(len(hs) - n + 1):
                h = 0
                for x in hs[i:i + n]:
                    h = (h * 116049371 + x) % 2 ** 64
                f.append(h % 101 + 4)
        want[k] = f, sorted({ids[w] - 4 for w in t if w.startswith("__label__") and w in ids})
    assert got == want


def test_words_meet_units_of_lines(spark):
    """No aggregate puts a line's tokens together again after a join."""
    df = spark.createDataFrame([(1, ["a", "b"])], "k long, t array<string>")
    vocab = spark.createDataFrame([(0, "a")], "id long, word string")
    plan = M.line_features(df, "k", "t", vocab, M.Args(), 1)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "collect_list" not in plan
