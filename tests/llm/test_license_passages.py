"""Licence passages against brute force over all runs, and their edge cases."""

import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from helpers import EDGE_TEXTS, by_id, docs, empty_docs
from textlake.llm import licenses as L

SMALL = (("one", "a b c d e"), ("one", "f g h"), ("two", "a b a b c a b"), ("three", "d e f g h i j k l m"), ("four", "x y"))


def _words(text):
    return re.sub(r"[^\w]+|_", " ", text.lower()).split()


def brute(text, templates, t=L.THRESHOLD):
    """(first word, last word, name, dice) of all runs, best first, without overlaps."""
    w = _words(text or "")
    g = [" ".join(p) for p in zip(w, w[1:])]
    runs, matching = [], []
    for name, notice in templates:
        b = Counter(L.bag_of(notice))
        n = sum(b.values())
        for s in range(len(g)):
            run, common, best = Counter(), 0, None
            for e in range(s, len(g)):
                run[g[e]] += 1
                common += run[g[e]] <= b[g[e]]
                size = e - s + 1
                assert size <= n * (2 - t) / t or 2 * common < t * (size + n) + 1e-9       # the size bound loses nothing
                if size <= n * (2 - t) / t + 1e-9 and g[s] in b and g[e] in b and 2 * common >= t * (size + n) - 1e-9:
                    matching.append((s, e))
                    if not starts_run(g, s, b, notice):
                        continue
                    score = 3 * common - size - n
                    if best is None or score > best[0]:
                        best = (score, 2 * common / (size + n), e)
            if best:
                runs.append((-best[0], -best[1], name, s, best[2]))
    kept = []
    for r in sorted(runs):
        if not any(r[3] <= k[4] + 1 and k[3] <= r[4] + 1 for k in kept):
            kept.append(r)
    # every matching run, wherever it starts, shares words with a reported one
    assert all(any(s <= k[4] + 1 and k[3] <= e + 1 for k in kept) for s, e in matching), text
    return sorted((r[3], r[4], r[2], round(-r[1], 9)) for r in kept)


def starts_run(g, s, b, notice):
    """No hit right before, or the notice's first bigram."""
    return s == 0 or g[s - 1] not in b or g[s] == " ".join(_words(notice)[:2])


def _line_of(text, word):
    n = 0
    for k, line in enumerate(re.split(r"\r\n|\n|\r", text or "")):
        n += len(_words(line))
        if word < n:
            return k + 1


def test_passages_are_brute_force_over_all_runs(spark):
    rng = random.Random(11)
    texts = []
    for _ in range(300):
        parts = []
        for _ in range(rng.randint(0, 8)):
            if rng.random() < 0.6:
                w = rng.choice(SMALL)[1].split()
                for _ in range(rng.choice([0, 0, 1, 2])):
                    k = rng.randrange(len(w) + 1)
                    w[k:k + rng.choice([0, 1])] = rng.choice([[], ["q"], ["a"], ["b", "a"]])
                parts += w
            else:
                parts += [rng.choice("abcdefghijklmxyzq") for _ in range(rng.randint(1, 6))]
        texts.append("".join(w + rng.choice([" ", " ", " ", ", ", "\n", "\r\n"]) for w in parts))
    got = by_id(L.passages(docs(spark, list(enumerate(texts))).repartition(4), templates=SMALL), "passages")
    some = 0
    for k, text in enumerate(texts):
        want = [(_line_of(text, s), _line_of(text, e + 1), name, d) for s, e, name, d in brute(text, SMALL)]
        assert [(p["line"], p["last"], p["name"], round(p["dice"], 9)) for p in got[k]] == want, (text, brute(text, SMALL))
        some += len(want)
    assert some > 300


def test_prefix_filter_loses_nothing():
    for name, notice in L.TEMPLATES + L.full_texts():
        b = L.bag_of(notice)
        need, _ = L.size_bounds(sum(b.values()), L.THRESHOLD)
        prefix = L.prefix_of(b, need)
        assert sum(m for g, m in b.items() if g not in set(prefix)) < need <= sum(b.values())


def test_notices_files_and_repeats(spark):
    full = dict(L.full_texts())
    notices = "\n\n".join(f"Component {k}\n" + "\n".join(full[n] for n in ("mit", "bsd-3-clause", "apache-2.0")) for k in range(8))
    repeated = "the software " * 3000 + full["mit"] + " the software" * 3000
    d = docs(spark, [(1, notices), (2, repeated), (3, "All rights reserved. " * 2000)]).coalesce(1).cache()
    d.count()
    L.scan(d.limit(0)).collect()
    t = time.time()
    got = by_id(L.scan(d.filter("doc_id = 1")), "licenses")
    seconds = time.time() - t
    names = Counter(m["name"] for m in got[1])
    assert names["mit"] >= 8 and names["bsd-3-clause"] >= 8 and names["apache-2.0"] >= 8
    got = by_id(L.passages(d.filter("doc_id > 1")), "passages")
    assert {p["name"] for p in got[2]} == {"mit"}
    assert len(got[3]) == 1000 or len(got[3]) == 2000
    print("notices file:", round(seconds, 1), "s")


def test_scan_edges(spark):
    assert L.scan(empty_docs(spark)).count() == 0 and "licenses" in L.scan(empty_docs(spark)).columns
    rows = [(k, t) for k, t in enumerate(EDGE_TEXTS)] + [(50, "All rights reserved.")] * 3 + [(None, "All rights reserved.")]
    d = docs(spark, rows)
    for c in ("licenses", "passages", "_body", "_grams", "_near", "_occ", "_runs", "_passages", "g", "at"):
        d = d.withColumn(c, F.lit("own"))
    out = L.scan(d)
    assert set(out.columns) == set(d.columns) and out.count() == len(rows)
    for r in out.collect():
        assert [m["name"] for m in r["licenses"]] == (["proprietary"] if r["text"] == "All rights reserved." else [])
        assert r["_body"] == r["_runs"] == r["passages"] == "own"
