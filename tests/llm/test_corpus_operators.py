"""SimHash, components, mixing, ANN, licences, URLs, language model, pipeline."""

import math
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SMALL
from helpers import EDGE_TEXTS, blank_words, by_id, docs, empty_docs
from textlake.llm import decontam, graph, graph_ann, licenses, mixing, ngram_lm, pii, quality, simhash, urls
from textlake.llm.common import table


def union_find(nodes, edges):
    parent = {n: n for n in nodes}

    def top(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


# --- components and SimHash -------------------------------------------------

@pytest.mark.parametrize("edges", [
    [(k, k + 1) for k in range(40)],                                 # a chain
    [(0, k) for k in range(1, 30)] + [(50, 51), (51, 52), (52, 50)], # a star, a ring
    [(5, 3), (3, 5), (5, 5), (9, 8)],                                # repeats, a loop
    [],
])
def test_components(spark, edges):
    e = spark.createDataFrame(edges, "a long, b long")
    want = union_find({x for p in edges for x in p}, edges)
    got = {r["node"]: r["root"] for r in graph.components(e, "a", "b").collect()}
    assert all(got.get(n, n) == r for n, r in want.items())


def plain_fingerprint(text):
    words = blank_words(text)
    shingles = [" ".join(words[i:i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprints_against_brute_force():
    rng = random.Random(1)
    texts = [" ".join(rng.choice("A b c é1 漢").split()) for _ in range(20)]
    texts = [" ".join(rng.choice("A b C é1 漢 d".split()) for _ in range(rng.randint(0, 30))) for _ in range(40)] + \
            ["", " ", "one", "One Two", "a\tb\nc\x0bd", "word " * 5000]
    got = simhash.fingerprints([t.encode() for t in texts])
    assert got.tolist() == [plain_fingerprint(t) for t in texts]


@pytest.mark.parametrize("pair_bucket", [2, 4, 16])
def test_links_join_exactly_the_linked_fingerprints(spark, pair_bucket):
    """Crowds of near fingerprints, with every way of treating a signature."""
    rng = random.Random(pair_bucket)
    prints = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        prints.add(centre)
        for _ in range(rng.choice([1, 3, 40])):
            f = centre
            for _ in range(rng.randint(1, 4)):
                f ^= 1 << rng.choice([rng.randint(0, 63), rng.randint(0, 5)])
            prints.add(f)
    signed = sorted(int(np.uint64(f).astype(np.int64)) for f in prints)
    links = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), pair_bucket)
    got = [(r["a"], r["b"]) for r in links.collect()]
    bits = lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1")
    assert all(bits(a, b) <= 2 for a, b in got)
    true = [(a, b) for i, a in enumerate(signed) for b in signed[i + 1:] if bits(a, b) <= 2]
    assert union_find(signed, got) == union_find(signed, true)


def _dedup_rows():
    rng = random.Random(2)
    rows = []
    for k in range(30):
        base = [f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(200, 300))]
        rows.append((len(rows) + 10, " ".join(base)))
        for _ in range(rng.choice([0, 1, 6])):
            near = list(base)
            near[rng.randint(0, len(near) - 1)] = "changed"
            rows.append((len(rows) + 10, " ".join(near if rng.random() < 0.6 else base).upper()))
    rows += [(2000 + k, t) for k, t in enumerate(EDGE_TEXTS)]
    rows += [rows[3], rows[3], (None, "no id here"), (None, rows[5][1]), (None, "only null ids")]
    return rows


def _true_components(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    distinct = sorted(set(prints))
    edges = [(a, b) for i, a in enumerate(distinct) for b in distinct[i + 1:] if bin(a ^ b).count("1") <= 2]
    root = union_find(distinct, edges)
    least = {}
    for (i, _), f in zip(rows, prints):
        least.setdefault(root[f], None)
        if i is not None and (least[root[f]] is None or i < least[root[f]]):
            least[root[f]] = i
    return [(f, least[root[f]], root[f]) for f in prints]


def test_simhash_groups_against_brute_force(spark):
    rows = _dedup_rows()
    d = docs(spark, rows).withColumn("fp", F.lit(1)).withColumn("component_id", F.lit(1)).withColumn("_k1", F.lit(1))
    got = sorted(((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash.groups(d).collect()), key=str)
    want = sorted(((i, f, c) for (i, _), (f, c, _) in zip(rows, _true_components(rows))), key=str)
    assert got == want
    kept = simhash.dedup(d)
    assert kept.columns == d.columns
    have = kept.collect()
    groups = {root for _, _, root in _true_components(rows)}
    assert len(have) == len(groups)                        # one row of each group
    ids = {c for _, c, _ in _true_components(rows)}
    assert {r["doc_id"] for r in have} == ids


def test_simhash_empty(spark):
    assert simhash.groups(empty_docs(spark)).count() == simhash.dedup(empty_docs(spark)).count() == 0


# --- mixing -----------------------------------------------------------------

def test_raking_meets_the_targets():
    rng = np.random.default_rng(0)
    cells = [(s, l) for s in ("a", "b", "*") for l in ("x", "*")]
    tokens = rng.integers(1000, 3000, len(cells)).astype(float)
    targets = [{"a": 0.4, "b": 0.35, "*": 0.25}, {"x": 0.55, "*": 0.45}]
    w = mixing.rake(tokens, cells, targets, budget=0.3, rounds=50)
    assert (w <= tokens + 1e-9).all()
    for k, t in enumerate(targets):
        for name, share in t.items():
            assert abs(sum(x for x, c in zip(w, cells) if c[k] == name) / w.sum() - share) < 1e-3


def test_mixing_edges(spark):
    rows = [(k, "word " * (k % 7), lang, src) for k, (lang, src) in
            enumerate([("en", "src0"), (None, None), ("xx", "src0"), ("de", "src9")] * 10)]
    rows += [(900 + k, t, "en", "src1") for k, t in enumerate(EDGE_TEXTS)] + [(1, "again and again", "en", "src0")] * 2
    d = docs(spark, rows).withColumn("mix_kept", F.lit("mine")).withColumn("mix_probability", F.lit("x"))
    out = mixing.sample(docs(spark, rows))
    assert out.count() == len(rows)
    assert all(0 <= r["mix_probability"] <= 1 and r["mix_tokens"] == len(blank_words(r["text"])) for r in out.collect())
    assert len({r["mix_kept"] for r in out.filter("text = 'again and again'").collect()}) == 1
    mixed = mixing.mix(d)
    assert mixed.columns == [c for c in d.columns if c != "mix_probability"] + ["mix_probability"]
    assert {r["mix_kept"] for r in mixed.collect()} <= {"mine"}
    assert mixing.mix(empty_docs(spark)).count() == 0
    with pytest.raises(ValueError):
        mixing.sample(d, {"source": {"a": 1.0}})


def test_sampled_share_follows_the_probability(spark):
    d = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("en").alias("lang"),
                                   F.concat(F.lit("src"), F.col("id") % 2).alias("source"))
    got = {r["mix_source"]: (r["p"], r["n"]) for r in mixing.sample(d, {"source": {"src0": 0.25, "*": 0.75}}, budget=0.5)
           .groupBy("mix_source").agg(F.avg("mix_probability").alias("p"), F.avg(F.col("mix_kept").cast("int")).alias("n")).collect()}
    assert abs(got["src0"][0] - 0.25) < 1e-9 and abs(got["*"][0] - 0.75) < 1e-9
    assert all(abs(p - n) < 0.02 for p, n in got.values())


def test_rows_without_ids_are_sampled_one_by_one(spark):
    d = docs(spark, [(None, f"text {k % 2000}", "en", "src0") for k in range(4000)])
    got = mixing.sample(d, {"source": {"src0": 1.0, "*": 0.0}}, budget=0.5).collect()
    assert abs(sum(r["mix_kept"] for r in got) / 4000 - 0.5) < 0.05
    assert len({(r["text"], r["mix_kept"]) for r in got}) == 2000


# --- nearest neighbours -----------------------------------------------------

def _exact(ids, x, k):
    out = {}
    for i, q in zip(ids, x):
        if i % 50 == 0:
            s = (x * q).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((q * q).sum()))
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def _nearest(spark, ids, x, **params):
    df = spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in zip(ids, x)], "vec_id long, embedding array<float>")
    out = graph_ann.nearest(df, F.col("vec_id") % 50 == 0, 5, graph_ann.Params(**params))
    got = {}
    for r in out.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return got


@pytest.mark.parametrize("params", [{}, {"shard_rows": 500, "query_block": 10}])
def test_ann_recall(spark, params):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2000, 24)).astype(np.float32)
    x[300:700] = x[299] + 0.02 * rng.normal(size=(400, 24))         # a dense crowd
    x[800:1100] = x[799]                                            # equal vectors
    ids = np.arange(2000)
    got, want = _nearest(spark, ids, x, **params), _exact(ids, x.astype(float), 5)
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 5 for q in want])
    assert recall >= 0.95
    for q, found in got.items():
        assert found == sorted(found, key=lambda p: (-p[1], p[0])) and q not in [i for i, _ in found]
    assert [i for i, _ in got[800]] == [799, 801, 802, 803, 804]    # ties to the smaller id


def test_ann_edges(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]),
            (6, [None, 1.0]), (7, [2.0, 0.0]), (8, [0.0, 3.0]), (None, [1.0, 1.0]), (50, [1.0, 0.0, 0.0]), (8, [0.0, 3.0]), (9, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(9)).withColumn("v", F.lit(9))
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in
           graph_ann.nearest(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 7, 1.0), (0, 2, 8, 0.0), (0, 3, 9, -1.0)]
    assert graph_ann.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


# --- licences ---------------------------------------------------------------

def _best_match(line, threshold=licenses.THRESHOLD):
    g = set(licenses.grams_of(line))
    scored = []
    for name, notice in licenses.TEMPLATES:
        t = set(licenses.grams_of(notice))
        if g:
            scored.append((-2 * len(g & t) / (len(g) + len(t)), name))
    best = min(scored, default=(0, ""))
    return (best[1], -best[0]) if -best[0] >= threshold else None


def test_licences_against_brute_force(spark):
    rng = random.Random(8)
    texts = list(EDGE_TEXTS)
    for name, notice in licenses.TEMPLATES:
        words = notice.split()
        for cut in (0, 1, 2, len(words) // 3):
            w = list(words)
            for _ in range(cut):
                w[rng.randint(0, len(w) - 1)] = "other"
            texts.append("Some prose here\r\n  " + " ".join(w).upper() + " \n\nmore prose, and more")
        texts.append(notice)
        texts.append((notice + "\n") * 3)
    d = docs(spark, list(enumerate(texts)) + [(1, "All rights reserved.")] * 2).withColumn("licenses", F.lit(1))
    out = licenses.matches(d)
    assert out.count() == d.count()
    for r in out.collect():
        body = r["text"] or ""
        lines = body.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        want = [(k, *m) for k, x in ([(0, body)] if len(lines) > 1 else []) + list(enumerate(lines, 1)) if (m := _best_match(x))]
        assert [(m["line"], m["name"], pytest.approx(m["dice"])) for m in r["licenses"]] == want


def test_licences_inside_lines_and_over_line_breaks(spark):
    full = dict(licenses.full_texts())
    wrapped = "Some prose and more of it, in many words that say nothing at all.\n# Licensed under the Apache\n# License, Version 2.0 (the \"License\");\n# you may not use this file except\n" \
              "# in compliance with the License. You\n# may obtain a copy of the License at\nx = 1  " + "y z w v u t s r " * 4
    texts = {"# Copyright 2020 The Foo Authors. All rights reserved.": "1:proprietary",
             "Notes on the tool. Released under the MIT License. Have fun.": "1:mit",
             "MIT License\n\nCopyright (c) 2020 Foo\n\n" + full["mit"]: "5:mit",
             "prose\n" * 5 + full["bsd-2-clause"]: "6:bsd-2-clause",
             "BSD\n" + full["bsd-3-clause"] + "\nmore prose, words " * 40: "2:bsd-3-clause",
             wrapped: "2:apache-2.0", "All rights\nreserved.": "0:proprietary", "Nothing under the license here": "", "": "", "all": ""}
    d = docs(spark, list(enumerate(texts)) + [(99, None)])
    got = by_id(licenses.scan(d), "licenses")
    for k, want in enumerate(texts.values()):
        assert want in ",".join(f"{m['line']}:{m['name']}" for m in got[k]) and bool(want) == bool(got[k])
    assert got[99] == []
    plan = licenses.scan(table(spark, SMALL, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Exchange", "Join"))


def test_licence_scan_is_native(spark):
    plan = licenses.matches(table(spark, SMALL, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Exchange", "Join"))


def test_size_bounds_lose_no_match():
    for b in range(1, 60):
        lo, hi = licenses.size_bounds(b, 0.8)
        for a in range(1, 120):
            assert (2 * min(a, b) / (a + b) >= 0.8 - 1e-12) == (lo <= a <= hi)


# --- URLs -------------------------------------------------------------------

def _parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    path = rest[cut:]
    end = min([path.find(c) for c in "?#" if c in path] or [len(path)])
    return rest[:cut].translate({c: c + 32 for c in range(65, 91)}), path[:end]


URLS = ["http://A.example.ORG/es/1?x", "https://example.org/en/12", "http://org/", "http://xorg/en", "http://shop.com/fr/a", "http://shop.com/de/a",
        "ftp://shop.com/de", "no scheme", "", None, "http://", "http://?q", "http://h#f://x/y", "x://y://z/de/", "http://casinonight.net/a",
        "http://big-casino.net/b", "http://news.net/casino", "http://sub.shop.com/de/x", "http://É.example/ä", "http://" + "q" * 200 + ".net/1", "http://org?/"]


def test_rules_against_brute_force(spark):
    rows = [(k, u, "<p>the night of big news</p>") for k, u in enumerate(URLS)] + [(0, URLS[0], None)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("host_words", F.lit(1))
    out = urls.judge(pages).collect()
    assert len(out) == len(rows)
    for r in out:
        host, path = _parts(r["url"])
        fits = [(len(h + p), h + p, what) for what, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, None))
        assert (r["host"], r["path"], r["rule"]) == (host, path, best[1])
        assert r["verdict"] == (best[2] or ("block" if r["score"] > 0 else "allow"))
    words = {r["url"]: r["host_words"] for r in out}
    assert words["http://casinonight.net/a"][:2] == ["casino", "night"]
    verdict = {r["url"]: r["verdict"] for r in out}
    assert verdict["http://casinonight.net/a"] == verdict["http://big-casino.net/b"] == "block" and verdict[None] == "allow"


def test_segmentation_against_all_splits():
    rng = random.Random(3)
    counts = Counter({"ab": 40, "a": 9, "ba": 30, "abc": 25, "c": 5, "cab": 12, "bb": 7})
    total = sum(counts.values())
    log = lambda w: math.log(counts[w] / total) if counts[w] else math.log(10 / total) - len(w) * math.log(10)

    def best(s):
        return max(((log(s[:k]) + (best(s[k:])[0] if s[k:] else 0.0), k) for k in range(1, len(s) + 1)), default=(0.0, 0))

    for _ in range(60):
        s = "".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))
        known = {(i, j): counts[s[i:j]] for i in range(len(s)) for j in range(i + 1, len(s) + 1) if counts[s[i:j]]}
        got = urls.split_name(s, known, total, 20)
        assert "".join(got) == s and sum(map(log, got)) == pytest.approx(best(s)[0])


def test_splits_do_not_depend_on_the_size_of_the_table(spark):
    hosts = spark.createDataFrame([(h,) for h in ("zqads.com", "zqkbet.net", "vlorpporn.org", "kwizpoker.net", "nightnews.com")], "host string")
    counts = [("night", 900), ("news", 700), ("com", 400), ("the", 20_000), ("bet", 3)]
    got = []
    for times in (1, 50, 1_000, 100_000):
        c = spark.createDataFrame([(w, n * times) for w, n in counts], "word string, n long")
        got.append(by_id(urls.segmented(hosts, c).withColumnRenamed("host", "doc_id"), "host_words"))
    assert got[0] == got[1] == got[2] == got[3]
    assert got[0]["zqads.com"] == ["zq", "ads", "com"] and got[0]["zqkbet.net"][:2] == ["zqk", "bet"]
    assert got[0]["vlorpporn.org"][:2] == ["vlorp", "porn"] and got[0]["kwizpoker.net"][:2] == ["kwiz", "poker"]
    assert got[0]["nightnews.com"] == ["night", "news", "com"]


def test_long_names_are_split(spark):
    name = "q" * 60 + "casino" + "news" * 30 + "q" * 70 + "poker"
    hosts = spark.createDataFrame([(f"{name}.com",)], "host string")
    counts = spark.createDataFrame([("news", 700), ("com", 400)], "word string, n long")
    [row] = urls.segmented(hosts, counts).collect()
    assert [w for w in row["host_words"] if not w.startswith("q")] == ["casino", *["news"] * 30, "poker", "com"]
    assert "".join(row["host_words"]) == name + "com"


def test_naive_bayes_counts(spark):
    rows = [([1, 1, 2], 1), ([2, 3], 0), ([3], 0)]
    w = urls.naive_bayes(spark.createDataFrame(rows, "b array<int>, block int"), urls.Params(bits=4))
    assert w[1] == pytest.approx(math.log((2 + .5) / (3 + 1.5)) - math.log((0 + .5) / (3 + 1.5)))
    assert w[3] == pytest.approx(math.log((0 + .5) / (3 + 1.5)) - math.log((2 + .5) / (3 + 1.5)))
    assert w[16] == pytest.approx(math.log(1 / 2)) and w[5] == 0
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert urls.judge(empty).count() == 0


# --- language model ---------------------------------------------------------

def plain_kneser_ney(training):
    """log10 probability of a text by dictionaries."""
    uni, pairs = Counter(), Counter()
    for t in training:
        seq = [*blank_words(t), "</s>"]
        uni.update(seq)
        pairs.update(zip(["<s>", *seq], seq))
    n_pairs, v = len(pairs), len(uni)
    of = lambda counts: ngram_lm.discounts(np.array([sum(c == k for c in counts) for k in (1, 2, 3, 4)]))
    contexts = Counter(w for _, w in pairs)
    d, dw = of(pairs.values()), of(contexts.values())
    total, follow = Counter(), {}
    for (a, _), c in pairs.items():
        total[a] += c
        follow.setdefault(a, Counter())[min(c, 3)] += 1
    gamma_w = sum(dw[min(c, 3)] for c in contexts.values()) / n_pairs if n_pairs else 1.0

    def prob(a, w):
        p = (max(contexts[w] - dw[min(contexts[w], 3)], 0) / n_pairs if n_pairs else 0) + gamma_w / (v + 1)
        if not total[a]:
            return p
        c = pairs[(a, w)]
        return max(c - d[min(c, 3)], 0) / total[a] + sum(d[k] * n for k, n in follow[a].items()) / total[a] * p

    return uni, prob


def test_language_model_against_brute_force(spark):
    rng = random.Random(6)
    words = ["The", "cat", "sat", "é", "漢字", "on", "mat.", "a", "b", "c"] + [f"r{k}" for k in range(40)]
    rows = [(k, " ".join(rng.choice(words[:rng.choice([6, 50])]) for _ in range(rng.randint(0, 30)))) for k in range(120)]
    rows += [(500 + k, t) for k, t in enumerate(EDGE_TEXTS)] + [rows[0], rows[0], (None, "the cat"), (700, "unknownword the cat")]
    d = docs(spark, rows).withColumn("lm", F.lit(1))
    held = lambda i: i is not None and i % 5 == 0
    out, model = ngram_lm.train_and_score(d, F.coalesce(F.col("doc_id") % 5 != 0, F.lit(True)))
    uni, prob = plain_kneser_ney([t for i, t in rows if not held(i)])
    n, v = sum(uni.values()), len(uni)
    assert (model.n_tokens, model.n_words) == (n, v)
    assert out.count() == len(rows)
    for r in out.collect():
        seq = [*blank_words(r["text"]), "</s>"]
        lm = r["lm"]
        assert (lm["n_tokens"], lm["n_known"]) == (len(seq), sum(uni[w] > 0 for w in seq))
        assert lm["base_score"] == pytest.approx(sum(math.log10((uni[w] + .1) / (n + .1 * (v + 1))) for w in seq))
        assert lm["score"] == pytest.approx(sum(math.log10(prob(a, w)) for a, w in zip(["<s>", *seq], seq)))
    for context in ("<s>", "the", "never"):                  # a distribution over the words and the unknown one
        assert sum(prob(context, w) for w in [*uni, "never seen"]) == pytest.approx(1.0)


def test_language_model_many_flushes_and_large_counts(spark, monkeypatch):
    """Large counts pass the one-byte store; the result doesn't depend on shards."""
    rows = [(k, "x y " * 400 + f"z{k}") for k in range(6)]
    d = docs(spark, rows)
    uni, prob = plain_kneser_ney([t for _, t in rows])
    for shards in (1, 7):
        model = ngram_lm.train(d, shards=shards)
        assert model.n_tokens == sum(uni.values())
        for r in ngram_lm.score(d, model).collect():
            seq = [*blank_words(r["text"]), "</s>"]
            assert r["lm"]["score"] == pytest.approx(sum(math.log10(prob(a, w)) for a, w in zip(["<s>", *seq], seq)))


def test_language_model_without_training(spark):
    model = ngram_lm.train(empty_docs(spark))
    lm = by_id(ngram_lm.score(docs(spark, [(1, "a b"), (2, None)]), model), "lm")
    assert (lm[1]["n_tokens"], lm[1]["n_known"], lm[1]["score"], lm[1]["base_score"]) == (3, 0, 0.0, 0.0)
    assert lm[2]["n_tokens"] == 1


# --- pipeline ---------------------------------------------------------------

def test_pipeline_stages_against_brute_force(spark):
    d = table(spark, SMALL, "documents")
    rows = {r["doc_id"]: r for r in d.collect()}
    columns = d.columns

    good = corpus_pipeline.quality_stage(spark, d, SMALL)
    kept = {r["doc_id"]: r for r in good.collect()}
    p = quality.Params()
    w = quality.train(d, table(spark, SMALL, "labels"), "quality", None, p)
    s = dict(zip(rows, quality.scores([(r["text"] or "").encode() for r in rows.values()], w, p)))
    assert good.columns == columns and set(kept) == {i for i in rows if s[i] >= p.threshold}
    assert all(kept[i] == rows[i] for i in kept)

    single = corpus_pipeline.near_dedup_stage(spark, good, SMALL)
    pairs = [(i, r["text"]) for i, r in kept.items()]
    want = {c for _, c, _ in _true_components(pairs)}
    one = {r["doc_id"]: r for r in single.collect()}
    assert single.columns == columns and set(one) == want and all(one[i] == rows[i] for i in one)

    clean = corpus_pipeline.decontaminate_stage(spark, single, SMALL)
    bench = [(r["id"], bytes(r["t"])) for r in table(spark, SMALL, "benchmark")
             .select(F.col("item_id").cast("string").alias("id"), F.col("text").cast("binary").alias("t")).collect()]
    block = decontam.build_block(bench, 10)
    left = {i for i, r in one.items() if not decontam.scan([(r["text"] or "").encode()], block)[0].items}
    assert clean.columns == columns and {r["doc_id"] for r in clean.collect()} == left

    private = corpus_pipeline.pii_stage(spark, clean, SMALL)
    for r in private.collect():
        text = pii.redact_text(rows[r["doc_id"]]["text"])
        assert r["text"] == text and (text == rows[r["doc_id"]]["text"] or r["n_chars"] == len(text))

    mixed = corpus_pipeline.mixing_stage(spark, private, SMALL)
    sampled = {r["doc_id"] for r in mixing.sample(private).filter("mix_kept").collect()}
    assert {r["doc_id"] for r in mixed.collect()} == sampled <= left
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, SMALL).collect()} == sampled


def test_pipeline_stages_on_edge_rows(spark):
    rows = [(k, t) for k, t in enumerate(EDGE_TEXTS)] + [(3, "a"), (None, "some text here"), (None, None)]
    d = docs(spark, rows)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, d, SMALL)
        assert out.columns[:5] == d.columns
        out.collect()
        assert stage(spark, empty_docs(spark), SMALL).count() == 0


def test_every_operator_is_registered():
    import __spark_entry__ as E
    names = E.queries()
    assert "pipeline" in names
    for n in range(1, 11):
        assert sum(q.startswith(f"op{n}_") for q in names) == 1
