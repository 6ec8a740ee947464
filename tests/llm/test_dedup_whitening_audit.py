"""Suffix dedup, whitening and the filter audit against brute force and edge cases."""

import hashlib
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from helpers import EDGE_TEXTS, by_id, docs, empty_docs
from textlake.llm import filter_audit as A, suffix_dedup as S, whitening as W


# --- suffix dedup -----------------------------------------------------------

def plain_dedup(rows, depth):
    """(kept, spans) of every (id, text), in the order of ids, ``None`` last."""
    seen, out = {}, {}
    keyed = [(i if i is not None else 1 << 63, (t or "").encode()) for i, t in rows]
    for i, b in sorted(set(keyed)):
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - depth + 1):
            if seen.setdefault(b[p:p + depth], (i, p)) != (i, p):
                gone[p:p + depth] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[i, b] = (kept, int(np.count_nonzero(gone[:-1] & ~np.concatenate([[False], gone[:-2]]))) if len(b) else 0)
    return out


def _random_docs(rng, n, alphabet, parts):
    shared = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40))) for _ in range(parts)]
    return [(i, "".join(rng.choice(shared) if rng.random() < 0.5 else "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30)))
                        for _ in range(rng.randint(0, 6)))) for i in range(n)]


@pytest.mark.parametrize("alphabet,depth,digit,crowd", [("ab", 12, 4, 50_000), ("abé", 20, 8, 3), ("a", 10, 3, 1), ("abcdefgh 漢", 24, 6, 2)])
def test_suffix_dedup_is_brute_force(spark, alphabet, depth, digit, crowd):
    rng = random.Random(depth)
    rows = _random_docs(rng, 60, alphabet, 8)
    rows += [(70 + k, rows[3][1] or "aaaaabbbbbaaaaabbbbb") for k in range(5)] + [(3, rows[3][1])] * 2 + [(90, None), (91, ""), (None, "a" * 50)]
    got = S.dedup(docs(spark, rows).repartition(5), depth=depth, digit=digit, crowd=crowd).collect()
    want = plain_dedup(rows, depth)
    assert len(got) == len(rows)
    texts = {}
    for i, t in rows:
        texts.setdefault(i, t)
    for r in got:
        b = (texts[r["doc_id"]] or "").encode()
        kept, spans = want[r["doc_id"] if r["doc_id"] is not None else 1 << 63, b]
        assert (bytes(r["kept"]), r["n_bytes"], r["n_removed"], r["n_spans"]) == (kept, len(b), len(b) - len(kept), spans), (r["doc_id"], b)
        assert r["kept_sha256"] == hashlib.sha256(kept).hexdigest()


def test_suffix_dedup_rows_of_one_id_and_without_id(spark):
    """Equal rows are one document; of two texts of one id one keeps the window they share, whichever the digest puts first."""
    rng = random.Random(1)
    common = "".join(rng.choice("abcdef") for _ in range(150))
    rows = [(7, "x" + common), (7, common + "y"), (7, "x" + common), (None, common), (None, common), (2, "z" * 30)]
    got = sorted((r["doc_id"] or 99, r["n_bytes"], r["n_removed"]) for r in S.dedup(docs(spark, rows)).collect())
    assert got[0] == (2, 30, 0)
    assert sorted(x[2] for x in got[1:4]) in ([0, 0, 150], [0, 150, 150]) and got[4:] == [(99, 150, 150), (99, 150, 150)]


def test_suffix_dedup_edges(spark):
    rows = [(k, t) for k, t in enumerate(EDGE_TEXTS)]
    d = docs(spark, rows).withColumn("kept", F.lit(1)).withColumn("bytes", F.lit(2)).withColumn("row", F.lit(3))
    got = S.dedup(d)
    assert {"doc_id", "lang", "source", "n_chars", "bytes", "row", "kept", "n_removed"} == set(got.columns) - {"n_bytes", "n_spans", "kept_sha256"}
    got, want = {r["doc_id"]: r for r in got.collect()}, plain_dedup(rows, 100)
    for i, t in rows:
        kept, spans = want[i, (t or "").encode()]
        assert (bytes(got[i]["kept"]), got[i]["n_spans"], got[i]["row"]) == (kept, spans, 3)
    assert S.digest(empty_docs(spark)).count() == 0


def test_texts_are_exchanged_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        d = S.digest(docs(spark, [(k, "ab" * 200 + str(k)) for k in range(50)]))
        d.collect()
        plan = d._jdf.queryExecution().executedPlan().toString()
        # every join of the texts reads one shuffle of them (by uid)
        texts = [x for x in re.findall(r"Exchange hashpartitioning\(uid#\d+L?, \d+\)[^\n]*", plan.split("Initial Plan")[0])]
        assert "ReusedExchange" in plan and texts
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(32 << 20))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.binary(min_size=0, max_size=60), min_size=1, max_size=4), st.integers(8, 20))
def test_equal_windows_have_equal_grams(texts, depth):
    texts = [bytes(b % 3 for b in t) for t in texts]
    owner, h, pos, first, last = S.anchors(texts, depth, 5)
    by_window, n = {}, 0
    for o, g, p, a, z in zip(owner.tolist(), h.tolist(), pos.tolist(), first.tolist(), last.tolist()):
        for w in range(a, z + 1):
            assert w <= p <= w + depth - 5
            assert by_window.setdefault(texts[o][w:w + depth], (g, p - w)) == (g, p - w)
            n += 1
    assert n == sum(max(0, len(t) - depth + 1) for t in texts)


# --- whitening --------------------------------------------------------------

def _vectors(spark, rows, extra=""):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>" + extra)


def test_whitening_is_that_of_a_plain_eigen_solve(spark):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(6, 6))
    x = np.round(rng.normal(size=(400, 6)) @ m * 3, 3).astype(np.float32)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    bad = [(900, None), (901, [1.0, None, 2.0, 0.0, 0.0, 0.0]), (902, [float("nan")] * 6), (903, [float("inf")] * 6), (904, [1.0]), (905, [])]
    out = W.whiten(_vectors(spark, rows + bad + [rows[0]]).repartition(7)).toPandas()
    ints = np.floor(64 * np.vstack([x, x[:1]]).astype(np.float64)).astype(np.int64) + 1_000_000
    n, s = len(ints), ints.sum(axis=0)
    c = ints - s / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    assert set(out["vec_id"]) == set(range(400)) and len(out) == n * 6 and set(out["n"]) == {n}
    for k in range(6):
        part = out[out["component"] == k + 1].drop_duplicates("vec_id").sort_values("vec_id")
        want = c[:400] @ vectors[:, k] / np.sqrt(values[k])
        got = part["whitened"].to_numpy()
        assert np.allclose(got, want, atol=1e-9) or np.allclose(got, -want, atol=1e-9)
        assert np.allclose(part["explained"], values[k] / values.sum(), rtol=1e-9)
        assert part["deviation"].tolist() == [int(v) for v in ((n * ints[:400] - s) ** 2).sum(axis=1)]
    assert out["identity_error"].iloc[0] < 1e-9


@pytest.mark.parametrize("values", [[5] * 3 + [5 + 1e-9] * 2 + [2 + 1e-6 * k for k in range(10)] + list(np.linspace(1, 0.1, 17)),
                                    [1.0] * 32, list(np.geomspace(1, 1e-9, 32)), [3.0, 3.0 - 1e-13] + [1e-3] * 30])
def test_clustered_eigenvalues_are_solved_to_double_precision(values):
    q, _ = np.linalg.qr(np.random.default_rng(2).normal(size=(32, 32)))
    wide = q.astype(np.longdouble)
    a = wide * np.array(values, np.longdouble) @ wide.T
    a = (a + a.T) / 2
    lam, x = W.eigen(a)
    assert float(np.abs(a @ x - x * lam).max()) < 1e-15 * max(values)
    assert float(np.abs(x.T @ x - np.eye(32)).max()) < 1e-17
    assert np.allclose(lam.astype(float), sorted(values, reverse=True), rtol=0, atol=1e-14 * max(values))


def test_float32_start_alone_is_not_enough():
    b = np.random.default_rng(3).normal(size=(200, 20))
    a = (b.T @ b / 200).astype(np.longdouble)
    _, rough = np.linalg.eigh(a.astype(np.float32))
    lam, x = W.refine(a, rough)
    r = rough.astype(np.longdouble)
    assert float(np.abs(r.T @ a @ r - np.diag(np.diag(r.T @ a @ r))).max()) > 1e-9 > 1e-15 > float(np.abs(a @ x - x * lam).max())


def test_extended_products():
    rng = np.random.default_rng(4)
    a, b = (rng.normal(size=(30, 30)).astype(np.longdouble) * np.exp2(rng.integers(-20, 20, size=(30, 1))) for _ in range(2))
    want = (a[:, :, None] * b[None, :, :]).sum(axis=1)
    size = (np.abs(a)[:, :, None] * np.abs(b).max(axis=0)[None, None, :]).sum(axis=1)
    assert float((np.abs(W._mul(a, b) - want) / size).max()) < 1e-17


def test_whitening_edges(spark):
    assert W.whiten(_vectors(spark, [])).count() == 0
    assert W.whiten(_vectors(spark, [(1, None), (2, [float("nan")])])).count() == 0
    assert W.whiten(_vectors(spark, [(1, [1.0, 2.0])])).count() == 0                     # one row: no variance
    assert W.whiten(_vectors(spark, [(1, []), (2, [])])).count() == 0
    flat = W.whiten(_vectors(spark, [(i if i else None, [float(i), 2.0 * i, 7.0]) for i in range(9)]).withColumn("n", F.lit("x"))).toPandas()
    assert set(flat["component"]) == {1} and len(flat) == 9 and flat["vec_id"].isna().sum() == 1   # dependent and constant dimensions
    assert flat["identity_error"].iloc[0] < 1e-9 and abs(flat["explained"].iloc[0] - 1) < 1e-9
    big = W.whiten(_vectors(spark, [(i, [1e9 * i, 1.0 * i * i]) for i in range(2000)])).toPandas()
    assert big["deviation"].isna().any() and big["identity_error"].iloc[0] < 1e-6


def test_whitening_does_not_depend_on_partitions(spark):
    v = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    a, b = (W.fit(v.repartition(k)) for k in (1, 16))
    assert a.n == b.n and a.sums == b.sums and (a.values == b.values).all() and (a.vectors == b.vectors).all()


# --- filter audit -----------------------------------------------------------

def plain_mask(text, smaller):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return ("A" * (len(words) < 50) + "B" * (100 * len(set(words)) < 65 * len(words))
            + "C" * (100 * len(re.findall("[A-Z]", text)) > 5 * len(text)) + "D" * bool(re.search(r"[#$%&*|]", text)) + "E" * smaller)


def plain_audit(rows, labels):
    docs_ = [(i, t or "", s or "") for i, t, s in rows]
    first = {}
    for i, t, _ in docs_:
        if i is not None:
            first[t] = min(first.get(t, i), i)
    fails = [(s, plain_mask(t, i is not None and first[t] < i), labels.get(i, (0, 0))) for i, t, s in docs_]
    out = {}
    for part in {s for s, _, _ in fails}:
        own = [(m, l) for s, m, l in fails if s == part]
        removed = Counter()
        for order in permutations("ABCDE"):
            left = own
            for k, f in enumerate(order):
                here = [(m, l) for m, l in left if f in m]
                row = [len(left) - len(here), len(here), sum(f in m for m, _ in own) - len(here), sum(m == f for m, _ in own),
                       sum(l[0] == 1 for _, l in here), sum(l[1] == 1 for _, l in here)]
                out[part, "".join(order), k + 1] = row
                removed[f] += len(here)
                left = [(m, l) for m, l in left if f not in m]
        for (p, order, k), row in out.items():
            if p == part:
                row.append(removed[order[k - 1]])
    return out


def _audit_rows():
    rng = random.Random(8)
    vocabulary = ["alpha", "Beta", "GAMMA", "a-very-long-word-of-many-letters", "a-very-long-word-of-many-Letters", "é漢😀", "x#y", "|", "z"] + [f"w{k}" for k in range(90)]
    rows = []
    for i in range(120):
        some = rng.sample(vocabulary, rng.randint(1, len(vocabulary)))
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(rng.choice(some) for _ in range(rng.choice([0, 3, 49, 50, 51, 90]))), rng.choice(["a", "b", None])))
    rows += [(rng.choice([None, 500 + k, 3]), rows[rng.randrange(120)][1], "b") for k in range(60)] + [(700, None, "c"), (701, "", "a"), (None, None, None)]
    return rows


def test_audit_is_brute_force(spark):
    rows = _audit_rows()
    rng = random.Random(9)
    labels = {i: (rng.choice([0, 1, None]), rng.choice([0, 1])) for i in rng.sample(range(600), 300)}
    lab = spark.createDataFrame([(i, *v) for i, v in labels.items()] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    d = docs(spark, [(i, t, "en", s) for i, t, s in rows]).withColumn("mask", F.lit(1)).withColumn("part", F.lit("p")).withColumn("id", F.lit(0))
    got = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")]
           for r in A.audit(d.repartition(6), lab).collect()}
    assert got == plain_audit(rows, labels)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="aB3é漢 .\n\t\x0b#|-😀\x00\x1f\x7f", max_size=60), min_size=1, max_size=6))
def test_transducer_counts(texts):
    c = A.transduce([t.encode() for t in texts])
    for k, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        assert (c.words[k], c.distinct[k], c.capitals[k], c.points[k], c.symbols[k]) == (
            len(w), len(set(w)), sum("A" <= x <= "Z" for x in t), len(t), sum(x in "#$%&*|" for x in t))


def test_equal_hashes_are_told_apart(monkeypatch):
    """With a hash that is the same for all words the table still counts right."""
    monkeypatch.setattr(A, "mix", lambda h: h * np.uint64(0))
    words = [f"a-long-common-beginning-{k % 17}" for k in range(60)] + ["b", "c", "b"]
    c = A.transduce([" ".join(words).encode(), b"b b c"])
    assert c.distinct.tolist() == [19, 2]


def test_audit_edges(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert A.audit(empty_docs(spark), none).count() == 0
    got = A.audit(docs(spark, [(k, t) for k, t in enumerate(EDGE_TEXTS)]), none)
    assert got.count() == 600 and {r["kept"] + r["removed"] for r in got.filter("step = 1").collect()} == {len(EDGE_TEXTS)}
