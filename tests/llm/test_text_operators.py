"""Tokens, quality, decontamination, toxicity, PII against brute force and edge cases."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from helpers import EDGE_TEXTS, alnum_words, blank_words, by_id, docs, empty_docs
from textlake.llm import decontam, pii, quality, tokens as T, toxicity


# --- tokens -----------------------------------------------------------------

@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB3é漢 .\n\t!-😀\x00\x1f", max_size=30), min_size=1, max_size=5))
def test_tokens_are_the_regex_words(texts):
    raw = [t.encode() for t in texts]
    for classes, words in ((T.ALPHANUMERIC, alnum_words), (T.BLANK_SEPARATED, blank_words)):
        t = T.tokenize(raw, classes)
        hashes = {}
        for i, text in enumerate(texts):
            a, b = t.off[i], t.off[i + 1]
            got = [t.data[x:y].decode().translate({c: c + 32 for c in range(65, 91)})
                   for x, y in zip(t.starts[a:b], t.ends[a:b])]
            assert got == words(text)
            for w, h in zip(got, t.hashes[a:b].tolist()):
                assert hashes.setdefault(w, h) == h
        assert len(set(hashes.values())) == len(hashes)


def test_prefix_hash_is_the_hash_of_the_prefix():
    t = T.tokenize([b"abcdef abc"], T.ALPHANUMERIC, prefix=(3,))
    assert t.prefixes[0][0] == t.hashes[1] == t.prefixes[0][1]


# --- quality ----------------------------------------------------------------

def _quality_rows(n=160):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(60)]
    rows, labels = [], []
    for i in range(n):
        body = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        good = i % 4 != 0
        rows.append((i, " ".join(body) + "." if good else " ".join(w.upper() + "!!" for w in body)))
        labels.append((i, int(good), 0))
    return rows, labels


def test_quality_learns_and_scores_edges(spark):
    rows, labels = _quality_rows()
    rows += [(1000 + k, t) for k, t in enumerate(EDGE_TEXTS)] + [(5, rows[5][1])] * 2 + [(None, "w1 w2")]
    d = docs(spark, rows).withColumn("score", F.lit("old")).withColumn("_text", F.lit(1))
    lab = spark.createDataFrame(labels + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    held = lambda i: i % 5 == 0
    w = quality.train(d, lab, "quality", F.col("doc_id") % 5 != 0)
    out = quality.score(d, w)
    assert out.columns == d.columns and out.count() == d.count()
    got = by_id(out, "score")
    assert all((got[i] >= 0.7) == bool(y) for i, y, _ in labels if held(i))
    assert got[1000] == got[1001] == got[1002]          # null, empty, blank: the intercept
    assert all(0 <= s <= 1 for s in got.values())
    five = {r["score"] for r in out.filter("doc_id = 5").collect()}
    assert len(five) == 1


def test_quality_without_labels(spark):
    d = docs(spark, [(1, "a b"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, quality int")
    w = quality.train(d, none)
    assert set(by_id(quality.score(d, w), "score").values()) == {0.5}
    assert quality.score(empty_docs(spark), w).count() == 0
    assert not quality.train(empty_docs(spark), none).any()


def test_ftrl_against_plain_loop():
    """The vectorised updates equal a loop over single coordinates."""
    p = quality.Params(bits=3, epochs=2)
    rng = np.random.default_rng(0)
    rows = [(np.sort(rng.choice(8, 3, replace=False)), rng.random(3), float(k % 2)) for k in range(20)]
    z, n = [0.0] * 9, [0.0] * 9

    def weight(i):
        if abs(z[i]) <= p.l1:
            return 0.0
        return -(z[i] - (1 if z[i] > 0 else -1) * p.l1) / ((p.beta + n[i] ** 0.5) / p.alpha + p.l2)

    for _ in range(p.epochs):
        for idx, x, y in rows:
            pairs = [*zip(idx.tolist(), x.tolist()), (8, 1.0)]
            ws = {i: weight(i) for i, _ in pairs}
            prob = 1 / (1 + np.exp(-sum(ws[i] * v for i, v in pairs)))
            for i, v in pairs:
                g = (prob - y) * v
                s = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / p.alpha
                z[i] += g - s * ws[i]
                n[i] += g * g
    assert np.allclose(quality.ftrl(rows, p), [weight(i) for i in range(9)], atol=1e-6)


def test_ngram_buckets_stay_inside_texts():
    one, off = quality.ngram_buckets([b"a b c", b"", b"d"], 18)
    assert off.tolist() == [0, 5, 5, 6]                 # 3 + 2 grams, none, 1
    assert one[5] == quality.ngram_buckets([b"d"], 18)[0][0]


# --- decontamination --------------------------------------------------------

def _overlap(text, items, n=10):
    words = alnum_words(text)
    hit, found = set(), set()
    for item, t in items:
        if item is None or t is None:
            continue
        w = alnum_words(t)
        size = min(n, len(w))
        wins = {tuple(w[k:k + size]) for k in range(len(w) - size + 1)} if w else set()
        for i in range(len(words) - size + 1):
            if size and tuple(words[i:i + size]) in wins:
                hit.update(range(i, i + size))
                found.add(str(item))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("block_bytes", [decontam.BLOCK_BYTES, 120])
def test_decontamination_against_brute_force(spark, block_bytes):
    rng = random.Random(5)
    some = lambda n: " ".join(rng.choice("a b C é1 d2".split()) for _ in range(n))
    items = [(k, some(rng.choice([3, 9, 10, 11, 14]))) for k in range(12)]
    items += [(2, some(12)), (100, ""), (101, None), (None, some(10)), (102, "solo"), (20, items[0][1])]
    rows = [(k, some(rng.randint(0, 60)) + (". " + items[k % 12][1].upper() if k % 3 == 0 else "")) for k in range(60)]
    rows += [(900 + k, t) for k, t in enumerate(EDGE_TEXTS)] + [(950, "x solo, y"), (950, "x solo, y"), (None, items[1][1])]
    d = docs(spark, rows).withColumn("overlap", F.lit(1)).withColumn("items", F.lit(2))
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontam.find(d, bench, block_bytes=block_bytes)
    assert out.count() == len(rows)
    for r in out.collect():
        assert (r["overlap"]["n_words"], r["overlap"]["n_hit"], r["overlap"]["items"]) == _overlap(r["text"], items)
    kept = decontam.remove(d, bench, "documents", block_bytes=block_bytes)
    assert kept.columns == d.columns
    clean = [r for r in rows if not _overlap(r[1], items)[1]]
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted((r[0] for r in clean), key=str)


def test_span_removal_keeps_the_rest(spark):
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    d = docs(spark, [(1, "Hello, ONE two; three! End é."), (2, "one two"), (3, None)])
    got = by_id(decontam.remove(d, bench, "spans"), "text")
    assert got[1].split() == ["Hello,", "!", "End", "é."] and got[2] == "one two" and got[3] is None


def test_decontamination_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    d = docs(spark, [(1, "a b")])
    assert by_id(decontam.find(d, bench), "overlap")[1]["n_hit"] == 0
    assert decontam.remove(empty_docs(spark), bench).count() == 0


# --- toxicity ---------------------------------------------------------------

def _toxic_rows(n=600):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(n):
        body = [f"w{rng.randint(0, 300)}" for _ in range(rng.randint(5, 80))]
        bad = rng.random() < 0.2
        if bad:
            for _ in range(3):
                body.insert(rng.randint(0, len(body)), rng.choice(["Vile", "grubby", "nastyone", "nastytwo"]))
        rows.append((i, " ".join(body)))
        if i % 2:
            labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_learns_from_positives_and_unlabelled_text(spark):
    rows, labels = _toxic_rows()
    truth = {i: bool(re.search("vile|grubby|nasty", t.lower())) for i, t in rows}
    rows += [(1000 + k, t) for k, t in enumerate(EDGE_TEXTS)] + [(7, rows[7][1]), (None, "vile")]
    d = docs(spark, rows).withColumn("score", F.lit("old")).withColumn("_pos", F.lit(1))
    lab = spark.createDataFrame(labels + [(None, 1, 1), (9, 1, None)], "doc_id long, quality int, toxic int")
    p = toxicity.Params()
    w = toxicity.train(d, lab, labelled=F.col("doc_id") % 3 != 1, usable=F.col("doc_id") % 3 != 1, p=p)
    out = toxicity.score(d, w, p)
    assert out.columns == d.columns and out.count() == d.count()
    got = by_id(out, "score")
    held = [i for i in truth if i % 3 == 1]
    hits = sum((got[i] >= p.threshold) == truth[i] for i in held)
    assert hits / len(held) > 0.95
    assert sum(got[i] >= p.threshold for i in held if not truth[i]) <= 2
    assert got[1000] == got[1001] == got[1002] < 0.5


@pytest.mark.parametrize("prior", [0.1, 0.3, 0.5])
def test_toxicity_learns_at_every_prior(prior):
    """Cue words pass the gate whatever share of the unlabelled text is toxic."""
    rng = random.Random(5)

    def text(bad):
        body = [f"w{rng.randint(0, 300)}" for _ in range(rng.randint(5, 80))]
        for _ in range(3 if bad else 0):
            body.insert(rng.randint(0, len(body)), rng.choice(["vile", "grubby", "nastyone", "nastytwo"]))
        return " ".join(body).encode()

    texts = [text(True) for _ in range(300)] + [text(rng.random() < prior) for _ in range(900)]
    positive = np.arange(1200) < 300
    p = toxicity.Params()
    w = toxicity.train_nnpu(texts, positive, prior, p)
    w[:-1][np.abs(w[:-1]) < p.least] = 0
    found, wrong = ((toxicity.scores([text(bad) for _ in range(400)], w, p) >= p.threshold).mean() for bad in (True, False))
    assert found > 0.8 and wrong < 0.05


def test_toxicity_without_positives(spark):
    d = docs(spark, [(1, "a b"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = by_id(toxicity.score(d, toxicity.train(d, none)), "score")
    assert all(abs(s - 0.1) < 1e-6 for s in got.values())
    assert toxicity.score(empty_docs(spark), toxicity.train(empty_docs(spark), none)).count() == 0


def test_toxicity_scores_against_a_plain_sum():
    p = toxicity.Params(bits=10)
    w = np.random.default_rng(1).random(1025).astype(np.float32) * (np.arange(1025) % 3 == 0)
    texts = [b"abcdefg abcd abcd x", b"", "é漢 abcdefg".encode()]
    for t, s in zip(texts, toxicity.scores(texts, w, p)):
        _, b = toxicity.features([t], p)
        assert abs(s - 1 / (1 + np.exp(-(sum(float(w[i]) for i in set(b.tolist())) + float(w[-1]))))) < 1e-6


# --- PII --------------------------------------------------------------------

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _luhn(d):
    total = 0
    for k, c in enumerate(reversed(d)):
        x = int(c) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_spans(text):
    out = [("email", *m.span()) for m in _EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]
    digits = lambda s: re.sub("[^0-9]", "", s)
    out += [("card", *m.span()) for m in _CARD.finditer(text)
            if 14 <= len(digits(m.group())) <= 19 and _luhn(digits(m.group()))]
    out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= len(digits(m.group())) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.BASE_KINDS.index(s[0])))


@settings(max_examples=500, deadline=None)
@given(st.one_of(
    st.text(alphabet="a1@.-+ %é", max_size=40),
    st.text(alphabet="0123.+- ()", max_size=60),
    st.lists(st.sampled_from(["a@b.c", "x.y@z-1.com.", "4111 1111 1111 1111", "4337166598464399", "256.1.1.1", "1.2.3.4.5.6.7.8",
                              "+1 (988) 555-2485", "+", " ", "é", "😀", "-", ".", "@", "0000", "account 12345678 "]), max_size=8).map("".join)))
def test_base_spans_are_those_of_the_patterns(text):
    assert [s for s in pii.find(text) if s[0] in pii.BASE_KINDS] == base_spans(text)


def test_added_spans():
    find = lambda t, k: [t[a:b] for kind, a, b in pii.find(t) if kind == k]
    assert find("see https://joe:pw@host.example/x?y=1. or http://host/plain", "address") == ["https://joe:pw@host.example/x?y=1"]
    assert find("mailto:a@b.example", "address") == ["mailto:a@b.example"]
    assert find("Account No: 1234 5678 90 and IBAN DE89370400440532013000.", "account") == ["1234 5678 90", "DE89370400440532013000"]
    assert find("password=b7db7aa4a5 but accounting 123456 or account closed", "account") == ["b7db7aa4a5"]


def test_secrets_without_digits():
    find = lambda t: [t[a:b] for kind, a, b in pii.find(t) if kind == "account"]
    assert find("password: hunter2 and secret=abcdefXYZ, token = 'p@ss.word!x' passwd:no") == ["hunter2", "abcdefXYZ", "p@ss.word!x", "no"]
    assert find("the password is lost; account: closed, api_key=is_it") == ["is_it"]
    assert pii.redact_text("secret=abcdefXYZ.") == "secret=<ACCOUNT>."


def test_pii_digest_and_redaction(spark):
    rows = [(1, "mail a@b.example or +1 (988) 555-2485 é"), (2, None), (3, ""), (4, "clean text"), (4, "clean text"), (None, "1.2.3.4")]
    d = docs(spark, rows + [(100 + k, t) for k, t in enumerate(EDGE_TEXTS)]).withColumn("spans", F.lit(0))
    out = pii.digest(d)
    assert out.count() == d.count()
    got = by_id(out, "n_email", "n_ip", "n_card", "n_phone", "spans")
    assert got[1] == (1, 0, 0, 1, "email:5:16,phone:20:37") and got[2] == got[3] == (0, 0, 0, 0, "")
    assert got[None][1] == 1
    clean = pii.redact(d, length="n_chars")
    assert clean.columns == d.columns
    text = by_id(clean, "text", "n_chars")
    assert text[1] == ("mail <EMAIL> or <PHONE> é", 25) and text[2] == (None, None) and text[4] == ("clean text", 10)
    assert not any(base_spans(t) for t, _ in text.values() if t)
    assert pii.digest(empty_docs(spark)).count() == pii.redact(empty_docs(spark)).count() == 0


def test_overlapping_spans_become_one_mark():
    assert pii.redact_text("x joe@1.2.3.4.example y") == "x <EMAIL> y"
