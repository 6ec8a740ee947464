"""Exchange counts of operators that used to shuffle more than they need."""

import pytest
from pyspark.sql import functions as F

from textlake.operators import models as M
from textlake.operators import ngrams as N
from textlake.operators import vectors as VE
from textlake.operators import vocab as V


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.fixture()
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.fixture()
def tokens(spark):
    return spark.createDataFrame([(1, ["a", "b"]), (2, ["c"])], "k long, t array<string>")


@pytest.fixture()
def vocab(spark):
    return spark.createDataFrame([(0, "a"), (1, "b")], "id long, word string")


def test_word_dropout_is_a_projection(tokens):
    assert exchanges(M.word_dropout(tokens, "k", "t", 0.5, 3)) == 0


def test_encode_and_decode_shuffle_once_for_the_join_and_once_for_the_lists(no_broadcast, tokens, vocab):
    e = V.encode_tokens(tokens, "k", "t", vocab)
    assert exchanges(e) == 3                     # tokens by word, vocabulary by word, lists by key
    coded = tokens.select("k", F.array(F.lit(1).cast("bigint")).alias("ids"))
    assert exchanges(V.decode_tokens(coded, "k", "ids", vocab)) == 3


def test_tag_filter_reads_its_input_once(no_broadcast, spark):
    df = spark.createDataFrame([(1, "a b"), (2, "c")], "k long, t string")
    tags = spark.createDataFrame([("a", "NN")], "token string, tag string")
    assert exchanges(N.filter_by_tag(df, "k", "t", tags, ["NN"])) == 3


def test_text_vectors_join_each_word_of_a_text_once(no_broadcast, spark):
    df = spark.createDataFrame([(1, ["a"] * 50 + ["b"])], "k long, t array<string>")
    vec = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [5.0, 2.0])], "word string, vec array<double>")
    out = VE.text_vectors(df, "k", "t", vec, 2, "mean")
    assert out.first()["vec"] == pytest.approx([(50 + 5) / 51, 2.0])


def test_char_grams_are_counted_once_where_the_text_is(no_broadcast, spark):
    df = spark.createDataFrame([(1, "some text"), (2, "other text")], "k long, t string")
    plan = N.char_tfidf(df, "k", "t", 3, 4)._jdf.queryExecution().executedPlan().toString()
    # both sides read the packed counts, the document frequencies their gram column only; the texts are
    # not read again, and nothing is dealt by (key, gram)
    assert "MapInArrow" not in plan and "other text" not in plan
    assert plan.count("FileScan parquet") == 2 and "ReadSchema: struct<grams:array<string>>" in plan
    assert not any("hashpartitioning(k" in line and "gram" in line.split("hashpartitioning(")[1].split("),")[0]
                   for line in plan.splitlines() if "hashpartitioning(" in line)


def test_char_tfidf_joins_repeated_keys_and_cuts_long_rows(spark, monkeypatch):
    from collections import Counter
    from math import log, sqrt
    monkeypatch.setattr(N, "GRAMS_A_ROW", 5)
    rows = [(1, "Abc  abd"), (2, ""), (None, "xy\U0001f600z"), (1, "abc"), (3, None), (None, "xy"), (4, "abcabcabc" * 30)]
    got = {(r["k"], r["gram"]): r["weight"] for r in N.char_tfidf(spark.createDataFrame(rows, "k long, t string"), "k", "t", 2, 3).collect()}
    tf = {}
    for k, t in rows:
        t = (t or "").lower().replace("  ", " ")
        tf.setdefault(k, Counter()).update(t[i:i + n] for n in (2, 3) for i in range(len(t) - n + 1))
    df = Counter(g for c in tf.values() for g in c)
    want = {}
    for k, c in tf.items():
        w = {g: n * (log((1 + len(rows)) / (1 + df[g])) + 1) for g, n in c.items()}
        want |= {(k, g): x / sqrt(sum(v * v for v in w.values())) for g, x in w.items()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-12 for x in want)
