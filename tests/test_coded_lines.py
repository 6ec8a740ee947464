"""Lines coded where they lie: texts are cut once, words stand once a unit; start vectors in batches."""

from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textlake.operators import classifier as K, models as M, vocab as V

DATA = [(1, "a b a"), (2, "b"), (None, "c a"), (4, ""), (5, "a " * 9 + "z"), (6, None), (7, "__label__x b b"), (8, "é")]


@pytest.mark.parametrize("unit", [1, 4, 1 << 20])
@pytest.mark.parametrize("parts", [1, 3])
def test_codes_give_the_lines_and_counts_back(spark, unit, parts, monkeypatch):
    monkeypatch.setattr(M, "WORD_CHUNK", 2)
    df = spark.createDataFrame(DATA + [(9, "b a")] * 3, "k long, t string").repartition(parts)
    df = df.select("k", F.when(F.col("k") == 2, F.array(F.lit(None), F.lit("b"))).otherwise(F.filter(F.split("t", " "), lambda w: w != "")).alias("t"))
    coded = M.coded_lines(df, "k", "t", M.Args(), unit)
    words = {(r["_unit"], r["code"]): (r["word"], r["n"]) for r in M._unit_words(coded).collect()}
    lines = coded.filter(F.col("_codes").isNotNull()).collect()
    got = Counter((r["k"], " ".join(words[r["_unit"], c][0] for c in r["_codes"])) for r in lines)
    want = Counter((k, " ".join(t.split())) for k, t in DATA + [(9, "b a")] * 3 if t)
    assert got == want
    met = Counter((r["_unit"], c) for r in lines for c in r["_codes"])
    assert {k: n for k, (_, n) in words.items()} == met
    assert len({u for u, _ in words}) >= (1 if unit > 9 else 4)
    direct = {r["word"]: r["count"] for r in V.token_counts(df.withColumn("tokens", F.filter("t", lambda w: w.isNotNull()))).collect()}
    assert {r["word"]: r["count"] for r in M.word_counts(coded).collect()} == direct


def test_training_cuts_each_text_once(spark):
    """Vocabulary and features come of one reading of the texts."""
    read = spark.sparkContext.accumulator(0)

    @F.arrow_udf("string")
    def seen(t: pa.Array) -> pa.Array:
        read.add(len(t))
        return t
    lines = spark.createDataFrame([(i, f"__label__{i % 2} w{i % 5} v") for i in range(40)], "id long, line string")
    lines = lines.select("id", seen.asNondeterministic()("line").alias("line"))
    model = K.train(lines, "id", "line", M.Args(dim=4, epoch=1, seed=1))
    assert read.value == 40 and model.vocab.count() == 9      # 5 words, v, </s> and 2 labels


@pytest.mark.parametrize("dim", [1, 8, 19])
def test_start_vectors_are_those_of_the_digest(spark, dim):
    import hashlib
    rows = [0, 1, 7, 2 ** 40]
    got = spark.createDataFrame([(r,) for r in rows], "r long").select("r", K.start_vector(F.col("r"), dim, 3).alias("v")).collect()
    for r, v in got:
        digests = b"".join(hashlib.md5(f"3:{r}:{b}".encode()).digest() for b in range(3))
        assert v == [(int.from_bytes(digests[2 * i:2 * i + 2], "big") / 65536.0 * 2 - 1) / dim for i in range(dim)]


@pytest.mark.parametrize("far", [0, 10 ** 12])
def test_feature_ids_and_places_for_dense_and_sparse_ids(spark, far):
    import numpy as np
    data = [(u, [(u * j) % 7 + far * (j % 2) for j in range(30)]) for u in range(5)] + [(9, [])]
    df = spark.createDataFrame(data, "u long, features array<long>").coalesce(1)
    rows = K.feature_ids(df, "u").collect()
    want = {(u, x) for u, f in data for x in f}
    assert {tuple(r) for r in rows} == want and len(rows) == len(want)           # one batch: each once, not an occurrence a row
    assert {r[0] for r in K.feature_ids(df).collect()} == {x for _, x in want}
    ids = np.unique([x for _, x in want])
    assert (ids[K._places(ids)(ids[::-1])] == ids[::-1]).all()


def test_a_round_sends_values_as_columns(spark):
    """No feature row or gradient travels as an array: only the lines' lists do."""
    rows = spark.createDataFrame([(0, [0.5, 1.0])], "row_id long, vec array<double>")
    lines = spark.createDataFrame([(1, [0, 0], [0])], "id long, features array<long>, labels array<long>")
    out, B = K.fit_rows(lines, "id", rows, 2, M.Args(dim=2, epoch=2, lr=0.1))
    assert out.columns == ["row_id", "v0", "v1", "g"] and B.shape == (2, 2) and B[0, 0] > 0 > B[1, 0]
