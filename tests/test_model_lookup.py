"""Saved classifiers: the shrunk flag, look-ups by key, and nearest words in blocks."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from textlake.operators import classifier as K, evaluation as EV, vectors as VE
from textlake.operators.models import Args


def _lines(spark, n=60):
    rows = [(k, " ".join(f"{'good' if k % 2 else 'bad'}{j % 7} w{(k * j) % 11}" for j in range(8)) + f" __label__{k % 2}") for k in range(n)]
    return spark.createDataFrame(rows, "id long, text string")


def _probabilities(model, lines):
    out = K.predict(model, lines.withColumn("text", F.regexp_replace("text", "__label__.", "")), "id", "text", k=2)
    return {(r["id"], r["label"]): r["prob"] for r in out.collect()}


def test_a_saved_shrunk_model_predicts_the_same(spark):
    lines = _lines(spark)
    model = K.train(lines, "id", "text", Args(dim=8, epoch=2, word_ngrams=2, bucket=500))
    small, _, _ = K.shrink(model, 10, key="id", text="text")
    for m, shrunk in ((model, False), (small, True)):
        path = K.folder(spark, "test-model")
        K.save(m, path, parts=4)
        back = K.load(spark, path)
        assert back.shrunk is shrunk and back.nwords == m.nwords and set(back.input.columns) == {"row_id", "vec"}
        a, b = _probabilities(m, lines), _probabilities(back, lines)
        assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 1e-12


def test_look_ups(spark):
    model = K.train(_lines(spark), "id", "text", Args(dim=6, epoch=1, minn=2, maxn=3, bucket=300))
    path = K.folder(spark, "test-model")
    K.save(model, path, parts=16)
    words = spark.createDataFrame([("good1",), ("nowhere",), ("good1",), ("__label__1",)], "word string")
    want = {r["word"]: r["id"] for r in model.vocab.collect()}
    got = {r["word"]: r["id"] for r in K.word_ids(spark, path, words).collect()}
    assert got == {"good1": want["good1"], "nowhere": -1, "__label__1": want["__label__1"]}
    vec = {r["row_id"]: r["vec"] for r in model.input.collect()}
    asked = sorted(vec)[:5] + [10 ** 9]
    back = {r["row_id"]: r["vec"] for r in K.input_vectors(spark, path, spark.createDataFrame([(i,) for i in asked], "row_id long")).collect()}
    assert all(back[i] == vec[i] for i in asked[:5]) and len(back[10 ** 9]) == 6
    rows = K.subword_vectors(spark, path, words.filter("word = 'good1'")).orderBy("pos").collect()
    assert rows[0]["gram"] == "good1" and rows[0]["row_id"] == want["good1"] and rows[0]["vec"] == vec[want["good1"]]
    assert [r["gram"] for r in rows[1:]] and all(r["vec"] is not None for r in rows)
    # one wanted word: the scan opens the folder of its hash only
    one = spark.read.parquet(f"{path}/vocab").filter((F.col("part") == K._part(F.lit("good1"), 16)) & (F.col("word") == "good1"))
    assert len(one.select(F.input_file_name()).distinct().collect()) == 1 and one.count() == 1


def test_no_labels_no_predictions(spark):
    hidden = spark.createDataFrame([(1, [1.0, 2.0])], "id long, vec array<double>")
    assert EV.predict(hidden, "id", spark.createDataFrame([], "label string, vec array<double>")).count() == 0


def test_blocks_of_queries_and_vectors_give_the_same_neighbours(spark):
    rng = np.random.default_rng(4)
    vec = spark.createDataFrame(pd.DataFrame({"word": [f"w{i:03d}" for i in range(200)], "vec": list(rng.normal(size=(200, 6)))}))
    q = VE.word_queries(vec, vec)
    whole = VE.nearest(q, vec, k=4)
    parts = VE.nearest(q, vec, k=4, chunk=30, vector_block=40)
    key = ["qid", "rank"]
    a, b = (x.toPandas().sort_values(key).reset_index(drop=True) for x in (whole, parts))
    assert a["word"].tolist() == b["word"].tolist() and np.allclose(a["sim"], b["sim"]) and len(a) == 800
    plans = [x._jdf.queryExecution().executedPlan().toString() for x in (whole, parts)]
    assert plans[0].count("FlatMapCoGroupsInPandas") == plans[1].count("FlatMapCoGroupsInPandas") > 0 and "Union" not in plans[1]
    assert VE.nearest(q.limit(0), vec).count() == 0 and VE.nearest(q, vec.limit(0)).count() == 0
