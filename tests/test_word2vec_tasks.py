"""Word2Vec's tasks follow the tokens, not one task for any input."""

from textlake.operators import models as M


def test_tasks_follow_the_tokens(spark, monkeypatch):
    df = spark.createDataFrame([(["a", "b", "c", "a"] * 5,)] * 20, "t array<string>")      # 400 tokens
    assert M.word2vec(df, "t", dim=4, min_count=1).getNumPartitions() == 1
    monkeypatch.setattr(M, "WORD2VEC_UNIT", 100)
    m = M.word2vec(df, "t", dim=4, min_count=1)
    assert m.getNumPartitions() == 4 and {r["word"] for r in m.getVectors().collect()} == {"a", "b", "c"}
