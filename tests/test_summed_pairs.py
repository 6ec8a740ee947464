"""Pairs summed up inside tasks: the plain pairs' counts and weights, for units of any size."""

from pyspark.sql import functions as F

from textlake.operators import vectors as VE


def test_summed_pairs_equal_the_plain_pairs(spark):
    lines = [(["a", "b", "a", "a", "é", "c"],), ([],), (None,), (["b"],), (["c", "", "a"] * 40,), (["z", None, "a", None],)]
    for kind, df in (("string", spark.createDataFrame(lines, "t array<string>")),
                     ("bigint", spark.createDataFrame([([5, 1, 5, 5, 9],), ([1, 2] * 30,), ([],)], "t array<bigint>"))):
        plain = df.filter("t is not null")
        want = VE.skipgram_pairs(plain, "t", 3).groupBy("center", "context").agg(
            F.count("*").alias("n"), F.round(F.sum("weight"), 9).alias("w")).collect()
        for unit in (1, 7, 1 << 20):
            got = VE.skipgram_pairs(df, "t", 3, summed=True, unit=unit).select("center", "context", "n", F.round("weight", 9)).collect()
            assert sorted(map(str, map(tuple, got))) == sorted(map(str, map(tuple, want))) and len(got) > 5, (kind, unit)


def test_a_unit_sends_a_word_once_with_its_partners(spark):
    """Rows sent on grow with the words of a unit, not with its pairs."""
    words = [f"w{i % 50}" for i in range(20_000)]
    out = spark.createDataFrame([(words,)], "t array<string>").coalesce(1).mapInArrow(
        VE._partners(5, 1 << 20, ["w7"]), "a string, b array<string>, n array<bigint>, k array<bigint>")
    assert out.count() <= 50
    # a frequent word owns its pairs with frequent words only: here with itself, and w7 never lies within 5 of w7
    assert out.filter("a = 'w7'").count() == 0 and out.filter(F.array_contains("b", "w7")).count() == 10
    assert out.select(F.sum(F.aggregate("n", F.lit(0).cast("bigint"), lambda x, y: x + y))).first()[0] == sum(20_000 - d for d in range(1, 6))


def test_pairs_travel_packed_by_bucket(spark, monkeypatch):
    """However many buckets: the plain pairs, and no exchange of (word, word) rows."""
    lines = spark.createDataFrame([([f"w{(i * i + j) % 23}" for i in range(60)] + [None, "é"],) for j in range(20)], "t array<string>")
    want = VE.skipgram_pairs(lines, "t", 3).groupBy("center", "context").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 9).alias("w")).collect()
    for bucket in (40, 1 << 22):
        monkeypatch.setattr(VE, "PAIR_BUCKET", bucket)
        out = VE.skipgram_pairs(lines.repartition(3), "t", 3, summed=True, unit=100)
        dealt = [x for x in out._jdf.queryExecution().executedPlan().toString().splitlines() if "hashpartitioning" in x]
        assert dealt and all("hashpartitioning(_b#" in x for x in dealt)
        got = out.select("center", "context", "n", F.round("weight", 9)).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, map(tuple, want)))
