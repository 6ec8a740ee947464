"""Lists put in order are sorted natively, not by a function call a comparison."""

from textlake.operators import vocab as V


def test_encode_sorts_natively(spark):
    toks = spark.createDataFrame([(1, ["b", "x", "a", "b"] * 40), (2, []), (3, None)], "k long, t array<string>")
    vocab = spark.createDataFrame([(0, "a"), (1, "b")], "id long, word string")
    e = V.encode_tokens(toks, "k", "t", vocab, offset=1)
    assert {r["k"]: r["ids"] for r in e.collect()} == {1: [2, 1, 2] * 40, 2: [], 3: []}
    plan = e._jdf.queryExecution().optimizedPlan().toString()
    assert "sort_array(collect_list(" in plan and "array_sort(" not in plan.replace("sort_array(", "")
