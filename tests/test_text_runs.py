"""Cleaners as replacements over the whole text: the tokens that the array form keeps, on odd texts."""

import random

from pyspark.sql import functions as F

from textlake.functions import text as T

BITS = list("aBcDZ http://x:;=-'()DPp.,_@#RT\t\n\r!’“‘\"`~|{}[]^\\/&0é漢😀 ") + [
    "http", "https://", "RT @u: ", "...", "Ab Cd", " A", "a-b", "it's", "‘_", "__", "Mo.X Ye", "one two three four "]


def _texts(spark):
    random.seed(3)
    rows = [("".join(random.choices(BITS, k=random.randint(0, 30))),) for _ in range(2000)]
    return spark.createDataFrame(rows + [("ab " * 5000,), ("Ab " * 5000 + "!" * 5000,), ("",)], "t string")


def test_replacements_keep_the_tokens_of_the_array_form(spark):
    t = F.col("t")
    array = F.array_join(T.drop_punct(T.tokens(t), T.PUNCT_SENTENCE), " ")
    words = F.array_join(F.filter(T.tokens(t), lambda x: x.rlike(T.KEEP_TOKEN_RE) & ~x.startswith("http")), " ")
    for r in _texts(spark).select(T.in_a_row(t, T.KEPT_SENTENCE_RE).alias("a"), array.alias("b"), T.process_text(t).alias("c"), words.alias("d")).collect():
        assert r["a"] == r["b"] and r["c"] == r["d"]


def test_cleaners_make_no_array_of_tokens(spark):
    """An array of tokens and a function call for each took most of their time."""
    for clean in (T.clean_sentence, T.process_text):
        plan = _texts(spark).select(clean(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
        assert "lambda" not in plan and "regexp_extract_all" not in plan


def test_glued_names(spark):
    df = spark.createDataFrame([("Monero Dark Net x Y",), ("A'B C",), ("aB.c- D d",), (None,)], "t string")
    assert [r[0] for r in df.select(T.glue_capitals(F.col("t"))).collect()] == ["Monero-Dark-Net x Y", "A'B-C", "aB.c--D d", None]
