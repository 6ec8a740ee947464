"""Vocabulary, corpus statistics, token <-> id encoding (AGG-03..05,
AGG-11..13, JOIN-04, JOIN-07, ARR-01/02, TOP-04, SET-03, WIN-06)."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlake.functions.text import EOS
from textlake.operators.common import dense_index

LABEL_PREFIX = "__label__"   # fixed value: the library's default label prefix


def token_counts(tokens: DataFrame, col: str = "tokens") -> DataFrame:
    """Counts of every token of an array column (map-side combined)."""
    return tokens.select(F.explode(col).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("count"))


def build_vocab(tokens: DataFrame, col: str = "tokens", min_count: int = 1, min_count_label: int = 1,
                prefix: str = LABEL_PREFIX) -> DataFrame:
    """AGG-03: (id, word, count, type); words first, then labels, each by
    falling count (ties by word); rare entries dropped.  Ids from 0."""
    return vocab_of_counts(token_counts(tokens, col), min_count, min_count_label, prefix)


def vocab_of_counts(c: DataFrame, min_count: int = 1, min_count_label: int = 1, prefix: str = LABEL_PREFIX) -> DataFrame:
    """AGG-03 of given (word, count) rows, one a word."""
    is_label = F.col("word").startswith(prefix)
    c = c.withColumn("type", F.when(is_label, "label").otherwise("word"))
    c = c.filter((is_label & (F.col("count") >= min_count_label)) | (~is_label & (F.col("count") >= min_count)))
    c = c.withColumn("_t", F.when(is_label, 1).otherwise(0))
    return dense_index(c, ["_t", F.col("count").desc(), "word"], name="id", start=0).drop("_t").select(
        "id", "word", "count", "type")


def corpus_stats(tokens: DataFrame, col: str = "tokens", prefix: str = LABEL_PREFIX) -> DataFrame:
    """AGG-11: total tokens (rare ones included), words, labels, lines, longest line."""
    t = F.col(col)
    n_lab = F.size(F.filter(t, lambda x: x.startswith(prefix)))
    return tokens.agg(
        F.coalesce(F.sum(F.size(t)), F.lit(0)).cast("bigint").alias("ntokens"),
        F.coalesce(F.sum(F.size(t) - n_lab), F.lit(0)).cast("bigint").alias("nwords_tokens"),
        F.coalesce(F.sum(n_lab), F.lit(0)).cast("bigint").alias("nlabel_tokens"),
        F.count(F.lit(1)).alias("nlines"),
        F.max(F.size(t)).cast("bigint").alias("longest"))


def keep_probability(vocab: DataFrame, ntokens, t: float = 1e-4) -> DataFrame:
    """AGG-12: f = count / ntokens, keep = min(1, sqrt(t/f) + t/f) (words)."""
    f = F.col("count") / F.lit(ntokens) if not isinstance(ntokens, Column) else F.col("count") / ntokens
    return vocab.filter(F.col("type") == "word").select(
        "id", "word", F.least(F.lit(1.0), F.sqrt(F.lit(t) / f) + F.lit(t) / f).alias("keep_prob"))


def negative_distribution(vocab: DataFrame) -> DataFrame:
    """AGG-13: sqrt(count) / sum(sqrt(count)) over words (sum as a scalar
    subquery: no join)."""
    w = vocab.filter(F.col("type") == "word")
    total = w.select(F.sum(F.sqrt("count"))).scalar()
    return w.select("id", "word", (F.sqrt("count") / total).alias("p_negative"))


def label_counts(tokens: DataFrame, col: str = "tokens", prefix: str = LABEL_PREFIX) -> DataFrame:
    """AGG-05: labels with their frequency."""
    return token_counts(tokens, col).filter(F.col("word").startswith(prefix)).withColumnRenamed("word", "label")


def _ordered(g: DataFrame, key: str, field: str, out: str, kind: str) -> DataFrame:
    """One list per key in position order (null entries are skipped)."""
    # sort_array compares natively, array_sort by a function call a comparison
    lists = g.groupBy(key).agg(F.sort_array(F.collect_list(
        F.when(F.col(field).isNotNull(), F.struct("pos", field)))).alias("_s"))
    return lists.select(key, F.transform("_s", lambda s: s[field]).cast(f"array<{kind}>").alias(out))


def word_frequencies(vocab: DataFrame) -> DataFrame:
    """AGG-05: words with their frequency."""
    return vocab.filter(F.col("type") == "word").select("word", "count")


def encode_tokens(df: DataFrame, key: str, col: str, vocab: DataFrame, offset: int = 0) -> DataFrame:
    """JOIN-04: token -> id + ``offset``, unknown dropped, order kept.

    posexplode -> left join on word (AQE splits a hot word) -> one ordered
    collect per row (a row's list is bounded by the row's own length); rows
    without known words keep an empty list, so ``df`` is read once.  An offset of
    1 leaves 0 free as a padding id."""
    ex = df.select(key, F.posexplode_outer(col).alias("pos", "word"))
    j = ex.join(vocab.select("word", (F.col("id") + offset).alias("_id")), "word", "left")
    return _ordered(j, key, "_id", "ids", "bigint")


def decode_tokens(df: DataFrame, key: str, col: str, vocab: DataFrame, pad: int = 0, offset: int = 1) -> DataFrame:
    """JOIN-07: ids (word id + ``offset``) back to words, padding dropped, order kept."""
    ids = F.filter(col, lambda i: i != pad)
    ex = df.select(key, F.posexplode_outer(ids).alias("pos", "_id"))
    words = vocab.select((F.col("id") + offset).alias("_id"), "word")
    return _ordered(ex.join(words, "_id", "left"), key, "word", "words", "string")


def pad(col: Column, n: int, value: int = 0) -> Column:
    """ARR-01: pad at the front / cut at the front to length ``n`` (ids from 1,
    see ``encode_tokens(offset=1)``: 0 is no word)."""
    size = F.size(col)
    return F.when(size >= n, F.slice(col, size - n + 1, n)).otherwise(
        F.concat(F.array_repeat(F.lit(value).cast("bigint"), F.lit(n) - size), col))


def one_hot(col: Column, n: int) -> Column:
    """ARR-02."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i == col, 1.0).otherwise(0.0))


def top_words(vocab: DataFrame, n: int) -> DataFrame:
    """TOP-04: the n most frequent words (TakeOrdered, ties by word)."""
    return vocab.filter(F.col("type") == "word").orderBy(F.col("count").desc(), "word").limit(n)


def label_index(*frames: DataFrame, col: str = "answer") -> DataFrame:
    """SET-03: union of the label sets, numbered by value."""
    u = frames[0].select(col)
    for f in frames[1:]:
        u = u.union(f.select(col))
    return dense_index(u.distinct(), [col], name="label_idx", start=0)


def balance(df: DataFrame, label: str, order: Sequence[str]) -> DataFrame:
    """WIN-06: the first n rows of every class, n = the smallest class size.
    Per-class positions come from ``dense_index`` (no per-class window, so a
    class holding a third of the rows is not one task)."""
    n = df.groupBy(label).count().select(F.min("count")).scalar()
    ix = dense_index(df, order, group=[label], name="_pos")
    return ix.filter(F.col("_pos") <= n).drop("_pos")
