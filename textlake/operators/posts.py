"""Operators on post tables: repeat removal, flags, cuts, look-up joins.

Skew: one id or user may hold a third of all rows.  Per-key work is
therefore done with ``groupBy`` (map-side partial aggregation) and equi
joins on the aggregated keys (AQE splits a skewed join partition), never
with a window that would put the hot key into one task.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlake.operators.common import fill_forward

from textlake.functions import text as T


def _order_struct(order: Sequence[str]) -> Column:
    return F.struct(*[F.col(c) for c in order])


def drop_repeats(df: DataFrame, id_col: str, order: Sequence[str], how: str = "keep_last") -> DataFrame:
    """WIN-01 repeat removal.

    ``keep_last``  : one row per id, the last in ``order`` (the meant rule).
    ``keep_first`` : one row per id, the first in ``order``.
    ``drop_first`` : the reference's literal rule: of an id seen more than
                     once only its first row is dropped (3 copies keep 2).
    ``order`` must make rows of one id distinct.
    """
    cols = df.columns
    key = _order_struct(order)
    if how in ("keep_last", "keep_first"):
        pick = F.max_by if how == "keep_last" else F.min_by
        row = F.struct(*[F.col(c) for c in cols])
        return df.groupBy(id_col).agg(pick(row, key).alias("_r")).select("_r.*")
    if how == "drop_first":
        first = (df.groupBy(id_col)
                 .agg(F.count(F.lit(1)).alias("_n"), F.min(key).alias("_first"))
                 .filter(F.col("_n") > 1))
        j = df.join(first, id_col, "left")
        return j.filter(F.col("_n").isNull() | (key != F.col("_first"))).select(*cols)
    raise ValueError(f"unknown rule {how!r}")


def keyword_flags(df: DataFrame, col: str, words: Sequence[str], processed: bool = True) -> DataFrame:
    """FLT-01: one boolean column per keyword (regex search, case-insensitive)
    in the processed text (STR-03) of ``col``."""
    src = T.process_text(F.col(col)) if processed else F.col(col)
    out = df.withColumn("_txt", src)
    return out.select(*df.columns, *[T.keyword_flag(F.col("_txt"), w).alias(w) for w in words])


def text_or_drop(df: DataFrame, col: str, how: str = "drop") -> DataFrame:
    """FLT-03: drop rows without text, or turn missing text into ''."""
    if how == "drop":
        return df.na.drop(subset=[col])
    return df.na.fill({col: ""})


def time_cut(df: DataFrame, ts: str, low=None, high=None) -> DataFrame:
    """FLT-04: both ends inclusive; a missing end is the data's own min/max
    (a lazy scalar subquery, so the cut is one plan)."""
    typ = df.schema[ts].dataType.simpleString()
    # constants typed like the column, so the cut reaches the Parquet scan
    lo = F.lit(low).cast(typ) if low is not None else df.select(F.min(ts)).scalar()
    hi = F.lit(high).cast(typ) if high is not None else df.select(F.max(ts)).scalar()
    return df.filter(F.col(ts).between(lo, hi))


def attach_topic_id(df: DataFrame, dim: DataFrame, name_col: str = "topic") -> DataFrame:
    """JOIN-01: name -> id, missing -1, the last duplicate name wins.

    ``dim`` is (name, id, pos); ``pos`` orders duplicates.  The dimension is
    reduced to one row per name first; the join side is then chosen by AQE
    from its measured size.
    """
    d = dim.groupBy("name").agg(F.max_by("id", "pos").alias("id"))
    j = df.join(d, df[name_col] == d["name"], "left").drop("name")
    return j.withColumn("id", F.coalesce(F.col("id"), F.lit(-1).cast("bigint")))


def split_ambiguous(names: DataFrame, lexicon: DataFrame, name_col: str = "name",
                    word_col: str = "word") -> tuple[DataFrame, DataFrame]:
    """JOIN-02: a name is unambiguous if none of its parts (split on blank or
    non-word character, lower-cased) is in the lexicon.  Returns (good, bad)."""
    parts = names.select(name_col, F.explode(F.split(F.lower(F.col(name_col)), r"[^\p{L}\p{N}_]", -1)).alias("_w"))
    hits = parts.join(lexicon.select(F.col(word_col).alias("_w")), "_w", "left_semi").select(name_col)
    good = names.join(hits, name_col, "left_anti")
    bad = names.join(hits, name_col, "left_semi")
    return good, bad


def membership(df: DataFrame, ids: DataFrame, key: str, keep: bool = True) -> DataFrame:
    """JOIN-03: rows whose ``key`` is (keep=True) or is not in ``ids``."""
    ids = ids.select(key).distinct()
    return df.join(ids, key, "left_semi" if keep else "left_anti")


def repeat_users(df: DataFrame, user: str, bar: float, group: Sequence[str] = ()) -> DataFrame:
    """AGG-02: users with more than ``bar`` posts (per group)."""
    return (df.groupBy(*group, user).agg(F.count(F.lit(1)).alias("n_posts"))
            .filter(F.col("n_posts") > F.lit(bar)))


def backfill(df: DataFrame, col: str, order: Sequence[str], part: Sequence[str] = ()) -> DataFrame:
    """WIN-04: a missing value takes the next row's (first non-null after it)
    within ``part`` (e.g. topic): the value is carried forward in reverse order,
    across sort partitions, so a hot topic is not one task.
    """
    return fill_forward(df, [F.col(c).desc() for c in order], col, part)


def by_time(df: DataFrame, col: str) -> DataFrame:
    """TOP-01 / TOP-05: total order by a column (range-partitioned sort)."""
    return df.orderBy(col)


def spam_split(flagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SET-04: (kept rows, all rows with ``is_spam``) from one flagged frame."""
    return flagged.filter(F.col("is_spam") == 0), flagged
