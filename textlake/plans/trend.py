"""Lifecycle A: posts -> repeat removal -> bins -> spam filter -> sentiment
-> filled series -> per-topic trend matrix (AGG-14).

One lazy plan.  Shuffles: the pre-aggregation on (topic, bin, user), the
flag joins on that (small) frame, the final (topic, bin) aggregate and the
per-topic window over bins.
"""

from __future__ import annotations

import datetime as _dt
from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlake.functions.time import interval_micros
from textlake.operators import bins as B
from textlake.operators.posts import attach_topic_id


def trend_series(posts: DataFrame, n_pieces: int = 4, up=None, low=None,
                 spam_ids: DataFrame | None = None, white_ids: DataFrame | None = None,
                 update: bool = True, carry: bool = True,
                 topic: Sequence[str] = ("topic",)) -> tuple[DataFrame, B.BinSpec]:
    """The per-topic filled bin series (8 reference columns + topic, bin_idx)."""
    spec = B.bin_spec(posts, "tweet_created_at", n_pieces, up, low)
    scores = B.binned_scores(posts, spec, topic, spam_ids=spam_ids, white_ids=white_ids,
                             update=update, carry=carry)
    return B.fill_bins(scores, posts, spec, topic), spec


TREND_COLS = ["twitter_trend_compound", "twitter_trend_positive", "volume_tweets_positive",
              "twitter_trend_negative", "volume_tweets_negative", "number_tweets",
              "number_tweets_rejected"]


def trend_matrix(posts: DataFrame, dim: DataFrame, mode: str = "GT", n_pieces: int = 4,
                 up: _dt.datetime | None = None, low: _dt.datetime | None = None,
                 since_parts=(1, 0, 0, 0), spam_ids=None, white_ids=None) -> DataFrame:
    """AGG-14: one row per topic: id (JOIN-01), name, start, time gap, then by
    mode the window's sentiment (``T``) and/or the trend score of the binned
    series over the last ``since_parts`` (``G``).

    Column names are made unique (the reference repeats one and pads one
    with a blank).
    """
    if up is None or low is None:
        lo, hi = posts.agg(F.min("tweet_created_at"), F.max("tweet_created_at")).first()
        up = hi if up is None else up
        low = lo if low is None else low
    base = posts.select("topic").distinct()
    out = base
    if "T" in mode:
        # one batch per topic covering [low, up]: a single bin as wide as the window
        typ = posts.schema["tweet_created_at"].dataType.simpleString()
        window = posts.filter(F.col("tweet_created_at").between(F.lit(low).cast(typ), F.lit(up).cast(typ)))
        spec = B.BinSpec(edge_us=0, width_us=1, n_bins=1, gap_us=_gap_us(up, low))
        one = window.withColumn("bin_idx", F.lit(0).cast("bigint")).withColumn(
            "_ts_us", F.unix_micros(F.col("tweet_created_at").cast("timestamp")))
        flagged = B.spam_filter(one, spec, spam_ids=spam_ids, white_ids=white_ids)
        kept = flagged.filter(F.col("is_spam") == 0)
        s = B.sentiment_scores(kept, ["topic"]).withColumnRenamed("compound_score", "twitter_trend_compound")
        rej = flagged.groupBy("topic").agg(F.sum("is_spam").cast("bigint").alias("number_tweets_rejected"))
        out = out.join(s, "topic", "left").join(rej, "topic", "left")
        # a topic that keeps nothing reports no score and no rejected posts
        out = out.withColumn("number_tweets_rejected", F.when(F.col("number_tweets").isNotNull(), F.col("number_tweets_rejected")))
    if "G" in mode:
        series, _ = trend_series(posts, n_pieces, up, low, spam_ids, white_ids)
        since = up - _dt.timedelta(microseconds=interval_micros(since_parts))
        g = B.trend_score(series, ["topic"], since).select(
            "topic", F.col("trend_score").alias("google_trend"))
        out = out.join(g, "topic", "left")
    out = attach_topic_id(out, dim)
    cols = [F.col("id"), F.col("topic").alias("name"), F.lit(low).cast("timestamp_ntz").alias("start_date"),
            F.lit(_gap_us(up, low) / 1e6).alias("time_gap_s")]
    if "T" in mode:
        defaults = dict(B.EMPTY_SCORE, twitter_trend_compound=B.EMPTY_SCORE["compound_score"])
        cols += [F.coalesce(F.col(c), F.lit(defaults[c])).alias(c) for c in TREND_COLS]
    if "G" in mode:
        cols += [F.col("google_trend")]
    return out.select(*cols)


def _gap_us(up, low) -> int:
    return (up - low) // _dt.timedelta(microseconds=1)


#: What a post needs to be judged and scored, in the order in which a lack is reported.
NEEDED = ("tweet_created_at", "user_id", "compound", "retweet_count", "tweet_favorite_count", "user_age_days",
          "user_posts_count", "user_follower_count", "user_favorite_count")


def topic_faults(posts: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(topic, failed_reason, n_faulty) of every topic that can't be scored: a post without a value that
    the scores need (or with a compound that is no number), or a requested term (``terms``: topic) without
    posts.  Posts without a topic are one row of their own.  One aggregation with partial sums; the result has a
    row a failed topic."""
    lacks = {c: F.col(c).isNull() for c in NEEDED}
    lacks["compound"] |= F.col("compound").isin(float("nan"), float("inf"), float("-inf"))
    faulty = F.col("topic").isNull()
    for bad in lacks.values():
        faulty |= bad
    per = posts.groupBy("topic").agg(F.count_if(faulty).alias("n_faulty"),
                                     *[F.max(bad).alias(f"_no_{c}") for c, bad in lacks.items()])
    reason = F.when(F.col("topic").isNull(), "no topic")
    for c in NEEDED:
        reason = reason.when(F.col(f"_no_{c}"), f"missing {c}")
    if terms is not None:
        asked = terms.select(F.col("topic").alias("_asked")).distinct()
        per = per.join(asked, F.col("topic").eqNullSafe(F.col("_asked")), "full").withColumn(
            "_posts", F.col("n_faulty").isNotNull())
        reason = F.when(~F.col("_posts"), "no posts").otherwise(reason)
        per = per.withColumn("topic", F.coalesce("topic", "_asked")).withColumn("n_faulty", F.coalesce("n_faulty", F.lit(0)))
    return per.select("topic", reason.alias("failed_reason"), "n_faulty").filter("failed_reason IS NOT NULL")


def trend_run(posts: DataFrame, dim: DataFrame, mode: str = "GT", terms: DataFrame | None = None, n_pieces: int = 4,
              up: _dt.datetime | None = None, low: _dt.datetime | None = None, **options) -> DataFrame:
    """AGG-14 with failed terms kept apart: the rows of ``trend_matrix`` for every topic that can be
    scored, and for each other one a row with its ``failed_reason`` and ``n_faulty`` posts (its scores are
    null).  The window reaches over all readable times, so a failing topic changes nothing for the rest.
    ``failed_reason`` is null for scored topics."""
    if up is None or low is None:
        lo, hi = posts.agg(F.min("tweet_created_at"), F.max("tweet_created_at")).first()
        up, low = (hi if up is None else up), (lo if low is None else low)
    failed = topic_faults(posts, terms)
    if up is None or low is None:           # no readable time at all: nothing can be scored
        up = low = _dt.datetime(1970, 1, 1)
    good = posts.filter(F.col("topic").isNotNull()).join(failed.select("topic"), "topic", "left_anti")
    matrix = trend_matrix(good, dim, mode, n_pieces, up, low, **options)
    ids = attach_topic_id(failed, dim).select(
        "id", F.col("topic").alias("name"), F.lit(low).cast("timestamp_ntz").alias("start_date"),
        F.lit(_gap_us(up, low) / 1e6).alias("time_gap_s"), "failed_reason", "n_faulty")
    return matrix.unionByName(ids, allowMissingColumns=True)


def split_failed(run: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(matrix, failed terms) of a ``trend_run``."""
    apart = ["failed_reason", "n_faulty"]
    return (run.filter("failed_reason IS NULL").drop(*apart),
            run.filter("failed_reason IS NOT NULL").select("id", "name", *apart))
