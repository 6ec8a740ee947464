"""Time bins, spam filter and sentiment scores (WIN-02/03/05, FLT-02, AGG-01/10).

Bins are right-closed ``(low, up]`` and counted back from an upper edge, in
microseconds.  Bin edges are plan constants (one 2-value aggregate when the
caller does not give them), so every per-bin quantity is one ``groupBy`` on
``(topic, bin)``: O(rows), map-side combined, no per-bin rescans.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlake.functions.time import (US_PER_DAY, from_micros, hour_edge_py,
                                     micros_py, to_micros)

# Fixed values of the reference's rules
EMPTY_SCORE = dict(compound_score=0.0, twitter_trend_positive=0.0, volume_tweets_positive=1,
                   twitter_trend_negative=0.0, volume_tweets_negative=1, number_tweets=-1,
                   number_tweets_rejected=0)
SAFE_AGE_DAYS = 180
MAX_POST_RATE = 3
MIN_POSTS, MIN_FOLLOWERS, MIN_FAVOURITES = 10, 5, 1
RESCUE_FAVOURITES, RESCUE_RETWEETS = 5, 5

SCORE_COLS = ["compound_score", "twitter_trend_positive", "volume_tweets_positive",
              "twitter_trend_negative", "volume_tweets_negative", "number_tweets",
              "number_tweets_rejected"]


@dataclass(frozen=True)
class BinSpec:
    edge_us: int    # upper edge of bin 0
    width_us: int
    n_bins: int
    gap_us: int     # up - low: the span the spam bar is scaled by

    @property
    def total_bar(self) -> int:
        days = self.gap_us // US_PER_DAY
        return 3 * days if days != 0 else 3


def bin_spec(df: DataFrame, ts: str, n_pieces: int, up=None, low=None) -> BinSpec:
    """Bin edges: ``n_pieces`` bins per day, top edge = next full hour of ``up``.

    Missing ends come from the data (one tiny aggregate; two scalars reach the
    driver, no rows).
    """
    if up is None or low is None:
        lo, hi = df.agg(F.min(ts), F.max(ts)).first()
        up = hi if up is None else up
        low = lo if low is None else low
    edge = hour_edge_py(up)
    width = round(86_400_000_000 / n_pieces)
    e_us, lo_us = micros_py(edge), micros_py(low)
    k = (e_us - lo_us + width - 1) // width if e_us > lo_us else 0
    return BinSpec(e_us, width, int(k), micros_py(up) - lo_us)


def assign_bins(df: DataFrame, spec: BinSpec, ts: str = "tweet_created_at") -> DataFrame:
    """WIN-02: ``bin_idx`` = floor((edge - ts) / width); rows outside all bins out.

    The range filter is on the raw column, so it is pushed into the scan.
    """
    import datetime as _dt
    lo_us = spec.edge_us - spec.n_bins * spec.width_us
    epoch = _dt.datetime(1970, 1, 1)
    hi_t = F.lit(epoch + _dt.timedelta(microseconds=spec.edge_us)).cast("timestamp_ntz")
    lo_t = F.lit(epoch + _dt.timedelta(microseconds=lo_us)).cast("timestamp_ntz")
    t = to_micros(F.col(ts))
    # raw-column comparisons with constant bounds: pushed to the Parquet scan
    out = df.filter((F.col(ts) <= hi_t) & (F.col(ts) > lo_t))
    return out.withColumn("bin_idx", ((F.lit(spec.edge_us) - t) / F.lit(spec.width_us)).cast("bigint")) \
              .withColumn("_ts_us", t)


def bin_date(spec: BinSpec, col: str = "bin_idx") -> Column:
    """The bin's own upper edge (the reference's ``bin_start_date``)."""
    return from_micros(F.lit(spec.edge_us) - F.col(col) * F.lit(spec.width_us))


def static_ok(age="user_age_days", posts="user_posts_count", followers="user_follower_count",
              favs="user_favorite_count") -> Column:
    """FLT-02 account terms that must all hold."""
    a, p = F.col(age), F.col(posts)
    return ((a > SAFE_AGE_DAYS)
            & (p.cast("double") / (a + 1) < MAX_POST_RATE)
            & (p > MIN_POSTS) & (F.col(followers) > MIN_FOLLOWERS) & (F.col(favs) > MIN_FAVOURITES))


def rescued(favs="tweet_favorite_count", rts="retweet_count") -> Column:
    """A failing user's post survives if it is popular."""
    return (F.col(favs) > RESCUE_FAVOURITES) | (F.col(rts) > RESCUE_RETWEETS)


def _flag_users(frame: DataFrame, spec: BinSpec, topic: Sequence[str], user: str, weight: Column,
                tmin: str, tmax: str, carry: bool, spam_ids: DataFrame | None,
                white_ids: DataFrame | None) -> DataFrame:
    """Adds ``_failing``: user over the bar in this bin (or, with ``carry``, in
    any later bin of the topic), or listed as spam, and not white-listed.

    ``frame`` may be raw rows (weight 1) or rows pre-aggregated per
    (topic, bin, user, ...) with a row count as weight.
    """
    batch = [*topic, "bin_idx"]
    # one aggregate of the frame gives the user counts; the bin span is
    # derived from it (no second pass over the rows)
    counts = frame.groupBy(*batch, user).agg(F.sum(weight).alias("_cnt"), F.min(tmin).alias("_lo"),
                                             F.max(tmax).alias("_hi"))
    span = counts.groupBy(*batch).agg((F.max("_hi") - F.min("_lo")).alias("_span"))
    bar = F.greatest(F.lit(1.0), F.col("_span").cast("double") / F.lit(float(spec.gap_us)) * F.lit(spec.total_bar))
    over = (counts.join(span.select(*batch, bar.alias("_bar")), batch)
            .filter(F.col("_cnt") > F.col("_bar")).select(*batch, user))
    if carry:
        # bins run backwards from the newest, and the spam list grows in
        # place: a user over the bar in bin j stays listed for bins k >= j.
        first = over.groupBy(*topic, user).agg(F.min("bin_idx").alias("_first"))
        out = frame.join(first, [*topic, user], "left")
        flagged = F.coalesce(F.col("bin_idx") >= F.col("_first"), F.lit(False))
        out = out.withColumn("_flag", flagged).drop("_first")
    else:
        out = frame.join(over.withColumn("_hit", F.lit(True)), [*batch, user], "left")
        out = out.withColumn("_flag", F.coalesce(F.col("_hit"), F.lit(False))).drop("_hit")
    if spam_ids is not None:
        out = out.join(spam_ids.select(user).distinct().withColumn("_listed", F.lit(True)), user, "left")
        out = out.withColumn("_flag", F.col("_flag") | F.coalesce(F.col("_listed"), F.lit(False))).drop("_listed")
    if white_ids is not None:
        out = out.join(white_ids.select(user).distinct().withColumn("_white", F.lit(True)), user, "left")
        out = out.withColumn("_flag", F.col("_flag") & ~F.coalesce(F.col("_white"), F.lit(False))).drop("_white")
    return out.withColumnRenamed("_flag", "_failing")


def spam_filter(binned: DataFrame, spec: BinSpec, topic: Sequence[str] = ("topic",), user: str = "user_id",
                spam_ids: DataFrame | None = None, white_ids: DataFrame | None = None,
                update: bool = True, carry: bool = False) -> DataFrame:
    """FLT-02 on binned rows: adds ``is_spam`` (0/1); filter ``is_spam = 0``
    for the kept rows (SET-04).  With ``update=False`` every row passes."""
    if not update:
        return binned.withColumn("is_spam", F.lit(0))
    f = _flag_users(binned, spec, list(topic), user, F.lit(1), "_ts_us", "_ts_us", carry, spam_ids, white_ids)
    keep = (~F.col("_failing") | rescued()) & static_ok()
    return f.withColumn("is_spam", F.when(keep, 0).otherwise(1)).drop("_failing")


def _scores_from_sums(n_pos, rt_pos, s_pos, n_neg, rt_neg, s_neg, n_rows) -> list[Column]:
    vol_pos = n_pos + rt_pos + 1
    vol_neg = n_neg + rt_neg + 1
    return [
        F.coalesce(F.try_divide(s_pos, s_pos - s_neg), F.lit(0.0)).alias("compound_score"),
        (s_pos / vol_pos).alias("twitter_trend_positive"),
        vol_pos.cast("bigint").alias("volume_tweets_positive"),
        (s_neg / vol_neg).alias("twitter_trend_negative"),
        vol_neg.cast("bigint").alias("volume_tweets_negative"),
        n_rows.cast("bigint").alias("number_tweets"),
    ]


def _sum_if(cond: Column, val: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, val)), F.lit(0))


def sentiment_scores(df: DataFrame, group: Sequence[str], compound: str = "compound",
                     rt: str = "retweet_count") -> DataFrame:
    """AGG-01: retweet-weighted sentiment per group, one ``groupBy``.

    A zero compound counts as positive; 0/0 gives 0 (the meant guard).
    """
    c, r = F.col(compound), F.col(rt)
    pos, neg = c >= 0, c < 0
    agg = df.groupBy(*group).agg(
        _sum_if(pos, F.lit(1)).alias("_np"), _sum_if(pos, r).alias("_rp"),
        _sum_if(pos, c * (r + 1)).alias("_sp"),
        _sum_if(neg, F.lit(1)).alias("_nn"), _sum_if(neg, r).alias("_rn"),
        _sum_if(neg, c * (r + 1)).alias("_sn"),
        F.count(F.lit(1)).alias("_n"))
    cols = _scores_from_sums(F.col("_np"), F.col("_rp"), F.col("_sp"), F.col("_nn"), F.col("_rn"),
                             F.col("_sn"), F.col("_n"))
    return agg.select(*group, *cols)


def binned_scores(posts: DataFrame, spec: BinSpec, topic: Sequence[str] = ("topic",), user: str = "user_id",
                  spam_ids: DataFrame | None = None, white_ids: DataFrame | None = None,
                  update: bool = True, carry: bool = True, ts: str = "tweet_created_at",
                  checkpoint: bool = True) -> DataFrame:
    """WIN-02 + FLT-02 (+ WIN-05) + AGG-01 per (topic, bin), non-empty bins only.

    One scan and one shuffle pre-aggregate the rows per (topic, bin, user)
    into the sentiment sums twice: over account-ok rows and over account-ok
    rows that are also rescued (popular).  A user's post count in the bin
    is then a column, the spam flag is a join on this small frame (a hot
    user is one row per bin), and the kept sums are one of the two sets.
    The frame is persisted (memory, spilling to disk) so its three readers
    (bin span, flags, final sums) share one scan of the posts; its lineage
    is one aggregate, so a lost partition is recomputed cheaply.
    """
    topic = list(topic)
    b = assign_bins(posts, spec, ts)
    c, r = F.col("compound"), F.col("retweet_count")
    ok, res = static_ok(), rescued()
    sums = []
    for tag, cond in (("o", ok), ("r", ok & res)):
        sums += [_sum_if(cond & (c >= 0), F.lit(1)).alias(f"_np{tag}"), _sum_if(cond & (c >= 0), r).alias(f"_rp{tag}"),
                 _sum_if(cond & (c >= 0), c * (r + 1)).alias(f"_sp{tag}"),
                 _sum_if(cond & (c < 0), F.lit(1)).alias(f"_nn{tag}"), _sum_if(cond & (c < 0), r).alias(f"_rn{tag}"),
                 _sum_if(cond & (c < 0), c * (r + 1)).alias(f"_sn{tag}")]
    pre = b.groupBy(*topic, "bin_idx", user).agg(
        F.count(F.lit(1)).alias("_n"), *sums, F.min("_ts_us").alias("_tmin"), F.max("_ts_us").alias("_tmax"))
    if checkpoint:
        from pyspark import StorageLevel
        pre = pre.persist(StorageLevel.MEMORY_AND_DISK)
    if update:
        pre = _flag_users(pre, spec, topic, user, F.col("_n"), "_tmin", "_tmax", carry, spam_ids, white_ids)
        fail = F.col("_failing")
    else:
        fail = F.lit(False)

    def kept(name):
        return F.when(fail, F.col(f"{name}r")).otherwise(F.col(f"{name}o"))
    kn = kept("_np") + kept("_nn")
    g = pre.groupBy(*topic, "bin_idx").agg(
        F.sum("_n").alias("_all"), F.sum(kn).alias("_kn"),
        *[F.sum(kept(x)).alias(x) for x in ("_np", "_rp", "_sp", "_nn", "_rn", "_sn")])
    cols = _scores_from_sums(F.col("_np"), F.col("_rp"), F.col("_sp"), F.col("_nn"), F.col("_rn"),
                             F.col("_sn"), F.col("_kn"))
    return g.filter(F.col("_kn") > 0).select(
        *topic, "bin_idx", *cols, (F.col("_all") - F.col("_kn")).cast("bigint").alias("number_tweets_rejected"))


def fill_bins(scores: DataFrame, topics: DataFrame, spec: BinSpec, topic: Sequence[str] = ("topic",)) -> DataFrame:
    """WIN-03: every bin of every topic; an empty bin takes the scores of the
    next later non-empty bin with volumes 0, count -1, rejected 0; leading
    empties take the empty score.  The window is per topic over its bins
    (bounded by the bin count, not by the data)."""
    topic = list(topic)
    spine = topics.select(*topic).distinct().select(
        *topic, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(max(spec.n_bins - 1, 0)).cast("bigint"))).alias("bin_idx"))
    if spec.n_bins == 0:
        spine = spine.filter(F.lit(False))
    j = spine.join(scores, [*topic, "bin_idx"], "left")
    w = Window.partitionBy(*topic).orderBy("bin_idx").rowsBetween(Window.unboundedPreceding, 0)
    have = F.col("number_tweets").isNotNull()
    out = []
    for c in ["compound_score", "twitter_trend_positive", "twitter_trend_negative"]:
        out.append(F.coalesce(F.last(F.col(c), ignorenulls=True).over(w), F.lit(EMPTY_SCORE[c])).alias(c))
    seen = F.max(have.cast("int")).over(w) == 1
    def vol(c):
        return F.when(have, F.col(c)).when(seen, F.lit(0)).otherwise(F.lit(EMPTY_SCORE[c])).cast("bigint").alias(c)
    return j.select(
        *topic, "bin_idx", bin_date(spec).alias("bin_start_date"),
        out[0], out[1], vol("volume_tweets_positive"), out[2], vol("volume_tweets_negative"),
        F.coalesce(F.col("number_tweets"), F.lit(-1)).cast("bigint").alias("number_tweets"),
        F.coalesce(F.col("number_tweets_rejected"), F.lit(0)).cast("bigint").alias("number_tweets_rejected"))


def trend_score(series: DataFrame, group: Sequence[str], since, date: str = "bin_start_date",
                value: str = "compound_score") -> DataFrame:
    """AGG-10: (latest - mean) / population std of the values after ``since``."""
    s = series.filter(F.col(date) > F.lit(since))
    return s.groupBy(*group).agg(
        F.try_divide(F.max_by(value, date) - F.avg(value), F.stddev_pop(value)).alias("trend_score"),
        F.count(F.lit(1)).alias("n_points"))
