"""Registered queries of lifecycle A (posts -> bins -> spam -> sentiment)."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlake.operators import bins as B
from textlake.operators import posts as P
from textlake.plans.registry import register, round_doubles
from textlake.plans.trend import trend_matrix, trend_series
from textlake.sources import tables as S
from textlake.sources.tables import with_fixtures

W6H = 21_600_000_000  # 6-hour bins (n_pieces = 4)

# bin constants from the data, as the Spark side derives them
SPEC_SQL = f"""
b0 AS (SELECT min(tweet_created_at) AS lo, max(tweet_created_at) AS hi FROM posts),
spec AS (SELECT epoch_us(lo) AS lo_us, epoch_us(hi) AS up_us,
    epoch_us(CASE WHEN hour(hi) < 23 THEN date_trunc('hour', hi) + INTERVAL 1 HOUR
                  ELSE date_trunc('hour', hi) END) AS e_us,
    CAST({W6H} AS BIGINT) AS w FROM b0),
spec2 AS (SELECT *, CASE WHEN e_us > lo_us THEN (e_us - lo_us + w - 1) // w ELSE 0 END AS k,
    up_us - lo_us AS gap_us,
    CASE WHEN (up_us - lo_us) // 86400000000 <> 0 THEN 3 * ((up_us - lo_us) // 86400000000) ELSE 3 END AS total_bar
  FROM spec),
binned AS (SELECT p.*, (s.e_us - epoch_us(p.tweet_created_at)) // s.w AS bin_idx,
    epoch_us(p.tweet_created_at) AS t
  FROM posts p, spec2 s
  WHERE epoch_us(p.tweet_created_at) <= s.e_us AND epoch_us(p.tweet_created_at) > s.e_us - s.k * s.w),
span AS (SELECT topic, bin_idx,
    greatest(1.0, CAST(max(t) - min(t) AS DOUBLE) / (SELECT CAST(gap_us AS DOUBLE) FROM spec2)
                  * (SELECT total_bar FROM spec2)) AS bar
  FROM binned GROUP BY topic, bin_idx),
cnt AS (SELECT topic, bin_idx, user_id, count(*) AS c FROM binned GROUP BY topic, bin_idx, user_id),
over_bar AS (SELECT c.topic, c.bin_idx, c.user_id FROM cnt c JOIN span s USING (topic, bin_idx) WHERE c.c > s.bar)
"""

JUDGE_SQL = """(b.user_age_days > 180 AND CAST(b.user_posts_count AS DOUBLE) / (b.user_age_days + 1) < 3
      AND b.user_posts_count > 10 AND b.user_follower_count > 5 AND b.user_favorite_count > 1)"""
RESCUE_SQL = "(b.tweet_favorite_count > 5 OR b.retweet_count > 5)"


def _sent_aggs(cond: str) -> str:
    return f"""count(*) FILTER (WHERE {cond} AND compound >= 0) AS np,
    coalesce(sum(retweet_count) FILTER (WHERE {cond} AND compound >= 0), 0) AS rp,
    coalesce(sum(compound * (retweet_count + 1)) FILTER (WHERE {cond} AND compound >= 0), 0) AS sp,
    count(*) FILTER (WHERE {cond} AND compound < 0) AS nn,
    coalesce(sum(retweet_count) FILTER (WHERE {cond} AND compound < 0), 0) AS rn,
    coalesce(sum(compound * (retweet_count + 1)) FILTER (WHERE {cond} AND compound < 0), 0) AS sn"""


def _r(x: str, rounded: bool) -> str:
    return f"round({x}, 6)" if rounded else x


def _scores_sql(rounded: bool = True) -> str:
    return f"""{_r('CASE WHEN sp - sn = 0 THEN 0.0 ELSE sp / (sp - sn) END', rounded)} AS compound_score,
    {_r('sp / (np + rp + 1)', rounded)} AS twitter_trend_positive, CAST(np + rp + 1 AS BIGINT) AS volume_tweets_positive,
    {_r('sn / (nn + rn + 1)', rounded)} AS twitter_trend_negative, CAST(nn + rn + 1 AS BIGINT) AS volume_tweets_negative"""


SCORES_SQL = _scores_sql(True)


# ---------------------------------------------------------------------------
# Flagship: the filled per-topic 6-hour sentiment series with spam filter
# ---------------------------------------------------------------------------
def _trend_bins_sql(rounded: bool = True) -> str:
    return with_fixtures(f"""WITH {SPEC_SQL},
first_flag AS (SELECT topic, user_id, min(bin_idx) AS first_bin FROM over_bar GROUP BY topic, user_id),
kept AS (SELECT b.*, {JUDGE_SQL} AND (NOT coalesce(b.bin_idx >= f.first_bin, false) OR {RESCUE_SQL}) AS keep
  FROM binned b LEFT JOIN first_flag f USING (topic, user_id)),
g AS (SELECT topic, bin_idx, count(*) AS n_all, count(*) FILTER (WHERE keep) AS kn, {_sent_aggs('keep')}
  FROM kept GROUP BY topic, bin_idx),
sc AS (SELECT topic, bin_idx, {_scores_sql(rounded)}, CAST(kn AS BIGINT) AS number_tweets,
    CAST(n_all - kn AS BIGINT) AS number_tweets_rejected FROM g WHERE kn > 0),
spine AS (SELECT t.topic, CAST(unnest(range(0, (SELECT k FROM spec2))) AS BIGINT) AS bin_idx
  FROM (SELECT DISTINCT topic FROM posts) t),
j AS (SELECT s.topic, s.bin_idx, sc.compound_score, sc.twitter_trend_positive, sc.volume_tweets_positive,
    sc.twitter_trend_negative, sc.volume_tweets_negative, sc.number_tweets, sc.number_tweets_rejected
  FROM spine s LEFT JOIN sc USING (topic, bin_idx))
SELECT topic, bin_idx,
  make_timestamp((SELECT e_us FROM spec2) - bin_idx * {W6H}) AS bin_start_date,
  {_r('coalesce(last_value(compound_score IGNORE NULLS) OVER w, 0.0)', rounded)} AS compound_score,
  {_r('coalesce(last_value(twitter_trend_positive IGNORE NULLS) OVER w, 0.0)', rounded)} AS twitter_trend_positive,
  CAST(CASE WHEN number_tweets IS NOT NULL THEN volume_tweets_positive
       WHEN max(CASE WHEN number_tweets IS NOT NULL THEN 1 ELSE 0 END) OVER w = 1 THEN 0 ELSE 1 END AS BIGINT)
    AS volume_tweets_positive,
  {_r('coalesce(last_value(twitter_trend_negative IGNORE NULLS) OVER w, 0.0)', rounded)} AS twitter_trend_negative,
  CAST(CASE WHEN number_tweets IS NOT NULL THEN volume_tweets_negative
       WHEN max(CASE WHEN number_tweets IS NOT NULL THEN 1 ELSE 0 END) OVER w = 1 THEN 0 ELSE 1 END AS BIGINT)
    AS volume_tweets_negative,
  CAST(coalesce(number_tweets, -1) AS BIGINT) AS number_tweets,
  CAST(coalesce(number_tweets_rejected, 0) AS BIGINT) AS number_tweets_rejected
FROM j
WINDOW w AS (PARTITION BY topic ORDER BY bin_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""", "posts")


TREND_BINS_SQL = _trend_bins_sql(True)


@register("trend_bins", TREND_BINS_SQL)
def trend_bins(spark, sf_dir):
    """Flagship: WIN-02 + FLT-02 + WIN-05 + AGG-01 + WIN-03 on the posts fixture."""
    series, _ = trend_series(S.posts(spark, sf_dir), n_pieces=4)
    return round_doubles(series)


# ---------------------------------------------------------------------------
# WIN-01 repeat removal on posts_dup (ids seen once, twice and three times)
# ---------------------------------------------------------------------------
POST_COLS = ["tweet_id", "tweet_created_at", "topic", "user_id", "retweet_count", "tweet_favorite_count",
             "compound", "user_age_days", "user_posts_count", "user_follower_count", "user_favorite_count", "seq"]

register_sql = with_fixtures(f"""SELECT {', '.join(POST_COLS)} FROM (
  SELECT *, row_number() OVER (PARTITION BY tweet_id ORDER BY seq DESC) AS rn FROM posts_dup) WHERE rn = 1""",
                             "posts_dup")


@register("drop_repeats_keep_last", register_sql)
def drop_repeats_keep_last(spark, sf_dir):
    return P.drop_repeats(S.posts_dup(spark, sf_dir), "tweet_id", ["seq"], "keep_last")


@register("drop_repeats_drop_first", with_fixtures(f"""SELECT {', '.join(POST_COLS)} FROM (
  SELECT *, row_number() OVER (PARTITION BY tweet_id ORDER BY seq) AS rn,
         count(*) OVER (PARTITION BY tweet_id) AS n FROM posts_dup) WHERE n = 1 OR rn > 1""", "posts_dup"))
def drop_repeats_drop_first(spark, sf_dir):
    return P.drop_repeats(S.posts_dup(spark, sf_dir), "tweet_id", ["seq"], "drop_first")


# ---------------------------------------------------------------------------
# FLT-02 / SET-04 spam filter per 6-hour bin without carry-over
# ---------------------------------------------------------------------------
@register("spam_filter_bins", with_fixtures(f"""WITH {SPEC_SQL}
SELECT b.tweet_id, b.topic, b.bin_idx,
  CASE WHEN {JUDGE_SQL} AND (o.user_id IS NULL OR {RESCUE_SQL}) THEN 0 ELSE 1 END AS is_spam
FROM binned b LEFT JOIN over_bar o USING (topic, bin_idx, user_id)""", "posts"))
def spam_filter_bins(spark, sf_dir):
    p = S.posts(spark, sf_dir)
    spec = B.bin_spec(p, "tweet_created_at", 4)
    f = B.spam_filter(B.assign_bins(p, spec), spec, carry=False)
    return f.select("tweet_id", "topic", "bin_idx", "is_spam")


@register("spam_filter_lists", with_fixtures(f"""WITH {SPEC_SQL}
SELECT b.tweet_id, b.topic, b.bin_idx,
  CASE WHEN {JUDGE_SQL} AND (NOT ((o.user_id IS NOT NULL OR b.user_id % 17 = 0) AND b.user_id % 5 <> 0) OR {RESCUE_SQL})
    THEN 0 ELSE 1 END AS is_spam
FROM binned b LEFT JOIN over_bar o USING (topic, bin_idx, user_id)""", "posts"))
def spam_filter_lists(spark, sf_dir):
    """FLT-02 with a spam list (every 17th user) and a white list (every 5th), which wins."""
    p = S.posts(spark, sf_dir)
    spec = B.bin_spec(p, "tweet_created_at", 4)
    users = p.select("user_id").distinct()
    f = B.spam_filter(B.assign_bins(p, spec), spec, carry=False, spam_ids=users.filter(F.col("user_id") % 17 == 0),
                      white_ids=users.filter(F.col("user_id") % 5 == 0))
    return f.select("tweet_id", "topic", "bin_idx", "is_spam")


@register("spam_kept_counts", with_fixtures(f"""WITH {SPEC_SQL}
SELECT b.topic, count(*) AS n_posts,
  CAST(sum(CASE WHEN {JUDGE_SQL} AND (o.user_id IS NULL OR {RESCUE_SQL}) THEN 1 ELSE 0 END) AS BIGINT) AS n_kept
FROM binned b LEFT JOIN over_bar o USING (topic, bin_idx, user_id) GROUP BY b.topic""", "posts"))
def spam_kept_counts(spark, sf_dir):
    """SET-04: kept and full tables from one flagged frame, counted per topic."""
    p = S.posts(spark, sf_dir)
    spec = B.bin_spec(p, "tweet_created_at", 4)
    kept, full = P.spam_split(B.spam_filter(B.assign_bins(p, spec), spec, carry=False))
    a = full.groupBy("topic").agg(F.count(F.lit(1)).alias("n_posts"))
    k = kept.groupBy("topic").agg(F.count(F.lit(1)).alias("n_kept"))
    return a.join(k, "topic", "left").select("topic", "n_posts", F.coalesce("n_kept", F.lit(0)).alias("n_kept"))


# ---------------------------------------------------------------------------
# WIN-05 carried spam list: first bin a user is over the bar, per topic
# ---------------------------------------------------------------------------
@register("carry_spam", with_fixtures(f"""WITH {SPEC_SQL}
SELECT topic, user_id, min(bin_idx) AS first_bin FROM over_bar GROUP BY topic, user_id""", "posts"))
def carry_spam(spark, sf_dir):
    p = S.posts(spark, sf_dir)
    spec = B.bin_spec(p, "tweet_created_at", 4)
    b = B.assign_bins(p, spec)
    f = B._flag_users(b, spec, ["topic"], "user_id", F.lit(1), "_ts_us", "_ts_us", True, None, None)
    return (f.filter(F.col("_failing")).groupBy("topic", "user_id")
            .agg(F.min("bin_idx").alias("first_bin")))


# ---------------------------------------------------------------------------
# AGG-01 sentiment per topic; AGG-02 repeat users
# ---------------------------------------------------------------------------
@register("sentiment_by_topic", with_fixtures(f"""SELECT topic, {SCORES_SQL}, CAST(n AS BIGINT) AS number_tweets
FROM (SELECT topic, count(*) AS n, {_sent_aggs('true')} FROM posts GROUP BY topic)""", "posts"))
def sentiment_by_topic(spark, sf_dir):
    return round_doubles(B.sentiment_scores(S.posts(spark, sf_dir), ["topic"]))


@register("repeat_users", with_fixtures("""SELECT topic, user_id, count(*) AS n_posts FROM posts
GROUP BY topic, user_id HAVING count(*) > 15""", "posts"))
def repeat_users(spark, sf_dir):
    return P.repeat_users(S.posts(spark, sf_dir), "user_id", 15, ["topic"])


# ---------------------------------------------------------------------------
# FLT-04 time cut (data min/max as default ends); TOP-01 ordering
# ---------------------------------------------------------------------------
@register("time_cut_default", with_fixtures("""SELECT tweet_id, tweet_created_at FROM posts
WHERE tweet_created_at BETWEEN (SELECT min(tweet_created_at) FROM posts) AND (SELECT max(tweet_created_at) FROM posts)""",
                                            "posts"))
def time_cut_default(spark, sf_dir):
    return P.time_cut(S.posts(spark, sf_dir), "tweet_created_at").select("tweet_id", "tweet_created_at")


@register("time_cut_window", with_fixtures("""SELECT tweet_id, tweet_created_at, topic FROM posts
WHERE tweet_created_at BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-20 12:00:00'""", "posts"))
def time_cut_window(spark, sf_dir):
    import datetime as dt
    p = S.posts(spark, sf_dir)
    return P.time_cut(p, "tweet_created_at", dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 20, 12)).select(
        "tweet_id", "tweet_created_at", "topic")


@register("posts_by_time", with_fixtures("""SELECT tweet_id, tweet_created_at FROM posts
ORDER BY tweet_created_at, tweet_id""", "posts"))
def posts_by_time(spark, sf_dir):
    """TOP-01 / TOP-05: total order by time (range-partitioned sort, no single task)."""
    return P.by_time(S.posts(spark, sf_dir).select("tweet_id", "tweet_created_at"), "tweet_created_at")


# ---------------------------------------------------------------------------
# JOIN-01 topic ids, JOIN-02 ambiguous names, JOIN-03 membership
# ---------------------------------------------------------------------------
@register("attach_topic_id", with_fixtures("""SELECT s.topic, coalesce(d.id, -1) AS id, s.n_posts
FROM (SELECT topic, count(*) AS n_posts FROM posts GROUP BY topic) s
LEFT JOIN (SELECT name, max_by(id, pos) AS id FROM topic_ids GROUP BY name) d ON s.topic = d.name""",
                                           "posts", "topic_ids"))
def attach_topic_id_q(spark, sf_dir):
    s = S.posts(spark, sf_dir).groupBy("topic").agg(F.count(F.lit(1)).alias("n_posts"))
    return P.attach_topic_id(s, S.topic_ids(spark, sf_dir))


@register("split_ambiguous", with_fixtures(r"""WITH hits AS (
  SELECT DISTINCT n.name FROM (SELECT name, unnest(regexp_split_to_array(lower(name), '[^\p{L}\p{N}_]')) AS w FROM names) n
  JOIN name_lexicon l ON n.w = l.word)
SELECT name, CASE WHEN name IN (SELECT name FROM hits) THEN 1 ELSE 0 END AS ambiguous FROM names""",
                                           "names", "name_lexicon"))
def split_ambiguous_q(spark, sf_dir):
    good, bad = P.split_ambiguous(S.names(spark, sf_dir), S.name_lexicon(spark, sf_dir))
    return good.withColumn("ambiguous", F.lit(0)).unionByName(bad.withColumn("ambiguous", F.lit(1)))


@register("posts_without_repeat_users", with_fixtures("""SELECT tweet_id, topic, user_id FROM posts p
WHERE NOT EXISTS (SELECT 1 FROM (SELECT user_id FROM posts GROUP BY user_id HAVING count(*) > 80) r
                  WHERE r.user_id = p.user_id)""", "posts"))
def posts_without_repeat_users(spark, sf_dir):
    p = S.posts(spark, sf_dir)
    heavy = P.repeat_users(p, "user_id", 80)
    return P.membership(p, heavy, "user_id", keep=False).select("tweet_id", "topic", "user_id")


# ---------------------------------------------------------------------------
# WIN-04 back-fill of missing times (every fifth time blanked)
# ---------------------------------------------------------------------------
@register("backfill_times", with_fixtures("""WITH g AS (SELECT tweet_id, topic,
    CASE WHEN tweet_id % 5 = 0 THEN NULL ELSE tweet_created_at END AS t FROM posts)
SELECT tweet_id, topic, first_value(t IGNORE NULLS) OVER (PARTITION BY topic ORDER BY tweet_id
    ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS t FROM g""", "posts"))
def backfill_times(spark, sf_dir):
    p = S.posts(spark, sf_dir).select(
        "tweet_id", "topic", F.when(F.col("tweet_id") % 5 == 0, F.lit(None)).otherwise(F.col("tweet_created_at")).alias("t"))
    return P.backfill(p, "t", ["tweet_id"], ["topic"])


# ---------------------------------------------------------------------------
# AGG-10 trend score of the filled series over its last 7 days
# ---------------------------------------------------------------------------
_SERIES = _trend_bins_sql(False)


@register("trend_score_7d", f"""WITH s AS ({_SERIES}),
bounds AS (SELECT max(ts) AS hi FROM events)
SELECT topic, round(CASE WHEN stddev_pop(compound_score) = 0 THEN NULL
    ELSE (max_by(compound_score, bin_start_date) - avg(compound_score)) / stddev_pop(compound_score) END, 6) AS trend_score,
  count(*) AS n_points
FROM s WHERE bin_start_date > (SELECT hi FROM bounds) - INTERVAL 7 DAY GROUP BY topic""")
def trend_score_7d(spark, sf_dir):
    import datetime as dt
    p = S.posts(spark, sf_dir)
    series, spec = trend_series(p, n_pieces=4)
    hi = p.agg(F.max("tweet_created_at")).first()[0]
    return round_doubles(B.trend_score(series, ["topic"], hi - dt.timedelta(days=7)))


# ---------------------------------------------------------------------------
# FLT-01 keyword flags on processed post text
# ---------------------------------------------------------------------------
KEYWORDS = ["the", "und", "les", "que", "ing"]

from textlake.functions import text as TX  # noqa: E402

PROCESS_SQL = (f"array_to_string(list_filter(regexp_extract_all(tweet_text, {TX.sql_lit(TX.TOKEN_RE)}), "
               f"lambda t: regexp_full_match(t, '.[\\p{{L}}\\p{{N}}_]+') AND NOT starts_with(t, 'http')), ' ')")


@register("keyword_flags", with_fixtures(f"""SELECT tweet_id, {', '.join(
    f"regexp_matches(lower(txt), {TX.sql_lit(w)}) AS kw_{w}" for w in KEYWORDS)}
FROM (SELECT tweet_id, {PROCESS_SQL} AS txt FROM posts_raw)""", "posts_raw"))
def keyword_flags_q(spark, sf_dir):
    p = S.posts_raw(spark, sf_dir).select("tweet_id", "tweet_text")
    f = P.keyword_flags(p, "tweet_text", KEYWORDS)
    return f.select("tweet_id", *[F.col(w).alias(f"kw_{w}") for w in KEYWORDS])


# ---------------------------------------------------------------------------
# AGG-14 per-topic trend matrix, mode GT (window sentiment + trend score)
# ---------------------------------------------------------------------------
TREND_MATRIX_SQL = f"""WITH s AS ({_SERIES}),
{with_fixtures("SELECT 1", "posts", "topic_ids")[5:].rsplit("SELECT 1", 1)[0].rstrip().rstrip(",")},
{SPEC_SQL},
win AS (SELECT p.*, epoch_us(tweet_created_at) AS t FROM posts p
  WHERE tweet_created_at BETWEEN (SELECT lo FROM b0) AND (SELECT hi FROM b0)),
wspan AS (SELECT topic, greatest(1.0, CAST(max(t) - min(t) AS DOUBLE) / (SELECT CAST(gap_us AS DOUBLE) FROM spec2)
    * (SELECT total_bar FROM spec2)) AS bar FROM win GROUP BY topic),
wcnt AS (SELECT topic, user_id, count(*) AS c FROM win GROUP BY topic, user_id),
wover AS (SELECT c.topic, c.user_id FROM wcnt c JOIN wspan s USING (topic) WHERE c.c > s.bar),
wk AS (SELECT b.*, {JUDGE_SQL} AND (o.user_id IS NULL OR {RESCUE_SQL}) AS keep
  FROM win b LEFT JOIN wover o USING (topic, user_id)),
tg AS (SELECT topic, count(*) FILTER (WHERE keep) AS kn, count(*) FILTER (WHERE NOT keep) AS rej, {_sent_aggs('keep')}
  FROM wk GROUP BY topic),
tt AS (SELECT topic, {SCORES_SQL.replace('AS compound_score', 'AS twitter_trend_compound')},
    CAST(kn AS BIGINT) AS number_tweets, CAST(rej AS BIGINT) AS number_tweets_rejected FROM tg WHERE kn > 0),
gg AS (SELECT topic, CASE WHEN stddev_pop(compound_score) = 0 THEN NULL
    ELSE (max_by(compound_score, bin_start_date) - avg(compound_score)) / stddev_pop(compound_score) END AS google_trend
  FROM s WHERE bin_start_date > (SELECT hi FROM b0) - INTERVAL 1 DAY GROUP BY topic),
ids AS (SELECT name, max_by(id, pos) AS id FROM topic_ids GROUP BY name),
tops AS (SELECT DISTINCT topic FROM posts)
SELECT coalesce(ids.id, -1) AS id, tops.topic AS name, (SELECT lo FROM b0) AS start_date,
  CAST((SELECT gap_us FROM spec2) AS DOUBLE) / 1e6 AS time_gap_s,
  coalesce(tt.twitter_trend_compound, 0.0) AS twitter_trend_compound,
  coalesce(tt.twitter_trend_positive, 0.0) AS twitter_trend_positive,
  coalesce(tt.volume_tweets_positive, 1) AS volume_tweets_positive,
  coalesce(tt.twitter_trend_negative, 0.0) AS twitter_trend_negative,
  coalesce(tt.volume_tweets_negative, 1) AS volume_tweets_negative,
  coalesce(tt.number_tweets, -1) AS number_tweets,
  coalesce(tt.number_tweets_rejected, 0) AS number_tweets_rejected,
  round(gg.google_trend, 6) AS google_trend
FROM tops LEFT JOIN tt USING (topic) LEFT JOIN gg USING (topic) LEFT JOIN ids ON ids.name = tops.topic"""


@register("trend_matrix", TREND_MATRIX_SQL)
def trend_matrix_q(spark, sf_dir):
    p = S.posts(spark, sf_dir)
    return round_doubles(trend_matrix(p, S.topic_ids(spark, sf_dir), mode="GT", n_pieces=4))
