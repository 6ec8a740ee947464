"""The stream's spam list against the rule read forward, over restarts and slices of time."""

import datetime as dt

import numpy as np
import pandas as pd

from textlake.streaming import stream as ST

DAY0 = dt.datetime(2024, 3, 1)


def _posts(n=1500, days=16):
    """User 0 writes a third of all posts in the first days, and comes back later."""
    rng = np.random.default_rng(8)
    t = np.sort(rng.integers(0, days * 86_400, n))
    user = np.where((rng.random(n) < .33) & ((t < 3 * 86_400) | (t > 12 * 86_400)), 0, rng.integers(1, 25, n))
    return pd.DataFrame({
        "t": [DAY0 + dt.timedelta(seconds=int(x)) for x in t], "topic": rng.choice(["a", "b"], n), "user_id": user,
        "retweet_count": rng.integers(0, 8, n), "tweet_favorite_count": rng.integers(0, 9, n), "compound": rng.integers(-9, 10, n) / 10,
        "user_age_days": 400, "user_posts_count": rng.choice([5, 300], n, p=[.1, .9]), "user_follower_count": 50, "user_favorite_count": 9})


def _forward(p, bar, memory):
    """Failing (day, topic, user), day by day."""
    n = p.assign(day=(p["t"] - DAY0).dt.days).groupby(["topic", "user_id", "day"]).size()
    out = {}
    for (topic, user), days in n.groupby(level=[0, 1]):
        last = None
        for day, c in sorted(days.droplevel([0, 1]).items()):
            last = day if c > bar else last
            out[day, topic, user] = last is not None and day - last < memory
    return out


def test_bins_equal_the_rule_read_forward_over_restarts(spark, tmp_path):
    p = _posts()
    want = _forward(p, 3, 4)
    slices = np.array_split(p, 5)
    src, out = tmp_path / "in", str(tmp_path / "out")
    schema = spark.createDataFrame(p.head(1)).schema
    for some in (slices[:2], slices[2:4], slices[4:]):               # three runs of one query
        for s in some:
            spark.createDataFrame(s).coalesce(1).write.mode("append").parquet(str(src))
        got = ST.stream_spam_bins(ST.stream_posts(spark, str(src), schema, "parquet", 1), "t", out, "1 day", 3, "4 days", "0 seconds")
    rows = got.toPandas()
    day = (pd.to_datetime(rows["start_us"], unit="us") - DAY0).dt.days
    assert not pd.DataFrame({"d": day, "t": rows["topic"], "u": rows["user_id"]}).duplicated().any()
    closed = (p["t"].max() - DAY0).days
    assert {(d, t, u): f for d, t, u, f in zip(day, rows["topic"], rows["user_id"], rows["failing"])} == {
        k: f for k, f in want.items() if k[0] < closed}
    assert rows["failing"].any() and not rows["failing"].all()
    bins = ST.kept_bins(got).toPandas()
    assert bins["number_tweets"].sum() + bins["n_rejected"].sum() == (p["t"] < DAY0 + dt.timedelta(days=closed)).sum()
    one = p[(p["t"] < DAY0 + dt.timedelta(days=1)) & (p["topic"] == "a")]
    fails = np.array([want[0, "a", u] for u in one["user_id"]])
    stays = (one["user_posts_count"] > 10) & (~fails | (one["tweet_favorite_count"] > 5) | (one["retweet_count"] > 5))
    row = bins[(bins["topic"] == "a") & (bins["window_start"] == DAY0)].iloc[0]
    assert row["number_tweets"] == stays.sum() and row["n_rejected"] == (~stays).sum()


def test_empty_stream(spark, tmp_path):
    p = _posts(5)
    spark.createDataFrame(p).limit(0).write.parquet(str(tmp_path / "in"))
    s = ST.stream_posts(spark, str(tmp_path / "in"), spark.createDataFrame(p).schema, "parquet")
    got = ST.stream_spam_bins(s, "t", str(tmp_path / "out"))
    assert ST.kept_bins(got).count() == 0
