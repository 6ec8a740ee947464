"""Registered file source / sink queries (SRC-01, SRC-02, SRC-03, SRC-09,
SRC-10): each writes data Spark derives from the tables to a folder under
the shared checkpoint folder and reads it back with the reader under test."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from textlake.plans.queries_trend import TREND_BINS_SQL
from textlake.plans.registry import register, round_doubles
from textlake.plans.trend import trend_series
from textlake.sources import files as FI
from textlake.sources import tables as S
from textlake.sources.tables import with_fixtures
from textlake.streaming.stream import scratch

CSV_SCHEMA = Ty.StructType([Ty.StructField("tweet_id", Ty.LongType()), Ty.StructField("topic", Ty.StringType()),
                            Ty.StructField("retweet_count", Ty.LongType()), Ty.StructField("note", Ty.StringType())])


@register("csv_dir_round_trip", with_fixtures("""SELECT tweet_id, topic, retweet_count,
  CASE WHEN tweet_id % 5 = 0 THEN '' ELSE 'n' || CAST(tweet_id % 3 AS VARCHAR) END AS note FROM posts""", "posts"))
def csv_dir_round_trip(spark, sf_dir):
    """SRC-09 writes the posts as CSV files (plus one file with a malformed
    line and one hidden file); SRC-01 reads the folder back: malformed and
    hidden lines dropped, empty fields stay empty strings."""
    out = scratch(spark, "csv")
    p = S.posts(spark, sf_dir).select("tweet_id", "topic", "retweet_count", F.when(
        F.col("tweet_id") % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("n"), (F.col("tweet_id") % 3).cast("string")))
        .alias("note"))
    FI.write_report(p, out, mode="overwrite")
    bad = spark.createDataFrame([("tweet_id,topic,retweet_count,note",), ("x,y,not-a-number,z",)], "value string")
    bad.coalesce(1).write.mode("overwrite").text(out + "/more")
    spark.createDataFrame([("1,hidden,1,h",)], "value string").coalesce(1).write.mode("overwrite").text(out + "/.hidden")
    df = FI.read_csv_dir(spark, out + "/*", CSV_SCHEMA, label_col="file")
    return df.select("tweet_id", "topic", "retweet_count", "note")


@register("read_posts_fallback", with_fixtures("""WITH p AS (SELECT tweet_id, date_trunc('second', tweet_created_at) AS t FROM posts)
SELECT tweet_id, CASE WHEN tweet_id % 50 = 7 THEN (SELECT t FROM p ORDER BY tweet_id LIMIT 1) ELSE t END AS tweet_created_at
FROM p""", "posts"))
def read_posts_fallback(spark, sf_dir):
    """SRC-02: posts CSV in the reference's 25 columns, every 50th time
    unparsable; such times take the first row's value; sorted by time."""
    out = scratch(spark, "posts-csv")
    p = S.posts(spark, sf_dir)
    t = F.date_format("tweet_created_at", "yyyy-MM-dd HH:mm:ss")
    cols = {n: F.lit(None).cast(ty) for n, ty in FI.POST_COLUMNS}
    cols.update(tweet_id=F.col("tweet_id").cast("string"), retweet_count=F.col("retweet_count"),
                tweet_created_at=F.when(F.col("tweet_id") % 50 == 7, F.lit("n/a")).otherwise(t),
                user_created_at=t, author_created_at=t, user_id=F.col("user_id").cast("string"),
                tweet_text=F.lit("x"))
    rows = p.select(*[cols[n].alias(n) for n, _ in FI.POST_COLUMNS]).orderBy(F.col("tweet_id").cast("bigint"))
    rows.write.mode("overwrite").option("header", True).csv(out)
    back = FI.read_posts(spark, out)
    return back.select(F.col("tweet_id").cast("bigint").alias("tweet_id"), "tweet_created_at")


NESTED = "retweet_count long, favorite_count long, created_at timestamp_ntz, text string, id_str string, " \
         "author struct<screen_name:string, created_at:timestamp_ntz, friends_count:long, followers_count:long, " \
         "statuses_count:long, favourites_count:long, listed_count:long, id_str:string, location:string>, " \
         "user struct<screen_name:string, created_at:timestamp_ntz, friends_count:long, followers_count:long, " \
         "statuses_count:long, favourites_count:long, listed_count:long, id_str:string, location:string>"


@register("flatten_posts", with_fixtures("""SELECT CAST(tweet_id AS VARCHAR) AS tweet_id, user_age_days,
  CASE WHEN user_id % 4 = 0 THEN NULL ELSE 'aloc' || CAST(user_id AS VARCHAR) END AS author_location,
  CASE WHEN user_id % 4 = 0 THEN NULL ELSE 'loc' || CAST(user_id % 10 AS VARCHAR) END AS user_location,
  user_posts_count, 'u' || CAST(user_id AS VARCHAR) AS "user" FROM posts""", "posts"))
def flatten_posts_q(spark, sf_dir):
    """SRC-03: posts as nested JSON objects (author and user sub-objects)
    read back and flattened; account age in whole days."""
    out = scratch(spark, "nested")
    p = S.posts(spark, sf_dir)
    ucreated = (F.col("tweet_created_at") - F.make_dt_interval(F.col("user_age_days"), (F.col("user_id") % 24).cast("int")))
    person = lambda loc: F.struct(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("screen_name"), ucreated.alias("created_at"),
        F.lit(1).cast("bigint").alias("friends_count"), F.col("user_follower_count").alias("followers_count"),
        F.col("user_posts_count").alias("statuses_count"), F.col("user_favorite_count").alias("favourites_count"),
        F.lit(0).cast("bigint").alias("listed_count"), F.col("user_id").cast("string").alias("id_str"),
        loc.alias("location"))
    uloc = F.when(F.col("user_id") % 4 != 0, F.concat(F.lit("loc"), (F.col("user_id") % 10).cast("string")))
    aloc = F.concat(F.lit("aloc"), F.col("user_id").cast("string"))
    nested = p.select("retweet_count", F.col("tweet_favorite_count").alias("favorite_count"),
                      F.col("tweet_created_at").alias("created_at"), F.lit("t").alias("text"),
                      F.col("tweet_id").cast("string").alias("id_str"), person(aloc).alias("author"),
                      person(uloc).alias("user"))
    nested.write.mode("overwrite").json(out)
    flat = FI.flatten_posts(spark.read.schema(NESTED).json(out))
    return flat.select("tweet_id", "user_age_days", "author_location", "user_location", "user_posts_count", "user")


@register("explode_envelope", with_fixtures("""SELECT topic AS key, bin_start_date, compound_score, number_tweets
FROM (""" + TREND_BINS_SQL + ")"))
def explode_envelope_q(spark, sf_dir):
    """SRC-10: per topic a JSON envelope {topic: {contents: <series as JSON
    table>, failed_terms: <JSON list>}} (one bounded row per topic), read
    back into rows."""
    series, _ = trend_series(S.posts(spark, sf_dir), n_pieces=4)
    s = round_doubles(series)
    env = s.groupBy("topic").agg(F.to_json(F.collect_list(F.struct("bin_start_date", "compound_score",
                                                                   "number_tweets"))).alias("contents"))
    env = env.select(F.to_json(F.create_map(F.col("topic"), F.struct(
        "contents", F.lit("[]").alias("failed_terms")))).alias("envelope"))
    rows = FI.explode_envelope(env, "envelope", "bin_start_date timestamp_ntz, compound_score double, number_tweets bigint")
    return rows.select("key", "bin_start_date", "compound_score", "number_tweets")
