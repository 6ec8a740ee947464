"""Structured Streaming versions of ingest, repeat removal and bins
(STM-01..05).

The reference polls and re-reads a growing CSV; here files are a stream
source, repeats are dropped within a watermark, bins are event-time
windows with bounded lateness (state is dropped once the watermark passes
a window), and the spam list is appended per micro-batch with
``foreachBatch``, and fails a user's later bins.  Every
query checkpoints to the shared folder, so a lost executor or a restarted
driver resumes from the last committed batch.
"""

from __future__ import annotations

import os
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from textlake.operators.bins import rescued, static_ok
from textlake.session import checkpoint_dir


def stream_table(spark: SparkSession, sf_dir: str, name: str, max_files: int | None = None) -> DataFrame:
    """STM-01: one of the driver's tables as a file stream (schema from the
    batch reader, so the stream never infers)."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    r = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(sf_dir)


def stream_posts(spark: SparkSession, path: str, schema, fmt: str = "json", max_files: int | None = None) -> DataFrame:
    """STM-01: post files as they land in ``path``."""
    r = spark.readStream.schema(schema).format(fmt)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.load(path)


def event_time(df: DataFrame, ts: str, out: str = "t") -> DataFrame:
    """Watermarks need TIMESTAMP; the tables carry TIMESTAMP_NTZ."""
    return df.withColumn(out, F.col(ts).cast("timestamp"))


def stream_dedup(df: DataFrame, id_col: str, ts: str, delay: str = "1 hour") -> DataFrame:
    """STM-02: drop repeats of an id arriving within the lateness bound."""
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark([id_col])


def stream_bins(df: DataFrame, ts: str, width: str = "6 hours", lateness: str = "1 hour",
                topic: str = "topic", compound: str = "compound", rt: str = "retweet_count") -> DataFrame:
    """STM-03: tumbling sentiment bins per topic (AGG-01 sums), append mode:
    a bin is written once the watermark passes its end; later rows drop."""
    c, r = F.col(compound), F.col(rt)
    pos, neg = c >= 0, c < 0

    def s(cond, v):
        return F.coalesce(F.sum(F.when(cond, v)), F.lit(0))
    g = (df.withWatermark(ts, lateness).groupBy(F.window(ts, width).alias("w"), topic)
         .agg(s(pos, F.lit(1)).alias("np"), s(pos, r).alias("rp"), s(pos, c * (r + 1)).alias("sp"),
              s(neg, F.lit(1)).alias("nn"), s(neg, r).alias("rn"), s(neg, c * (r + 1)).alias("sn"),
              F.count(F.lit(1)).alias("n")))
    return g.select(
        F.col("w.start").cast("timestamp_ntz").alias("window_start"), topic,
        F.coalesce(F.try_divide(F.col("sp"), F.col("sp") - F.col("sn")), F.lit(0.0)).alias("compound_score"),
        (F.col("sp") / (F.col("np") + F.col("rp") + 1)).alias("twitter_trend_positive"),
        (F.col("np") + F.col("rp") + 1).cast("bigint").alias("volume_tweets_positive"),
        (F.col("sn") / (F.col("nn") + F.col("rn") + 1)).alias("twitter_trend_negative"),
        (F.col("nn") + F.col("rn") + 1).cast("bigint").alias("volume_tweets_negative"),
        F.col("n").alias("number_tweets"))


def stream_repeat_users(df: DataFrame, ts: str, user: str = "user_id", width: str = "1 day", bar: int = 3,
                        lateness: str = "1 hour") -> DataFrame:
    """STM-04: users over the bar per event-time window."""
    g = (df.withWatermark(ts, lateness).groupBy(F.window(ts, width).alias("w"), user)
         .agg(F.count(F.lit(1)).alias("n_posts")))
    return g.filter(F.col("n_posts") > bar).select(
        F.col("w.start").cast("timestamp_ntz").alias("window_start"), user, "n_posts")


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return os.path.join(checkpoint_dir(spark), f"{tag}-{uuid.uuid4().hex}")


def run_available(df: DataFrame, out: str, mode: str = "append", foreach_batch=None) -> DataFrame:
    """STM-05: process everything available now, then stop; the result is
    read back from the sink (parquet in the shared folder)."""
    spark = df.sparkSession
    w = df.writeStream.outputMode(mode).option("checkpointLocation", out + "/_checkpoint")
    if foreach_batch is not None:
        w = w.foreachBatch(foreach_batch)
    else:
        w = w.format("parquet").option("path", out + "/data")
    q = w.trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out + "/data")


def append_spam_table(path: str):
    """STM-04 sink: each micro-batch's flagged users become one partition
    ``batch_id=<id>`` of a table; a batch that is replayed after a failure
    overwrites its own partition, so it is never there twice."""
    def write(batch: DataFrame, epoch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={epoch_id}")
    return write


# ---------------------------------------------------------------------------
# STM-04 / WIN-05: a spam list that acts on later bins
# ---------------------------------------------------------------------------
#: What is summed for a user's bin: of all posts that pass the account terms, and of the popular ones among them.
SUMS = ("np", "rp", "sp", "nn", "rn", "sn", "n")


def _user_sums(c, r, ok, prefix: str) -> list:
    pos, neg = ok & (c >= 0), ok & (c < 0)
    values = dict(np=(pos, F.lit(1)), rp=(pos, r), sp=(pos, c * (r + 1)), nn=(neg, F.lit(1)), rn=(neg, r), sn=(neg, c * (r + 1)),
                  n=(ok, F.lit(1)))
    return [F.coalesce(F.sum(F.when(cond, v)), F.lit(0)).cast("double").alias(prefix + k) for k, (cond, v) in values.items()]


def stream_user_bins(df: DataFrame, ts: str, width: str, lateness: str, topic: str = "topic", user: str = "user_id",
                     compound: str = "compound", rt: str = "retweet_count") -> DataFrame:
    """A row per (bin, topic, user) once the bin is closed: ``n_posts`` of the user and the sums of
    AGG-01 over the posts that pass the account terms (``a_*``) and the popular ones of them (``p_*``).
    A null compound or retweet count adds to no sum; a null user counts as one user."""
    c, r = F.col(compound), F.col(rt)
    ok = F.coalesce(static_ok(), F.lit(False))
    popular = ok & F.coalesce(rescued(), F.lit(False))
    g = df.withWatermark(ts, lateness).groupBy(F.window(ts, width).alias("w"), topic, user).agg(
        F.count(F.lit(1)).alias("n_posts"), *_user_sums(c, r, ok, "a_"), *_user_sums(c, r, popular, "p_"))
    return g.select(F.unix_micros("w.start").alias("start_us"), F.col(topic).alias("topic"),
                    F.col(user).alias("user_id"), "n_posts", *[p + s for p in ("a_", "p_") for s in SUMS])


def stream_spam_bins(df: DataFrame, ts: str, out: str, width: str = "6 hours", bar: int = 3, memory: str = "7 days",
                     lateness: str = "1 hour", **cols) -> DataFrame:
    """``stream_user_bins`` of all that is available now, with ``failing``: the user had more than
    ``bar`` posts on the topic in this bin or in one that began less than ``memory`` before it.

    Bins close in the order of time, and a user's posts of a bin are one row by then, so neither the arrival
    of posts nor a hot user matters.  A micro-batch adds its users over the bar to the spam table
    ``out``/spam and judges its bins by the part of the table that its oldest bin can still see; what is
    older is never read again.  A replayed batch overwrites its own partitions of both tables and
    reads none of later ones, so a query that is started again on ``out`` goes on as if it had never stopped."""
    spark = df.sparkSession
    users = stream_user_bins(df, ts, width, lateness, **cols)
    keep = pd.Timedelta(memory) // pd.Timedelta("1us")
    schema = StructType(list(users.schema.fields)).add("failing", "boolean")
    spark.createDataFrame([], schema).write.mode("ignore").parquet(out + "/data/batch_id=-1")       # a stream without rows

    def judge(batch: DataFrame, epoch_id: int) -> None:
        session = batch.sparkSession
        batch.persist()
        over = batch.filter(F.col("n_posts") > bar).select("topic", "user_id", "start_us")
        over.write.mode("overwrite").parquet(f"{out}/spam/batch_id={epoch_id}")
        first = batch.agg(F.min("start_us")).first()[0]
        listed = session.read.schema(StructType(list(over.schema.fields)).add("batch_id", "long")).parquet(out + "/spam").filter(
            (F.col("batch_id") < epoch_id) & (F.col("start_us") > F.lit(0 if first is None else first - keep)))
        rows = batch.unionByName(listed.select("topic", "user_id", "start_us", F.lit(bar + 1).cast("long").alias("n_posts"),
                                               F.lit(True).alias("_listed")), allowMissingColumns=True)
        seen = Window.partitionBy("topic", "user_id").orderBy("start_us")        # a row a bin
        rows = rows.withColumn("_last", F.max(F.when(F.col("n_posts") > bar, F.col("start_us"))).over(seen))
        rows = rows.filter("_listed is null").withColumn("failing", F.coalesce(F.col("start_us") - F.col("_last") < keep, F.lit(False)))
        rows.select(*schema.names).write.mode("overwrite").parquet(f"{out}/data/batch_id={epoch_id}")
        batch.unpersist()
    return run_available(users, out, foreach_batch=judge)


def kept_bins(judged: DataFrame) -> DataFrame:
    """Sentiment bins (AGG-01) of the posts that stay, from the sink of ``stream_spam_bins``: all of a clean
    user that pass the account terms, the popular ones of a failing user; ``n_rejected`` counts the rest."""
    s = [F.sum(F.when(F.col("failing"), F.col("p_" + c)).otherwise(F.col("a_" + c))).alias(c) for c in SUMS]
    g = judged.groupBy("start_us", "topic").agg(*s, F.sum("n_posts").alias("_all"))
    return g.select(
        F.timestamp_micros("start_us").cast("timestamp_ntz").alias("window_start"), "topic",
        F.coalesce(F.try_divide(F.col("sp"), F.col("sp") - F.col("sn")), F.lit(0.0)).alias("compound_score"),
        (F.col("sp") / (F.col("np") + F.col("rp") + 1)).alias("twitter_trend_positive"),
        (F.col("sn") / (F.col("nn") + F.col("rn") + 1)).alias("twitter_trend_negative"),
        F.col("n").cast("bigint").alias("number_tweets"), (F.col("_all") - F.col("n")).cast("bigint").alias("n_rejected"))
