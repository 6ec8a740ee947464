"""File sources and sinks (SRC-01..12).

Readers take explicit schemas (no inference pass over 100 TB), keep the
source file name from ``_metadata`` where the reference used it as a label,
and order lines by (file, block start, position in block) when line order
matters, so no step needs a single global task.
"""

from __future__ import annotations

from typing import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from textlake.functions import text as T
from textlake.functions.time import parse_time
from textlake.operators.common import fill_forward

POST_COLUMNS = [
    ("retweet_count", "long"), ("tweet_favorite_count", "long"), ("tweet_created_at", "string"),
    ("tweet_text", "string"), ("tweet_id", "string"), ("author", "string"), ("author_created_at", "string"),
    ("author_following_count", "long"), ("author_follower_count", "long"), ("author_posts_count", "long"),
    ("author_favorite_count", "long"), ("author_listed_count", "long"), ("author_id", "string"),
    ("author_location", "string"), ("user", "string"), ("user_created_at", "string"), ("user_age_days", "long"),
    ("user_following_count", "long"), ("user_follower_count", "long"), ("user_posts_count", "long"),
    ("user_favorite_count", "long"), ("user_listed_count", "long"), ("user_id", "string"),
    ("user_location", "string"), ("is_spam", "string"),
]
POST_SCHEMA = Ty.StructType([Ty.StructField(n, Ty.LongType() if t == "long" else Ty.StringType()) for n, t in POST_COLUMNS])


def _line_order(df: DataFrame) -> DataFrame:
    """(file, block start, row in block): the order lines have in their files."""
    return (df.withColumn("_file", F.col("_metadata.file_name"))
              .withColumn("_block", F.col("_metadata.file_block_start"))
              .withColumn("_row", F.monotonically_increasing_id()
                          - F.shiftleft(F.spark_partition_id().cast("bigint"), 33)))


LINE_ORDER = ["_file", "_block", "_row"]


# SRC-01 -------------------------------------------------------------------
def read_csv_dir(spark: SparkSession, path: str, schema: Ty.StructType | str, label_col: str = "file") -> DataFrame:
    """Every non-hidden CSV of a directory; the file name kept as a label;
    malformed lines dropped; an empty field is the empty string."""
    df = (spark.read.schema(schema).option("header", True).option("mode", "DROPMALFORMED")
          .option("emptyValue", "").option("nullValue", "\u0000").csv(path))
    df = df.withColumn(label_col, F.col("_metadata.file_name"))
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, Ty.StringType)]
    return df.na.fill("", subset=strings)


# SRC-02 -------------------------------------------------------------------
def read_posts(spark: SparkSession, path: str) -> DataFrame:
    """Typed posts: a time that does not parse takes the first row's value
    (``author_created_at`` falls back to the first row's *user* time);
    sorted by time."""
    raw = read_csv_dir(spark, path, POST_SCHEMA, label_col="_file_name")
    raw = _line_order(raw)
    return posts_with_fallback(raw, LINE_ORDER).drop("_file_name", *LINE_ORDER)


def posts_with_fallback(raw: DataFrame, order: Sequence[str]) -> DataFrame:
    first = raw.select(F.min_by(F.struct(
        parse_time(F.col("tweet_created_at")).alias("t"),
        parse_time(F.col("user_created_at")).alias("u")), F.struct(*order)).alias("f"))
    f_t = first.select("f.t").scalar()
    f_u = first.select("f.u").scalar()
    out = (raw.withColumn("tweet_created_at", parse_time(F.col("tweet_created_at"), f_t))
              .withColumn("author_created_at", parse_time(F.col("author_created_at"), f_u))
              .withColumn("user_created_at", parse_time(F.col("user_created_at"), f_u)))
    return out.orderBy("tweet_created_at")


# SRC-03 -------------------------------------------------------------------
def flatten_posts(df: DataFrame) -> DataFrame:
    """Nested post objects (``author``, ``user`` structs) -> the 25 columns.

    Account age in whole days; the author's location is kept only when the
    *user's* location is set (the reference's rule)."""
    a, u = "author", "user"
    age = F.floor((F.unix_micros(F.col("created_at").cast("timestamp"))
                   - F.unix_micros(F.col(f"{u}.created_at").cast("timestamp"))) / 86_400_000_000).cast("bigint")
    return df.select(
        F.col("retweet_count"), F.col("favorite_count").alias("tweet_favorite_count"),
        F.col("created_at").alias("tweet_created_at"), F.col("text").alias("tweet_text"),
        F.col("id_str").alias("tweet_id"),
        F.col(f"{a}.screen_name").alias("author"), F.col(f"{a}.created_at").alias("author_created_at"),
        F.col(f"{a}.friends_count").alias("author_following_count"),
        F.col(f"{a}.followers_count").alias("author_follower_count"),
        F.col(f"{a}.statuses_count").alias("author_posts_count"),
        F.col(f"{a}.favourites_count").alias("author_favorite_count"),
        F.col(f"{a}.listed_count").alias("author_listed_count"), F.col(f"{a}.id_str").alias("author_id"),
        F.when(F.col(f"{u}.location").isNotNull(), F.col(f"{a}.location")).alias("author_location"),
        F.col(f"{u}.screen_name").alias("user"), F.col(f"{u}.created_at").alias("user_created_at"),
        age.alias("user_age_days"),
        F.col(f"{u}.friends_count").alias("user_following_count"),
        F.col(f"{u}.followers_count").alias("user_follower_count"),
        F.col(f"{u}.statuses_count").alias("user_posts_count"),
        F.col(f"{u}.favourites_count").alias("user_favorite_count"),
        F.col(f"{u}.listed_count").alias("user_listed_count"), F.col(f"{u}.id_str").alias("user_id"),
        F.col(f"{u}.location").alias("user_location"), F.lit(None).cast("string").alias("is_spam"))


# SRC-04 / SRC-05 / SRC-06 ---------------------------------------------------
def parse_labeled(df: DataFrame, col: str, prefix: str = "__label__") -> DataFrame:
    """Whitespace tokens; those starting with the prefix (anywhere in the
    line) are labels, the rest words."""
    t = T.tokenize_ws(F.col(col), eos_at_end=False)
    return df.withColumn("labels", F.filter(t, lambda x: x.startswith(prefix))) \
             .withColumn("words", F.filter(t, lambda x: ~x.startswith(prefix)))


def parse_labeled_tail(df: DataFrame, col: str, marker: str = "__label__") -> DataFrame:
    """Tail form ``text__label__x``: split at the marker; lines without it
    are skipped."""
    parts = F.split(F.col(col), marker, -1)
    return (df.withColumn("_parts", parts).filter(F.size("_parts") >= 2)
              .withColumn("text", F.get("_parts", 0)).withColumn("label", F.get("_parts", 1)).drop("_parts"))


def labeled_lines(good: DataFrame, bad: DataFrame, col: str, good_label: str = "1",
                  bad_label: str = "0", prefix: str = "__label__") -> DataFrame:
    """Distinct texts per class, stacked as ``text __label__x`` lines (with
    the blank the library's reader needs to see a label)."""
    g = good.select(col).distinct().select(F.concat(F.col(col), F.lit(f" {prefix}{good_label}")).alias("line"))
    b = bad.select(col).distinct().select(F.concat(F.col(col), F.lit(f" {prefix}{bad_label}")).alias("line"))
    return g.unionByName(b)


def write_labeled(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    lines.select("line").write.mode(mode).text(path)


# SRC-07 / SRC-08 word vectors in text form ------------------------------------
def parse_vectors(lines: DataFrame, order: Sequence[str], col: str = "value") -> DataFrame:
    """``word v1 ... vd`` lines.  A first line of two whole numbers is the
    ``n dim`` header and names the dimension; without one the first line's
    field count does.  Rows with a wrong field count or a bad number are
    dropped, zero-norm rows skipped, the first duplicate wins."""
    f = F.filter(F.split(F.col(col), " ", -1), lambda x: x != "")
    df = lines.withColumn("_f", f).withColumn("_o", F.struct(*order))
    first = df.select(F.min_by(F.struct("_f", "_o"), "_o").alias("x")).first()["x"]
    if first is None:
        return df.select(F.lit("").alias("word"), F.array().cast("array<float>").alias("vec")).limit(0)
    head = first["_f"]
    header = len(head) == 2 and all(x.isascii() and x.isdigit() for x in head)
    dim = int(head[1]) if header else len(head) - 1
    if header:
        smallest = df.select(F.min("_o")).scalar()
        df = df.filter(F.col("_o") > smallest)
    vec = F.transform(F.slice("_f", 2, F.size("_f")), lambda x: x.try_cast("float"))
    df = df.filter(F.size("_f") == dim + 1).withColumn("word", F.get("_f", 0)).withColumn("vec", vec)
    df = df.filter(F.forall("vec", lambda x: x.isNotNull()))
    df = df.filter(F.aggregate("vec", F.lit(0.0).cast("double"), lambda a, x: a + x * x) > 0)
    first = df.groupBy("word").agg(F.min_by("vec", F.struct(*order)).alias("vec"))
    return first


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    lines = _line_order(spark.read.text(path))
    return parse_vectors(lines, LINE_ORDER)


def _fmt5(values: pd.Series) -> pd.Series:
    """5 significant digits, C ``%g`` style (the library's stream output)."""
    return values.map(lambda v: " ".join("%.5g" % x for x in v) if v is not None else None)


@F.pandas_udf(Ty.StringType())
def format_vector(v: pd.Series) -> pd.Series:
    return _fmt5(v)


def vector_lines(df: DataFrame, word: str = "word", vec: str = "vec", count: str | None = None) -> DataFrame:
    """SRC-08: ``word v1 ... vd`` lines (by falling count when given)."""
    out = df.select(word, *( [count] if count else []), F.concat_ws(" ", F.col(word), format_vector(F.col(vec))).alias("line"))
    return out.orderBy(F.col(count).desc(), word) if count else out


def write_vectors(df: DataFrame, path: str, word: str = "word", vec: str = "vec", count: str | None = None,
                  mode: str = "overwrite") -> None:
    """Header ``n dim`` (a single small file written by the driver from two
    scalars) followed by the vector lines (distributed text output)."""
    lines = vector_lines(df, word, vec, count)
    n, dim = df.select(F.count(F.lit(1)), F.max(F.size(vec))).first()
    header = df.sparkSession.createDataFrame([(f"{n} {dim}",)], "line string")
    header.unionByName(lines.select("line")).write.mode(mode).text(path)


# SRC-09 ---------------------------------------------------------------------
def write_report(df: DataFrame, path: str, mode: str = "append", encoding: str = "utf-8", save: bool = True) -> None:
    if save:
        df.write.mode(mode).option("header", True).option("encoding", encoding).csv(path)


# SRC-10 ---------------------------------------------------------------------
def explode_envelope(df: DataFrame, col: str, contents_schema: str, keys: Sequence[str] = ()) -> DataFrame:
    """JSON envelope ``{key: {contents: <JSON table>, failed_terms: <JSON list>}}``:
    one row per (key, table row), failed terms as an array."""
    env = F.from_json(F.col(col), "map<string, struct<contents:string, failed_terms:string>>")
    ex = df.select(F.explode(env).alias("key", "v"))
    if keys:
        ex = ex.filter(F.col("key").isin(list(keys)))
    rows = ex.select("key", F.from_json("v.failed_terms", "array<string>").alias("failed_terms"),
                     F.explode(F.from_json("v.contents", f"array<struct<{contents_schema}>>")).alias("r"))
    return rows.select("key", "failed_terms", "r.*")


# SRC-11 / SRC-12 ------------------------------------------------------------
def parse_pairs(lines: DataFrame, col: str = "value") -> DataFrame:
    """Word-pair gold lines ``w1 w2 score``, lower-cased."""
    f = F.split(F.trim(F.col(col)), "[ \t]+", -1)
    return lines.filter(F.size(f) >= 3).select(
        F.lower(F.get(f, 0)).alias("w1"), F.lower(F.get(f, 1)).alias("w2"),
        F.get(f, 2).cast("double").alias("gold"))


def parse_questions(lines: DataFrame, order: Sequence[str], col: str = "value") -> DataFrame:
    """Analogy file: ``:`` lines open a section, other lines are four words.

    The section is carried forward in line order with ``fill_forward``
    (per-partition fill plus a small cross-partition prefix)."""
    is_sec = F.col(col).startswith(":")
    df = lines.withColumn("_sec", F.when(is_sec, F.trim(F.expr(f"substring({col}, 2)"))))
    df = fill_forward(df, order, "_sec")
    f = F.split(F.trim(F.col(col)), " ", -1)
    q = df.filter(~is_sec & (F.size(f) == 4))
    keep = [c for c in lines.columns if c != col]
    return q.select(F.col("_sec").alias("section"), *keep,
                    F.get(f, 0).alias("a"), F.get(f, 1).alias("b"), F.get(f, 2).alias("c"), F.get(f, 3).alias("d"))
