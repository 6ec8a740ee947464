"""Loading the driver's parquet tables and building the derived fixtures.

Every fixture is a Spark plan over the given tables (integer arithmetic
only, so Spark and the DuckDB oracle agree); the same definitions exist as
SQL in ``FIXTURE_SQL`` for the oracle.  Nothing here is made-up input: the
work of each fixture grows with its source table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlake.functions import text as T
from textlake.operators.common import dense_index

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


TEXT_TABLES = {"documents", "pages", "conversations"}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table; Catalyst prunes columns and pushes filters to the scan.

    Text tables feed CPU-heavy per-row work (regexes, n-grams); when one
    arrives in fewer splits than the cluster has cores (a small file with
    one row group) it is spread round-robin first.  A large input is already
    read in many splits and is left alone (no extra shuffle at scale)."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    if name in TEXT_TABLES:
        df = spread(df)
    return df


def spread(df: DataFrame) -> DataFrame:
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df


# ---------------------------------------------------------------------------
# Spark fixtures
# ---------------------------------------------------------------------------

def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posts_from_events(load(spark, sf_dir, "events"))


def posts_from_events(ev: DataFrame) -> DataFrame:
    """The posts fixture as a projection (works on batch and stream frames)."""
    eid, uid = F.col("event_id"), F.col("user_id")
    return ev.select(
        eid.alias("tweet_id"),
        F.col("ts").alias("tweet_created_at"),
        F.col("event_type").alias("topic"),
        uid.alias("user_id"),
        (eid % 7).alias("retweet_count"),
        (eid % 11).alias("tweet_favorite_count"),
        (((eid * 37) % 201 - 100).cast("double") / 100).alias("compound"),
        (120 + (uid * 77) % 1000).alias("user_age_days"),
        ((uid * 59) % 1500).alias("user_posts_count"),
        ((uid * 7) % 60).alias("user_follower_count"),
        (uid % 9).alias("user_favorite_count"),
    )


def posts_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = posts(spark, sf_dir)
    return (p.withColumn("seq", F.lit(0))
            .unionByName(p.filter(F.col("tweet_id") % 10 == 0).withColumn("seq", F.lit(1)))
            .unionByName(p.filter(F.col("tweet_id") % 30 == 0).withColumn("seq", F.lit(2))))


def posts_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts with text taken from ``documents`` (repost marks and links added)."""
    p = posts(spark, sf_dir)
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    n_docs = docs.select(F.count(F.lit(1))).scalar()
    p = p.withColumn("doc_id", F.col("tweet_id") % n_docs)
    j = p.join(docs, "doc_id", "inner")
    k = F.col("tweet_id") % 3
    text = (F.when(k == 0, F.concat(F.lit("RT @user: "), F.col("text")))
            .when(k == 1, F.concat(F.col("text"), F.lit(" http://x.example/a")))
            .otherwise(F.col("text")))
    return j.withColumn("tweet_text", text).drop("text")


def topic_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topic -> id table: ids by name order, the last topic left out and the
    first one listed twice (the later entry, id + 100, must win)."""
    t = posts(spark, sf_dir).select("topic").distinct()
    r = dense_index(t, ["topic"], name="id")
    n = r.select(F.max("id")).scalar()
    base = r.filter(F.col("id") < n).select(F.col("topic").alias("name"), "id", F.col("id").alias("pos"))
    dup = r.filter(F.col("id") == 1).select(F.col("topic").alias("name"), (F.col("id") + 100).alias("id"),
                                            F.lit(1000).cast("bigint").alias("pos"))
    return base.unionByName(dup)


def doc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents")
    return d.select(F.explode(T.words(F.lower("text"))).alias("token"))


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens seen at least 5 times, valence ``length % 9 - 4``."""
    c = doc_tokens(spark, sf_dir).groupBy("token").count().filter(F.col("count") >= 5)
    return c.select("token", (F.length("token") % 9 - 4).cast("double").alias("valence"))


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = doc_tokens(spark, sf_dir).groupBy("token").count().filter(F.col("count") >= 5)
    return c.select("token", F.when(F.length("token") % 3 == 0, "NNP").otherwise("NN").alias("tag"))


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()


def name_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ambiguity lexicon: the words of part names with even length."""
    w = names(spark, sf_dir).select(F.explode(F.split(F.lower("name"), r"[^\p{L}\p{N}_]", -1)).alias("word"))
    return w.filter((F.length("word") > 0) & (F.length("word") % 2 == 0)).distinct()


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "embeddings")
    return e.select(F.concat(F.lit("w"), F.col("vec_id").cast("string")).alias("word"),
                    "vec_id", F.col("embedding").alias("vec"), "label")


def _wid(c):
    return F.concat(F.lit("w"), c.cast("string"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word pairs (i, i+1) with gold score (i*17)%100; every tenth partner is OOV."""
    e = load(spark, sf_dir, "embeddings").select("vec_id")
    i = F.col("vec_id")
    j = F.when(i % 10 == 9, i + 1_000_000).otherwise(i + 1)
    return e.select(_wid(i).alias("w1"), _wid(j).alias("w2"), ((i * 17) % 100).cast("double").alias("gold"))


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analogy questions a:b :: c:d over ids i..i+3, sections of 50 ids."""
    e = load(spark, sf_dir, "embeddings").select("vec_id")
    i = F.col("vec_id")
    c = F.when(i % 10 == 9, i + 1_000_000).otherwise(i + 2)
    return e.select(
        F.concat(F.lit("sec"), F.lpad((i / 50).cast("bigint").cast("string"), 3, "0")).alias("section"),
        i.alias("qid"), _wid(i).alias("a"), _wid(i + 1).alias("b"), _wid(c).alias("c"), _wid(i + 3).alias("d"))


def lines_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a training line, its quality label (when labelled) in front."""
    d = load(spark, sf_dir, "documents").select("doc_id", "text")
    lab = load(spark, sf_dir, "labels").select("doc_id", "quality")
    j = d.join(lab, "doc_id", "left")
    lab_txt = F.when(F.col("quality").isNotNull(),
                     F.concat(F.lit("__label__"), F.col("quality").cast("string"), F.lit(" "))).otherwise(F.lit(""))
    return j.select("doc_id", F.concat(lab_txt, F.col("text")).alias("line"))


def labeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents").select("doc_id", "text")
    lab = load(spark, sf_dir, "labels")
    return d.join(lab, "doc_id").select(
        "doc_id", "text", F.concat(F.lit("__label__"), F.col("quality").cast("string")).alias("label"),
        "quality", "toxic")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labeled + a fixed prediction (doc_id % 2) and label lists from id arithmetic."""
    l = labeled(spark, sf_dir)
    did = F.col("doc_id")
    return l.select(
        "doc_id", F.col("quality").cast("bigint").alias("y"), (did % 2).alias("prediction"),
        F.array(F.concat(F.lit("__label__"), F.col("quality").cast("string")),
                F.concat(F.lit("__label__t"), F.col("toxic").cast("string"))).alias("true_labels"),
        F.array(F.concat(F.lit("__label__"), (did % 2).cast("string")),
                F.concat(F.lit("__label__t"), (did % 3).cast("string")),
                F.concat(F.lit("__label__x"), (did % 5).cast("string"))).alias("pred_labels"),
        # long words only, so that some labelled lines have none
        F.regexp_extract_all("text", F.lit("[a-z]{12,}"), 0).alias("words"))


def codebook(spark: SparkSession, sf_dir: str, dsub: int = 2, k: int = 16) -> DataFrame:
    """Fixed codebook for QNT-02..04: the first ``k`` vectors by id, in parts of ``dsub``."""
    e = load(spark, sf_dir, "embeddings")
    first = e.filter(F.col("vec_id") < k)
    dim = 64
    nsub = -(-dim // dsub)
    parts = first.select(F.col("vec_id").alias("code"),
                         F.posexplode(F.sequence(F.lit(0), F.lit(nsub - 1))).alias("p", "sub"),
                         "embedding")
    return parts.select("sub", "code",
                        F.slice("embedding", F.col("sub") * dsub + 1, F.lit(dsub)).alias("centroid"))


# ---------------------------------------------------------------------------
# Oracle (DuckDB) versions of the same fixtures
# ---------------------------------------------------------------------------

FIXTURE_SQL = {
    "posts": """SELECT event_id AS tweet_id, ts AS tweet_created_at, event_type AS topic, user_id,
        event_id % 7 AS retweet_count, event_id % 11 AS tweet_favorite_count,
        CAST((event_id * 37) % 201 - 100 AS DOUBLE) / 100 AS compound,
        120 + (user_id * 77) % 1000 AS user_age_days, (user_id * 59) % 1500 AS user_posts_count,
        (user_id * 7) % 60 AS user_follower_count, user_id % 9 AS user_favorite_count
      FROM events""",
    "posts_dup": """SELECT *, 0 AS seq FROM posts
      UNION ALL SELECT *, 1 AS seq FROM posts WHERE tweet_id % 10 = 0
      UNION ALL SELECT *, 2 AS seq FROM posts WHERE tweet_id % 30 = 0""",
    "posts_raw": """SELECT p.*, p.tweet_id % (SELECT count(*) FROM documents) AS doc_id,
        CASE p.tweet_id % 3 WHEN 0 THEN 'RT @user: ' || d.text
             WHEN 1 THEN d.text || ' http://x.example/a' ELSE d.text END AS tweet_text
      FROM posts p JOIN documents d ON d.doc_id = p.tweet_id % (SELECT count(*) FROM documents)""",
    "topic_ids": """WITH r AS (SELECT topic, CAST(dense_rank() OVER (ORDER BY topic) AS BIGINT) AS id
                     FROM (SELECT DISTINCT topic FROM posts))
      SELECT topic AS name, id, id AS pos FROM r WHERE id < (SELECT max(id) FROM r)
      UNION ALL SELECT topic AS name, id + 100 AS id, CAST(1000 AS BIGINT) AS pos FROM r WHERE id = 1""",
    "doc_tokens": f"""SELECT unnest(regexp_extract_all(lower(text), {T.sql_lit(T.WORD_RE)})) AS token FROM documents""",
    "lexicon": """SELECT token, CAST(length(token) % 9 - 4 AS DOUBLE) AS valence
      FROM doc_tokens GROUP BY token HAVING count(*) >= 5""",
    "tags": """SELECT token, CASE WHEN length(token) % 3 = 0 THEN 'NNP' ELSE 'NN' END AS tag
      FROM doc_tokens GROUP BY token HAVING count(*) >= 5""",
    "names": "SELECT DISTINCT p_name AS name FROM part",
    "name_lexicon": r"""SELECT DISTINCT word FROM (
        SELECT unnest(regexp_split_to_array(lower(name), '[^\p{L}\p{N}_]')) AS word FROM names)
      WHERE length(word) > 0 AND length(word) % 2 = 0""",
    "vectors": "SELECT 'w' || CAST(vec_id AS VARCHAR) AS word, vec_id, embedding AS vec, label FROM embeddings",
    "pairs": """SELECT 'w' || CAST(vec_id AS VARCHAR) AS w1,
        'w' || CAST(CASE WHEN vec_id % 10 = 9 THEN vec_id + 1000000 ELSE vec_id + 1 END AS VARCHAR) AS w2,
        CAST((vec_id * 17) % 100 AS DOUBLE) AS gold FROM embeddings""",
    "triples": """SELECT 'sec' || lpad(CAST(CAST(floor(vec_id / 50) AS BIGINT) AS VARCHAR), 3, '0') AS section,
        vec_id AS qid, 'w' || CAST(vec_id AS VARCHAR) AS a, 'w' || CAST(vec_id + 1 AS VARCHAR) AS b,
        'w' || CAST(CASE WHEN vec_id % 10 = 9 THEN vec_id + 1000000 ELSE vec_id + 2 END AS VARCHAR) AS c,
        'w' || CAST(vec_id + 3 AS VARCHAR) AS d FROM embeddings""",
    "lines_all": """SELECT d.doc_id, CASE WHEN l.quality IS NOT NULL THEN '__label__' || CAST(l.quality AS VARCHAR) || ' '
        ELSE '' END || d.text AS line FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "labeled": """SELECT d.doc_id, d.text, '__label__' || CAST(l.quality AS VARCHAR) AS label, l.quality, l.toxic
      FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    "predictions": """SELECT doc_id, CAST(quality AS BIGINT) AS y, doc_id % 2 AS prediction,
        ['__label__' || CAST(quality AS VARCHAR), '__label__t' || CAST(toxic AS VARCHAR)] AS true_labels,
        ['__label__' || CAST(doc_id % 2 AS VARCHAR), '__label__t' || CAST(doc_id % 3 AS VARCHAR),
         '__label__x' || CAST(doc_id % 5 AS VARCHAR)] AS pred_labels,
        regexp_extract_all(text, '[a-z]{12,}') AS words
      FROM labeled""",
    "codebook": """SELECT s.sub, e.vec_id AS code, e.embedding[s.sub * 2 + 1 : s.sub * 2 + 2] AS centroid
      FROM embeddings e, (SELECT unnest(range(0, 32)) AS sub) s WHERE e.vec_id < 16""",
}

# dependency order for WITH clauses
_FIXTURE_DEPS = {
    "posts_dup": ["posts"], "posts_raw": ["posts"], "topic_ids": ["posts"],
    "lexicon": ["doc_tokens"], "tags": ["doc_tokens"], "name_lexicon": ["names"],
    "predictions": ["labeled"],
}


def with_fixtures(sql: str, *names: str) -> str:
    """Prefix ``sql`` with WITH clauses for the named fixtures (and their deps)."""
    order: list[str] = []

    def add(n):
        for d in _FIXTURE_DEPS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    if not order:
        return sql
    ctes = ",\n".join(f"{n} AS ({FIXTURE_SQL[n]})" for n in order)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
