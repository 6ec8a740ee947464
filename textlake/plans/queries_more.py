"""Further registered queries: vector and label files end to end, sub-word
vectors, word frequencies, a repeatable permutation, single-mode trend matrices,
text operators with a given tokenizer."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from textlake.functions import arrays as A
from textlake.functions import text as T
from textlake.operators import common as C
from textlake.operators import ngrams as N
from textlake.operators import udf as U
from textlake.operators import vectors as VE
from textlake.operators import vocab as V
from textlake.plans import sqlfrag as Q
from textlake.plans.queries_trend import TREND_MATRIX_SQL
from textlake.plans.queries_vocab import MAXN, MINN, VOCAB_SQL, _vocab
from textlake.plans.registry import register, round_doubles
from textlake.plans.trend import trend_matrix, trend_run
from textlake.session import checkpoint_dir
from textlake.sources import files as FI
from textlake.sources import tables as S
from textlake.sources.tables import with_fixtures


def _folder(spark, tag: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


@register("word_frequencies", with_fixtures(f"""WITH {VOCAB_SQL}
SELECT word, count FROM vocab WHERE type = 'word'""", "lines_all"))
def word_frequencies(spark, sf_dir):
    """AGG-05: the word list with its frequencies."""
    return V.word_frequencies(_vocab(spark, sf_dir))


@register("subword_vectors", with_fixtures(f"""WITH {VOCAB_SQL},
nemb AS (SELECT count(*) AS n FROM embeddings),
gw AS (SELECT word, {Q.char_ngram_strings('word', MINN, MAXN)} AS grams, nemb.n AS nb FROM vocab, nemb
  WHERE type = 'word' AND word <> '</s>'),
sw AS (SELECT word, CAST(unnest(range(len(grams))) AS INTEGER) AS pos, unnest(grams) AS gram,
  unnest(list_transform(grams, lambda g: {Q.fnv1a('g')} % nb)) AS row_id FROM gw)
SELECT word, pos, gram, round(list_sum(CAST(e.embedding AS DOUBLE[])), 6) AS vsum
FROM sw JOIN embeddings e ON e.vec_id = sw.row_id""", "lines_all"))
def subword_vectors_q(spark, sf_dir):
    """VEC-03: each sub-word of a word with its vector."""
    emb = S.load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("vec"))
    words = _vocab(spark, sf_dir).filter((F.col("type") == "word") & (F.col("word") != "</s>")).select("word")
    sv = VE.subword_vectors(words, emb, None, 0, emb.count(), MINN, MAXN).filter(F.col("vec").isNotNull())
    return round_doubles(sv.select("word", "pos", "gram", A.vec_sum(F.col("vec")).alias("vsum")))


@register("vector_file_round_trip", with_fixtures("""SELECT word, round(list_sum(list_transform(vec,
  lambda x: CAST(CAST(printf('%.5g', CAST(x AS DOUBLE)) AS FLOAT) AS DOUBLE))), 4) AS vsum FROM vectors""", "vectors"))
def vector_file_round_trip(spark, sf_dir):
    """SRC-08 + SRC-07: vectors written as text with their header, read back."""
    path = _folder(spark, "vectors")
    FI.write_vectors(S.vectors(spark, sf_dir).select("word", "vec"), path)
    return FI.read_vectors(spark, path).select("word", F.round(A.vec_sum(F.col("vec")), 4).alias("vsum"))


@register("labeled_file_round_trip", with_fixtures("""SELECT DISTINCT unnest(list_filter(string_split(text || ' __label__' ||
  CAST(quality AS VARCHAR), chr(10)), lambda l: l <> '')) AS line FROM labeled""", "labeled"))
def labeled_file_round_trip(spark, sf_dir):
    """SRC-06: labelled lines written as text and read back, line by line."""
    l = S.labeled(spark, sf_dir)
    path = _folder(spark, "labeled")
    FI.write_labeled(FI.labeled_lines(l.filter("quality = 1"), l.filter("quality = 0"), "text"), path)
    return spark.read.option("lineSep", "\n").text(path).filter("value != ''").select(F.col("value").alias("line")).distinct()


@register("shuffled_docs", """SELECT doc_id, row_number() OVER (ORDER BY md5('7' || CAST(doc_id AS VARCHAR)), doc_id) AS position
FROM documents""")
def shuffled_docs(spark, sf_dir):
    """TOP-06: a repeatable permutation of all documents."""
    return C.shuffle_rows(S.load(spark, sf_dir, "documents").select("doc_id"), 7, "doc_id")


_T_COLS = "id, name, start_date, time_gap_s, twitter_trend_compound, twitter_trend_positive, volume_tweets_positive, " \
    "twitter_trend_negative, volume_tweets_negative, number_tweets, number_tweets_rejected"


@register("trend_matrix_sentiment", f"SELECT {_T_COLS} FROM ({TREND_MATRIX_SQL})")
def trend_matrix_sentiment(spark, sf_dir):
    """AGG-14, mode T: the window's sentiment only."""
    return round_doubles(trend_matrix(S.posts(spark, sf_dir), S.topic_ids(spark, sf_dir), mode="T", n_pieces=4))


@register("trend_matrix_score", f"SELECT id, name, start_date, time_gap_s, google_trend FROM ({TREND_MATRIX_SQL})")
def trend_matrix_score(spark, sf_dir):
    """AGG-14, mode G: the trend score only."""
    return round_doubles(trend_matrix(S.posts(spark, sf_dir), S.topic_ids(spark, sf_dir), mode="G", n_pieces=4))


# Two topics with posts that can't be scored (no time, no compound), and a term that nobody wrote about.
_FAULT = {"view": "event_id % 97 = 0", "error": "event_id % 89 = 0"}
_RUN_SQL = (TREND_MATRIX_SQL
            .replace("FROM (SELECT DISTINCT topic FROM posts)", "FROM (SELECT DISTINCT event_type AS topic FROM events)")
            .replace("FROM events),", "FROM events WHERE event_type NOT IN (SELECT topic FROM faults)),")
            .replace("b0 AS (SELECT min(tweet_created_at) AS lo, max(tweet_created_at) AS hi FROM posts)",
                     "b0 AS (SELECT min(ts) AS lo, max(ts) AS hi FROM events "
                     f"WHERE NOT (event_type = 'view' AND {_FAULT['view']}))"))


@register("trend_matrix_failed", f"""WITH faults AS (SELECT event_type AS topic,
    CASE event_type WHEN 'view' THEN 'missing tweet_created_at' ELSE 'missing compound' END AS failed_reason, count(*) AS n_faulty
  FROM events WHERE (event_type = 'view' AND {_FAULT['view']}) OR (event_type = 'error' AND {_FAULT['error']})
  GROUP BY event_type UNION ALL SELECT 'unwritten', 'no posts', 0),
tid AS (SELECT topic, CAST(dense_rank() OVER (ORDER BY topic) AS BIGINT) AS r, count(*) OVER () AS n
  FROM (SELECT DISTINCT event_type AS topic FROM events)),
w AS (SELECT min(ts) AS lo, max(ts) AS hi FROM events WHERE NOT (event_type = 'view' AND {_FAULT['view']}))
SELECT *, NULL AS failed_reason, CAST(NULL AS BIGINT) AS n_faulty FROM ({_RUN_SQL})
UNION ALL BY NAME
SELECT CASE WHEN r = 1 THEN 101 WHEN r < n THEN r ELSE -1 END AS id, topic AS name, (SELECT lo FROM w) AS start_date,
  (SELECT CAST(epoch_us(hi) - epoch_us(lo) AS DOUBLE) / 1e6 FROM w) AS time_gap_s, failed_reason, n_faulty
FROM faults LEFT JOIN tid USING (topic)""")
def trend_matrix_failed(spark, sf_dir):
    """AGG-14, failed terms kept apart: matrix and failed list of one run."""
    p = S.posts(spark, sf_dir)
    at = lambda t, n: (F.col("topic") == t) & (F.col("tweet_id") % n == 0)
    p = p.withColumn("tweet_created_at", F.when(~at("view", 97), F.col("tweet_created_at"))).withColumn(
        "compound", F.when(~at("error", 89), F.col("compound")))
    terms = p.select("topic").distinct().unionByName(spark.range(1).select(F.lit("unwritten").alias("topic")))
    return round_doubles(trend_run(p, S.topic_ids(spark, sf_dir), "GT", terms))


_LOWER = "translate(regexp_replace(text, '[0-9'']', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@register("get_tokens_token_func", f"""WITH t AS (SELECT doc_id, list_filter(string_split({_LOWER}, ' '), lambda w: w <> '') AS w FROM documents)
SELECT doc_id, array_to_string(list_transform(list_zip(w[1:len(w) - 1], w[2:]), lambda p: p[1] || ' ' || p[2]), '|') AS bigrams FROM t""")
def get_tokens_token_func(spark, sf_dir):
    """UDF-03: word bigrams with a tokenizer given as a function."""
    d = S.load(spark, sf_dir, "documents")
    return d.select("doc_id", F.array_join(T.get_tokens(F.col("text"), 2, token_func=U.blank_split_lower), "|").alias("bigrams"))
