"""Registered queries for operators otherwise only used inside larger plans
(FLT-03, JOIN-08, WIN-02, STR-12, STR-14, DAT-02, DAT-03, VEC-02(b), VEC-05)."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlake.functions import hashing as H
from textlake.functions import text as T
from textlake.functions import time as TM
from textlake.operators import bins as B
from textlake.operators import posts as P
from textlake.operators import vectors as VE
from textlake.plans import sqlfrag as Q
from textlake.plans.queries_trend import SPEC_SQL, W6H
from textlake.plans.queries_vectors import COS_SQL, DOC_TOKS_SQL, WORD_TABLE_SQL, _dim, _doc_tokens, _summary, _word_table
from textlake.plans.queries_vocab import VOCAB_SQL
from textlake.plans.registry import register, round_doubles
from textlake.sources import tables as S
from textlake.sources.tables import with_fixtures


@register("text_or_drop", """SELECT d.doc_id, coalesce('__label__' || CAST(l.quality AS VARCHAR), '') AS label,
  CAST(l.quality IS NULL AS INTEGER) AS was_missing FROM documents d LEFT JOIN labels l USING (doc_id)""")
def text_or_drop_q(spark, sf_dir):
    """FLT-03: every document with its label text; unlabelled documents have
    none, which the fill form turns into '' (the drop form keeps the rest)."""
    d = S.load(spark, sf_dir, "documents").select("doc_id")
    lab = S.load(spark, sf_dir, "labels").select(
        "doc_id", F.concat(F.lit("__label__"), F.col("quality").cast("string")).alias("label"))
    j = d.join(lab, "doc_id", "left").withColumn("was_missing", F.col("label").isNull().cast("int"))
    return P.text_or_drop(j, "label", "fill").select("doc_id", "label", "was_missing")


@register("attach_labels", """SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)""")
def attach_labels(spark, sf_dir):
    """JOIN-08: scores beside their source rows by a stable key."""
    from textlake.operators.vectors import attach
    d = S.load(spark, sf_dir, "documents").select("doc_id", "lang")
    return attach(d, S.load(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), "doc_id")


@register("time_bins", with_fixtures(f"""WITH {SPEC_SQL}
SELECT tweet_id, bin_idx, make_timestamp((SELECT e_us FROM spec2) - bin_idx * {W6H}) AS bin_start_date FROM binned""",
                                     "posts"))
def time_bins(spark, sf_dir):
    """WIN-02: right-closed 6-hour bins counted back from the hour edge."""
    p = S.posts(spark, sf_dir)
    spec = B.bin_spec(p, "tweet_created_at", 4)
    return B.assign_bins(p, spec).select("tweet_id", "bin_idx", B.bin_date(spec).alias("bin_start_date"))


@register("hour_edges", """SELECT event_id, CASE WHEN hour(ts) < 23 THEN date_trunc('hour', ts) + INTERVAL 1 HOUR
  ELSE date_trunc('hour', ts) END AS edge FROM events""")
def hour_edges(spark, sf_dir):
    """DAT-03: the next full hour (inside hour 23 that hour's start)."""
    e = S.load(spark, sf_dir, "events")
    return e.select("event_id", TM.hour_edge(F.col("ts")).alias("edge"))


@register("events_since", """SELECT event_id, ts FROM events
WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 2 DAY - INTERVAL 3 HOUR - INTERVAL 30 MINUTE""")
def events_since(spark, sf_dir):
    """DAT-02: rows after ``now - [2 d, 3 h, 30 min, 0 s]`` with now = the data's last time."""
    e = S.load(spark, sf_dir, "events")
    now = e.select(F.max("ts")).scalar()
    return e.filter(F.col("ts") > TM.since(now, [2, 3, 30, 0])).select("event_id", "ts")


WNG_SQL = f"""WITH t AS (SELECT doc_id, {Q.tokenize_ws('text', eos=False)} AS tk FROM documents),
h AS (SELECT doc_id, list_transform(tk, lambda w: CAST({Q.fnv1a('w')} AS HUGEINT)) AS hs FROM t),
s AS (SELECT doc_id, list_transform(hs, lambda x: CASE WHEN x >= 2147483648 THEN x - 4294967296 + 18446744073709551616 ELSE x END) AS u
  FROM h),
b AS (SELECT doc_id, list_transform(list_zip(u[1:len(u) - 1], u[2:]),
    lambda z: CAST(((z[1] * 116049371 + z[2]) % 18446744073709551616) % 2000000 AS BIGINT)) AS bk FROM s)
SELECT doc_id, CAST(len(bk) AS BIGINT) AS n, CAST(coalesce(list_sum(bk), 0) AS BIGINT) AS bucket_sum,
  array_to_string(bk, ' ') AS buckets FROM b"""


@register("word_ngram_buckets", WNG_SQL)
def word_ngram_buckets_q(spark, sf_dir):
    """STR-12: word bigram bucket ids of every document line (2,000,000 buckets)."""
    d = S.load(spark, sf_dir, "documents").select("doc_id", T.tokenize_ws(F.col("text"), eos_at_end=False).alias("tk"))
    b = d.select("doc_id", H.word_ngram_buckets(F.transform("tk", H.fnv1a), 2, 2_000_000).alias("bk"))
    return b.select("doc_id", F.size("bk").cast("bigint").alias("n"),
                    F.aggregate("bk", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("bucket_sum"),
                    F.array_join("bk", " ").alias("buckets"))


FEATURE_BUCKET = 1 << 16


@register("line_features", with_fixtures(f"""WITH {VOCAB_SQL},
nw AS (SELECT count(*) AS n FROM vocab WHERE type = 'word'),
tk AS (SELECT doc_id, unnest(tokens) AS word, generate_subscripts(tokens, 1) AS pos FROM toks),
dw AS (SELECT DISTINCT word FROM tk WHERE NOT starts_with(word, '__label__')),
sw AS (SELECT word, id, n, CAST({Q.fnv1a('word')} AS HUGEINT) AS h,
    list_transform({Q.char_ngram_strings('word', 3, 6)}, lambda sg: {Q.fnv1a('sg')} % {FEATURE_BUCKET}) AS b
  FROM dw LEFT JOIN vocab USING (word) CROSS JOIN nw),
wf AS (SELECT word, list_concat(CASE WHEN id IS NULL THEN []::BIGINT[] ELSE [CAST(id AS BIGINT)] END,
    CASE WHEN word = '</s>' THEN []::BIGINT[] ELSE list_transform(b, lambda x: x + n) END) AS ids,
  CASE WHEN h >= 2147483648 THEN h - 4294967296 + 18446744073709551616 ELSE h END AS u FROM sw),
ln AS (SELECT doc_id, flatten(list(ids ORDER BY pos)) AS ids, list(u ORDER BY pos) AS u FROM tk JOIN wf USING (word) GROUP BY doc_id),
ft AS (SELECT doc_id, list_concat(ids, list_transform(list_zip(u[1:len(u) - 1], u[2:]),
    lambda z: CAST(((z[1] * 116049371 + z[2]) % 18446744073709551616) % {FEATURE_BUCKET} AS BIGINT) + n)) AS f FROM ln CROSS JOIN nw),
lb AS (SELECT doc_id, string_agg(DISTINCT CAST(id - n AS VARCHAR), ' ') AS labels FROM tk JOIN vocab USING (word) CROSS JOIN nw
  WHERE type = 'label' GROUP BY doc_id)
SELECT doc_id, CAST(len(f) AS INTEGER) AS n_features, md5(array_to_string(f, ' ')) AS features_md5, coalesce(labels, '') AS labels
FROM ft LEFT JOIN lb USING (doc_id)""", "lines_all"))
def line_features_q(spark, sf_dir):
    """STR-14: feature ids of every labelled line (word ids and their 3..6
    sub-words, then word bigram buckets), as a digest of the ids in order, and its label ids."""
    from textlake.operators import models as M
    from textlake.operators import vocab as V
    args = M.Args(minn=3, maxn=6, word_ngrams=2, bucket=FEATURE_BUCKET, min_count=5)
    l = S.lines_all(spark, sf_dir).select("doc_id", T.tokenize_ws(F.col("line")).alias("tokens"))
    vocab = V.build_vocab(l, "tokens", 5, 1)
    nwords = vocab.filter(F.col("type") == "word").count()
    f = M.line_features(l, "doc_id", "tokens", vocab, args, nwords)
    return f.select("doc_id", F.size("features").alias("n_features"), F.md5(F.array_join("features", " ")).alias("features_md5"),
                    F.array_join("labels", " ").alias("labels"))


@register("text_vectors_mean", with_fixtures(f"""WITH {WORD_TABLE_SQL},
ex AS (SELECT doc_id, unnest({DOC_TOKS_SQL}) AS word FROM documents),
j AS (SELECT ex.doc_id, wt.vec FROM ex JOIN wt USING (word)),
nt AS (SELECT doc_id, count(*) AS n FROM j GROUP BY doc_id),
dims AS (SELECT j.doc_id, d.i, sum(vec[d.i]) / any_value(nt.n) AS m FROM j JOIN nt USING (doc_id),
    (SELECT unnest(range(1, 65)) AS i) d GROUP BY j.doc_id, d.i),
per AS (SELECT doc_id, sum(m) AS vsum, sqrt(sum(m * m)) AS vnorm FROM dims GROUP BY doc_id)
SELECT d.doc_id, round(coalesce(per.vsum, 0.0), 6) AS vsum, round(coalesce(per.vnorm, 0.0), 6) AS vnorm
FROM documents d LEFT JOIN per USING (doc_id)""", "lines_all"))
def text_vectors_mean(spark, sf_dir):
    """VEC-02(b): mean of the rows of the known words."""
    tv = VE.text_vectors(_doc_tokens(spark, sf_dir), "doc_id", "tokens", _word_table(spark, sf_dir), _dim(spark, sf_dir), "mean")
    return _summary(tv, "doc_id")


@register("analogy_raw_top3", with_fixtures(f"""WITH vv AS (SELECT word, CAST(vec AS DOUBLE[]) AS v FROM vectors),
qq AS (SELECT t.qid, t.a, t.b, t.c, list_transform(list_zip(va.v, vb.v, vc.v), lambda z: z[1] - z[2] + z[3]) AS v
  FROM triples t JOIN vv va ON va.word = t.a JOIN vv vb ON vb.word = t.b JOIN vv vc ON vc.word = t.c),
s AS (SELECT q.qid, o.word, {COS_SQL} AS sim FROM qq q, vv o WHERE o.word NOT IN (q.a, q.b, q.c)),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, word DESC) AS rank FROM s)
SELECT qid, CAST(rank AS INTEGER) AS rank, word, round(sim, 6) AS sim FROM r WHERE rank <= 3""", "vectors", "triples"))
def analogy_raw_top3(spark, sf_dir):
    """VEC-05 interactive form: A - B + C on raw vectors, the three banned."""
    v = S.vectors(spark, sf_dir).select("word", "vec")
    q = VE.analogy_queries(S.triples(spark, sf_dir), v, unit=False)
    nn = VE.nearest(q, v, k=3)
    return round_doubles(nn.select("qid", F.col("rank").cast("int").alias("rank"), "word", "sim"))
