"""Registered evaluation / quantization / fixed-model prediction queries
(AGG-06, AGG-07, FLT-07, QNT-01..05, MDL-05, TOP-03)."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlake.functions import arrays as A
from textlake.operators import evaluation as EV
from textlake.operators import quant as QN
from textlake.operators import vocab as V
from textlake.plans.queries_vocab import TOKS_SQL, VOCAB_SQL, _line_tokens
from textlake.plans.registry import register, round_doubles
from textlake.sources import tables as S
from textlake.sources.tables import with_fixtures

DSUB = 2


@register("confusion_matrix", with_fixtures("""SELECT y, prediction, count(*) AS n FROM predictions
GROUP BY y, prediction""", "predictions"))
def confusion_matrix(spark, sf_dir):
    return EV.confusion(S.predictions(spark, sf_dir))


@register("class_recall", with_fixtures("""SELECT 1 AS class, round(sum(CASE WHEN prediction = 1 THEN 1 ELSE 0 END) / count(*), 6)
  AS recall FROM predictions WHERE y = 1""", "predictions"))
def class_recall_q(spark, sf_dir):
    return round_doubles(EV.class_recall(S.predictions(spark, sf_dir), 1))


@register("misclassified", with_fixtures("""SELECT doc_id, y, prediction FROM predictions WHERE y <> prediction""",
                                         "predictions"))
def misclassified(spark, sf_dir):
    return EV.errors(S.predictions(spark, sf_dir)).select("doc_id", "y", "prediction")


def _pr_sql(k):
    return with_fixtures(f"""SELECT count(*) AS n,
  round(sum(len(list_filter(pred_labels[1:{k}], lambda p: list_contains(true_labels, p)))) / ({k} * count(*)), 6) AS p_at_{k},
  round(sum(len(list_filter(pred_labels[1:{k}], lambda p: list_contains(true_labels, p)))) / sum(len(true_labels)), 6)
    AS r_at_{k}
FROM predictions WHERE len(true_labels) > 0 AND len(words) > 0""", "predictions")


@register("precision_recall_at_1", _pr_sql(1))
def precision_recall_at_1(spark, sf_dir):
    return round_doubles(EV.precision_recall_at_k(S.predictions(spark, sf_dir), 1))


@register("precision_recall_at_2", _pr_sql(2))
def precision_recall_at_2(spark, sf_dir):
    return round_doubles(EV.precision_recall_at_k(S.predictions(spark, sf_dir), 2))


# ---------------------------------------------------------------------------
# QNT-02 / QNT-03 / QNT-04 with the fixed codebook (first 16 vectors)
# ---------------------------------------------------------------------------
ENCODE_SQL = """d AS (SELECT e.vec_id, c.sub, c.code,
    list_sum(list_transform(list_zip(CAST(e.embedding[c.sub * 2 + 1 : c.sub * 2 + 2] AS DOUBLE[]), CAST(c.centroid AS DOUBLE[])),
      lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS dist
  FROM embeddings e JOIN codebook c ON true),
best AS (SELECT vec_id, sub, arg_min(code, (dist, code)) AS code FROM d GROUP BY vec_id, sub),
enc AS (SELECT vec_id, list(code ORDER BY sub) AS codes FROM best GROUP BY vec_id)"""


def _codes(spark, sf_dir):
    e = S.load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("vec"))
    return QN.pq_encode(e, S.codebook(spark, sf_dir), DSUB)


@register("pq_encode", with_fixtures(f"""WITH {ENCODE_SQL}
SELECT vec_id AS row_id, array_to_string(codes, ' ') AS codes FROM enc""", "codebook"))
def pq_encode_q(spark, sf_dir):
    return _codes(spark, sf_dir).select("row_id", F.array_join("codes", " ").alias("codes"))


@register("pq_decode", with_fixtures(f"""WITH {ENCODE_SQL},
dec AS (SELECT b.vec_id, b.sub, c.centroid FROM best b JOIN codebook c USING (sub, code)),
per AS (SELECT vec_id, sum(list_sum(CAST(centroid AS DOUBLE[]))) AS vsum,
    sqrt(sum(list_dot_product(CAST(centroid AS DOUBLE[]), CAST(centroid AS DOUBLE[])))) AS vnorm,
    CAST(sum(len(centroid)) AS INTEGER) AS dim FROM dec GROUP BY vec_id)
SELECT vec_id AS row_id, round(vsum, 6) AS vsum, round(vnorm, 6) AS vnorm, dim FROM per""", "codebook"))
def pq_decode_q(spark, sf_dir):
    dec = QN.pq_decode(_codes(spark, sf_dir), S.codebook(spark, sf_dir))
    return round_doubles(dec.select("row_id", A.vec_sum(F.col("vec")).alias("vsum"),
                                    A.vec_norm(F.col("vec")).alias("vnorm"), F.size("vec").alias("dim")))


def _mean_vector(spark, sf_dir):
    e = S.load(spark, sf_dir, "embeddings")
    m = e.select(F.posexplode("embedding").alias("d", "x")).groupBy("d").agg(F.avg("x").alias("m"))
    return [r["m"] for r in m.orderBy("d").collect()]       # dim numbers


@register("pq_dot_mean_query", with_fixtures(f"""WITH {ENCODE_SQL},
q AS (SELECT i - 1 AS d, avg(CAST(e.embedding[i] AS DOUBLE)) AS m FROM embeddings e, (SELECT unnest(range(1, 65)) AS i) r
  GROUP BY i),
tab AS (SELECT c.sub, c.code, c.centroid[1] * q1.m + c.centroid[2] * q2.m AS dot FROM codebook c
  JOIN q q1 ON q1.d = c.sub * 2 JOIN q q2 ON q2.d = c.sub * 2 + 1)
SELECT b.vec_id AS row_id, round(sum(t.dot), 6) AS dot FROM best b JOIN tab t USING (sub, code) GROUP BY b.vec_id""",
                                               "codebook"))
def pq_dot_mean_query(spark, sf_dir):
    """QNT-04 with the mean embedding as the query vector."""
    return round_doubles(QN.pq_dot(_mean_vector(spark, sf_dir), _codes(spark, sf_dir), S.codebook(spark, sf_dir), DSUB))


@register("pq_lloyd_round", with_fixtures(f"""WITH {ENCODE_SQL},
m AS (SELECT b.sub, b.code, avg(CAST(e.embedding[b.sub * 2 + 1] AS DOUBLE)) AS m0, avg(CAST(e.embedding[b.sub * 2 + 2] AS DOUBLE)) AS m1
  FROM best b JOIN embeddings e USING (vec_id) GROUP BY b.sub, b.code)
SELECT CAST(sub AS INTEGER) AS sub, code, round(m0, 6) AS m0, round(m1, 6) AS m1 FROM m""", "codebook"))
def pq_lloyd_round(spark, sf_dir):
    """QNT-01: one Lloyd round over all rows from a given codebook."""
    e = S.load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("vec"))
    cb = QN.pq_train(e, DSUB, niter=1, start=S.codebook(spark, sf_dir))
    return round_doubles(cb.select("sub", "code", F.col("centroid")[0].alias("m0"), F.col("centroid")[1].alias("m1")))


@register("pq_train_codebook")
def pq_train_codebook(spark, sf_dir):
    """QNT-01: 256 centroids per 2-dim part, 25 Lloyd rounds (rows-only)."""
    e = S.load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("vec"))
    cb = QN.pq_train(e, DSUB)
    return cb.select("sub", "code", A.vec_sum(F.col("centroid")).alias("csum"))


@register("pq_train_unit_norms")
def pq_train_unit_norms(spark, sf_dir):
    """QNT-05: unit rows and norms quantized apart (norm codebook of 1-dim
    parts); returns each row's reconstructed norm code and unit codes."""
    e = S.load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("vec"))
    unit, norms = QN.quantize_norms(e)
    ucb = QN.pq_train(unit, DSUB, niter=5)
    ncb = QN.pq_train(norms, 1, niter=5)
    uc = QN.pq_encode(unit, ucb, DSUB)
    nc = QN.pq_encode(norms, ncb, 1).select("row_id", F.get("codes", 0).alias("norm_code"))
    return uc.join(nc, "row_id").select("row_id", "norm_code", F.array_join("codes", " ").alias("codes"))


@register("prune_by_norm", """WITH r AS (SELECT vec_id, CASE WHEN vec_id = 0 THEN 1 ELSE 0 END AS eos,
    sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS nrm FROM embeddings)
SELECT vec_id AS row_id, CAST(row_number() OVER (ORDER BY eos DESC, nrm DESC, vec_id) - 1 AS BIGINT) AS new_id
FROM r ORDER BY eos DESC, nrm DESC, vec_id LIMIT 100""")
def prune_by_norm_q(spark, sf_dir):
    """TOP-03: keep the 100 largest-norm rows, row 0 (end of line) first."""
    e = S.load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("vec"))
    return QN.prune_by_norm(e, 100).select("row_id", "new_id")


# ---------------------------------------------------------------------------
# MDL-05 prediction with a fixed model derived from the tables
# ---------------------------------------------------------------------------
def fixed_model(spark, sf_dir):
    """Dictionary = vocabulary of the labelled lines; input row of word id w
    = embedding (w mod n); output rows: __label__0 / __label__1 = the last
    two embeddings."""
    emb = S.load(spark, sf_dir, "embeddings")
    n = emb.count()
    toks = _line_tokens(spark, sf_dir)
    vocab = V.build_vocab(toks, "tokens", 5, 1).filter(F.col("type") == "word")
    rows = vocab.join(emb, F.pmod(vocab["id"], n) == emb["vec_id"]).select("word", F.col("embedding").alias("vec"))
    out = emb.filter(F.col("vec_id") >= n - 2).select(
        F.concat(F.lit("__label__"), (F.lit(n - 1) - F.col("vec_id")).cast("string")).alias("label"),
        F.col("embedding").alias("vec"))
    return toks, rows, out


@register("predict_fixed_model", with_fixtures(f"""WITH {VOCAB_SQL},
ne AS (SELECT count(*) AS n FROM embeddings),
rows AS (SELECT v.word, CAST(e.embedding AS DOUBLE[]) AS vec FROM vocab v JOIN embeddings e
  ON e.vec_id = v.id % (SELECT n FROM ne) WHERE v.type = 'word'),
outr AS (SELECT '__label__' || CAST((SELECT n FROM ne) - 1 - vec_id AS VARCHAR) AS label, CAST(embedding AS DOUBLE[]) AS w
  FROM embeddings WHERE vec_id >= (SELECT n FROM ne) - 2),
ex AS (SELECT t.doc_id, r.vec FROM (SELECT doc_id, unnest(tokens) AS word FROM toks) t JOIN rows r USING (word)),
hid AS (SELECT doc_id, d.i, avg(vec[d.i]) AS h FROM ex, (SELECT unnest(range(1, 65)) AS i) d GROUP BY doc_id, d.i),
hv AS (SELECT doc_id, list(h ORDER BY i) AS hvec FROM hid GROUP BY doc_id),
allh AS (SELECT t.doc_id, coalesce(hv.hvec, list_transform(range(64), lambda z: 0.0)) AS hvec FROM toks t
  LEFT JOIN hv USING (doc_id)),
lg AS (SELECT a.doc_id, o.label, list_dot_product(a.hvec, o.w) AS z FROM allh a, outr o),
sm AS (SELECT doc_id, label, exp(z - max(z) OVER (PARTITION BY doc_id)) AS ez FROM lg),
pr AS (SELECT doc_id, label, ez / sum(ez) OVER (PARTITION BY doc_id) AS prob FROM sm)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY prob DESC, label) AS INTEGER) AS rank, label,
  round(prob, 6) AS prob FROM pr""", "lines_all"))
def predict_fixed_model(spark, sf_dir):
    toks, rows, out = fixed_model(spark, sf_dir)
    hidden = EV.sentence_hidden(toks, "doc_id", "tokens", rows, 64)
    return round_doubles(EV.predict(hidden, "doc_id", out, k=2))
