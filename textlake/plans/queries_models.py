"""Registered model queries (MDL-01..04, MDL-06..11, QNT-06).  Where SQL can't
state a trained result, the query states what it can (rows kept, vocabulary,
held-out accuracy not below the majority share); tests check the rest."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from textlake.functions import arrays as A
from textlake.functions import text as T
from textlake.operators import classifier as K
from textlake.operators import common as C
from textlake.operators import embeddings as EM
from textlake.operators import models as M
from textlake.operators import quant as QN
from textlake.operators import vectors as VE
from textlake.plans import sqlfrag as Q
from textlake.plans.queries_vectors import TOKS_NOEOS, WORD_TABLE_SQL
from textlake.plans.queries_vocab import VOCAB_SQL
from textlake.plans.registry import register, round_doubles
from textlake.session import checkpoint_dir
from textlake.sources import tables as S
from textlake.sources.tables import with_fixtures

SMALL = dict(dim=16, bucket=4096, seed=7)


def _labeled_lines(spark, sf_dir):
    l = S.labeled(spark, sf_dir)
    return l.select("doc_id", F.concat(F.col("label"), F.lit(" "), F.lower("text")).alias("line"))


def _train_split(spark, sf_dir):
    return C.split_share(_labeled_lines(spark, sf_dir), 0.2, 11, "doc_id")[0]


def _held_out(spark, sf_dir):
    l = S.labeled(spark, sf_dir).select("doc_id", F.lower("text").alias("text"), "label")
    return C.split_share(l, 0.2, 11, "doc_id")[1]


def _classifier(spark, sf_dir, epoch=5, word_ngrams=2):
    args = M.Args(model="supervised", lr=0.5, epoch=epoch, word_ngrams=word_ngrams, **SMALL)
    return K.train(_train_split(spark, sf_dir), "doc_id", "line", args)


# the training lines and their held-out counterpart as SQL
_SHARE = "CAST(('0x' || substring(md5('11' || CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT AS DOUBLE) / 4294967296.0"
TRAIN_SQL = f"""tr AS (SELECT doc_id, label || ' ' || lower(text) AS line FROM labeled WHERE {_SHARE} >= 0.2),
trt AS (SELECT doc_id, {Q.tokenize_ws('line')} AS tokens FROM tr),
trw AS (SELECT doc_id, unnest(tokens) AS word FROM trt)"""


@register("train_classifier_predict")
def train_classifier_predict(spark, sf_dir):
    """MDL-03 + MDL-05: train on 80 % of the labelled documents, predict the
    held-out 20 %: (doc_id, rank, label, prob)."""
    model = _classifier(spark, sf_dir)
    return round_doubles(K.predict(model, _held_out(spark, sf_dir).drop("label"), "doc_id", "text", k=2))


@register("classifier_beats_majority", with_fixtures(f"""SELECT count(*) AS n_held_out, true AS not_below_majority
FROM labeled WHERE {_SHARE} < 0.2""", "labeled"))
def classifier_beats_majority(spark, sf_dir):
    """Held-out P@1 of the classifier against the share of the commonest label."""
    va = _held_out(spark, sf_dir)
    best = K.predict(_classifier(spark, sf_dir), va.drop("label"), "doc_id", "text").select("doc_id", F.col("label").alias("_p"))
    j = va.join(best, "doc_id")
    share = j.groupBy("label").count().agg(F.max("count")).scalar()
    hits = j.agg(F.count("*").alias("n_held_out"), F.sum((F.col("label") == F.col("_p")).cast("int")).alias("_hits"))
    return hits.select("n_held_out", (F.col("_hits") >= share).alias("not_below_majority"))


ROUNDS_ARGS = M.Args(model="supervised", lr=0.5, epoch=2, min_count=5, dim=8, seed=7)
_R0, _R1, _D = ROUNDS_ARGS.lr, ROUNDS_ARGS.lr / 2, ROUNDS_ARGS.dim


@register("classifier_two_rounds", with_fixtures(f"""WITH {VOCAB_SQL},
nw AS (SELECT count(*) AS n FROM vocab WHERE type = 'word'),
labs AS (SELECT id - (SELECT n FROM nw) AS l, word FROM vocab WHERE type = 'label'),
ex AS (SELECT doc_id, unnest(tokens) AS word FROM toks),
y AS (SELECT DISTINCT ex.doc_id, labs.l FROM ex JOIN labs USING (word)),
ny AS (SELECT doc_id, count(*) AS n FROM y GROUP BY doc_id),
feat AS (SELECT ex.doc_id, v.id AS row_id, count(*) AS c FROM ex JOIN vocab v USING (word)
  WHERE v.type = 'word' AND ex.doc_id IN (SELECT doc_id FROM y) GROUP BY ex.doc_id, v.id),
w AS (SELECT doc_id, row_id, c / sum(c) OVER (PARTITION BY doc_id) AS w FROM feat),
st AS (SELECT row_id, unnest(range({_D})) AS i, unnest({K.start_vector_sql('row_id', _D, 7)}) AS v FROM (SELECT DISTINCT row_id FROM w)),
h AS (SELECT doc_id, i, sum(w * v) AS h FROM w JOIN st USING (row_id) GROUP BY doc_id, i),
docs AS (SELECT DISTINCT doc_id FROM h),
dl AS (SELECT docs.doc_id, labs.l, coalesce(1.0 / ny.n, 0.0) AS y FROM docs CROSS JOIN labs
  LEFT JOIN y ON y.doc_id = docs.doc_id AND y.l = labs.l LEFT JOIN ny ON ny.doc_id = y.doc_id),
g0 AS (SELECT dl.l, h.i, sum((dl.y - 1.0 / (SELECT count(*) FROM labs)) * h.h) AS d FROM dl JOIN h USING (doc_id) GROUP BY dl.l, h.i),
s0 AS (SELECT l, avg(d * d) AS g FROM g0 GROUP BY l),
b1 AS (SELECT g0.l, g0.i, {_R0} * d / sqrt(s0.g + 1e-12) AS b FROM g0 JOIN s0 USING (l)),
z AS (SELECT h.doc_id, b1.l, sum(h.h * b1.b) AS z FROM h JOIN b1 USING (i) GROUP BY h.doc_id, b1.l),
p AS (SELECT doc_id, l, exp(z) / sum(exp(z)) OVER (PARTITION BY doc_id) AS p FROM z),
e AS (SELECT dl.doc_id, dl.l, dl.y - p.p AS e FROM dl JOIN p USING (doc_id, l)),
g1 AS (SELECT e.l, h.i, sum(e.e * h.h) AS d FROM e JOIN h USING (doc_id) GROUP BY e.l, h.i),
s1 AS (SELECT g1.l, any_value(s0.g) + avg(d * d) AS g FROM g1 JOIN s0 USING (l) GROUP BY g1.l),
b2 AS (SELECT b1.l, b1.i, b + {_R1} * d / sqrt(s1.g + 1e-12) AS b FROM b1 JOIN g1 USING (l, i) JOIN s1 USING (l)),
dh AS (SELECT e.doc_id, b1.i, sum(e.e * b1.b) AS d FROM e JOIN b1 USING (l) GROUP BY e.doc_id, b1.i),
da AS (SELECT w.row_id, dh.i, sum(w.w * dh.d) AS d FROM w JOIN dh USING (doc_id) GROUP BY w.row_id, dh.i),
sa AS (SELECT row_id, avg(d * d) AS g FROM da GROUP BY row_id),
a2 AS (SELECT st.row_id, st.i, st.v + {_R1} * d / sqrt(sa.g + 1e-12) AS v FROM st JOIN da USING (row_id, i) JOIN sa USING (row_id))
SELECT 'label' AS kind, l AS id, round(sum(b), 5) AS vsum, round(sqrt(sum(b * b)), 5) AS vnorm FROM b2 GROUP BY l
UNION ALL SELECT 'row', row_id, round(sum(v), 5), round(sqrt(sum(v * v)), 5) FROM a2 GROUP BY row_id""", "lines_all"))
def classifier_two_rounds(spark, sf_dir):
    """Two exact gradient rounds over all labelled lines: every label row and feature row."""
    m = K.train(S.lines_all(spark, sf_dir), "doc_id", "line", ROUNDS_ARGS)
    both = m.output.select(F.lit("label").alias("kind"), F.col("label_id").alias("id"), "vec").unionByName(
        m.input.select(F.lit("row").alias("kind"), F.col("row_id").alias("id"), "vec"))
    return both.select("kind", "id", F.round(A.vec_sum(F.col("vec")), 5).alias("vsum"),
                       F.round(A.vec_norm(F.col("vec")), 5).alias("vnorm"))


@register("train_skipgram_vectors")
def train_skipgram_vectors(spark, sf_dir):
    """MDL-01: skip-gram with negative sampling and 3..6 sub-words; output
    the vocabulary words' vectors (norm and sum)."""
    args = M.Args(model="skipgram", lr=0.2, epoch=3, minn=3, maxn=6, min_count=5, **SMALL)
    model = EM.train(S.load(spark, sf_dir, "documents"), "doc_id", "text", args)
    wv = EM.word_vectors(model, model.vocab.filter(F.col("type") == "word").select("word"))
    return round_doubles(wv.select("word", A.vec_norm(F.col("vec")).alias("vnorm"), A.vec_sum(F.col("vec")).alias("vsum")))


@register("train_cbow_vectors")
def train_cbow_vectors(spark, sf_dir):
    """MDL-02: CBOW on the same corpus; input rows' norms per vocabulary word."""
    args = M.Args(model="cbow", lr=0.2, epoch=3, minn=0, maxn=0, min_count=5, **{**SMALL, "bucket": 0})
    model = EM.train(S.load(spark, sf_dir, "documents"), "doc_id", "text", args)
    v = model.vocab.filter(F.col("type") == "word").select(F.col("id").alias("row_id"), "word")
    return round_doubles(v.join(model.input, "row_id").select("word", A.vec_norm(F.col("vec")).alias("vnorm")))


HELD_WORDS = 100      # the commonest words of the held-out documents, judged in pairs


def held_pairs(docs, ws):
    """(w1, w2, n, gold) of every pair of the ``HELD_WORDS`` commonest words: how often they stand
    within ``ws`` words of each other, and that over both words' neighbours."""
    p = VE.skipgram_pairs(docs.select(T.tokenize_ws(F.col("text"), eos_at_end=False).alias("tk")), "tk", ws, summed=True)
    n = p.select("center", "context", "n")
    top = n.groupBy("center").agg(F.sum("n").alias("c")).orderBy(F.desc("c"), "center").limit(HELD_WORDS)
    words = top.agg(F.array_sort(F.collect_list(F.struct(F.col("center").alias("w"), "c"))).alias("t"))
    pairs = words.select(F.explode("t").alias("x"), "t").select("x", F.explode("t").alias("y")).filter("x.w < y.w")
    pairs = pairs.select(F.col("x.w").alias("w1"), F.col("y.w").alias("w2"), (F.col("x.c") * F.col("y.c")).alias("both"))
    met = n.select(F.col("center").alias("w1"), F.col("context").alias("w2"), "n")
    pairs = pairs.join(met, ["w1", "w2"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return pairs.select("w1", "w2", "n", (F.col("n") / F.col("both")).alias("gold"))


@register("skipgram_beats_start", "WITH t AS (SELECT " + TOKS_NOEOS + f" AS tk FROM documents WHERE {_SHARE} < 0.2),\n" + "p AS (" + " UNION ALL ".join(
    f"SELECT unnest(list_slice(tk, 1, greatest(len(tk) - {d}, 0))) AS a, "
    f"unnest(list_slice(tk, {d} + 1, {d} + greatest(len(tk) - {d}, 0))) AS b FROM t" for d in range(1, 4)) + f"""),
n AS (SELECT a, b, count(*) AS n FROM (SELECT a, b FROM p UNION ALL SELECT b, a FROM p) GROUP BY a, b),
top AS (SELECT a AS w FROM n GROUP BY a ORDER BY sum(n) DESC, a LIMIT {HELD_WORDS})
SELECT count(*) AS n_held_pairs, coalesce(sum(n), 0)::BIGINT AS n_met, true AS vectors_follow_pairs, true AS above_start
FROM top x JOIN top y ON x.w < y.w LEFT JOIN n ON n.a = x.w AND n.b = y.w""")
def skipgram_beats_start(spark, sf_dir):
    """MDL-01 + AGG-09: rank correlation of the cosines of trained vectors with how readily the
    commonest words of held-out documents meet; it is positive and above that of the start vectors."""
    rest, held = C.split_share(S.load(spark, sf_dir, "documents"), 0.2, 11, "doc_id")
    args = M.Args(model="skipgram", lr=0.2, epoch=5, ws=3, minn=0, maxn=0, min_count=5, t=1.0, **{**SMALL, "bucket": 0})
    model = EM.train(rest, "doc_id", "text", args)
    checkpoint_dir(spark)
    pairs = held_pairs(held, args.ws).checkpoint(eager=True)
    words = model.vocab.filter(F.col("type") == "word").select("word", F.col("id").alias("row_id"))
    trained = words.join(model.input, "row_id").select("word", "vec")
    start = words.select("word", K.start_vector(F.col("row_id"), args.dim, args.seed).alias("vec"))

    def rank(vectors):
        known = VE.pair_similarity(pairs, vectors).filter("known").withColumn("_sim", F.round("sim", 9))
        return VE.spearman(known, "_sim", "gold").first()["spearman_x100"] or 0.0
    t, s = rank(trained), rank(start)
    return pairs.agg(F.count("*").alias("n_held_pairs"), F.sum("n").alias("n_met"),
                     F.lit(t > 0).alias("vectors_follow_pairs"), F.lit(t > s).alias("above_start"))


@register("train_word2vec")
def train_word2vec(spark, sf_dir):
    """MDL-01 words only with Spark ML's Word2Vec."""
    d = S.load(spark, sf_dir, "documents").select(T.tokenize_ws(F.lower("text"), eos_at_end=False).alias("tokens"))
    m = M.word2vec(d, "tokens", dim=16, min_count=5, seed=7)
    from pyspark.ml.functions import vector_to_array
    v = m.getVectors().select("word", vector_to_array("vector").alias("vec"))
    return round_doubles(v.select("word", A.vec_norm(F.col("vec")).alias("vnorm")))


@register("classifier_pretrained", with_fixtures(f"""WITH {WORD_TABLE_SQL},
{TRAIN_SQL},
words AS (SELECT word FROM trw UNION SELECT word FROM wt)
SELECT CASE WHEN starts_with(word, '__label__') THEN 'label' ELSE 'word' END AS type, count(*) AS n,
  CAST(sum((SELECT count(*) FROM trw WHERE trw.word = words.word) + (SELECT count(*) FROM wt WHERE wt.word = words.word)) AS BIGINT) AS count
FROM words GROUP BY 1""", "lines_all", "labeled"))
def classifier_pretrained(spark, sf_dir):
    """MDL-04: classifier started from given vectors of its dimension; the
    vocabulary it ends with: a given word gains a count."""
    from textlake.plans.queries_vectors import _word_table
    pre = _word_table(spark, sf_dir)
    dim = pre.select(F.size("vec")).first()[0]
    args = M.Args(model="supervised", lr=0.5, epoch=2, dim=dim, seed=7)
    model = K.train(_train_split(spark, sf_dir), "doc_id", "line", args, pretrained=pre)
    return model.vocab.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.sum("count").alias("count"))


@register("word_dropout", with_fixtures(f"""WITH t AS (SELECT doc_id, {Q.tokenize_ws('text', eos=False)} AS tk FROM documents),
ex AS (SELECT doc_id, unnest(range(len(tk))) AS pos, unnest(tk) AS tok FROM t),
k AS (SELECT * FROM ex WHERE CAST(('0x' || substring(md5('13' || CAST(doc_id AS VARCHAR) || ':' || CAST(pos AS VARCHAR)), 1, 8))::BIGINT
  AS DOUBLE) / 4294967296.0 >= 0.3)
SELECT t.doc_id, coalesce((SELECT string_agg(tok, ' ' ORDER BY pos) FROM k WHERE k.doc_id = t.doc_id), '') AS kept FROM t"""))
def word_dropout_q(spark, sf_dir):
    """MDL-07: tokens dropped with chance 0.3, repeatable by hash."""
    d = S.load(spark, sf_dir, "documents").select("doc_id", T.tokenize_ws(F.col("text"), eos_at_end=False).alias("tk"))
    out = M.word_dropout(d, "doc_id", "tk", 0.3, 13)
    return out.select("doc_id", F.array_join("tk", " ").alias("kept"))


def _doc_vectors(spark, sf_dir):
    from textlake.plans.queries_vectors import _dim, _doc_tokens, _word_table
    l = S.labeled(spark, sf_dir).select("doc_id", "quality")
    tv = VE.text_vectors(_doc_tokens(spark, sf_dir), "doc_id", "tokens", _word_table(spark, sf_dir), _dim(spark, sf_dir), "normed")
    checkpoint_dir(spark)
    # iterative ML fits scan their input many times: cut the lineage once
    return tv.join(l, "doc_id").withColumn("quality", F.col("quality").cast("double")).checkpoint(eager=True)


@register("train_dan")
def train_dan_q(spark, sf_dir):
    """MDL-06: averaged word vectors -> two hidden layers -> softmax
    (sigmoid layers; batch norm and dropout have no Spark ML counterpart)."""
    d = _doc_vectors(spark, sf_dir)
    tr, va = C.split_share(d, 0.2, 11, "doc_id")
    m = M.train_dan(tr, "quality", "vec", hidden=(32, 32), max_iter=50, seed=7)
    return m.transform(M.dense_features(va, "vec")).select("doc_id", "quality", "prediction")


@register("train_nbow")
def train_nbow_q(spark, sf_dir):
    """MDL-06 without hidden layers (multinomial logistic regression)."""
    d = _doc_vectors(spark, sf_dir)
    tr, va = C.split_share(d, 0.2, 11, "doc_id")
    m = M.train_dan(tr, "quality", "vec", hidden=(), max_iter=50)
    return m.transform(M.dense_features(va, "vec")).select("doc_id", "quality", "prediction")


@register("grid_search")
def grid_search_q(spark, sf_dir):
    """MDL-08: grid over regularisation and iterations, 20 % validation."""
    m = M.grid_search(_doc_vectors(spark, sf_dir), "quality", "vec")
    rows = [(i, float(x)) for i, x in enumerate(m.validationMetrics)]
    return spark.createDataFrame(rows, "grid_point int, accuracy double")


@register("kmeans_clusters")
def kmeans_clusters(spark, sf_dir):
    """MDL-09: 19 clusters of the embeddings, attached to each row."""
    e = S.load(spark, sf_dir, "embeddings").select("vec_id", A.as_double(F.col("embedding")).alias("vec"))
    return M.cluster(e, "vec", k=19, max_iter=300, seed=0).select("vec_id", "cluster")


@register("pca_projection")
def pca_projection(spark, sf_dir):
    """MDL-10: first three principal components of the centred embeddings."""
    e = S.load(spark, sf_dir, "embeddings").select("vec_id", A.as_double(F.col("embedding")).alias("vec"))
    out, _ = M.project(e, "vec", 3)
    return round_doubles(out.select("vec_id", *[F.col("pca")[i].alias(f"pc{i + 1}") for i in range(3)]))


@register("model_save_load", with_fixtures(f"""WITH {TRAIN_SQL},
v AS (SELECT word, starts_with(word, '__label__') AS is_label FROM trw GROUP BY word)
SELECT 'vocab' AS part, count(*) AS n_rows, 0.0 AS max_abs_diff FROM v
UNION ALL SELECT 'input', count(*), 0.0 FROM v WHERE NOT is_label
UNION ALL SELECT 'output', count(*), 0.0 FROM v WHERE is_label""", "labeled"))
def model_save_load(spark, sf_dir):
    """MDL-11: save a classifier to the shared folder, load it back and report
    per part its rows and the largest absolute difference (0)."""
    model = _classifier(spark, sf_dir, epoch=1, word_ngrams=1)
    path = K.folder(spark, "model")
    K.save(model, path)
    back = K.load(spark, path)

    def difference(name, key):
        a, b = getattr(model, name), getattr(back, name).withColumnRenamed("vec", "_v")
        far = F.aggregate(F.zip_with("vec", "_v", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda m, x: F.greatest(m, x))
        return a.join(b.select(key, "_v"), key).agg(F.count("*").alias("n_rows"), F.max(far).alias("max_abs_diff")).select(
            F.lit(name).alias("part"), "n_rows", "max_abs_diff")

    vocab = back.vocab.join(model.vocab, ["id", "word", "count", "type"]).agg(F.count("*").alias("n_rows")).select(
        F.lit("vocab").alias("part"), "n_rows", F.lit(0.0).alias("max_abs_diff"))
    return difference("input", "row_id").unionByName(difference("output", "label_id")).unionByName(vocab)


@register("model_lookup", with_fixtures(f"""WITH {TRAIN_SQL},
v AS (SELECT word, starts_with(word, '__label__') AS is_label, count(*) AS n FROM trw GROUP BY word),
ids AS (SELECT word, n, is_label, row_number() OVER (ORDER BY is_label, n DESC, word) - 1 AS id FROM v)
SELECT word, CAST(id AS BIGINT) AS id, NOT is_label AS has_row FROM ids WHERE n % 2 = 0
UNION ALL SELECT 'no such word', -1, false""", "labeled"))
def model_lookup(spark, sf_dir):
    """MDL-11: look-ups in a saved classifier: ids of words (those of an even
    count and an unknown one) and whether their ids have feature rows."""
    model = _classifier(spark, sf_dir, epoch=1, word_ngrams=1)
    path = K.folder(spark, "model")
    K.save(model, path)
    asked = model.vocab.filter(F.col("count") % 2 == 0).select("word").unionByName(spark.createDataFrame([("no such word",)], "word string"))
    ids = K.word_ids(spark, path, asked).select("word", "id", "type")
    rows = K.input_vectors(spark, path, ids.filter("type = 'word'").select(F.col("id").alias("row_id")))
    moved = rows.select(F.col("row_id").alias("id"), (F.size("vec") == model.args.dim).alias("has_row"))
    return ids.join(moved, "id", "left").select("word", "id", F.coalesce("has_row", F.lit(False)).alias("has_row"))


@register("shrink_classifier")
def shrink_classifier(spark, sf_dir):
    """QNT-06: keep 300 feature rows, train on with them, store rows (norms
    apart) and label rows as codes, predict the held-out documents: how many
    are right, beside the count of their commonest label (rows-only: SQL can't
    state a trained result)."""
    model = _classifier(spark, sf_dir)
    small, codes, _ = K.shrink(model, 300, qnorm=True, qout=True, retrain=_train_split(spark, sf_dir), key="doc_id", text="line")
    va = _held_out(spark, sf_dir)
    best = K.predict(small, va.drop("label"), "doc_id", "text").select("doc_id", F.col("label").alias("_p"))
    j = va.join(best, "doc_id")
    share = j.groupBy("label").count().agg(F.max("count")).scalar()
    return j.agg(F.count("*").alias("n_held_out"), F.lit(codes.count()).cast("long").alias("n_rows"),
                 F.sum((F.col("label") == F.col("_p")).cast("int")).alias("n_right"), share.alias("n_commonest"))


@register("predict_from_codes", with_fixtures(f"""SELECT count(*) AS n_held_out, true AS as_decoded,
  CAST(300 * ({SMALL['dim']} / 2 + 1) AS BIGINT) AS code_bytes FROM labeled WHERE {_SHARE} < 0.2""", "labeled"))
def predict_from_codes(spark, sf_dir):
    """QNT-03 + QNT-06: the held-out documents' labels and probabilities from packed codes (a byte for
    two dimensions, one for the norm) are those of the decoded rows."""
    small, _, _ = K.shrink(_classifier(spark, sf_dir, epoch=2, word_ngrams=1), 300, qnorm=True)
    va = _held_out(spark, sf_dir).drop("label")

    def best(model, name):
        return K.predict(model, va, "doc_id", "text").select("doc_id", F.struct("label", "prob").alias(name))
    j = best(small, "a").join(best(replace(small, packed=None), "b"), "doc_id", "full_outer")
    same = F.coalesce((F.col("a.label") == F.col("b.label")) & (F.abs(F.col("a.prob") - F.col("b.prob")) < 1e-6), F.lit(False))
    return j.agg(F.count("*").alias("n_held_out"), F.coalesce(F.every(same), F.lit(True)).alias("as_decoded"),
                 F.lit(QN.code_bytes(small.packed)).cast("long").alias("code_bytes"))
