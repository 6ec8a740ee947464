"""Registered vocabulary / n-gram / TF-IDF / sampling / hashing queries
(AGG-03..05, AGG-11..13, TXT-01..05, JOIN-04, JOIN-07, ARR-01/02, TOP-04,
TOP-06/07, SET-01/03, WIN-06, STR-10/11/13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlake.functions import hashing as H
from textlake.functions import text as T
from textlake.operators import common as C
from textlake.operators import ngrams as N
from textlake.operators import vocab as V
from textlake.plans import sqlfrag as Q
from textlake.plans.registry import register, round_doubles
from textlake.sources import tables as S
from textlake.sources.tables import with_fixtures

MIN_COUNT = 5
BUCKET = 2_000_000      # the library's default bucket count
MINN, MAXN = 3, 6       # the library's default sub-word lengths for skip-gram


def _line_tokens(spark, sf_dir):
    return S.lines_all(spark, sf_dir).select("doc_id", T.tokenize_ws(F.col("line")).alias("tokens"))


def _vocab(spark, sf_dir):
    return V.build_vocab(_line_tokens(spark, sf_dir), "tokens", MIN_COUNT, 1)


TOKS_SQL = f"toks AS (SELECT doc_id, {Q.tokenize_ws('line')} AS tokens FROM lines_all)"
VOCAB_SQL = f"""{TOKS_SQL},
cnt AS (SELECT word, count(*) AS count, CASE WHEN starts_with(word, '__label__') THEN 'label' ELSE 'word' END AS type
  FROM (SELECT unnest(tokens) AS word FROM toks) GROUP BY word),
vocab AS (SELECT row_number() OVER (ORDER BY CASE WHEN type = 'label' THEN 1 ELSE 0 END, count DESC, word) - 1 AS id,
    word, count, type FROM cnt WHERE (type = 'label' AND count >= 1) OR (type = 'word' AND count >= {MIN_COUNT}))"""


@register("build_vocab", with_fixtures(f"WITH {VOCAB_SQL} SELECT id, word, count, type FROM vocab", "lines_all"))
def build_vocab_q(spark, sf_dir):
    return _vocab(spark, sf_dir)


@register("corpus_stats", with_fixtures(f"""WITH {TOKS_SQL}
SELECT CAST(sum(len(tokens)) AS BIGINT) AS ntokens,
  CAST(sum(len(list_filter(tokens, lambda x: NOT starts_with(x, '__label__')))) AS BIGINT) AS nwords_tokens,
  CAST(sum(len(list_filter(tokens, lambda x: starts_with(x, '__label__')))) AS BIGINT) AS nlabel_tokens,
  count(*) AS nlines, CAST(max(len(tokens)) AS BIGINT) AS longest FROM toks""", "lines_all"))
def corpus_stats_q(spark, sf_dir):
    return V.corpus_stats(_line_tokens(spark, sf_dir), "tokens")


@register("keep_probability", with_fixtures(f"""WITH {VOCAB_SQL},
tot AS (SELECT sum(len(tokens)) AS n FROM toks)
SELECT id, word, round(least(1.0, sqrt(1e-4 / (count / (SELECT n FROM tot))) + 1e-4 / (count / (SELECT n FROM tot))), 6)
  AS keep_prob FROM vocab WHERE type = 'word'""", "lines_all"))
def keep_probability_q(spark, sf_dir):
    toks = _line_tokens(spark, sf_dir)
    ntok = toks.select(F.sum(F.size("tokens"))).scalar()
    return round_doubles(V.keep_probability(V.build_vocab(toks, "tokens", MIN_COUNT, 1), ntok))


@register("negative_distribution", with_fixtures(f"""WITH {VOCAB_SQL}
SELECT id, word, round(sqrt(count) / (SELECT sum(sqrt(count)) FROM vocab WHERE type = 'word'), 6) AS p_negative
FROM vocab WHERE type = 'word'""", "lines_all"))
def negative_distribution_q(spark, sf_dir):
    return round_doubles(V.negative_distribution(_vocab(spark, sf_dir)))


@register("label_counts", with_fixtures(f"""WITH {TOKS_SQL}
SELECT word AS label, count(*) AS count FROM (SELECT unnest(tokens) AS word FROM toks)
WHERE starts_with(word, '__label__') GROUP BY word""", "lines_all"))
def label_counts_q(spark, sf_dir):
    return V.label_counts(_line_tokens(spark, sf_dir), "tokens")


@register("top_words", with_fixtures(f"""WITH {VOCAB_SQL}
SELECT id, word, count, type FROM vocab WHERE type = 'word' ORDER BY count DESC, word LIMIT 100""", "lines_all"))
def top_words_q(spark, sf_dir):
    return V.top_words(_vocab(spark, sf_dir), 100)


# ---------------------------------------------------------------------------
# JOIN-04 / ARR-01 / JOIN-07: encode, pad to 140 at the front, decode
# ---------------------------------------------------------------------------
ENC_SQL = f"""{VOCAB_SQL},
ex AS (SELECT doc_id, unnest(range(len(tokens))) AS pos, unnest(tokens) AS word FROM toks),
enc AS (SELECT t.doc_id, coalesce((SELECT list(v.id ORDER BY e.pos) FROM ex e JOIN vocab v USING (word)
                                   WHERE e.doc_id = t.doc_id), []) AS ids FROM toks t)"""


@register("encode_tokens", with_fixtures(f"""WITH {ENC_SQL}
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_ids, array_to_string(ids, ' ') AS ids FROM enc""", "lines_all"))
def encode_tokens_q(spark, sf_dir):
    toks = _line_tokens(spark, sf_dir)
    e = V.encode_tokens(toks, "doc_id", "tokens", V.build_vocab(toks, "tokens", MIN_COUNT, 1))
    return e.select("doc_id", F.size("ids").cast("bigint").alias("n_ids"), F.array_join("ids", " ").alias("ids"))


# word ids from 1: the padding id 0 is no word
ENC1_SQL = "SELECT doc_id, list_transform(ids, lambda z: z + 1) AS ids FROM enc"
PAD_SQL = "CASE WHEN len(ids) >= 140 THEN ids[len(ids) - 139:] ELSE list_concat(list_transform(range(140 - len(ids)), lambda z: 0), ids) END"


@register("pad_sequences", with_fixtures(f"""WITH {ENC_SQL}
SELECT doc_id, array_to_string({PAD_SQL}, ' ') AS padded FROM ({ENC1_SQL})""", "lines_all"))
def pad_sequences_q(spark, sf_dir):
    toks = _line_tokens(spark, sf_dir)
    e = V.encode_tokens(toks, "doc_id", "tokens", V.build_vocab(toks, "tokens", MIN_COUNT, 1), offset=1)
    return e.select("doc_id", F.array_join(V.pad(F.col("ids"), 140), " ").alias("padded"))


@register("decode_tokens", with_fixtures(f"""WITH {ENC_SQL},
pd AS (SELECT doc_id, {PAD_SQL} AS p FROM ({ENC1_SQL})),
ex2 AS (SELECT doc_id, unnest(range(len(p))) AS pos, unnest(p) AS id FROM pd)
SELECT d.doc_id, coalesce((SELECT string_agg(v.word, ' ' ORDER BY e.pos) FROM ex2 e JOIN vocab v ON v.id = e.id - 1
                           WHERE e.doc_id = d.doc_id AND e.id <> 0), '') AS words FROM pd d""", "lines_all"))
def decode_tokens_q(spark, sf_dir):
    """Encode with ids from 1, pad with 0, decode: every word of the last 140 comes back."""
    toks = _line_tokens(spark, sf_dir)
    vocab = V.build_vocab(toks, "tokens", MIN_COUNT, 1)
    e = V.encode_tokens(toks, "doc_id", "tokens", vocab, offset=1).select("doc_id", V.pad(F.col("ids"), 140).alias("ids"))
    d = V.decode_tokens(e, "doc_id", "ids", vocab)
    return d.select("doc_id", F.array_join("words", " ").alias("words"))


@register("one_hot_quality", """SELECT doc_id, CASE WHEN quality = 0 THEN 1.0 ELSE 0.0 END AS oh0,
  CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END AS oh1 FROM labels""")
def one_hot_quality(spark, sf_dir):
    l = S.load(spark, sf_dir, "labels")
    oh = V.one_hot(F.col("quality"), 2)
    return l.select("doc_id", F.get(oh, 0).alias("oh0"), F.get(oh, 1).alias("oh1"))


# ---------------------------------------------------------------------------
# AGG-04 bigram model, TXT-03 noun model, TXT-02 log scoring, TXT-01 lexicon
# ---------------------------------------------------------------------------
CLEAN_SQL = f"cl AS (SELECT doc_id, {Q.clean_sentence('text')} AS c FROM documents)"


@register("ngram_model_bigrams", f"""WITH {CLEAN_SQL},
g AS (SELECT unnest({Q.get_tokens('c', 2)}) AS ngram FROM cl),
c AS (SELECT ngram, count(*) AS count FROM g GROUP BY ngram)
SELECT ngram, count, round(count / (SELECT sum(count) FROM c), 6) AS freq FROM c""")
def ngram_model_bigrams(spark, sf_dir):
    d = S.load(spark, sf_dir, "documents")
    g = d.select(T.get_tokens(T.clean_sentence(F.col("text")), 2).alias("g"))
    return round_doubles(N.ngram_model(g, "g"))


@register("noun_model", with_fixtures(f"""WITH {CLEAN_SQL},
ex AS (SELECT doc_id, unnest(string_split(c, ' ')) AS token FROM cl),
kept AS (SELECT token FROM ex WHERE token <> '' AND token IN (SELECT token FROM tags WHERE tag IN ('NNP', 'NNPS'))),
c AS (SELECT token AS ngram, count(*) AS count FROM kept GROUP BY token)
SELECT ngram, count, round(count / (SELECT sum(count) FROM c), 6) AS freq FROM c""", "tags"))
def noun_model(spark, sf_dir):
    """TXT-03: FLT-05 then a unigram model (the kept text is re-split on blanks)."""
    d = S.load(spark, sf_dir, "documents").select("doc_id", T.clean_sentence(F.col("text")).alias("c"))
    kept = N.filter_by_tag(d, "doc_id", "c", S.tags(spark, sf_dir), ["NNP", "NNPS"])
    toks = kept.select(F.filter(F.split("text", " ", -1), lambda z: z != "").alias("g"))
    return round_doubles(N.ngram_model(toks, "g"))


@register("lm_score_benchmark", f"""WITH {CLEAN_SQL},
g AS (SELECT unnest({Q.get_tokens('c', 1)}) AS ngram FROM cl),
c AS (SELECT ngram, count(*) AS count FROM g GROUP BY ngram),
m AS (SELECT ngram, count / (SELECT sum(count) FROM c) AS freq FROM c),
b AS (SELECT item_id, {Q.get_tokens(Q.clean_sentence('text'), 1)} AS gs FROM benchmark),
ex AS (SELECT item_id, unnest(gs) AS ngram FROM b)
SELECT b.item_id, round(coalesce((SELECT sum(coalesce(ln(m.freq), -100.0)) FROM ex LEFT JOIN m USING (ngram)
                                  WHERE ex.item_id = b.item_id), 0.0), 6) AS log_prob FROM b""")
def lm_score_benchmark(spark, sf_dir):
    d = S.load(spark, sf_dir, "documents")
    model = N.ngram_model(d.select(T.get_tokens(T.clean_sentence(F.col("text")), 1).alias("g")), "g")
    b = S.load(spark, sf_dir, "benchmark")
    return round_doubles(N.lm_score(b, "item_id", "text", model, 1))


@register("lexicon_sentiment", with_fixtures(f"""WITH ex AS (SELECT d.doc_id, t.token FROM documents d
    LEFT JOIN LATERAL (SELECT unnest({Q.words('lower(d.text)')}) AS token) t ON true),
j AS (SELECT ex.doc_id, ex.token, coalesce(l.valence, 0.0) AS v FROM ex LEFT JOIN lexicon l USING (token)),
g AS (SELECT doc_id, sum(CASE WHEN token IS NOT NULL THEN v ELSE 0 END) AS s,
    sum(CASE WHEN token IS NOT NULL AND v > 0 THEN v + 1 ELSE 0 END) AS ps,
    sum(CASE WHEN token IS NOT NULL AND v < 0 THEN v - 1 ELSE 0 END) AS ns,
    sum(CASE WHEN token IS NOT NULL AND v = 0 THEN 1.0 ELSE 0 END) AS nu FROM j GROUP BY doc_id)
SELECT doc_id, round(CASE WHEN s = 0 THEN 0.0 ELSE s / sqrt(s * s + 15.0) END, 6) AS compound,
  round(coalesce(ps / nullif(ps + abs(ns) + nu, 0), 0.0), 6) AS pos,
  round(coalesce(nu / nullif(ps + abs(ns) + nu, 0), 0.0), 6) AS neu,
  round(coalesce(abs(ns) / nullif(ps + abs(ns) + nu, 0), 0.0), 6) AS neg FROM g""", "lexicon"))
def lexicon_sentiment_q(spark, sf_dir):
    d = S.load(spark, sf_dir, "documents")
    return round_doubles(N.lexicon_sentiment(d, "doc_id", "text", S.lexicon(spark, sf_dir)))


# ---------------------------------------------------------------------------
# TXT-04 / TXT-05 character 3..7-gram TF-IDF on the clean texts
# ---------------------------------------------------------------------------
def _char_grams_sql(ch: str, minn: int, maxn: int) -> str:
    """Zips of shifted slices, one list per gram length (as on the Spark side)."""
    per_length = []
    for k in range(minn, maxn + 1):
        slices = ", ".join(f"list_slice({ch}, {i + 1}, {i} + greatest(len({ch}) - {k} + 1, 0))" for i in range(k))
        joined = " || ".join(f"cz[{i + 1}]" for i in range(k))
        per_length.append(f"list_transform(list_zip({slices}), lambda cz: {joined})")
    return f"list_concat({', '.join(per_length)})"


TFIDF_SQL = f"""{CLEAN_SQL},
lt AS (SELECT doc_id, regexp_replace(lower(c), '{N.CHAR_WS_RE}', ' ', 'g') AS t FROM cl),
chs AS (SELECT doc_id, regexp_extract_all(t, '(?s).') AS ch FROM lt),
ex AS (SELECT doc_id, unnest({_char_grams_sql('ch', 3, 7)}) AS gram FROM chs),
tf AS (SELECT doc_id, gram, count(*) AS tf FROM ex GROUP BY doc_id, gram),
dfq AS (SELECT gram, count(*) AS df FROM tf GROUP BY gram),
w AS (SELECT tf.doc_id, tf.gram, tf.tf * (ln((1 + (SELECT count(*) FROM documents)) / (1 + dfq.df)) + 1) AS w
  FROM tf JOIN dfq USING (gram)),
nrm AS (SELECT doc_id, sqrt(sum(w * w)) AS n FROM w GROUP BY doc_id),
tfidf AS (SELECT w.doc_id, w.gram, w.w / nrm.n AS weight FROM w JOIN nrm USING (doc_id))"""


def _tfidf(spark, sf_dir):
    d = S.load(spark, sf_dir, "documents").select("doc_id", T.clean_sentence(F.col("text")).alias("c"))
    return N.char_tfidf(d, "doc_id", "c", 3, 7)


@register("char_tfidf_summary", f"""WITH {TFIDF_SQL}
SELECT doc_id, count(*) AS n_grams, round(max(weight), 6) AS max_weight, round(sum(weight), 4) AS weight_sum,
  round(sum(weight * length(gram)), 4) AS weight_by_length
FROM tfidf GROUP BY doc_id""")
def char_tfidf_summary(spark, sf_dir):
    t = _tfidf(spark, sf_dir)
    return round_doubles(t.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_grams"), F.max("weight").alias("max_weight"),
        F.round(F.sum("weight"), 4).alias("weight_sum"),
        F.round(F.sum(F.col("weight") * F.length("gram")), 4).alias("weight_by_length")))


@register("top_grams", f"""WITH {TFIDF_SQL}
SELECT gram, round(max(weight), 6) AS max_weight FROM tfidf GROUP BY gram""")
def top_grams_q(spark, sf_dir):
    """TXT-05: the largest weight of every gram."""
    return round_doubles(N.top_grams(_tfidf(spark, sf_dir)))


# ---------------------------------------------------------------------------
# TOP-06 / TOP-07 sampling and splits, SET-01 / SET-03, WIN-06
# ---------------------------------------------------------------------------
@register("sample_docs", """SELECT doc_id, lang FROM documents ORDER BY md5('7' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 100""")
def sample_docs(spark, sf_dir):
    d = S.load(spark, sf_dir, "documents").select("doc_id", "lang")
    return C.sample_n(d, 100, 7, "doc_id")


@register("split_share", with_fixtures("""SELECT doc_id, CASE WHEN
  CAST(('0x' || substring(md5('11' || CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT AS DOUBLE) / 4294967296.0 < 0.2
  THEN 'valid' ELSE 'train' END AS split FROM labeled""", "labeled"))
def split_share_q(spark, sf_dir):
    l = S.labeled(spark, sf_dir).select("doc_id")
    tr, va = C.split_share(l, 0.2, 11, "doc_id")
    return tr.withColumn("split", F.lit("train")).unionByName(va.withColumn("split", F.lit("valid")))


@register("split_head_tail", with_fixtures("""SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) <= 300
  THEN 'train' ELSE 'valid' END AS split FROM labeled""", "labeled"))
def split_head_tail_q(spark, sf_dir):
    l = S.labeled(spark, sf_dir).select("doc_id")
    tr, va = C.split_head_tail(l, 300, ["doc_id"])
    return tr.withColumn("split", F.lit("train")).unionByName(va.withColumn("split", F.lit("valid")))


@register("stack_texts", """SELECT 'documents' AS src, doc_id AS id, NULL::BIGINT AS turn, text, lang FROM documents
UNION ALL SELECT 'benchmark', item_id, NULL, text, NULL FROM benchmark
UNION ALL SELECT 'conversations', conv_id, turn, text, NULL FROM conversations""")
def stack_texts(spark, sf_dir):
    """SET-01: stack frames with different columns by name."""
    d = S.load(spark, sf_dir, "documents").select(F.lit("documents").alias("src"), F.col("doc_id").alias("id"),
                                                  "text", "lang")
    b = S.load(spark, sf_dir, "benchmark").select(F.lit("benchmark").alias("src"), F.col("item_id").alias("id"), "text")
    c = S.load(spark, sf_dir, "conversations").select(F.lit("conversations").alias("src"),
                                                      F.col("conv_id").alias("id"), "turn", "text")
    return d.unionByName(b, allowMissingColumns=True).unionByName(c, allowMissingColumns=True)


@register("label_index", with_fixtures("""WITH sp AS (SELECT *, CAST(('0x' || substring(md5('11' || CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT AS DOUBLE)
    / 4294967296.0 < 0.2 AS dev FROM labeled),
u AS (SELECT label AS answer FROM sp WHERE NOT dev UNION SELECT 'tox' || CAST(toxic AS VARCHAR) FROM sp WHERE dev)
SELECT answer, row_number() OVER (ORDER BY answer) - 1 AS label_idx FROM u""", "labeled"))
def label_index_q(spark, sf_dir):
    """SET-03: answers of the train and dev splits, unioned, numbered by value."""
    l = S.labeled(spark, sf_dir)
    tr, dev = C.split_share(l, 0.2, 11, "doc_id")
    a = tr.select(F.col("label").alias("answer"))
    b = dev.select(F.concat(F.lit("tox"), F.col("toxic").cast("string")).alias("answer"))
    return V.label_index(a, b, col="answer")


@register("balance_classes", with_fixtures("""WITH r AS (SELECT doc_id, quality,
    row_number() OVER (PARTITION BY quality ORDER BY doc_id) AS rn FROM labeled)
SELECT doc_id, quality FROM r WHERE rn <= (SELECT min(c) FROM (SELECT count(*) AS c FROM labeled GROUP BY quality))""",
                                           "labeled"))
def balance_classes(spark, sf_dir):
    l = S.labeled(spark, sf_dir).select("doc_id", "quality")
    return V.balance(l, "quality", ["doc_id"])


# ---------------------------------------------------------------------------
# STR-10 / STR-11 / STR-13 sub-words of the vocabulary words
# ---------------------------------------------------------------------------
@register("char_ngrams_vocab", with_fixtures(f"""WITH {VOCAB_SQL}
SELECT word, array_to_string({Q.char_ngram_strings('word', MINN, MAXN)}, '|') AS grams FROM vocab WHERE type = 'word'""",
                                             "lines_all"))
def char_ngrams_vocab(spark, sf_dir):
    v = _vocab(spark, sf_dir).filter(F.col("type") == "word")
    return v.select("word", F.array_join(H.char_ngrams(F.col("word"), MINN, MAXN), "|").alias("grams"))


@register("fnv_hash_vocab", with_fixtures(f"""WITH {VOCAB_SQL}
SELECT word, {Q.fnv1a('word')} AS h, {Q.fnv1a('word')} % {BUCKET} AS bucket FROM vocab""", "lines_all"))
def fnv_hash_vocab(spark, sf_dir):
    v = _vocab(spark, sf_dir)
    h = H.fnv1a(F.col("word"))
    return v.select("word", h.alias("h"), F.pmod(h, F.lit(BUCKET)).alias("bucket"))


@register("subword_ids_vocab", with_fixtures(f"""WITH {VOCAB_SQL},
nw AS (SELECT count(*) AS n FROM vocab WHERE type = 'word'),
sw AS (SELECT id, word, nw.n AS nwords, list_transform({Q.char_ngram_strings('word', MINN, MAXN)},
    lambda sg: {Q.fnv1a('sg')} % {BUCKET}) AS b FROM vocab, nw WHERE type = 'word')
SELECT word, array_to_string(list_concat([id], CASE WHEN word = '</s>' THEN []::BIGINT[]
    ELSE list_transform(b, lambda x: x + nwords) END), ' ') AS ids FROM sw""", "lines_all"))
def subword_ids_vocab(spark, sf_dir):
    v = _vocab(spark, sf_dir).filter(F.col("type") == "word")
    nwords = v.select(F.count(F.lit(1))).first()[0]
    ids = H.subword_ids(F.col("word"), F.col("id"), nwords, BUCKET, MINN, MAXN)
    return v.select("word", F.array_join(ids, " ").alias("ids"))
