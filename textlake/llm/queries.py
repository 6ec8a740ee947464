"""The registered queries of the corpus operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlake.llm import (decontam, filter_audit, graph_ann, licenses, mixing, ngram_lm, pii, quality, simhash, suffix_dedup,
                          toxicity, urls, whitening)
from textlake.llm.common import fold, table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; labels of fold 2 (of 4) are held out."""
    p = quality.Params()
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    weights = quality.train(docs, labels, "quality", fold(F.col("doc_id"), 4) != 2, p)
    return (quality.score(docs.select("doc_id", "text"), weights, p)
            .select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score",
                    (F.col("score") >= p.threshold).cast("int").alias("predicted")))


def op2_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of every document with the benchmark's 10-word windows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.find(docs, table(spark, sf_dir, "benchmark"))
    o = F.col("overlap")
    return found.select(
        "doc_id", o["n_words"].alias("n_words"), o["n_hit"].alias("n_hit"),
        F.size(o["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(o["items"], ","), 256).alias("items_sha256"),
        (o["n_hit"] > 0).alias("contaminated"))


_LOWER_SQL = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM_SQL = r"regexp_extract_all(" + _LOWER_SQL + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP2_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_ALNUM_SQL.format("coalesce(text, '')")} AS w FROM documents),
b AS (SELECT item_id, {_ALNUM_SQL.format("text")} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM win),
dw AS (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
       FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)),
hits AS (SELECT DISTINCT rid, dw.n, i, item_id FROM dw JOIN win ON dw.n = win.n AND dw.s = win.s),
words AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hits) GROUP BY rid),
items AS (SELECT rid, count(DISTINCT item_id) AS n_items,
                 sha256(array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',')) AS h
          FROM hits GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(h, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)"""


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raked sampling probability of every document and whether it is sampled."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return mixing.sample(docs).select(
        "doc_id", F.col("mix_tokens").alias("n_tokens"), F.col("mix_source").alias("source"),
        F.col("mix_lang").alias("lang"), F.col("mix_topic").alias("topic"),
        F.round("mix_probability", 9).alias("probability"), F.col("mix_kept").alias("kept"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    g = simhash.groups(table(spark, sf_dir, "documents"))
    return g.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest vectors of every 50th vector, by graph search."""
    return graph_ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices and texts of every document: how many, the best, and where they begin."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = licenses.scan(docs)
    m = F.col("licenses")
    best = F.array_max(F.transform(m, lambda x: x["dice"]))
    return found.select(
        "doc_id", F.size(F.split(F.coalesce("text", F.lit("")), r"\r\n|\n|\r")).cast("long").alias("n_lines"),
        F.size(m).cast("long").alias("n_matches"),
        F.array_min(F.transform(F.filter(m, lambda x: x["dice"] == best), lambda x: x["name"])).alias("license"),
        F.round(best, 6).alias("dice"),
        F.array_join(F.transform(m, lambda x: F.concat(x["line"].cast("string"), F.lit(":"), x["name"])), ",").alias("found"))


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the url of every page: by rule, else by host words and naive Bayes."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return urls.judge(pages).select("page_id", "host", "path", "rule", "verdict", "score",
                                    F.array_join("host_words", " ").alias("host_words"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; labels of fold 1 (of 3) are held out
    (their documents don't serve as unlabelled text either)."""
    p = toxicity.Params()
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    seen = fold(F.col("doc_id"), 3) != 1
    weights = toxicity.train(docs, labels, "toxic", seen, seen, p)
    return (toxicity.score(docs.select("doc_id", "text"), weights, p)
            .select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score",
                    (F.col("score") >= p.threshold).cast("int").alias("predicted")))


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kneser-Ney score of every document, by a model of the folds 1 to 9 (of 10)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = fold(F.col("doc_id"), 10) == 0
    scored, model = ngram_lm.train_and_score(docs, ~held)
    lm = F.col("lm")
    return scored.select("doc_id", held.alias("held_out"), lm["n_tokens"].alias("n_tokens"), lm["n_known"].alias("n_known"),
                         F.lit(model.n_tokens).cast("long").alias("train_tokens"), lm["base_score"].alias("base_score"),
                         lm["score"].alias("score"), lm["perplexity"].alias("perplexity"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: counts, a hash of the base spans, all spans."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.digest(docs).drop("text")


def op11_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the bytes of 100-byte strings seen before."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.digest(docs)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened components of every embedding, with exact deviation and explained variance."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes in each of their orders, per source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return filter_audit.audit(docs, table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_quality": op1_quality,
    "op2_decontam": op2_decontam,
    "op3_mixing": op3_mixing,
    "op4_simhash": op4_simhash,
    "op5_ann": op5_ann,
    "op6_licenses": op6_licenses,
    "op7_urls": op7_urls,
    "op8_toxicity": op8_toxicity,
    "op9_lm": op9_lm,
    "op10_pii": op10_pii,
    "op11_suffix": op11_suffix,
    "op12_whitening": op12_whitening,
    "op13_audit": op13_audit,
}

ORACLE: dict[str, str] = {
    "op2_decontam": OP2_SQL,
    "op3_mixing": mixing.sample_sql(),
    "op6_licenses": licenses.matches_sql(),
    "op11_suffix": suffix_dedup.digest_sql(),
    "op13_audit": filter_audit.audit_sql(),
}
