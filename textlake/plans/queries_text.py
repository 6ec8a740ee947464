"""Registered text queries: cleaners, tokenizers, normalizers, labelled
lines, UDF glue (STR-01..09, STR-15, FLT-05/06, SRC-04..06, UDF-01..03)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from textlake.functions import text as T
from textlake.operators import udf as U
from textlake.plans import sqlfrag as Q
from textlake.plans.registry import register
from textlake.sources import tables as S
from textlake.sources.files import labeled_lines, parse_labeled, parse_labeled_tail
from textlake.sources.tables import with_fixtures

# ---------------------------------------------------------------------------
# STR-01 / STR-02 / STR-03 on post texts (repost marks and links present)
# ---------------------------------------------------------------------------


@register("clean_name", with_fixtures(f"SELECT tweet_id, {Q.clean_name('tweet_text')} AS clean FROM posts_raw",
                                      "posts_raw"))
def clean_name_q(spark, sf_dir):
    p = S.posts_raw(spark, sf_dir)
    return p.select("tweet_id", T.clean_name(F.col("tweet_text")).alias("clean"))


@register("clean_sentence", with_fixtures(
    f"SELECT tweet_id, {Q.clean_sentence('tweet_text')} AS clean FROM posts_raw", "posts_raw"))
def clean_sentence_q(spark, sf_dir):
    p = S.posts_raw(spark, sf_dir)
    return p.select("tweet_id", T.clean_sentence(F.col("tweet_text")).alias("clean"))


@register("process_text", with_fixtures(
    f"SELECT tweet_id, {Q.process_text('tweet_text')} AS processed FROM posts_raw", "posts_raw"))
def process_text_q(spark, sf_dir):
    p = S.posts_raw(spark, sf_dir)
    return p.select("tweet_id", T.process_text(F.col("tweet_text")).alias("processed"))


@register("get_tokens_bigrams", f"""SELECT doc_id, len(g) AS n_grams, array_to_string(g, '|') AS grams
FROM (SELECT doc_id, {Q.get_tokens('text', 2)} AS g FROM documents)""")
def get_tokens_bigrams(spark, sf_dir):
    d = S.load(spark, sf_dir, "documents")
    g = T.get_tokens(F.col("text"), 2)
    return d.select("doc_id", F.size(g).cast("bigint").alias("n_grams"), F.array_join(g, "|").alias("grams"))


# ---------------------------------------------------------------------------
# STR-05 whitespace tokenizer; FLT-06 lines with more than one token
# ---------------------------------------------------------------------------
@register("tokenize_ws", f"""SELECT doc_id, len(t) AS n_tokens, array_to_string(t, ' ') AS tokens
FROM (SELECT doc_id, {Q.tokenize_ws('text')} AS t FROM documents)""")
def tokenize_ws_q(spark, sf_dir):
    d = S.load(spark, sf_dir, "documents")
    t = T.tokenize_ws(F.col("text"))
    return d.select("doc_id", F.size(t).cast("bigint").alias("n_tokens"), F.array_join(t, " ").alias("tokens"))


@register("min_tokens_lines", """SELECT doc_id, pos, line FROM (
  SELECT doc_id, CAST(unnest(range(len(l))) AS BIGINT) AS pos, unnest(l) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))
WHERE len(list_filter(regexp_split_to_array(line, '[ \\t]+'), lambda z: z <> '')) > 1""")
def min_tokens_lines(spark, sf_dir):
    d = S.load(spark, sf_dir, "documents")
    lines = d.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return lines.filter(T.min_tokens_mask(F.col("line"), 1)).select("doc_id", F.col("pos").cast("bigint").alias("pos"), "line")


# ---------------------------------------------------------------------------
# STR-06 / STR-07 / STR-09 normalizers, STR-08 markup stripper
# ---------------------------------------------------------------------------
@register("normalize_review", f"SELECT doc_id, {Q.normalize_review('text')} AS norm FROM documents")
def normalize_review_q(spark, sf_dir):
    d = S.load(spark, sf_dir, "documents")
    return d.select("doc_id", T.normalize_review(F.col("text")).alias("norm"))


@register("normalize_wiki", f"SELECT doc_id, {Q.normalize_wiki('text')} AS norm FROM documents")
def normalize_wiki_q(spark, sf_dir):
    d = S.load(spark, sf_dir, "documents")
    return d.select("doc_id", T.normalize_wiki(F.col("text")).alias("norm"))


@register("normalize_crude", f"""SELECT doc_id, {Q.normalize_crude('text')} AS norm,
  {Q.normalize_crude('text', True)} AS norm_published FROM documents""")
def normalize_crude_q(spark, sf_dir):
    d = S.load(spark, sf_dir, "documents")
    return d.select("doc_id", T.normalize_crude(F.col("text")).alias("norm"),
                    T.normalize_crude(F.col("text"), published=True).alias("norm_published"))


@register("strip_markup", f"""SELECT page_id, {Q.strip_markup('html')} AS visible,
  {Q.strip_markup('html', True)} AS letters FROM pages""")
def strip_markup_q(spark, sf_dir):
    p = S.load(spark, sf_dir, "pages")
    return p.select("page_id", T.strip_markup(F.col("html")).alias("visible"),
                    T.strip_markup(F.col("html"), spell_digits=True).alias("letters"))


# Pages as a dump holds them: a head, the text region, a tail; every fifth page is a redirect, every
# seventh has no region, every third a second region.
_DUMP_SQL = """SELECT page_id, '<page> <title>Page ' || CAST(page_id AS VARCHAR) || '</title> <id>7</id> '
  || CASE WHEN page_id % 7 = 0 THEN '<note>' ELSE '<text xml:space="preserve">' END
  || CASE WHEN page_id % 5 = 0 THEN '#REDIRECT [[Other]] ' ELSE '' END || html || '</text> between <b>regions</b> '
  || CASE WHEN page_id % 3 = 0 THEN '<text id="2">Second [[part|piece]] 42</text>' ELSE '' END || ' tail</page>' AS dump
  FROM pages"""


@register("strip_markup_region", f"""WITH d AS ({_DUMP_SQL}),
r AS (SELECT page_id, unnest(regexp_extract_all(dump, {T.sql_lit(T.RECORD_RE)})) AS rec,
  generate_subscripts(regexp_extract_all(dump, {T.sql_lit(T.RECORD_RE)}), 1) AS i FROM d),
e AS (SELECT *, regexp_matches(rec, {T.sql_lit(T.REDIRECT_RE)}) AS red, contains(rec, {T.sql_lit(T.REGION_OPEN)}) AS opn,
  contains(rec, {T.sql_lit(T.REGION_CLOSE)}) AS cls FROM r),
b AS (SELECT *, last_value(CASE WHEN red OR cls THEN 0 WHEN opn THEN 1 END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY i
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e),
k AS (SELECT page_id, i, {Q.strip_record('rec')} AS v, {Q.strip_record('rec', True)} AS l FROM b
  WHERE NOT red AND (opn OR coalesce(before, 0) = 1)),
g AS (SELECT page_id, string_agg(v, '' ORDER BY i) AS v, string_agg(l, '' ORDER BY i) AS l FROM k GROUP BY page_id)
SELECT page_id, coalesce(g.v, '') AS visible, coalesce(g.l, '') AS letters FROM pages LEFT JOIN g USING (page_id)""")
def strip_markup_region(spark, sf_dir):
    """STR-08 with the text-region gate and the redirect rule, on pages wrapped as a dump."""
    n = F.col("page_id")
    opening = F.when(n % 7 == 0, "<note>").otherwise('<text xml:space="preserve">')
    second = F.when(n % 3 == 0, '<text id="2">Second [[part|piece]] 42</text>').otherwise("")
    dump = F.concat(F.lit("<page> <title>Page "), n.cast("string"), F.lit("</title> <id>7</id> "), opening,
                    F.when(n % 5 == 0, "#REDIRECT [[Other]] ").otherwise(""), F.col("html"),
                    F.lit("</text> between <b>regions</b> "), second, F.lit(" tail</page>"))
    p = S.load(spark, sf_dir, "pages").select("page_id", dump.alias("dump"))
    return p.select("page_id", T.strip_markup(F.col("dump"), region=True).alias("visible"),
                    T.strip_markup(F.col("dump"), spell_digits=True, region=True).alias("letters"))


# ---------------------------------------------------------------------------
# STR-15 join a conversation's turns in order
# ---------------------------------------------------------------------------
@register("join_turns", """SELECT conv_id, count(*) AS n_turns, string_agg(text, ' ' ORDER BY turn) AS text
FROM conversations GROUP BY conv_id""")
def join_turns(spark, sf_dir):
    c = S.load(spark, sf_dir, "conversations")
    g = c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"),
                                 F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("_t"))
    return g.select("conv_id", "n_turns", T.join_sentences(F.transform("_t", lambda s: s["text"])).alias("text"))


# ---------------------------------------------------------------------------
# FLT-05 keep proper-noun tokens (tag table from documents)
# ---------------------------------------------------------------------------
@register("filter_by_tag", with_fixtures(f"""WITH c AS (SELECT doc_id, {Q.clean_sentence('text')} AS t FROM documents),
ex AS (SELECT doc_id, unnest(range(len(string_split(t, ' ')))) AS pos, unnest(string_split(t, ' ')) AS token FROM c),
kept AS (SELECT ex.* FROM ex WHERE token <> '' AND token IN (SELECT token FROM tags WHERE tag IN ('NNP', 'NNPS')))
SELECT c.doc_id, coalesce((SELECT string_agg(token, ' ' ORDER BY pos) FROM kept k WHERE k.doc_id = c.doc_id), '') AS text
FROM c""", "tags"))
def filter_by_tag_q(spark, sf_dir):
    from textlake.operators.ngrams import filter_by_tag
    d = S.load(spark, sf_dir, "documents").select("doc_id", T.clean_sentence(F.col("text")).alias("t"))
    return filter_by_tag(d, "doc_id", "t", S.tags(spark, sf_dir), ["NNP", "NNPS"])


# ---------------------------------------------------------------------------
# SRC-04 / SRC-05 / SRC-06 labelled lines
# ---------------------------------------------------------------------------
@register("parse_labeled", with_fixtures(f"""SELECT doc_id,
  array_to_string(list_filter(t, lambda z: starts_with(z, '__label__')), ' ') AS labels,
  array_to_string(list_filter(t, lambda z: NOT starts_with(z, '__label__')), ' ') AS words
FROM (SELECT doc_id, {Q.tokenize_ws("label || ' ' || text || ' __label__t' || CAST(toxic AS VARCHAR)", eos=False)} AS t
      FROM labeled)""", "labeled"))
def parse_labeled_q(spark, sf_dir):
    l = S.labeled(spark, sf_dir).select(
        "doc_id", F.concat(F.col("label"), F.lit(" "), F.col("text"), F.lit(" __label__t"),
                           F.col("toxic").cast("string")).alias("line"))
    p = parse_labeled(l, "line")
    return p.select("doc_id", F.array_join("labels", " ").alias("labels"), F.array_join("words", " ").alias("words"))


@register("parse_labeled_tail", with_fixtures(f"""SELECT doc_id, parts[1] AS text, parts[2] AS label FROM (
  SELECT doc_id, string_split({Q.clean_sentence('text')} || '__label__' || CAST(quality AS VARCHAR), '__label__') AS parts
  FROM labeled) WHERE len(parts) >= 2""", "labeled"))
def parse_labeled_tail_q(spark, sf_dir):
    l = S.labeled(spark, sf_dir).select(
        "doc_id", F.concat(T.clean_sentence(F.col("text")), F.lit("__label__"), F.col("quality").cast("string")).alias("line"))
    return parse_labeled_tail(l, "line").select("doc_id", "text", "label")


@register("labeled_lines", with_fixtures(f"""SELECT DISTINCT {Q.clean_sentence('text')} || ' __label__1' AS line
FROM labeled WHERE quality = 1
UNION ALL SELECT DISTINCT {Q.clean_sentence('text')} || ' __label__0' AS line FROM labeled WHERE quality = 0""",
                                          "labeled"))
def labeled_lines_q(spark, sf_dir):
    """SET-02 + SRC-06: distinct clean texts per class, stacked as lines."""
    l = S.labeled(spark, sf_dir).withColumn("clean", T.clean_sentence(F.col("text")))
    good = l.filter(F.col("quality") == 1).select("clean")
    bad = l.filter(F.col("quality") == 0).select("clean")
    return labeled_lines(good, bad, "clean")


# ---------------------------------------------------------------------------
# UDF-01 / UDF-02 / UDF-03
# ---------------------------------------------------------------------------
def _text_shape(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"doc_id": pdf["doc_id"],
                         "n_chars": pdf["text"].str.len().astype("int64"),
                         "n_lines": (pdf["text"].str.count("\n") + 1).astype("int64")})


@register("map_rows_text_shape", """SELECT doc_id, length(text) AS n_chars,
  length(text) - length(replace(text, chr(10), '')) + 1 AS n_lines FROM documents""")
def map_rows_text_shape(spark, sf_dir):
    d = S.load(spark, sf_dir, "documents").select("doc_id", "text")
    return U.map_rows(d, _text_shape, "doc_id long, n_chars long, n_lines long", key="doc_id")


def _chunk_totals(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"lang": pdf["lang"], "n_chars": pdf["n_chars"].astype("int64")}).groupby(
        "lang", as_index=False).agg(docs=("n_chars", "size"), chars=("n_chars", "sum"))


@register("map_chunks_lang_totals", """SELECT lang, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars
FROM documents GROUP BY lang""")
def map_chunks_lang_totals(spark, sf_dir):
    """UDF-02: a user function over bounded chunks of rows, partial results
    combined by a Spark aggregate (never one group in one task)."""
    d = S.load(spark, sf_dir, "documents").select("lang", "n_chars")
    part = U.map_chunks(d, _chunk_totals, "lang string, docs long, chars long", chunk_rows=5000)
    return part.groupBy("lang").agg(F.sum("docs").alias("docs"), F.sum("chars").alias("chars"))


@register("ngram_model_token_func", f"""SELECT ngram, count(*) AS count FROM (
  SELECT unnest(list_filter(string_split({Q.ascii_lower('text')}, ' '), lambda z: z <> '')) AS ngram FROM documents)
GROUP BY ngram""")
def ngram_model_token_func(spark, sf_dir):
    """UDF-03: a tokenizer passed as a function (here an Arrow UDF)."""
    from textlake.operators.ngrams import ngram_model
    d = S.load(spark, sf_dir, "documents")
    toks = d.select(U.blank_split_lower(F.col("text")).alias("toks"))
    return ngram_model(toks, "toks", norm=False).select("ngram", "count")
