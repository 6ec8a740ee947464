"""URL filters: host word segmentation and naive Bayes.

Rules come first: a rule is a host and the beginning of a path; it fits its host
and all subdomains if the url's path starts with its path, and the longest
that fits gives the verdict.  The method judges the rest:

1. word counts: every page's visible words are counted by Spark, a few seed
   words are added with a fixed share of all words;
2. segmentation: each distinct name in a host (letters between dots, digits and
   hyphens) is split by unigram Viterbi into the likeliest words; candidate
   words reach their names by an equality join of the names' substrings with the
   word counts, so neither table has to fit anywhere; only shares of the total
   count, known and unknown pieces alike, so a split doesn't depend on the size of the table;
3. naive Bayes: urls whose host holds a seed word are the examples of ``block``,
   the others of ``allow``; multinomial counts of host words and path tokens
   are kept in ``2**bits`` hash buckets (a model of fixed size, broadcast), and a url is
   blocked if its log odds are above ``threshold``.

Defined results
* null url, or one without ``://``: empty host and path, no rule, scored on the
  class shares alone;
* repeated rows get equal results, extra columns are kept, clashing names replaced;
* an empty table gives an empty result; without any seeded url all are allowed.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlake.llm.common import cut

#: Words that mark a host as unwanted, fixed values.
SEEDS = ("ads", "adult", "bet", "bets", "casino", "pills", "poker", "porn", "sex", "spam", "track", "tracker",
         "viagra", "xxx")

#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))

STEP = 64               # letters a piece of a name advances


@dataclass(frozen=True)
class Params:
    bits: int = 16
    longest: int = 20           # letters of a candidate word
    seed_share: float = 0.002   # share of all words added for each seed word; a seed of k letters
                                # is cut from an unknown remainder if it is over 10**-k
    scale: int = 1_000_000      # total that the counts are brought to: an unknown piece of n letters
                                # has the share 10 / (scale * 10**n)
    smoothing: float = 0.5
    threshold: float = 0.0


def host_of(url: Column) -> Column:
    host = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule as text, its verdict) of the longest rule that fits, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_counts(pages: DataFrame, html: str = "html", p: Params = Params()) -> DataFrame:
    """``word``, ``n`` of the visible words of all pages."""
    plain = F.regexp_replace(_lower(F.coalesce(F.col(html), F.lit(""))), r"<[^>]*>|[^a-z]+", " ")
    words = pages.select(F.explode(F.split(plain, " +")).alias("word")).filter(
        (F.col("word") != "") & (F.length("word") <= p.longest))
    return words.groupBy("word").agg(F.count("*").alias("n"))


def word_shares(counts: DataFrame, p: Params = Params()) -> DataFrame:
    """``word``, ``n``: the counts brought to a total of ``scale``, and the seeds' shares."""
    total = counts.agg(F.sum("n")).first()[0] or 1
    seeds = counts.sparkSession.createDataFrame([(w,) for w in SEEDS], "word string")
    return (counts.select("word", (F.col("n") * float(p.scale) / total).alias("n"))
            .unionByName(seeds.select("word", F.lit(p.seed_share * p.scale).alias("n")))
            .groupBy("word").agg(F.sum("n").alias("n")))


def split_name(name: str, words: dict[tuple[int, int], float], total: int, longest: int) -> list[str]:
    """Likeliest split of a name; ``words``: counts of its known substrings.
    An unknown piece of n letters has the probability 10 / (total * 10**n)."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(name) + 1):
        options = []
        for start in range(max(0, end - longest), end):
            n = words.get((start, end))
            log = math.log(n / total) if n else math.log(10 / total) - (end - start) * math.log(10)
            options.append((best[start][0] + log, start))
        best.append(max(options))
    out, end = [], len(name)
    while end:
        start = best[end][1]
        out.append(name[start:end])
        end = start
    return out[::-1]


def segmented(hosts: DataFrame, counts: DataFrame, p: Params = Params()) -> DataFrame:
    """``hosts`` (column ``host``, distinct) with ``host_words``."""
    parts = hosts.select("host", F.posexplode(F.split("host", "[^a-z]+")).alias("pos", "name")).filter("name != ''")
    names = parts.select("name").distinct()
    # a short key and short pieces go with the substrings, so their bytes grow with the length of a name, not its square
    key = F.when(F.length("name") <= STEP, F.col("name")).otherwise(F.concat(F.lit("#"), F.sha2("name", 256)))
    starts = F.sequence(F.lit(0), F.floor((F.length("name") - 1) / STEP))
    pieces = names.select(key.alias("key"), F.posexplode(F.transform(
        starts, lambda k: F.substr("name", (k * STEP + 1).cast("int"), F.lit(STEP + p.longest - 1)))).alias("k", "piece"))
    subs = (pieces.select("key", "k", "piece", F.explode(F.sequence(F.lit(0), F.least(F.length("piece"), F.lit(STEP)) - 1)).alias("s"))
            .select("key", "k", "piece", "s",
                    F.explode(F.sequence(F.col("s") + 1, F.least(F.length("piece"), F.col("s") + p.longest))).alias("e"))
            .select("key", (F.col("k") * STEP + F.col("s")).alias("s"), (F.col("k") * STEP + F.col("e")).alias("e"),
                    F.expr("substring(piece, s + 1, e - s)").alias("word")))
    found = (subs.join(word_shares(counts, p), "word").groupBy("key")
             .agg(F.collect_list(F.struct("s", "e", "n")).alias("known")))     # at most longest a letter

    @F.arrow_udf("array<string>")
    def split(name: pa.Array, known: pa.Array) -> pa.Array:
        out = []
        for s, k in zip(name.to_pylist(), known.to_pylist()):
            have = {(x["s"], x["e"]): x["n"] for x in k or ()}
            out.append(split_name(s, have, p.scale, p.longest))
        return pa.array(out, pa.list_(pa.string()))

    words = (names.withColumn("key", key).join(found, "key", "left")
             .select("name", split("name", "known").alias("w")))
    return (parts.join(words, "name").groupBy("host")
            .agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("pos", "w"))), lambda x: x["w"])).alias("host_words")))


def path_tokens(path: Column) -> Column:
    """Lower-case tokens of a path; a number stands for its length only."""
    parts = F.filter(F.split(_lower(path), "[^a-z0-9]+"), lambda t: t != "")
    return F.transform(parts, lambda t: F.when(t.rlike("^[0-9]+$"), F.concat(F.lit("#"), F.length(t).cast("string"))).otherwise(t))


def naive_bayes(buckets: DataFrame, p: Params) -> np.ndarray:
    """Log odds of every bucket, the class odds last, from ``b`` (buckets of a
    url, array) and ``block`` (0 or 1).  At most 2**bits rows come back."""
    classes = buckets.agg(F.sum("block"), F.count("*")).first()
    blocked, urls = classes[0] or 0, classes[1]
    size = 1 << p.bits
    out = np.zeros(size + 1)
    if not blocked or blocked == urls:
        out[size] = -30.0 if not blocked else 30.0
        return out
    rows = (buckets.select(F.explode("b").alias("i"), "block").groupBy("i")
            .agg(F.sum("block").alias("y"), F.sum(1 - F.col("block")).alias("n")).toPandas())
    i, y, n = rows["i"].to_numpy(np.int64), rows["y"].to_numpy(float), rows["n"].to_numpy(float)
    k, s = len(i), p.smoothing
    out[i] = np.log((y + s) / (y.sum() + s * k)) - np.log((n + s) / (n.sum() + s * k))
    out[size] = math.log(blocked / (urls - blocked))
    return out


def judge(pages: DataFrame, url: str = "url", html: str = "html", rules=RULES, p: Params = Params()) -> DataFrame:
    """``pages`` with host, path, rule, host_words, score (log odds of block) and verdict."""
    frame = pages.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    hosts = frame.select("host").distinct()
    # both are read several times: the counts and the words of each host are kept
    known = cut(segmented(hosts, cut(word_counts(pages, html, p)), p))
    frame = frame.drop("host_words").join(known, "host", "left")
    words = F.coalesce("host_words", F.array().cast("array<string>"))
    tokens = F.concat(F.transform(words, lambda w: F.concat(F.lit("h:"), w)),
                      F.transform(path_tokens(F.col("path")), lambda t: F.concat(F.lit("p:"), t)))
    bucket = F.transform(tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(1 << p.bits)))
    seeded = F.arrays_overlap(words, F.array(*map(F.lit, SEEDS))).cast("int")
    weights = naive_bayes(frame.select(bucket.alias("b"), seeded.alias("block")), p)
    shared = pages.sparkSession.sparkContext.broadcast(weights)

    @F.arrow_udf("double")
    def odds(b: pa.Array) -> pa.Array:
        off = b.offsets.to_numpy()
        w = shared.value
        flat = np.concatenate([[0.0], np.cumsum(w[b.values.to_numpy(zero_copy_only=False).astype(np.int64)])])
        return pa.array((flat[off[1:]] - flat[off[:-1]] + w[-1]).round(9))

    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return (frame.withColumn("score", odds(bucket)).withColumn("rule", rule)
            .withColumn("verdict", F.coalesce(verdict, F.when(F.col("score") > p.threshold, "block").otherwise("allow"))))
