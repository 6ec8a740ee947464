"""Toxicity: non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; the other side is unlabelled text
(labels of 0 are not used as negatives, only for the class prior).  A linear
model over hashed words and word beginnings (present or not) is trained with
numpy on the risk

    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))

(logistic loss, full-batch steps, weights of cue words never below zero); when
the second part falls below zero, a step goes the other way on that part, so
the model can't win by calling the positives among the unlabelled negative.  Spark trains ``members`` classifiers
side by side, each in its own task on its own unlabelled sample, and averages
their weights; a size fixed by ``bits`` is broadcast, and every whole
text is scored in its own task.

Defined results
* null and empty texts have no features and get the score of the intercept;
* without a positive (empty tables, no labels) every score is the prior given
  as ``prior`` or 0.1;
* label rows with a null id or label are left out; several labels of an id
  count as the highest; documents that share an id count once for training
  (smallest text), every row is scored, equal texts get equal scores;
* extra columns are kept, a column named like the output is replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlake.llm import tokens as T
from textlake.llm.common import utf8


@dataclass(frozen=True)
class Params:
    bits: int = 18
    prefix: tuple[int, ...] = (4, 5)  # lengths of word beginnings, in bytes
    positive_rows: int = 3000    # bound of the positive sample
    unlabelled_rows: int = 6000  # bound of a member's unlabelled sample
    members: int = 3
    steps: int = 1000            # full-batch gradient steps
    rate: float = 30.0
    intercept_rate: float = 1.0
    l1: float = 3e-5
    least: float = 0.05          # smaller weights are set to 0
    min_texts: int = 5           # a bucket in fewer positives gets no weight,
    lift: float = 4.0            # nor does one less than so many times as frequent in them as in clean text
    prior: float | None = None   # share of toxic texts; None: from the labels
    threshold: float = 0.7


def features(texts: list[bytes], p: Params) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of every word and word beginning, repeats included."""
    t = T.tokenize(texts, T.ALPHANUMERIC, prefix=p.prefix)
    doc = np.repeat(np.arange(len(texts)), np.diff(t.off))
    shift = np.uint64(64 - p.bits)
    docs, buckets = [doc], [t.hashes >> shift]
    for length, begin in zip(p.prefix, t.prefixes):
        long = (t.ends - t.starts) > length
        docs.append(doc[long])
        buckets.append(T.mix(begin[long] + np.uint64(length)) >> shift)
    return np.concatenate(docs), np.concatenate(buckets).astype(np.int64)


def distinct(doc: np.ndarray, bucket: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique((doc.astype(np.int64) << bits) | bucket)
    return key >> bits, key & ((1 << bits) - 1)


def train_nnpu(texts: list[bytes], positive: np.ndarray, prior: float, p: Params) -> np.ndarray:
    """Weights (intercept last) of one member."""
    size = 1 << p.bits
    rows: list[np.ndarray] = []
    for lo, hi in T.chunks(texts):
        doc, bucket = distinct(*features(texts[lo:hi], p), p.bits)
        rows += np.split(bucket, np.searchsorted(doc, np.arange(1, hi - lo)))
    seen = np.zeros((2, size))
    for r, y in zip(rows, positive):
        seen[int(y), r] += 1
    share = seen / np.maximum([[(~positive).sum()], [positive.sum()]], 1)
    # unlabelled text holds positives at the prior: the share in clean text is what they leave
    clean = np.maximum(share[0] - prior * share[1], 0.0) / (1 - prior)
    cue = (seen[1] >= p.min_texts) & (share[1] >= p.lift * clean)
    rows = [r[cue[r]] for r in rows]
    w = np.zeros(size)
    b = math.log(prior / (1 - prior))

    def matrix(which):
        part = [r for r, y in zip(rows, positive) if y == which]
        return np.concatenate(part), np.concatenate([[0], np.cumsum([len(r) for r in part])])

    (xp, op), (xu, ou) = matrix(True), matrix(False)
    n_p, n_u = len(op) - 1, len(ou) - 1

    def sigmoid(x):
        return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))

    for step in range(p.steps):
        rate = p.rate / (1 + 4 * step / p.steps)
        fp, fu = T.segment_sum(w[xp], op) + b, T.segment_sum(w[xu], ou) + b
        rest = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        sign = 1.0 if rest >= 0 else -1.0
        # derivatives by f, per text
        gp = (-prior * (1 - sigmoid(fp)) * (sign > 0) - sign * prior * sigmoid(fp)) / n_p
        gu = sign * sigmoid(fu) / n_u
        g = np.bincount(np.concatenate([xp, xu]),
                        np.concatenate([np.repeat(gp, np.diff(op)), np.repeat(gu, np.diff(ou))]), minlength=size)
        # words are evidence for toxicity only: a long clean text gets no bonus
        w = np.maximum(w - rate * (g + p.l1), 0.0)
        b -= p.intercept_rate * (gp.sum() + gu.sum())
    return np.append(w, b)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, labelled: Column, usable: Column,
                  p: Params) -> tuple[DataFrame, float]:
    """(``_t``, ``_pos``, ``member``) rows and the class prior.

    ``labelled`` is a condition on the label rows, ``usable`` one on the
    documents that may serve as unlabelled text."""
    lab = (labels.filter(labelled & F.col("doc_id").isNotNull() & F.col(label).isNotNull())
           .groupBy(F.col("doc_id").alias("_id")).agg(F.max(label).alias("_y")))
    n, n1 = lab.agg(F.count("*"), F.sum(F.when(F.col("_y") > 0, 1).otherwise(0))).first()
    # the share of the labelled; where all are positive, half a row short of one
    prior = p.prior or (min(n1 / n, 1 - 0.5 / n) if n and n1 else 0.1)
    top = (F.xxhash64("_id"), F.col("_id"))
    chosen = lab.filter(F.col("_y") > 0).orderBy(*top).limit(p.positive_rows).select("_id")
    ids = docs.filter(usable & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_id")).distinct()
    # members draw in their own orders, independent of that of the positives
    both = chosen.select("_id", F.lit(True).alias("_pos"), F.explode(F.array(*map(F.lit, range(p.members)))).alias("member"))
    for m in range(p.members):
        drawn = ids.orderBy(F.xxhash64("_id", F.lit(m + 1)), "_id").limit(p.unlabelled_rows)
        both = both.unionByName(drawn.select("_id", F.lit(False).alias("_pos"), F.lit(m).alias("member")))
    # bounded by the parameters: members * (positive_rows + unlabelled_rows) ids
    sides = both.groupBy("_id").agg(F.collect_list(F.struct("_pos", "member")).alias("_sides"))
    d = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"))
    texts = (d.join(F.broadcast(sides), "_id")
             .groupBy("_id").agg(F.min("_text").alias("_text"), F.first("_sides").alias("_sides")))
    return texts.select("_id", utf8(F.col("_text")).alias("_t"), F.inline("_sides")), prior


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", labelled: Column | None = None,
          usable: Column | None = None, p: Params = Params()) -> np.ndarray:
    """Average weights of the members (at most 2**bits + 1 numbers come back)."""
    yes = F.lit(True)
    rows, prior = training_rows(docs, labels, label, yes if labelled is None else labelled,
                                yes if usable is None else usable, p)
    members = p.members

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_pos", "_id"], kind="stable")
        positive = pdf["_pos"].to_numpy(bool)
        if not positive.any() or positive.all():
            return pd.DataFrame({"i": [], "w": []})
        w = train_nnpu([bytes(t) for t in pdf["_t"]], positive, prior, p)
        i = np.flatnonzero(w)
        return pd.DataFrame({"i": i, "w": w[i] / members})

    got = (rows.groupBy("member").applyInPandas(fit, "i long, w double")
           .groupBy("i").agg(F.sum("w").alias("w")).toPandas())
    weights = np.zeros((1 << p.bits) + 1)
    weights[got["i"].to_numpy(np.int64)] = got["w"].to_numpy()
    weights[:-1][np.abs(weights[:-1]) < p.least] = 0
    if not len(got):
        weights[-1] = math.log(prior / (1 - prior))
    return weights.astype(np.float32)


def scores(texts: list[bytes], weights: np.ndarray, p: Params) -> np.ndarray:
    """Probability that each text is toxic."""
    out = np.empty(len(texts))
    for lo, hi in T.chunks(texts):
        doc, bucket = features(texts[lo:hi], p)
        known = weights[bucket] != 0
        doc, bucket = distinct(doc[known], bucket[known], p.bits)
        f = np.bincount(doc, weights[bucket], minlength=hi - lo) + weights[-1]
        out[lo:hi] = 1.0 / (1.0 + np.exp(-np.clip(f, -35, 35)))
    return out.round(9)


def score(docs: DataFrame, weights: np.ndarray, p: Params = Params(), text: str = "text",
          out: str = "score") -> DataFrame:
    """``docs`` with the column ``out``; one pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    @F.arrow_udf("double")
    def judge(t: pa.Array) -> pa.Array:
        return pa.array(scores(t.to_pylist(), shared.value, p))

    return docs.withColumn(out, judge(utf8(F.col(text))))
