"""Quality classifier: hashed word n-gram logistic regression, FTRL-proximal.

A text becomes tokens (words and runs of punctuation; a word that repeats the
word before it becomes one marker token, so stuttering text is visible
whatever its words are).  Token 1-grams and 2-grams are hashed into
``2**bits`` buckets; a feature's value is its share of the text's n-grams
times ``scale``.  Training goes once or more over a bounded sample of labelled
rows, one row after the other, with per-coordinate follow-the-regularised-
leader updates; the weights (one number per bucket, a size fixed by ``bits``)
are broadcast and every text is scored in its own task as a sparse dot product.

Defined results
* null and empty texts have no n-grams: their score is that of the intercept;
* with no usable label (none, or all null) every score is 0.5;
* a label row whose document is missing, or with a null id or label, is left
  out; several labels of one id count as the lowest of them, several
  documents of one id as the smallest text of them, so repeats don't weigh more;
* repeated rows get equal scores, extra columns are kept, and clashing names
  (``score``) are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlake.llm import tokens as T
from textlake.llm.common import utf8


@dataclass(frozen=True)
class Params:
    bits: int = 18              # 2**bits hashed features
    train_rows: int = 5000      # bound of the labelled sample
    epochs: int = 3
    alpha: float = 0.5          # learning rate of FTRL
    beta: float = 0.1
    l1: float = 0.02
    l2: float = 0.5
    scale: float = 10.0
    threshold: float = 0.7


def ngram_buckets(texts: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the 1- and 2-grams of every text, text by text, and the
    offsets of the texts in them."""
    t = T.tokenize(texts, T.WORDS_AND_MARKS, T.SAME)
    h, off = t.hashes, t.off
    n = len(h)
    first = np.zeros(n + 1, bool)
    first[off[:-1]] = True
    first = first[:n]
    # the word before a word: one or two tokens back (a mark may stand between)
    repeat = np.zeros(n, bool)
    for back in (1, 2):
        if n > back:
            same = (h[back:] == h[:-back]) & (t.kind[back:] == 1) & ~first[back:]
            if back == 2:
                same &= (t.kind[1:-1] == 2) & ~first[1:-1]
            repeat[back:] |= same
    h = np.where(repeat, np.uint64(0x5EED5EED5EED5EED), h)
    pair = T.mix(h[:-1] * np.uint64(3) + h[1:]) if n else h
    inner = ~first[1:]
    shift = np.uint64(64 - bits)
    # position of each gram: token i's 1-gram, then the 2-gram ending in it
    doc = np.repeat(np.arange(len(texts)), np.diff(off))
    buckets = np.concatenate([T.mix(h) >> shift, (pair >> shift)[inner]]).astype(np.int64)
    doc = np.concatenate([doc, doc[1:][inner]])
    order = np.argsort(doc, kind="stable")
    counts = np.bincount(doc, minlength=len(texts))
    return buckets[order], np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def features(text: bytes, bits: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Sparse row of one text: distinct buckets and values."""
    b, _ = ngram_buckets([text], bits)
    idx, count = np.unique(b, return_counts=True)
    return idx, count * (scale / max(len(b), 1))


def ftrl(rows: Iterable[tuple[np.ndarray, np.ndarray, float]], p: Params) -> np.ndarray:
    """Weights (intercept last) after ``p.epochs`` passes over the sparse rows
    (buckets, values, label) in their order."""
    size = (1 << p.bits) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weights(i):
        zi = z[i]
        return np.where(np.abs(zi) <= p.l1, 0.0,
                        -(zi - np.sign(zi) * p.l1) / ((p.beta + np.sqrt(n[i])) / p.alpha + p.l2))

    rows = [(np.append(i, size - 1), np.append(x, 1.0), y) for i, x, y in rows]
    for _ in range(p.epochs):
        for i, x, y in rows:
            w = weights(i)
            g = (1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            step = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / p.alpha
            z[i] += g - step * w
            n[i] += g * g
    return weights(slice(None)).astype(np.float32)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, eligible: Column, limit: int) -> DataFrame:
    """A repeatable sample of at most ``limit`` labelled texts: ``_id``, ``_y``, ``_text``.

    ``eligible`` is a condition on the label rows.  The sample is drawn from the
    label table (top ``limit`` by a hash of the id, kept per task), so only its
    texts move; joining it as a broadcast is bounded by ``limit``."""
    lab = (labels.filter(eligible & F.col("doc_id").isNotNull() & F.col(label).isNotNull())
           .groupBy(F.col("doc_id").alias("_id")).agg(F.min(label).cast("double").alias("_y"))
           .orderBy(F.xxhash64("_id"), "_id").limit(limit))
    d = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"))
    return (d.join(F.broadcast(lab), "_id").groupBy("_id", "_y").agg(F.min("_text").alias("_text")))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", eligible: Column | None = None,
          p: Params = Params()) -> np.ndarray:
    """Fit on a bounded sample of the labelled rows; returns the weights.

    The sample (at most ``p.train_rows`` texts) is read by one task in hash
    order; what comes back are the non-zero weights, at most 2**bits + 1."""
    sample = training_rows(docs, labels, label, F.lit(True) if eligible is None else eligible, p.train_rows)

    def fit(batches):
        rows = [(*features(t, p.bits, p.scale), y)
                for b in batches for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        if not rows:
            return
        w = ftrl(rows, p)
        i = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(w[i], pa.float32())], names=["i", "w"])

    one = (sample.select(utf8(F.col("_text")).alias("t"), "_y", "_id").coalesce(1)
           .sortWithinPartitions(F.xxhash64("_id"), "_id").select("t", "_y"))
    got = one.mapInArrow(fit, "i long, w float").toPandas()
    weights = np.zeros((1 << p.bits) + 1, np.float32)
    weights[got["i"].to_numpy(np.int64)] = got["w"].to_numpy(np.float32)
    return weights


def scores(texts: list[bytes], weights: np.ndarray, p: Params) -> np.ndarray:
    """Probability of label 1 for each text."""
    out = np.empty(len(texts))
    for lo, hi in T.chunks(texts):
        b, off = ngram_buckets(texts[lo:hi], p.bits)
        dot = T.segment_sum(weights[b], off) * (p.scale / np.maximum(np.diff(off), 1))
        out[lo:hi] = 1.0 / (1.0 + np.exp(-np.clip(dot + weights[-1], -35, 35)))
    return out.round(9)  # the sums depend on a text's neighbours in their last bits


def score(docs: DataFrame, weights: np.ndarray, p: Params = Params(), text: str = "text",
          out: str = "score") -> DataFrame:
    """``docs`` with the column ``out``; one pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    @F.arrow_udf("double")
    def judge(t: pa.Array) -> pa.Array:
        return pa.array(scores(t.to_pylist(), shared.value, p))

    return docs.withColumn(out, judge(utf8(F.col(text))))
