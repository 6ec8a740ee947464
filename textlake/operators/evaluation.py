"""Classifier evaluation and prediction (AGG-06, AGG-07, FLT-07, MDL-05, TOP-02).

Prediction broadcasts the output matrix (one row per label) while it is one tile;
a larger one meets the rows tile by tile in a join of blocks.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LABEL_TILE = 4096   # labels scored at once for a batch of rows
ROW_BLOCK = 8192    # sentence vectors that meet a tile of labels in one task


def confusion(df: DataFrame, y: str = "y", pred: str = "prediction") -> DataFrame:
    """AGG-06: long-form confusion matrix (y, prediction, n)."""
    return df.groupBy(y, pred).agg(F.count(F.lit(1)).alias("n"))


def class_recall(df: DataFrame, c, y: str = "y", pred: str = "prediction") -> DataFrame:
    """AGG-06: recall of class ``c`` = hits / rows of that class."""
    d = df.filter(F.col(y) == c)
    return d.agg(F.lit(c).alias("class"), (F.sum((F.col(pred) == c).cast("int")) / F.count(F.lit(1))).alias("recall"))


def errors(df: DataFrame, y: str = "y", pred: str = "prediction") -> DataFrame:
    """FLT-07: misclassified rows."""
    return df.filter(F.col(y) != F.col(pred))


def precision_recall_at_k(df: DataFrame, k: int, true: str = "true_labels", pred: str = "pred_labels",
                          words: str = "words") -> DataFrame:
    """AGG-07: N (rows with a label and a word), P@k = hits / (k N), R@k = hits / sum(labels)."""
    d = df.filter((F.size(true) > 0) & (F.size(words) > 0))
    top = F.slice(F.col(pred), 1, k)
    hits = F.size(F.filter(top, lambda p: F.array_contains(F.col(true), p)))
    return d.agg(F.count(F.lit(1)).alias("n"),
                 (F.sum(hits) / (F.lit(k) * F.count(F.lit(1)))).alias(f"p_at_{k}"),
                 (F.sum(hits) / F.sum(F.size(true))).alias(f"r_at_{k}"))


def _softmax_state(H: np.ndarray, W: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows H against a tile of label rows W: largest logit, sum of exp(logit - largest), and the k
    best logits with their positions (ties: the earlier label)."""
    z = H @ W.T
    top = z.max(axis=1)
    norm = np.exp(z - top[:, None]).sum(axis=1)
    best = np.argsort(-z, axis=1, kind="stable")[:, :k]
    return top, norm, np.take_along_axis(z, best, 1), best


def _rows(col: pd.Series) -> np.ndarray:
    return np.stack(col.to_numpy()).astype(np.float64)


def predict(hidden: DataFrame, key: str, output: DataFrame, k: int = 1, threshold: float = 0.0,
            label_tile: int = LABEL_TILE, row_block: int = ROW_BLOCK) -> DataFrame:
    """MDL-05: softmax over ``hidden . output_row`` for every label, the k
    best with their (exact) probabilities.

    ``hidden``: (key, vec) sentence vectors (VEC-02 mean of feature rows);
    ``output``: (label, vec), one row a label.  Returns (key, rank, label, prob); ties go to the smaller label.
    Up to ``label_tile`` label rows are broadcast and a batch is scored where it lies; more of
    them go the way of ``predict_tiled``, so the label rows that reach the driver are bounded.
    """
    key_type = dict(hidden.dtypes)[key]
    schema = f"{key} {key_type}, rank int, label string, prob double"
    rows = output.select("label", "vec").limit(label_tile + 1).collect()       # bounded by the tile
    if not rows:                                      # no label, no prediction
        return hidden.sparkSession.createDataFrame([], schema)
    if len(rows) > label_tile:
        return predict_tiled(hidden, key, output, k, threshold, label_tile, row_block)
    rows.sort(key=lambda r: r["label"])
    labels = np.array([r["label"] for r in rows], dtype=object)
    W = hidden.sparkSession.sparkContext.broadcast(np.stack([np.asarray(r["vec"], dtype=np.float64) for r in rows]))
    kk = min(k, len(labels))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            top, norm, best, ids = _softmax_state(_rows(b["vec"]), W.value, kk)
            p = np.exp(best - top[:, None]) / norm[:, None]
            out = pd.DataFrame({key: np.repeat(b[key].to_numpy(), kk), "rank": np.tile(np.arange(1, kk + 1), len(b)).astype(np.int32),
                                "label": labels[ids].ravel(), "prob": p.ravel()})
            yield out[out["prob"] >= threshold]
    return hidden.select(key, "vec").mapInPandas(run, schema)


def predict_tiled(hidden: DataFrame, key: str, output: DataFrame, k: int = 1, threshold: float = 0.0,
                  label_tile: int = LABEL_TILE, row_block: int = ROW_BLOCK) -> DataFrame:
    """MDL-05 for any number of labels: hash tiles of label rows meet blocks of sentence vectors by an
    equality join on both numbers; a task holds one of each and gives every sentence a softmax state (largest
    logit, sum of exp, k best).  The states of a sentence, one a tile, merge by addition, so nothing of
    the label table passes through the driver.  Sentences are told apart by a row number that a checkpoint
    fixes, so repeated keys are answered row by row."""
    h = hidden.select(key, "vec").withColumn("_row", F.monotonically_increasing_id()).checkpoint()
    n_tile = max(1, -(-output.count() // label_tile))
    n_block = max(1, -(-h.count() // row_block))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = h.select("_row", "vec", block("_row", n_block).alias("_b")).withColumn("_t", every(n_tile))
    right = output.select("label", "vec", block("label", n_tile).alias("_t")).withColumn("_b", every(n_block))

    def state(l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(l) or not len(r):
            return pd.DataFrame({"_row": [], "top": [], "norm": [], "z": [], "label": []}).astype({"_row": "int64"})
        r = r.sort_values("label", kind="stable")
        top, norm, best, ids = _softmax_state(_rows(l["vec"]), _rows(r["vec"]), k)
        return pd.DataFrame({"_row": l["_row"].to_numpy(), "top": top, "norm": norm, "z": list(best),
                             "label": list(r["label"].to_numpy()[ids])})

    states = left.groupBy("_b", "_t").cogroup(right.groupBy("_b", "_t")).applyInPandas(
        state, "_row bigint, top double, norm double, z array<double>, label array<string>")
    merged = states.groupBy("_row").agg(
        F.max("top").alias("_top"), F.collect_list(F.struct("top", "norm")).alias("_s"),
        F.flatten(F.collect_list(F.zip_with("z", "label", lambda z, l: F.struct((-z).alias("nz"), l.alias("label"))))).alias("_c"))
    norm = F.aggregate("_s", F.lit(0.0), lambda a, s: a + s["norm"] * F.exp(s["top"] - F.col("_top")))
    best = merged.select("_row", "_top", norm.alias("_norm"),
                         F.posexplode(F.slice(F.array_sort("_c"), 1, k)).alias("_i", "_b"))
    out = best.select("_row", (F.col("_i") + 1).cast("int").alias("rank"), F.col("_b")["label"].alias("label"),
                      (F.exp(-F.col("_b")["nz"] - F.col("_top")) / F.col("_norm")).alias("prob"))
    return h.select("_row", key).join(out, "_row").filter(F.col("prob") >= threshold).select(key, "rank", "label", "prob")


def sentence_hidden(df: DataFrame, key: str, tokens: str, rows: DataFrame, dim: int) -> DataFrame:
    """VEC-02(b) for a classifier: mean of the input rows of the known words
    of each line (unknown words have no features); none -> zeros.  A row is
    sent once to a unit of lines (``vectors.row_sums``)."""
    from textlake.functions import arrays as A
    from textlake.operators.vectors import row_sums
    s = row_sums(df, key, tokens, rows.select("word", "vec", F.lit(1.0).alias("scale")), dim)
    h = s.select(key, A.scale_by(F.col("vec"), F.col("n")).alias("vec"))
    return df.select(key).join(h, key, "left").select(key, F.coalesce("vec", A.zeros(dim)).alias("vec"))
