"""Corpus pipeline: five of the corpus operators over ``documents``, one after the other.

quality classifier (documents that it rejects go), SimHash near-dedup (one
document of each group stays), benchmark decontamination (documents with a
benchmark window go), PII (spans become marks), mixing to target weights
(documents are sampled by calibrated probabilities).  A stage takes (spark,
docs, sf_dir) and returns a frame; what it returns is written as Parquet and
read again as the next stage's documents.  All but the last return the columns
of ``documents``; the last adds ``mix_probability``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlake.llm import decontam, mixing, pii, quality, simhash
from textlake.llm.common import free_name, prepare, table
from textlake.session import checkpoint_dir


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the classifier takes for good (score at or above its threshold).

    It is trained on the labelled documents of the stage's own input; an
    unlabelled corpus gives the score 0.5 everywhere, and then nothing is rejected."""
    prepare(spark)
    p = quality.Params()
    weights = quality.train(docs, table(spark, sf_dir, "labels"), "quality", None, p)
    if not weights.any():
        return docs
    score = free_name(docs, "_score")
    return quality.score(docs, weights, p, out=score).filter(F.col(score) >= p.threshold).drop(score)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: that with the least id."""
    prepare(spark)
    return simhash.dedup(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of the benchmark go."""
    prepare(spark)
    return decontam.remove(docs, table(spark, sf_dir, "benchmark"), "documents")


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes marks such as <EMAIL>; n_chars follows the text."""
    prepare(spark)
    return pii.redact(docs, length="n_chars")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled towards the target shares of source, language and topic."""
    prepare(spark)
    return mixing.mix(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
]

#: SQL can't express the first two stages; they are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every result is written to the shared
    checkpoint folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
