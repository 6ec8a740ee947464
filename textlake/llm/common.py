"""Shared pieces of the corpus operators: tables, held-out folds, iteration cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textlake.session import checkpoint_dir, ship_package

#: The text columns of ``documents``.
DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Texts handed to Python at once; a few MB of prose.
ARROW_ROWS = 1000


def prepare(spark: SparkSession) -> None:
    """Session settings the operators rely on, and the package on the executors."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    ship_package(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; -1 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts, F.lit(-1))


def cut(df: DataFrame) -> DataFrame:
    """Write the frame to the shared checkpoint folder and go on from there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def utf8(text: Column) -> Column:
    """Bytes of a text; empty for null."""
    return F.coalesce(text, F.lit("")).cast("binary")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
