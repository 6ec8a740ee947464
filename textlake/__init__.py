"""textlake: text and trend analytics as Spark DataFrame / SQL / ML jobs.

Layout
------
sources/    table loading, derived fixtures, file readers and writers
functions/  Column -> Column building blocks (text, hashing, arrays, time)
operators/  DataFrame -> DataFrame operators (posts, bins, vocabulary,
            n-grams, vectors, evaluation, quantization, models, UDF glue)
plans/      end-to-end plans built from operators (trend matrix, topic script)
streaming/  Structured Streaming versions of ingest, repeat removal and bins
"""

from textlake.session import get_spark, checkpoint_dir  # noqa: F401

__all__ = ["get_spark", "checkpoint_dir"]
