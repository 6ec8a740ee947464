"""The tokenizer passed as a function works on Arrow arrays."""

import pyarrow as pa
from pyspark.sql import functions as F

from textlake.operators import udf as U


def test_blank_split_works_on_arrow_arrays(spark):
    rows = [("A  bÉ c ",), (None,), ("",), (" ",), ("x",)]
    got = spark.createDataFrame(rows, "t string").coalesce(1).select(U.blank_split_lower(F.col("t")).alias("w")).collect()
    assert [r["w"] for r in got] == [["a", "bÉ", "c"], [], [], [], ["x"]]
    assert isinstance(U.blank_split_lower.func(pa.array(["a b"])), pa.ListArray)
