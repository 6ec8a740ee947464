"""User functions over rows and chunks (UDF-01..03).

The reference runs a Python function over chunks of a list in a process
pool and restores input order.  On Spark the partitions are the chunks:
``mapInPandas`` hands the function Arrow batches of bounded size, and order
is restored (when asked) by a sort on a key at the end.
"""

from __future__ import annotations

from typing import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType


def map_rows(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str,
             key: str | None = None) -> DataFrame:
    """UDF-01: ``fn`` over every row (vectorised per Arrow batch); results
    sorted by ``key`` when given."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield fn(b)
    out = df.mapInPandas(run, schema)
    return out.orderBy(key) if key else out


def map_chunks(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str,
               chunk_rows: int = 10_000) -> DataFrame:
    """UDF-02: ``fn`` over chunks of at most ``chunk_rows`` rows.  Chunks are
    slices of partitions, so no key can make one chunk hold a third of the
    data; callers combine partial results with a Spark aggregate."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), chunk_rows):
                yield fn(b.iloc[i:i + chunk_rows])
    return df.mapInPandas(run, schema)


@F.arrow_udf(ArrayType(StringType()))
def blank_split_lower(s: pa.Array) -> pa.Array:
    """UDF-03 example tokenizer: A-Z lowered, split on blanks, empties out.  Arrow kernels cut up
    the batch, so no word becomes a Python object."""
    split = pc.split_pattern(pc.ascii_lower(pc.fill_null(s, "")), " ")
    words = pc.list_flatten(split)
    kept = pc.not_equal(words, "")
    sizes = np.bincount(pc.list_parent_indices(split).filter(kept).to_numpy(), minlength=len(split))
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), words.filter(kept))
