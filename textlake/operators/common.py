"""Shared distributed building blocks: consecutive numbering, repeatable
sampling and splits.

``dense_index`` replaces ``row_number()`` over a global (or hot-group)
window, which would pull the whole table (or a third of it) into one task:
the frame is range-sorted, each row gets its position inside its sort
partition, and the per-(partition, group) counts (a table of
#partitions x #groups rows) give the offsets.  The sorted frame is
checkpointed to the shared checkpoint folder so both uses see the same
partitioning.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlake.session import checkpoint_dir


def _cols(xs):
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def dense_index(df: DataFrame, order: Sequence, group: Sequence[str] = (), name: str = "idx",
                start: int = 1, checkpoint: bool = True) -> DataFrame:
    """Consecutive number (from ``start``) by ``order`` within each ``group``.

    ``order`` must be a total order inside a group (break ties).
    """
    spark = df.sparkSession
    s = df.orderBy(*_cols(group), *_cols(order))
    s = (s.withColumn("_p", F.spark_partition_id())
          .withColumn("_m", F.monotonically_increasing_id()))
    s = s.withColumn("_r", F.col("_m") - F.shiftleft(F.col("_p").cast("bigint"), 33)).drop("_m")
    if checkpoint:
        checkpoint_dir(spark)
        s = s.checkpoint(eager=True)
    g = list(group)
    cnt = s.groupBy("_p", *g).agg(F.count(F.lit(1)).alias("_c"), F.min("_r").alias("_r0"))
    w = Window.partitionBy(*g).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    off = cnt.withColumn("_off", F.coalesce(F.sum("_c").over(w), F.lit(0)))
    # #partitions rows without groups (then always broadcast by AQE); with
    # many groups it can grow, so the join side is left to AQE's size check
    off_t = off.select("_p", *g, "_off", "_r0")
    out = s.join(F.broadcast(off_t) if not g else off_t, ["_p", *g])
    idx = (F.col("_off") + F.col("_r") - F.col("_r0") + start).cast("bigint")
    return out.withColumn(name, idx).drop("_p", "_r", "_off", "_r0")


def hash_key(seed: int, key: Column) -> Column:
    """Repeatable pseudo-random order key: md5(seed || key) (same in DuckDB)."""
    return F.md5(F.concat(F.lit(str(seed)), key.cast("string")))


def hash_share(seed: int, key: Column) -> Column:
    """A number in [0, 1) from the first 8 hex digits of md5(seed || key)."""
    return F.conv(F.substring(hash_key(seed, key), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def sample_n(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """TOP-06: exactly ``n`` rows without replacement (top-n by hash: a
    TakeOrdered, each task keeps n candidates)."""
    return df.orderBy(hash_key(seed, F.col(key)), F.col(key)).limit(n)


def shuffle_rows(df: DataFrame, seed: int, key: str) -> DataFrame:
    """TOP-06: a repeatable permutation: the rows with their ``position`` (from 1)
    in the order of a hash of the key."""
    return dense_index(df, [hash_key(seed, F.col(key)), F.col(key)], name="position")


def split_share(df: DataFrame, share: float, seed: int, key: str) -> tuple[DataFrame, DataFrame]:
    """TOP-07: (train, held-out) by hash share; disjoint and repeatable."""
    h = hash_share(seed, F.col(key))
    return df.filter(h >= share), df.filter(h < share)


def split_head_tail(df: DataFrame, n: int, order: Sequence) -> tuple[DataFrame, DataFrame]:
    """TOP-07: first ``n`` rows by ``order`` and the rest."""
    ix = dense_index(df, order, name="_pos")
    return ix.filter(F.col("_pos") <= n).drop("_pos"), ix.filter(F.col("_pos") > n).drop("_pos")


def fill_forward(df: DataFrame, order: Sequence, col: str, group: Sequence[str] = ()) -> DataFrame:
    """Carry the last non-null ``col`` forward in ``order`` (within each
    ``group``) without a window over a whole group: fill inside each sort
    partition, then take the carry-in from the last value of the group in earlier
    partitions (#partitions rows, and one more for each further group)."""
    g = list(group)
    s = df.orderBy(*_cols(g), *_cols(order))
    s = (s.withColumn("_p", F.spark_partition_id())
          .withColumn("_m", F.monotonically_increasing_id()))
    checkpoint_dir(df.sparkSession)
    s = s.checkpoint(eager=True)
    wp = Window.partitionBy("_p", *g).orderBy("_m").rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("_fill", F.last(col, ignorenulls=True).over(wp))
    last = s.groupBy("_p", *g).agg(F.max_by(col, F.when(F.col(col).isNotNull(), F.col("_m"))).alias("_last"))
    wl = Window.partitionBy(*g).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    carry = last.withColumn("_carry", F.last("_last", ignorenulls=True).over(wl)).select("_p", *g, "_carry")
    # without groups #partitions rows; with groups the side is left to AQE's size check
    out = s.join(F.broadcast(carry) if not g else carry, ["_p", *g], "left")
    return out.withColumn(col, F.coalesce(F.col("_fill"), F.col("_carry"))).drop("_p", "_m", "_fill", "_carry")
