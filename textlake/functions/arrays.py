"""Vector helpers on ARRAY<FLOAT/DOUBLE> columns (ARR-03..05).

Built-in higher-order functions (zip_with, aggregate, transform), computed
in double precision.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def vec_add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") + y.cast("double"))


def vec_sub(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))


def vec_scale(a: Column, s: Column | float) -> Column:
    s = s if isinstance(s, Column) else F.lit(s)
    return F.transform(a, lambda x: x.cast("double") * s)


def vec_dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def vec_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0).cast("double"), lambda acc, x: acc + x.cast("double"))


def vec_norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0).cast("double"), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def vec_cosine(a: Column, b: Column) -> Column:
    return vec_dot(a, b) / (vec_norm(a) * vec_norm(b))


def vec_argmax(a: Column) -> Column:
    """0-based position of the first largest element."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def zeros(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0).cast("double"), dim)


def normalize_rows(v: Column) -> Column:
    """ARR-04: divide by the L2 norm; a zero row stays zero.  The norm is
    bound once (``let``), not recomputed for every element."""
    from textlake.functions.text import let

    def body(s):
        n, vv = s["n"], s["v"]
        return F.when(n > 0, F.transform(vv, lambda x: x.cast("double") / n)).otherwise(as_double(vv))
    return let(F.struct(v.alias("v"), vec_norm(v).alias("n")), body)


def scale_by(v: Column, d: Column) -> Column:
    """``v / d`` element-wise with ``d`` evaluated once."""
    from textlake.functions.text import let
    return let(F.struct(v.alias("v"), d.alias("d")), lambda s: F.transform(s["v"], lambda x: x / s["d"]))


def expand_vector(df: DataFrame, col: str, n: int, prefix: str = "dim") -> DataFrame:
    """ARR-05: spread a vector into columns dim0..dim{n-1}."""
    others = [c for c in df.columns if c != col]
    return df.select(*others, *[F.col(col)[i].alias(f"{prefix}{i}") for i in range(n)])


def group_vector_stats(df: DataFrame, keys, vec: str, metric: str = "mean", out: str = "vec",
                       weight: str | None = None) -> DataFrame:
    """Element-wise (weighted) mean or sum of ``vec`` per key with Spark ML's
    ``Summarizer`` (a JVM aggregate with map-side partial aggregation: no
    list is collected per key, so a hot key is not one task's memory)."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    v = array_to_vector(as_double(F.col(vec)))
    w = [F.col(weight)] if weight else []
    m = Summarizer.mean(v, *w) if metric == "mean" else Summarizer.sum(v, *w)
    g = df.groupBy(*keys).agg(m.alias("_m"), F.count(F.lit(1)).alias("_cnt"))
    return g.select(*keys, vector_to_array("_m").alias(out), "_cnt")
