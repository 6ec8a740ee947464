"""Product quantization of vector tables (QNT-01..06, TOP-03).

Vectors are cut into ``ceil(dim / dsub)`` parts (the last may be shorter).
Codebooks hold at most 256 centroids per part, so a codebook is bounded by
256 x dim numbers whatever the row count: it is the one thing broadcast.
Encoding is a ``mapInPandas`` arg-min against the broadcast codebook (no
row x centroid join); training is Lloyd rounds in which every task sums its
rows per centroid, with the small centroid table fed back.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textlake.functions import arrays as A
from textlake.operators.common import hash_key
from textlake.session import checkpoint_dir

KSUB = 256              # fixed value: centroids per part
NITER = 25              # fixed value: Lloyd rounds
SPLIT_EPS = 1e-7        # fixed value: distance of the two halves of a split cluster


def n_parts(dim: int, dsub: int) -> int:
    return -(-dim // dsub)


def _check_codebook(codebook: DataFrame) -> None:
    """A codebook holds at most 256 centroids per part: the bound that makes
    broadcasting it safe whatever the data size."""
    n, nsub = codebook.agg(F.count(F.lit(1)), F.countDistinct("sub")).first()
    if n > KSUB * max(nsub, 1):
        raise ValueError("codebook larger than 256 centroids per part")


def _codebook_arrays(codebook: DataFrame):
    """Codebook table (sub, code, centroid) -> {sub: (codes, matrix)}; its size
    is checked against the per-part bound before it leaves the cluster."""
    _check_codebook(codebook)
    out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for r in codebook.orderBy("sub", "code").collect():
        out.setdefault(r["sub"], ([], []))
        out[r["sub"]][0].append(r["code"])
        out[r["sub"]][1].append(np.asarray(r["centroid"], dtype=np.float64))
    return {s: (np.array(c, dtype=np.int64), np.stack(m)) for s, (c, m) in out.items()}


def pq_encode(df: DataFrame, codebook, dsub: int, key: str = "row_id", vec: str = "vec") -> DataFrame:
    """QNT-02: nearest centroid per part (lowest code on ties) -> (key, codes).
    ``codebook`` is a (sub, code, centroid) table or its checked arrays."""
    spark = df.sparkSession
    book0 = codebook if isinstance(codebook, dict) else _codebook_arrays(codebook)
    cb = spark.sparkContext.broadcast(book0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        book = cb.value
        subs = sorted(book)
        for b in batches:
            if len(b) == 0:
                continue
            X = np.stack(b[vec].to_numpy()).astype(np.float64)
            codes = np.empty((len(b), len(subs)), dtype=np.int64)
            for j, s in enumerate(subs):
                cids, C = book[s]
                part = X[:, s * dsub: s * dsub + C.shape[1]]
                d = ((part[:, None, :] - C[None, :, :]) ** 2).sum(axis=2)
                codes[:, j] = cids[np.argmin(d, axis=1)]
            yield pd.DataFrame({key: b[key].to_numpy(), "codes": list(codes)})
    kt = dict(df.dtypes)[key]
    return df.select(key, vec).mapInPandas(run, f"{key} {kt}, codes array<bigint>")


def pq_decode(codes: DataFrame, codebook: DataFrame, key: str = "row_id") -> DataFrame:
    """QNT-03: the centroids of a row's codes, concatenated in part order.
    The codebook side is bounded (<= 256 x parts rows) and broadcast."""
    _check_codebook(codebook)
    ex = codes.select(key, F.posexplode("codes").alias("sub", "code"))
    j = ex.join(F.broadcast(codebook.select("sub", "code", "centroid")), ["sub", "code"])
    g = j.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("sub", "centroid"))).alias("_p"))
    return g.select(key, F.flatten(F.transform("_p", lambda s: s["centroid"])).alias("vec"))


@dataclass
class Packed:
    """Coded rows (row_id, code: a byte a part, and one more for the norm where norms are
    apart) and the codebooks that the bytes point into (<= 256 x dim numbers)."""
    rows: DataFrame
    book: DataFrame                     # (sub, code, centroid)
    norm_book: DataFrame | None = None


def pack(codes: DataFrame, key: str = "row_id") -> DataFrame:
    """QNT-03: (key, code): the codes of a row as one binary, a byte each."""
    return codes.select(key, F.unhex(F.array_join(F.transform("codes", lambda c: F.lpad(F.hex(c), 2, "0")), "")).alias("code"))


def code_bytes(packed: Packed) -> int:
    """Bytes that the coded rows take, without keys and codebooks."""
    return packed.rows.agg(F.sum(F.length("code"))).first()[0] or 0


def weighted_means(members: DataFrame, key: str, packed: Packed) -> DataFrame:
    """QNT-06: (key, vec), the mean of the rows of ``members`` (key, row_id, w) by weight, added up
    from the codebooks inside tasks: what travels is a row's bytes and one sum a key, no
    decoded row.  Members without a coded row are left out, and so are keys without any."""
    spark = members.sparkSession
    parts = [m for _, (_, m) in sorted(_codebook_arrays(packed.book).items())]
    norms = None if packed.norm_book is None else _codebook_arrays(packed.norm_book)[0][1][:, 0]
    shared = spark.sparkContext.broadcast((parts, norms))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, norms = shared.value
        for b in batches:
            if not len(b):
                continue
            codes = np.frombuffer(b"".join(b["code"]), np.uint8).reshape(len(b), -1)
            w = b["w"].to_numpy()
            scale = w if norms is None else w * norms[codes[:, -1]]
            X = np.hstack([m[codes[:, j]] for j, m in enumerate(parts)]) * scale[:, None]
            at, first = pd.factorize(b[key])           # a key's rows lie together
            total = np.zeros((len(first), X.shape[1]))
            np.add.at(total, at, X)
            yield pd.DataFrame({key: first, "vec": list(total), "w": np.bincount(at, w)})
    met = members.join(packed.rows, "row_id").repartition(key).sortWithinPartitions(key, "row_id").select(key, "w", "code")
    sums = met.mapInPandas(run, f"`{key}` {dict(members.dtypes)[key]}, vec array<double>, w double")
    dim = sum(m.shape[1] for m in parts)
    g = sums.groupBy(key).agg(*[F.sum(F.col("vec")[i]).alias(f"v{i}") for i in range(dim)], F.sum("w").alias("w"))
    return g.select(key, F.array(*[F.col(f"v{i}") / F.col("w") for i in range(dim)]).alias("vec"))


def pq_dot(query_vec: list[float], codes: DataFrame, codebook: DataFrame, dsub: int, key: str = "row_id") -> DataFrame:
    """QNT-04: dot product of one query with every coded row by table
    look-up: a (sub, code) -> dot table (<= 256 x parts rows, broadcast),
    joined to the exploded codes and summed per row."""
    spark = codes.sparkSession
    qv = np.asarray(query_vec, dtype=np.float64)
    book = _codebook_arrays(codebook)
    rows = []
    for s, (cids, C) in book.items():
        dots = C @ qv[s * dsub: s * dsub + C.shape[1]]
        rows.extend((int(s), int(c), float(d)) for c, d in zip(cids, dots))
    table = spark.createDataFrame(rows, "sub int, code bigint, dot double")
    ex = codes.select(key, F.posexplode("codes").alias("sub", "code"))
    j = ex.join(F.broadcast(table), ["sub", "code"])
    return j.groupBy(key).agg(F.sum("dot").alias("dot"))


def _part_sums(book, dsub: int, vec: str):
    """Of one task: per (part, code) how many rows it is nearest to and their sum."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = book.value
        counts = {s: np.zeros(len(c), np.int64) for s, (c, _) in parts.items()}
        sums = {s: np.zeros_like(m) for s, (_, m) in parts.items()}
        for b in batches:
            if len(b) == 0:
                continue
            X = np.stack(b[vec].to_numpy()).astype(np.float64)
            for s, (_, C) in parts.items():
                part = X[:, s * dsub: s * dsub + C.shape[1]]
                near = ((part[:, None, :] - C[None, :, :]) ** 2).sum(axis=2).argmin(axis=1)
                counts[s] += np.bincount(near, minlength=len(C))
                np.add.at(sums[s], near, part)
        rows = [(s, i, int(n), sums[s][i]) for s in parts for i, n in enumerate(counts[s]) if n]
        if rows:
            yield pd.DataFrame(rows, columns=["sub", "i", "n", "total"])
    return run


def _split_empty(counts: np.ndarray, M: np.ndarray) -> None:
    """An empty cluster takes half of the fullest one, a hair apart from it."""
    for e in np.flatnonzero(counts == 0):
        big = int(counts.argmax())
        if counts[big] < 2:
            continue
        sign = np.where(np.arange(M.shape[1]) % 2, SPLIT_EPS, -SPLIT_EPS)
        M[e] = M[big] + sign
        M[big] -= sign
        counts[e] = counts[big] // 2
        counts[big] -= counts[e]


def pq_train(df: DataFrame, dsub: int, ksub: int = KSUB, niter: int = NITER, seed: int = 1234,
             key: str = "row_id", vec: str = "vec", start: DataFrame | None = None) -> DataFrame:
    """QNT-01: codebook (sub, code, centroid) by Lloyd's k-means per part over all rows.

    Seeds: the first ``ksub`` rows by md5(seed || key) (all rows if there are
    fewer) or the codebook ``start``.  In a round every task assigns its rows
    and emits one sum per (part, code); those are added up, so rows never move.
    Empty clusters split the fullest.  The rows are cut to the shared folder once."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    train = df.select(key, vec).checkpoint(eager=True)
    if start is not None:
        book = _codebook_arrays(start)
    else:
        seeds = train.orderBy(hash_key(seed, F.col(key)), key).limit(ksub).collect()
        dim = len(seeds[0][vec]) if seeds else 0
        X = np.array([list(r[vec]) for r in seeds], dtype=np.float64).reshape(len(seeds), dim)
        book = {s: (np.arange(len(seeds), dtype=np.int64), X[:, s * dsub:(s + 1) * dsub]) for s in range(n_parts(dim, dsub))}
    for _ in range(niter if book else 0):
        shared = spark.sparkContext.broadcast(book)
        found = (train.mapInPandas(_part_sums(shared, dsub, vec), "sub int, i int, n long, total array<double>")
                 .select("sub", "i", "n", F.posexplode("total").alias("d", "x")).groupBy("sub", "i", "d")
                 .agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect())      # <= 256 x dim rows
        counts = {s: np.zeros(len(c), np.int64) for s, (c, _) in book.items()}
        book = {s: (c, m.copy()) for s, (c, m) in book.items()}
        for r in found:
            counts[r["sub"]][r["i"]] = r["n"]
            book[r["sub"]][1][r["i"], r["d"]] = r["x"] / r["n"]
        for s, (_, M) in book.items():
            _split_empty(counts[s], M)
        shared.unpersist()
    return _book_df(spark, book)


def _book_df(spark, book) -> DataFrame:
    rows = [(int(s), int(c), [float(x) for x in M[i]]) for s, (cids, M) in book.items() for i, c in enumerate(cids)]
    return spark.createDataFrame(rows, "sub int, code bigint, centroid array<double>")


def quantize_norms(df: DataFrame, key: str = "row_id", vec: str = "vec") -> tuple[DataFrame, DataFrame]:
    """QNT-05: rows made unit and their norms apart: (unit rows, norm rows)."""
    unit = df.select(key, A.normalize_rows(F.col(vec)).alias(vec))
    norms = df.select(key, F.array(A.vec_norm(F.col(vec))).alias(vec))
    return unit, norms


def prune_by_norm(rows: DataFrame, n: int, key: str = "row_id", vec: str = "vec", eos_key=0) -> DataFrame:
    """TOP-03: keep the ``n`` rows of largest norm (the end-of-line row
    first), renumbered 0..n-1 in that order (a TakeOrdered of n rows)."""
    r = rows.withColumn("_eos", (F.col(key) == eos_key).cast("int")).withColumn("_norm", A.vec_norm(F.col(vec)))
    top = r.orderBy(F.col("_eos").desc(), F.col("_norm").desc(), key).limit(n)
    # n is the requested (small) model size: a window over n rows is bounded
    w = Window.orderBy(F.col("_eos").desc(), F.col("_norm").desc(), key)
    return top.withColumn("new_id", (F.row_number().over(w) - 1).cast("bigint")).drop("_eos", "_norm")
