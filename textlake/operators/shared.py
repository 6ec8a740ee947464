"""Arrays in the shared checkpoint folder: tasks write them, tasks read them, so a table that every task needs is
stored once instead of being sent to each.  A task writes under a name of its own and returns it; a repeated task does no harm."""

from __future__ import annotations

import gc
import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlake.session import checkpoint_dir

#: Spark drops the shuffle files of a query once its rows are checkpointed.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

ROW_BLOCK = 1 << 15      # ids whose sums travel as one record
SUMS = "kind int, block long, part int, ids binary, sums binary"


def folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _at(path: str):
    """The store and the path in it; no store for a path that a worker can open."""
    if path.startswith("file:"):
        return None, "/" + path[5:].lstrip("/")
    if "://" not in path:
        return None, path
    from pyarrow import fs
    return fs.FileSystem.from_uri(path)


def write(path: str, *arrays: np.ndarray) -> str:
    """Writes the arrays one after the other to a new file; its name."""
    name, (store, root) = uuid.uuid4().hex, _at(path)
    if store is None:
        os.makedirs(root, exist_ok=True)
        with open(f"{root}/{name}", "wb") as f:
            for a in arrays:
                np.ascontiguousarray(a).tofile(f)
    else:
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/{name}") as f:
            for a in arrays:
                f.write(np.ascontiguousarray(a))
    return name


def read(path: str, name: str) -> np.ndarray:
    """The bytes of a file, mapped where that is possible."""
    store, root = _at(path)
    if store is None:
        file = f"{root}/{name}"
        return np.memmap(file, np.uint8, "r") if os.path.getsize(file) else np.empty(0, np.uint8)
    with store.open_input_file(f"{root}/{name}") as f:
        return np.frombuffer(f.read(), np.uint8)


def drop(path: str, names: list[str]) -> None:
    """Removes files that no task reads any more."""
    store, root = _at(path)
    for name in names:
        os.remove(f"{root}/{name}") if store is None else store.delete_file(f"{root}/{name}")


@contextmanager
def files_dropped(spark: SparkSession):
    """Inside, a query's shuffle files go when it ends.  Only for queries whose rows are checkpointed or collected."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def forget(spark: SparkSession) -> None:
    """Spark removes what the driver holds no more (checkpoints, if it is told to clean them) when the JVM has
    collected its garbage, which by itself it seldom does."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def even_numbers(spark: SparkSession, units: int, parts: int) -> DataFrame:
    """(_k, _unit): a number for each of ``units``, so that Spark's hash deals the numbers evenly to ``parts``."""
    found: dict[int, list[int]] = {}
    tried = spark.range(16 * units + 64).select(F.col("id").cast("int").alias("i"))
    for r in tried.select("i", F.pmod(F.hash("i"), F.lit(parts)).alias("p")).orderBy("i").collect():
        found.setdefault(r["p"], []).append(r["i"])
    turns = sorted((turn, p, i) for p, numbers in found.items() for turn, i in enumerate(numbers))[:units]
    return spark.createDataFrame([(k, i) for k, (_, _, i) in enumerate(turns)], "_k int, _unit int")


def squeezed(values: np.ndarray) -> bytes:
    """Values compressed byte by byte: all first bytes, all second ones and so on."""
    planes = np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T)
    return pa.Codec("zstd", compression_level=1).compress(planes.tobytes(), asbytes=True)


def swollen(raw: bytes, n: int, kind) -> np.ndarray:
    kind = np.dtype(kind)
    planes = np.frombuffer(pa.Codec("zstd").decompress(raw, n * kind.itemsize, asbytes=True), np.uint8).reshape(kind.itemsize, n)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def place(ids: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where ``wanted`` lie in the sorted ``ids``, and which of them do."""
    at = np.searchsorted(ids, wanted)
    ok = at < len(ids)
    ok[ok] = ids[at[ok]] == wanted[ok]
    return at, ok


def stored(df: DataFrame, folder: str) -> list[str]:
    """Files of the rows (id, share, keep, v0..) of ``df``, one a partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if len(b)]
        if held:
            t = pa.Table.from_batches(held)
            name = write(folder, np.array([len(t)]), t["id"].to_numpy(), t["share"].to_numpy(), t["keep"].to_numpy(),
                            *[t[c].to_numpy() for c in t.column_names[3:]])
            yield pa.RecordBatch.from_arrays([pa.array([name])], ["name"])
    return sorted(r["name"] for r in df.mapInArrow(run, "name string").collect())


def load(folder: str, names: list[str], dim: int, wanted: np.ndarray | None = None, order: str = "C") -> tuple[np.ndarray, ...]:
    """(ids, share, keep, vectors) by rising id of stored rows, those of the sorted ``wanted`` if given."""
    files = []
    for name in names:
        raw = read(folder, name)
        n = int(raw[:8].view(np.int64)[0])
        files.append((raw[8:8 + 16 * n].view(np.int64).reshape(2, n), raw[8 + 16 * n:].view(np.float64).reshape(dim + 1, n)))
    keep = [slice(None) if wanted is None else np.flatnonzero(place(wanted, ids[0])[1]) for ids, _ in files]
    ids = np.concatenate([f[0][0][k] for f, k in zip(files, keep)]) if files else np.empty(0, np.int64)
    rising = np.argsort(ids, kind="stable")
    rank = np.empty(len(ids), np.int64)
    rank[rising] = np.arange(len(ids))
    share, prob, vec, lo = np.empty(len(ids), np.int64), np.empty(len(ids)), np.empty((len(ids), dim), order=order), 0
    for (whole_ids, rest), k in zip(files, keep):
        at = rank[lo:lo + len(whole_ids[0][k])]
        share[at], prob[at] = whole_ids[1][k], rest[0][k]
        for j in range(dim):
            vec[at, j] = rest[j + 1][k]
        lo += len(at)
    return ids[rising], share, prob, vec


def packed_sums(kind: int, part: int, ids: np.ndarray, D: np.ndarray) -> Iterator[pa.RecordBatch]:
    """``SUMS`` of the columns of ``D`` (dimension x ids) that aren't zero; a block is a range of ids, alike in all parts."""
    block = ids // ROW_BLOCK
    cuts = np.r_[0, np.flatnonzero(np.diff(block)) + 1, len(ids)] if len(ids) else []
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        moved = D[:, lo:hi].any(axis=0)
        if moved.any():
            yield pa.RecordBatch.from_arrays([
                pa.array([kind], pa.int32()), pa.array([block[lo]], pa.int64()), pa.array([part], pa.int32()),
                pa.array([ids[lo:hi][moved].astype(np.int64).tobytes()], pa.binary()), pa.array([np.ascontiguousarray(D[:, lo:hi][:, moved]).tobytes()], pa.binary())],
                ["kind", "block", "part", "ids", "sums"])


def added_sums(dim: int):
    """Arrow task: the packed sums of a block of rows -> (kind, id, d0..), added up in the order of the units."""
    def run(records: pa.Table) -> pa.Table:
        records = records.sort_by("part")
        ids = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in records["ids"]])
        rows, at = np.unique(ids, return_inverse=True)
        total, lo = np.zeros((dim, len(rows))), 0
        for x in records["sums"]:
            part = np.frombuffer(x.as_buffer(), np.float64).reshape(dim, -1)
            total[:, at[lo:lo + part.shape[1]]] += part                # an id stands once in a record
            lo += part.shape[1]
        return pa.Table.from_arrays([pa.array(np.full(len(rows), records["kind"][0].as_py(), np.int32)), pa.array(rows), *map(pa.array, total)],
                                    ["kind", "id", *[f"d{i}" for i in range(dim)]])
    return run
