"""Spark session defaults shared by tests, bench and the driver entry."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on: UTC wall clock (the data is naive time),
# adaptive execution for runtime re-planning (partition coalescing, skew-join
# splitting, broadcast conversion from *measured* sizes) and no web UI.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Only sides whose measured size is below this are broadcast; anything
    # larger falls back to a shuffled join. This is the size check for every
    # join whose side is not bounded by construction.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    # Partition sizing: scans split at 128 MB; shuffles start wide and AQE
    # coalesces small ones (a cluster sets spark.sql.shuffle.partitions to a
    # few x its cores).
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
    # Window partitions here are bounded by one document / one topic's bins;
    # keep them in memory instead of spilling past 4096 rows.
    "spark.sql.windowExec.buffer.in.memory.threshold": str(1 << 16),
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Malformed CSV rows must not survive pruned reads (SRC-01).
    "spark.sql.csv.parser.columnPruning.enabled": "false",
}


def get_spark(master: str | None = None, app: str = "textlake",
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the package defaults.

    On a cluster pass ``master=None`` and let spark-submit decide; tests use
    ``local[*]`` with few shuffle partitions.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if master and master.startswith("local"):
        conf.setdefault("spark.driver.memory", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    for k, v in conf.items():
        if not k.startswith(("spark.driver.", "spark.ui.", "spark.master")):
            try:
                spark.conf.set(k, v)
            except Exception:  # static conf of an already running session
                pass
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints.

    A cluster names it in ``spark.checkpoint.dir``; we read it from the
    session. Only when it is unset (local tests) do we make our own.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="textlake-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``textlake`` importable on the executors (what ``--py-files``
    does at submit time): the package is zipped once per SparkContext and
    added with ``addPyFile``; Spark serves it to every executor."""
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    import zipfile
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    out = os.path.join(tempfile.mkdtemp(prefix="textlake-pyfiles-"), "textlake.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    p = os.path.join(d, f)
                    z.write(p, os.path.relpath(p, root))
    sc.addPyFile(out)
    _SHIPPED.add(key)
