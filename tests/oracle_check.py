"""Compare a Spark query with its DuckDB oracle SQL (what the driver does).

Usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402,F401
import pandas as pd  # noqa: E402

from textlake.sources.tables import TABLES  # noqa: E402


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 5)
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime().replace(tzinfo=None)
    if hasattr(v, "tolist") and not isinstance(v, (str, bytes)):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def frame_rows(pdf: pd.DataFrame):
    cols = sorted(pdf.columns)
    rows = [tuple(_norm(r[c]) for c in cols) for r in pdf.to_dict("records")]
    return cols, sorted(rows, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    spdf = sdf.toPandas()
    t1 = time.time()
    dpdf = con.execute(sql).df() if sql else None
    t2 = time.time()
    if dpdf is None:
        return dict(name=name, ok=None, rows=len(spdf), spark_s=round(t1 - t0, 2))
    sc, sr = frame_rows(spdf)
    dc, dr = frame_rows(dpdf)
    ok = sc == dc and sr == dr
    info = dict(name=name, ok=ok, rows=(len(sr), len(dr)), spark_s=round(t1 - t0, 2), duck_s=round(t2 - t1, 2))
    if not ok:
        if sc != dc:
            info["cols"] = (sc, dc)
        else:
            diff = [(a, b) for a, b in zip(sr, dr) if a != b][:3]
            info["diff"] = diff
    return info


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    import __spark_entry__ as E
    from textlake.session import get_spark
    if os.environ.get("PLAIN_SESSION"):
        # a bare session, as an outside driver would build it
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").getOrCreate()
        spark.sparkContext.setLogLevel("ERROR")
    else:
        spark = get_spark("local[8]", shuffle_partitions=8)
    con = duck(sf_dir)
    qs, os_ = E.queries(), E.oracle_sql()
    bad = 0
    for n in (names or sorted(qs)):
        try:
            r = compare(spark, con, n, qs[n], os_.get(n), sf_dir)
        except Exception as e:  # report and go on
            r = dict(name=n, ok=False, error=repr(e)[:600])
        if r.get("ok") is False:
            bad += 1
        print(r, flush=True)
    print("FAILED", bad)


if __name__ == "__main__":
    main()
