"""Time helpers (DAT-01..03).  All arithmetic is in microseconds."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"   # fixed value: the posts' time format
US_PER_DAY = 86_400_000_000
US_PER_HOUR = 3_600_000_000


def to_micros(col: Column) -> Column:
    """Microseconds since the epoch of a TIMESTAMP or TIMESTAMP_NTZ column
    (session time zone is UTC, so both read the same wall clock)."""
    return F.unix_micros(col.cast("timestamp"))


def from_micros(col: Column) -> Column:
    """Naive (TIMESTAMP_NTZ) timestamp from epoch microseconds."""
    return F.timestamp_micros(col).cast("timestamp_ntz")


def parse_time(col: Column, fallback: Column | None = None) -> Column:
    """DAT-01: parse the fixed format; unparsable values take ``fallback``."""
    t = F.try_to_timestamp(col.cast("string"), F.lit(TIME_FORMAT)).cast("timestamp_ntz")
    return t if fallback is None else F.coalesce(t, fallback)


def interval_of(parts) -> Column:
    """DAT-02: interval from ``[days, hours, minutes, seconds]``."""
    d, h, m, s = parts
    return F.make_dt_interval(F.lit(d), F.lit(h), F.lit(m), F.lit(s))


def since(now: Column, parts) -> Column:
    """DAT-02: ``now - interval``; ``now`` is an argument for repeatability."""
    return now - interval_of(parts)


def hour_edge(col: Column) -> Column:
    """DAT-03: the next full hour; inside hour 23 that hour's own start."""
    start = F.date_trunc("hour", col).cast("timestamp_ntz")
    return F.when(F.hour(col) < 23, start + F.expr("INTERVAL 1 HOUR")).otherwise(start)


def hour_edge_py(t: _dt.datetime) -> _dt.datetime:
    """Same rule for a driver-side scalar (bin edges are plan constants)."""
    start = t.replace(minute=0, second=0, microsecond=0)
    return start + _dt.timedelta(hours=1) if t.hour < 23 else start


def micros_py(t: _dt.datetime) -> int:
    epoch = _dt.datetime(1970, 1, 1)
    return (t - epoch) // _dt.timedelta(microseconds=1)


def interval_micros(parts) -> int:
    d, h, m, s = parts
    return micros_py(_dt.datetime(1970, 1, 1) + _dt.timedelta(days=d, hours=h, minutes=m, seconds=s))
