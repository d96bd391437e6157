"""Calendar expressions on TIMESTAMP_NTZ / TIMESTAMP columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


_EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"
_UTC_NAMES = {"UTC", "Etc/UTC", "GMT", "Etc/GMT", "Z", "+00:00", "UTC+00:00"}


def _session_tz() -> str:
    from pyspark.sql import SparkSession
    s = SparkSession.getActiveSession()
    return s.conf.get("spark.sql.session.timeZone") if s is not None else "UTC"


def epoch_micros(ts) -> Column:
    """Microseconds since the epoch of the wall-clock value, whatever the
    session time zone.  Under UTC the cheap TIMESTAMP cast is exact;
    otherwise ``timestamp_diff`` on TIMESTAMP_NTZ (zone-free)."""
    if _session_tz() in _UTC_NAMES:
        return F.unix_micros(_c(ts).cast("timestamp_ntz").cast("timestamp"))
    return F.timestamp_diff("MICROSECOND", F.expr(_EPOCH_NTZ), _c(ts).cast("timestamp_ntz"))


def from_epoch_micros(us) -> Column:
    """Inverse of ``epoch_micros``: the TIMESTAMP_NTZ whose wall clock is
    ``us`` after the epoch.  The instant is shifted by the session zone
    before the NTZ cast, so the result does not depend on that zone."""
    t = F.timestamp_micros(_c(us))
    tz = _session_tz()
    if tz not in _UTC_NAMES:
        t = F.to_utc_timestamp(t, tz)
    return t.cast("timestamp_ntz")


def hour_of(ts) -> Column:
    return F.hour(_c(ts))


def day_of_week(ts) -> Column:
    """Monday = 0 ... Sunday = 6 (``weekday``; ``dayofweek`` is Sunday = 1)."""
    return F.weekday(_c(ts))


def is_weekend(ts) -> Column:
    return day_of_week(ts).isin(5, 6).cast("int")


def is_night(ts) -> Column:
    return hour_of(ts).between(0, 5).cast("int")
