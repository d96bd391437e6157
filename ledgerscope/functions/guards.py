"""Null / NaN / zero guards that reproduce the pandas semantics the
detectors were specified with (NaN compares false, fillna, replace(0, 1))."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nan_to_null(c) -> Column:
    """Spark aggregates skip NULL but not NaN, and ``NaN > 3`` is true in
    Spark: turn NaN into NULL once, at ingest."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nanvl(c, F.lit(None).cast("double"))


def flag(cond: Column) -> Column:
    """0/1 integer flag; an unknown (NULL) condition is 0."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def safe_std(std: Column) -> Column:
    """Sample std with NULL (one row) or 0 replaced by 1."""
    return F.coalesce(F.nullif(std, F.lit(0.0)), F.lit(1.0))


def safe_ratio_denominator(x: Column) -> Column:
    """Denominator with 0 (or NULL) replaced by 1."""
    return F.coalesce(F.nullif(x, F.lit(0.0)), F.lit(1.0))
