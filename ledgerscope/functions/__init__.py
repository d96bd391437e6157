"""Column-level helpers (pure ``pyspark.sql.functions`` expressions)."""

from ledgerscope.functions.geo import haversine_km
from ledgerscope.functions.guards import (
    flag, nan_to_null, safe_std, safe_ratio_denominator)
from ledgerscope.functions.temporal import (
    epoch_micros, hour_of, day_of_week, is_weekend, is_night)

__all__ = [
    "haversine_km", "flag", "nan_to_null", "safe_std", "safe_ratio_denominator",
    "epoch_micros", "hour_of", "day_of_week", "is_weekend", "is_night",
]
