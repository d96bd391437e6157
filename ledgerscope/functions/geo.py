"""Great-circle distance as a JVM-side Column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed value: mean Earth radius in km used by the haversine formula
EARTH_RADIUS_KM = 6371.0


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Haversine distance in km.  ``least(1, a)`` keeps near-antipodal points
    inside the ``asin`` domain (the result stays finite)."""
    p1, p2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    dlat = p2 - p1
    dlon = F.radians(_c(lon2)) - F.radians(_c(lon1))
    s_lat = F.sin(dlat / 2)
    s_lon = F.sin(dlon / 2)
    a = s_lat * s_lat + F.cos(p1) * F.cos(p2) * s_lon * s_lon
    return F.lit(EARTH_RADIUS_KM) * 2 * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """Same formula as SQL text (runs in Spark SQL and DuckDB)."""
    return (
        f"({EARTH_RADIUS_KM} * 2 * asin(sqrt(least(1.0, "
        f"sin((radians({lat2}) - radians({lat1})) / 2) * sin((radians({lat2}) - radians({lat1})) / 2)"
        f" + cos(radians({lat1})) * cos(radians({lat2}))"
        f" * sin((radians({lon2}) - radians({lon1})) / 2) * sin((radians({lon2}) - radians({lon1})) / 2)))))"
    )
