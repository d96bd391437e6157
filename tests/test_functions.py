import math

import pytest
from pyspark.sql import functions as F

from ledgerscope.functions import day_of_week, haversine_km, is_night, is_weekend

# haversine reference values (R = 6371 km)
CASES = [
    ((40.71, -74.01), (35.68, 139.69), 10849.9537),
    ((40.71, -74.01), (42.36, -71.06), 306.4858),
    ((40.71, -74.01), (51.51, -0.13), 5570.4446),
    ((0.0, 0.0), (0.0, 180.0), 20015.0868),
]


def test_haversine(spark):
    rows = [(a[0], a[1], b[0], b[1]) for a, b, _ in CASES]
    df = spark.createDataFrame(rows, "lat1 double, lon1 double, lat2 double, lon2 double")
    got = [r[0] for r in df.select(haversine_km("lat1", "lon1", "lat2", "lon2")).collect()]
    for g, (_, _, want) in zip(got, CASES):
        assert round(g, 4) == pytest.approx(want, abs=1e-4)
        assert math.isfinite(g)


def test_calendar(spark):
    df = spark.createDataFrame([("2024-01-01 03:00:00",), ("2024-01-06 12:00:00",), ("2024-01-07 05:59:59",)], "s string")
    df = df.select(F.to_timestamp_ntz("s").alias("t"))
    got = df.select(day_of_week("t"), is_weekend("t"), is_night("t")).collect()
    assert [tuple(r) for r in got] == [(0, 0, 1), (5, 1, 0), (6, 1, 1)]
