"""Null / tie / threshold cases of the rules (FIXTURES.md section 3)."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerscope.operators import rules as R
from ledgerscope.operators.features import engineer_features

SCHEMA = "transaction_id long, user_id long, timestamp timestamp_ntz, amount double, lat double, lon double, category string"
T0 = dt.datetime(2024, 1, 1, 12, 0, 0)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def row(i, user, minutes=0, amount=10.0, lat=40.71, lon=-74.01, cat="a"):
    return (i, user, T0 + dt.timedelta(minutes=minutes), amount, lat, lon, cat)


def by_id(df, *cols):
    return {r["transaction_id"]: tuple(r[c] for c in cols) for r in df.collect()}


def test_one_row_and_constant_user(spark):
    df = frame(spark, [row(1, 1, amount=50.0)] + [row(i, 2, minutes=i * 200, amount=50.0) for i in (2, 3, 4)])
    out, ran = R.detect_amount_anomaly(df)
    assert ran
    assert all(v == (0.0, 0) for v in by_id(out, "amount_z_score", "flag_amount_anomaly").values())


def test_nan_amount(spark):
    from ledgerscope.sources.transactions import clean_numeric
    df = clean_numeric(frame(spark, [row(1, 1, amount=10.0), row(2, 1, minutes=90, amount=float("nan")),
                                     row(3, 1, minutes=200, amount=20.0)]))
    out, _ = R.detect_amount_anomaly(df)
    got = by_id(out, "amount_z_score", "flag_amount_anomaly")
    assert got[2] == (0.0, 0)
    assert got[1][0] == pytest.approx(-5 / (50 ** 0.5))


def test_null_category_and_user(spark):
    rows = [row(i, 1, minutes=i * 61) for i in range(1, 20)] + [row(20, 1, minutes=20 * 61, cat=None)]
    rows += [row(21, None, minutes=5)]
    r = R.run_rules(frame(spark, rows))
    got = by_id(r.df, "cat_pct", "flag_category_deviation", "flag_temporal_anomaly", "txn_count_in_window",
                "travel_speed_kmh", "flag_amount_anomaly", "flag_location_deviation", "flag_velocity",
                "flag_geo_impossible")
    assert got[20][:2] == (0.0, 1)
    assert got[1][0] == pytest.approx(19 / 20)
    # null user: R3 and R5 flag, R1 R2 R4 R6 do not, count 0, speed 0
    assert got[21] == (0.0, 1, 1, 0, 0.0, 0, 0, 0, 0)


def test_speed_cases(spark):
    tokyo = (35.68, 139.69)
    rows = [row(1, 1, 0), row(2, 1, 240, lat=tokyo[0], lon=tokyo[1]),
            row(3, 2, 0), row(4, 2, 0, lat=tokyo[0], lon=tokyo[1])]
    out, _ = R.detect_geographic_impossibility(frame(spark, rows))
    got = by_id(out, "travel_speed_kmh", "flag_geo_impossible")
    assert got[1] == (0.0, 0)
    assert got[2][0] == pytest.approx(2712.49, abs=0.01) and got[2][1] == 1
    assert got[4] == (0.0, 0)  # same time, other place


def test_velocity_edges(spark):
    # exactly 60 minutes apart counts; 5 rows -> 0, 6 rows -> 1
    rows = [row(i, 1, minutes=(i - 1) * 12) for i in range(1, 7)]
    out, _ = R.detect_velocity(frame(spark, rows))
    got = by_id(out, "txn_count_in_window", "flag_velocity")
    assert got[5] == (5, 0)
    assert got[6] == (6, 1)


def test_equal_times_and_caps(spark):
    rows = [row(i, 1, 0) for i in range(1, 4)]
    out, _ = R.detect_velocity(frame(spark, rows))
    assert [v[0] for _, v in sorted(by_id(out, "txn_count_in_window").items())] == [1, 2, 3]
    rows = [(i, 1, T0 + dt.timedelta(seconds=i), 1.0, 0.0, 0.0, "a") for i in range(1, 31)]
    df = frame(spark, rows)
    rule, _ = R.detect_velocity(df)
    assert max(v[0] for v in by_id(rule, "txn_count_in_window").values()) == 30
    capped, _ = R.detect_velocity(df, lookback_rows=20)
    assert max(v[0] for v in by_id(capped, "txn_count_in_window").values()) == 21
    feat = engineer_features(df)
    assert max(v[0] for v in by_id(feat, "txn_count_1h").values()) == 30
    rows = [(i, 1, T0 + dt.timedelta(seconds=i // 2), 1.0, 0.0, 0.0, "a") for i in range(1, 61)]
    feat = engineer_features(frame(spark, rows))
    assert max(v[0] for v in by_id(feat, "txn_count_1h").values()) == 60


def test_share_threshold_not_flagged(spark):
    rows = [row(i, 1, minutes=i * 61, cat="a") for i in range(1, 20)] + [row(20, 1, minutes=20 * 61, cat="b")]
    out, _ = R.detect_category_deviation(frame(spark, rows))
    assert by_id(out, "cat_pct", "flag_category_deviation")[20] == (0.05, 0)


def test_antipodes_finite(spark):
    rows = [row(1, 1, 0, lat=0.0, lon=0.0), row(2, 1, 600, lat=0.0, lon=180.0)]
    out, _ = R.detect_geographic_impossibility(frame(spark, rows))
    assert by_id(out, "travel_speed_kmh")[2][0] == pytest.approx(20015.0868 / 10, abs=1e-3)


def test_skip_protocol_and_dynamic_threshold(spark):
    df = frame(spark, [row(i, 1, i * 30) for i in range(1, 5)]).drop("lat", "lon")
    r = R.run_rules(df)
    assert r.ran == {"amount": True, "location": False, "temporal": True, "velocity": True,
                     "category": True, "geo_speed": False}
    assert r.rules_run == 4
    assert r.df.where("location_distance_km <> 0 OR flag_geo_impossible <> 0").count() == 0
    r1 = R.run_rules(df.select("transaction_id", "user_id", "amount"))
    assert r1.rules_run == 1 and R.dynamic_threshold(1) == 1
    assert R.dynamic_threshold(0) is None and R.dynamic_threshold(3) == 2


def test_mapper_no_duplicate(spark):
    from ledgerscope.sources.transactions import map_generic_columns
    df = spark.createDataFrame([("TXN_000001", 3, "2024-01-01 10:00:00", 12.5, 40.0, -70.0, "grocery", 0)],
                               "transaction_id string, user_id int, trans_date_trans_time string, amt double, "
                               "lat double, long double, category string, is_fraud int")
    out, mapping = map_generic_columns(df)
    assert out.columns.count("user_id") == 1
    assert out.first()["user_id"] == 3
    assert {"timestamp", "amount", "lon", "category", "is_fraud"} <= set(out.columns)


def test_global_user_fallback(spark):
    from ledgerscope.sources.transactions import map_generic_columns
    df = spark.createDataFrame([(1, 2.0), (2, 3.0)], "k long, q double")
    out, mapping = map_generic_columns(df)
    assert {r["user_id"] for r in out.collect()} == {"GlobalUser"}


def test_feed_without_transaction_id(spark):
    rows = [row(i, 1, 0) for i in range(1, 4)] + [row(4, 1, 30), row(5, 1, 30), row(6, 1, 30, amount=11.0)]
    df = frame(spark, rows).drop("transaction_id").withColumn("m", F.create_map(F.lit("k"), F.lit(1)))
    r = R.run_rules(df)
    assert r.rules_run == 6
    assert sorted(x["txn_count_in_window"] for x in r.df.collect()) == [1, 2, 3, 4, 5, 6]
