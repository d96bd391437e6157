"""Plan shape: no cartesian products in the rule / feature plans, no Python
workers there, filters and column pruning reach the parquet scan."""
from ledgerscope.operators.features import engineer_features
from ledgerscope.operators.rules import run_rules
from ledgerscope.plans.common import txn

from .conftest import SF


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rules_plan_shape(spark):
    p = _plan(run_rules(txn(spark, SF)).df)
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert bad not in p
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string,value:double>" in p


def test_features_plan_shape(spark):
    p = _plan(engineer_features(txn(spark, SF)))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in p


def test_pushdown(spark):
    df = spark.read.parquet(f"{SF}/events.parquet").where("user_id = 3").select("event_id", "value")
    p = _plan(df)
    assert "PushedFilters: [IsNotNull(user_id), EqualTo(user_id,3)]" in p
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,value:double>" in p


def _counts(df):
    import re
    p = _plan(df)
    # an adaptive plan's text holds its initial plan once before it runs
    return len(re.findall(r"Scan parquet", p)), len(re.findall(r"Exchange hashpartitioning", p))


def test_rows_move_once(spark):
    scans, exchanges = _counts(run_rules(txn(spark, SF)).df)
    assert scans <= 3 and exchanges <= 8
    scans, exchanges = _counts(engineer_features(txn(spark, SF)))
    assert scans <= 3 and exchanges <= 8


def test_wanted_features_only(spark):
    calendar = engineer_features(txn(spark, SF), wanted=["hour", "day_of_week", "is_weekend", "is_night"])
    assert _counts(calendar)[0] == 1 and "Exchange" not in _plan(calendar) and "amount_z_score" not in calendar.columns
    whole = engineer_features(txn(spark, SF)).where("transaction_id < 50")
    for wanted in (["amount_z_score"], ["amount_to_median", "category_encoded"], ["txn_count_1h"], ["time_since_last_txn", "location_distance_km"]):
        part = engineer_features(txn(spark, SF), wanted=wanted).where("transaction_id < 50").select("transaction_id", *wanted)
        assert sorted(part.collect()) == sorted(whole.select("transaction_id", *wanted).collect())
