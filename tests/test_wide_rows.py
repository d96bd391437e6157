"""What a user carries to the rows is wide; it meets them after they are sorted."""
from datetime import datetime, timedelta

from ledgerscope.operators import sequence
from ledgerscope.operators.rules import run_rules
from ledgerscope.plans.common import txn

from .conftest import SF


def test_rows_are_sorted_narrow(spark):
    lines = run_rules(txn(spark, SF)).df._jdf.queryExecution().optimizedPlan().toString().split("\n")
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    windows = [i for i, x in enumerate(lines) if x.lstrip(" :+-").startswith("Window [")]
    assert len(windows) >= 2
    for i in windows:
        end = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
        assert not any("_category_counts" in x or "_hour_counts" in x for x in lines[i:end])


def test_tasks_grow_with_the_events(spark, monkeypatch):
    rows = [(i, i % 40, None if i == 7 else datetime(2024, 1, 1) + timedelta(minutes=i)) for i in range(3_000)]
    df = spark.createDataFrame(rows, "transaction_id long, user_id long, timestamp timestamp")
    count = (sequence.TrailingCount("cnt", 3_600_000_000),)
    few = sequence.user_sequence(df, counts=count)
    monkeypatch.setattr(sequence, "TASK_EVENTS", 100)
    many = sequence.user_sequence(df, counts=count)
    planned = many._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in planned and f", {3_000 * 2 // 100}\n" in planned
    assert sorted(many.collect()) == sorted(few.collect())
