import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 1000
    assert sum(r["predicted_fraud"] for r in rows) == 22  # FIXTURES.md section 2, sf0.001


def test_registry_consistent():
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q)
    assert len(q) >= 60


def test_rule_counts_sf0001(spark):
    from pyspark.sql import functions as F
    from ledgerscope.operators.rules import FLAG_COLS, run_rules
    from ledgerscope.plans.common import txn
    r = run_rules(txn(spark, "/root/testdata/sf0.001")).df
    row = r.agg(*[F.sum(c).alias(c) for c in FLAG_COLS]).first()
    assert [row[c] for c in FLAG_COLS] == [15, 19, 45, 3, 17, 46]
