import numpy as np
import pytest
from pyspark.sql import functions as F


def test_isolation_forest_invariants(spark):
    from ledgerscope.operators import iforest
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 2))
    x[0] = [9, 9]
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    s1 = {r["id"]: r["iforest_score"] for r in iforest.isolation_forest(df.repartition(1), "id", ["a", "b"]).collect()}
    s4 = {r["id"]: r["iforest_score"] for r in iforest.isolation_forest(df.repartition(4), "id", ["a", "b"]).collect()}
    assert s1 == pytest.approx(s4)
    assert all(0 < v < 1 for v in s1.values())
    assert max(s1, key=s1.get) == 0
    nodes, psi = iforest.fit(df, "id", ["a", "b"])
    assert psi == 256 and nodes["depth"].max() <= 8 and nodes["tree"].nunique() == 100


def test_split_and_weights(spark):
    from ledgerscope.operators.supervised import class_weight, stratified_split
    df = spark.range(1000).select(F.col("id").alias("transaction_id"), (F.col("id") % 10 == 0).cast("int").alias("label"))
    ratio, pos, neg = class_weight(df)
    assert (pos, neg, ratio) == (100, 900, 9.0)
    s = stratified_split(df)
    got = {(r["label"], r["is_test"]): r["count"] for r in s.groupBy("label", "is_test").count().collect()}
    assert got == {(0, 1): 225, (0, 0): 675, (1, 1): 25, (1, 0): 75}


def test_gbt_learns_planted_signal(spark):
    from ledgerscope.operators.evaluate import roc_auc
    from ledgerscope.operators.supervised import fit_boosted_trees, predict, with_weights
    from ledgerscope.operators.features import feature_matrix
    rng = np.random.default_rng(2)
    a = rng.normal(size=2000)
    y = (a + 0.2 * rng.normal(size=2000) > 1.2).astype(int)
    df = spark.createDataFrame([(i, float(v), float(rng.normal()), int(t)) for i, (v, t) in enumerate(zip(a, y))],
                               "transaction_id long, amount double, hour double, label int")
    m = feature_matrix(with_weights(df, 3.0), ["amount", "hour"])
    model = fit_boosted_trees(m, n_trees=10, max_depth=3)
    auc = roc_auc(predict(model, m), "label", "fraud_prob").first()["roc_auc"]
    assert auc > 0.9


def test_report_one_class_and_histogram(spark):
    from ledgerscope.operators.evaluate import confusion_matrix, roc_auc, score_histogram
    df = spark.range(10).select(F.lit(0).alias("y"), F.lit(0).alias("p"), F.lit(0.3).alias("s"), F.lit(1).alias("g"))
    cm = {(r["actual"], r["predicted"]): r["count"] for r in confusion_matrix(df, "y", "p").collect()}
    assert cm == {(0, 0): 10, (0, 1): 0, (1, 0): 0, (1, 1): 0}
    assert roc_auc(df, "y", "s").first()["roc_auc"] is None
    h = score_histogram(df, "s", "g").collect()
    assert len(h) == 50 and sum(r["count"] for r in h) == 10
    assert min(r["bin_start"] for r in h) == pytest.approx(-0.2) and max(r["bin_end"] for r in h) == pytest.approx(0.8)


def test_robust_scale_constant_iqr(spark):
    from ledgerscope.operators.outliers import robust_scale
    df = spark.createDataFrame([(0.0,)] * 9 + [(100.0,)], "x double")
    out, _ = robust_scale(df, ["x"])
    assert sorted(r["x"] for r in out.collect())[-1] == 100.0


def test_small_n_eps(spark):
    from ledgerscope.operators.outliers import dynamic_eps
    df = spark.createDataFrame([(i, [float(i)]) for i in range(4)], "id long, v array<double>")
    assert dynamic_eps(df, "id")[0] == 0.5


def test_split_of_any_id(spark):
    from ledgerscope.operators.supervised import stratified_split
    ids = [f"TXN_{i:06d}" for i in range(400)]
    df = spark.createDataFrame([(i, n % 2) for n, i in enumerate(ids)], "transaction_id string, label int")
    s = stratified_split(df)
    assert {(r["label"], r["is_test"]): r["count"] for r in s.groupBy("label", "is_test").count().collect()} == {
        (0, 1): 50, (0, 0): 150, (1, 1): 50, (1, 0): 150}
    big = spark.range(1 << 40, (1 << 40) + 100).select(F.col("id").alias("transaction_id"), F.lit(1).alias("label"))
    assert stratified_split(big).where("is_test = 1").count() == 25


def test_category_codes_keep_type_and_order(spark):
    from ledgerscope.operators.features import category_codes
    df = spark.range(3000).select((F.col("id") % 1000).cast("int").alias("k"))
    assert category_codes(df, "k").schema["k"].dataType.simpleString() == "int"
    assert sorted((r["k"], r["category_encoded"]) for r in category_codes(df, "k").collect()) == [(i, i) for i in range(1000)]


def test_ensemble_without_an_id(spark):
    from ledgerscope.operators.ensemble import detect_generic
    rng = np.random.default_rng(3)
    rows = [(1 if i % 3 else None, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(300, 2)))]
    rows += [(1, 50.0, 50.0)] + rows[:5]
    df = spark.createDataFrame(rows, "k long, a double, b double")
    out = detect_generic(df, exclude=("k",), n_trees=20).df
    got = out.collect()
    assert len(got) == 306 and "_row" not in out.columns
    assert [r["is_anomaly_ensemble"] for r in got if r["a"] == 50.0] == [1]
