"""Second-order trees against a NumPy version, the forest's samples, row names."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerscope.operators import boosting, ensemble, iforest


def _numpy_trees(x, y, w, n_trees, depth, rate, l2=1.0, mcw=1.0):
    """Exact greedy trees as nested tuples; margins of the training rows."""
    margin, trees = np.zeros(len(y)), []
    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = w * (p - y), w * p * (1 - p)

        def grow(rows, level):
            G, H = g[rows].sum(), h[rows].sum()
            best = (1e-6, None)
            if level < depth:
                for f in range(x.shape[1]):
                    for c in np.unique(x[rows, f])[:-1]:
                        left = rows[x[rows, f] <= c]
                        GL, HL = g[left].sum(), h[left].sum()
                        if HL >= mcw and H - HL >= mcw:
                            gain = GL**2 / (HL + l2) + (G - GL)**2 / (H - HL + l2) - G**2 / (H + l2)
                            if gain > best[0] + 1e-9:
                                best = (gain, (f, c))
            if best[1] is None:
                margin_of[rows] = -rate * G / (H + l2)
                return -rate * G / (H + l2)
            f, c = best[1]
            return (f, c, grow(rows[x[rows, f] <= c], level + 1), grow(rows[x[rows, f] > c], level + 1))
        margin_of = np.zeros(len(y))
        trees.append(grow(np.arange(len(y)), 0))
        margin = margin + margin_of
    return trees, margin


def _as_tuple(t, node=0):
    if t.feature[node] < 0:
        return t.value[node]
    return (int(t.feature[node]), t.threshold[node], _as_tuple(t, 2 * node + 1), _as_tuple(t, 2 * node + 2))


def _same(a, b):
    if isinstance(a, tuple) != isinstance(b, tuple):
        return False
    if not isinstance(a, tuple):
        return a == pytest.approx(b, abs=1e-9)
    return a[0] == b[0] and a[1] == pytest.approx(b[1]) and _same(a[2], b[2]) and _same(a[3], b[3])


def _frame(spark, x, y, w, parts):
    rows = [([float(v) for v in r], int(t), float(u)) for r, t, u in zip(x, y, w)]
    return spark.createDataFrame(rows, "x array<double>, y int, w double").repartition(parts)


@pytest.mark.parametrize("parts", [1, 5])
def test_trees_equal_numpy(spark, monkeypatch, parts):
    monkeypatch.setattr(boosting, "DIRECT_SUMS", 2)  # five blocks' sums are added in the cluster
    rng = np.random.default_rng(5)
    x = np.stack([rng.integers(0, 60, 400), np.round(rng.normal(size=400), 1), np.full(400, 3.0)], axis=1)
    y = ((x[:, 0] > 40) ^ (x[:, 1] > 0.5) ^ (rng.random(400) < 0.1)).astype(int)
    w = np.where(y == 1, 2.5, 1.0)
    model = boosting.fit(_frame(spark, x, y, w, parts), "x", "y", "w", n_trees=12, max_depth=3, learning_rate=0.3)
    want, margin = _numpy_trees(x, y, w, 12, 3, 0.3)
    assert len(model.trees) == 12 and all(_same(_as_tuple(t), n) for t, n in zip(model.trees, want))
    assert model.margin(x) == pytest.approx(margin)
    assert model.importance().sum() == pytest.approx(1) and model.importance()[2] == 0


def test_planted_signal_no_worse_than_first_order(spark):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import vector_to_array

    from ledgerscope.operators.evaluate import roc_auc
    from ledgerscope.operators.features import feature_matrix
    from ledgerscope.operators.supervised import fit_boosted_trees, predict, with_weights
    rng = np.random.default_rng(7)
    a, b = rng.normal(size=4000), rng.normal(size=4000)
    y = (a * b + 0.3 * rng.normal(size=4000) > 1).astype(int)
    df = spark.createDataFrame([(i, float(u), float(v), int(t)) for i, (u, v, t) in enumerate(zip(a, b, y))],
                               "transaction_id long, amount double, hour double, label int")
    m = feature_matrix(with_weights(df, 4.0), ["amount", "hour"])
    train, test = m.where("transaction_id % 4 > 0"), m.where("transaction_id % 4 = 0")
    own = roc_auc(predict(fit_boosted_trees(train, n_trees=30, max_depth=4), test), "label", "fraud_prob").first()["roc_auc"]
    other = GBTClassifier(labelCol="label", weightCol="weight", maxIter=30, maxDepth=4, stepSize=0.1, seed=1).fit(train).transform(test)
    first_order = roc_auc(other.withColumn("p", vector_to_array("probability")[1]), "label", "p").first()["roc_auc"]
    assert own >= first_order - 0.005 and own > 0.9


def test_one_class_and_constant_features(spark):
    x = np.ones((50, 2))
    model = boosting.fit(_frame(spark, x, np.zeros(50), np.ones(50), 3), "x", "y", "w", n_trees=3, max_depth=3, learning_rate=0.1)
    assert (model.margin(x) < 0).all() and model.importance().sum() == 0
    assert boosting.fit(_frame(spark, x[:0], [], [], 1), "x", "y", "w", 3, 3, 0.1).trees == []


def test_forest_samples(spark):
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(20_000, 2)))], "id long, a double, b double")
    p = 0.02
    got = iforest.offered(df.select("id"), "id", 100, p, 3)
    per_tree = np.array([r["n"] for r in got.groupBy("_tree").agg(F.count("*").alias("n")).orderBy("_tree").collect()])
    assert len(per_tree) == 100 and got.distinct().count() == got.count()
    assert abs(per_tree.mean() - 400) < 12 and 250 < per_tree.min() and per_tree.max() < 550  # 400 on average, deviation 20
    pairs = got.alias("s").join(got.alias("t"), "id").where("s._tree = 3 and t._tree = 70").count()
    assert pairs < 40  # trees are drawn independently: 8 on average
    scores = [{r["id"]: r["iforest_score"] for r in iforest.isolation_forest(df.repartition(k), "id", ["a", "b"], n_trees=30).collect()} for k in (1, 4, 17)]
    assert scores[0] == scores[1] == scores[2]


def test_rows_without_an_id_are_named_by_content(spark):
    rng = np.random.default_rng(10)
    x = np.round(rng.normal(size=(600, 2)), 2) + 0.0
    rows = [(float(a), float(b), "t" if k % 2 else None) for k, (a, b) in enumerate(x)] + [(1.0, 1.0, None)] * 40
    df = spark.createDataFrame(rows, "a double, b double, c string")
    names = [sorted(r["_row"] for r in ensemble.with_row_names(df.repartition(k)).collect()) for k in (1, 7)]
    assert names[0] == names[1] and len(set(names[0])) == 640
    assert sorted(map(str, ensemble.with_row_names(df).drop("_row").collect())) == sorted(map(str, df.collect()))
    votes = [sorted((r["a"], r["b"], r["c"] or "", round(r["iforest_score"], 9), r["anomaly_votes"]) for r in
                    ensemble.detect_generic(df.repartition(k), n_trees=20).df.collect()) for k in (1, 7)]
    assert votes[0] == votes[1] and len(votes[0]) == 640
