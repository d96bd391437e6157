"""Bounded work under outliers, dense clusters, hot users: results against
NumPy, and the size of what a task or a query meets."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerscope.operators.neighbours import LEAF, cell_tree, collapse, knn, query_cells, radius_cells, radius_counts
from ledgerscope.operators.sequence import TrailingCount, user_sequence

US = 1_000_000


def _frame(spark, x):
    import pandas as pd
    return spark.createDataFrame(pd.DataFrame({"id": np.arange(len(x)), "v": list(x)})).selectExpr("id", "v")


def _cloud(n):
    """``n`` points: spread out, one dense cluster, a few around it, one far away."""
    rng = np.random.default_rng(21)
    return np.vstack([rng.normal(size=(n * 6 // 10, 2)), 4 + rng.normal(scale=1e-5, size=(n * 4 // 10 - 100, 2)),
                      4 + rng.uniform(-0.3, 0.3, (99, 2)), [[1e7, -1e7]]])


@pytest.fixture(scope="module")
def tree(spark):
    return cell_tree(collapse(_frame(spark, _cloud(100_000)), "id")[0])


def test_knn_meets_few_points_per_query(tree):
    cells = query_cells(tree, 21).groupBy("gid").agg(F.sum("m").alias("met"))
    r = cells.agg(F.max("met"), F.avg("met"), F.count(F.lit(1))).first()
    assert r[2] == 100_000 and r[0] <= 100 * LEAF and r[1] <= 12 * LEAF


def test_radius_counts_pair_only_the_border(tree):
    # all of the dense cluster lies within one radius: no point of it is paired with another
    whole, crossed = radius_cells(tree, 0.01)
    met = crossed.groupBy("gid").agg(F.sum("m").alias("met")).agg(F.max("met"), F.sum("met")).first()
    assert met[0] <= 100 * LEAF and met[1] <= 60 * LEAF * 100_000
    assert whole.groupBy("gid").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] >= 39_900


def test_outlier_and_cluster_by_brute_force(spark):
    x = _cloud(3_000)
    groups, _ = collapse(_frame(spark, x), "id")
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    got = {r["qid"]: r["kd"] for r in knn(groups, 20, include_self=False).groupBy("qid").agg(F.max("d").alias("kd")).collect()}
    np.fill_diagonal(d, np.inf)
    want = np.sort(d, axis=1)[:, 19]
    assert [got[i] for i in range(len(x))] == pytest.approx(want.tolist(), rel=1e-12)
    np.fill_diagonal(d, 0)
    counts = {r["qid"]: r["n_within"] for r in radius_counts(groups, 0.05).collect()}
    assert [counts[i] for i in range(len(x))] == (d <= 0.05).sum(axis=1).tolist()


def test_tree_of_odd_tables(spark):
    for x in ([[1.0, 2.0]] * 5, [[0.0, 0.0], [0.0, 1e-300], [1e300, 0.0], [-1e300, 5.0], [0.0, 0.0], [float(2 ** 20), 3.0]]):
        x = np.array(x)
        groups, rowmap = collapse(_frame(spark, x), "id")
        near = rowmap.join(knn(groups, 3, include_self=False, max_candidates=2).groupBy("qid").agg(F.max("d").alias("kd"), F.sum("take").alias("n")),
                           F.col("gid") == F.col("qid")).collect()
        counts = {r["id"]: r["n_within"] for r in rowmap.join(radius_counts(groups, 1.0, leaf=2), F.col("gid") == F.col("qid")).collect()}
        assert len(near) == len(x) == len(counts)
        for r in near:
            with np.errstate(over="ignore"):
                d = np.sqrt(((x - x[r["id"]]) ** 2).sum(1))
            assert counts[r["id"]] == (d <= 1.0).sum() and r["n"] == 3 and r["kd"] == np.sort(np.delete(d, r["id"]))[2]


def test_hot_user_inside_one_hour(spark):
    rng = np.random.default_rng(6)
    n = 100_000
    us = np.concatenate([1_700_000_000 * US + rng.integers(0, 3_000 * US, n), 1_700_000_000 * US + rng.integers(0, 5 * 86_400 * US, 3_000)])
    user = np.concatenate([np.zeros(n, int), rng.integers(0, 20, 3_000)])
    import pandas as pd
    df = spark.createDataFrame(pd.DataFrame({"transaction_id": np.arange(len(us)), "user_id": user, "us": us})).select(
        "transaction_id", "user_id", F.timestamp_micros("us").cast("timestamp_ntz").alias("timestamp"), "us")
    out = user_sequence(df, counts=(TrailingCount("cnt", 3_600 * US), TrailingCount("minute", 60 * US, None, True)), previous=("us",), hot_rows=5_000)
    got = out.select("transaction_id", "cnt", "minute", "_prev_us", F.spark_partition_id().alias("p")).toPandas().set_index("transaction_id")
    assert len(got) == len(us) and got["p"].value_counts().max() <= 0.4 * len(us)  # of 8 tasks
    for u in range(3):
        rows = np.flatnonzero(user == u)
        rows = rows[np.lexsort((rows, us[rows]))]
        t = us[rows]
        place = np.arange(len(t))
        assert (got.loc[rows, "cnt"].to_numpy() == place - np.searchsorted(t, t - 3_600 * US) + 1).all()
        s = t // US
        assert (got.loc[rows, "minute"].to_numpy() == place - np.searchsorted(s, s - 60) + 1).all()
        assert np.isnan(got.loc[rows[0], "_prev_us"]) and (got.loc[rows[1:], "_prev_us"].to_numpy() == t[:-1]).all()


def test_rows_without_user_or_time_pass(spark):
    df = spark.sql("""select id as transaction_id, if(id % 3 = 0, null, 1) as user_id,
                      if(id % 5 = 0, null, timestamp_ntz'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,id)) as timestamp from range(30)""")
    rows = user_sequence(df, counts=(TrailingCount("cnt", 10 * US),), previous=("transaction_id",), hot_rows=3).collect()
    assert len(rows) == 30
    for r in rows:
        if r["user_id"] is None or r["timestamp"] is None:
            assert r["cnt"] == 0 and r["_prev_us"] is None
        else:
            i = r["transaction_id"]
            assert r["cnt"] == sum(1 for j in range(max(0, i - 10), i + 1) if j % 3 and j % 5)


EDGES = [0.0, -0.0, 1.0, -1.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, -1.7976931348623157e308,
         float("inf"), float("-inf"), 0.1, 0.30000000000000004, 1 - 2**-53, 1 + 2**-52, 2.0**52, 2.0**53 + 2, 3.0, 1024.0, 1023.9999999999999]


def test_order_key_is_the_bits(spark):
    import struct

    from ledgerscope.operators.quantiles import order_key, value_of
    rng = np.random.default_rng(1)
    x = EDGES + [struct.unpack("<d", rng.bytes(8))[0] for _ in range(4000)] + [s * 2.0 ** e for e in range(-1074, 1024, 7) for s in (1, -1)]
    x = [v for v in x if v == v]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in x], "v double").select(order_key(F.col("v"))).collect()]
    for v, k in zip(x, got):
        bits = struct.unpack("<q", struct.pack("<d", abs(v)))[0]
        assert k == (-bits if v < 0 else bits) and value_of(k) == v
    odd = spark.createDataFrame([(float("nan"),), (None,)], "v double").select(order_key(F.col("v"))).collect()
    assert odd[0][0] > max(got) and odd[1][0] is None


@pytest.mark.parametrize("target", [1, 50, 200_000])
def test_radix_quantiles(spark, target):
    from ledgerscope.operators.quantiles import column_quantiles, grouped_quantiles, kth_smallest
    rng = np.random.default_rng(4)
    n = 4000
    g = np.where(rng.random(n) < 0.5, 0, rng.integers(1, 9, n))
    x, y = rng.standard_cauchy(n) * 1e6, np.round(rng.normal(size=n), 1)
    near = 1 + rng.integers(0, 1 << 20, n) * 2.0**-52  # alike in their first 32 bits
    rows = [(None if k == 8 else int(k), float(a), None if k == 7 else float(b), float(c)) for k, a, b, c in zip(g, x, y, near)]
    df = spark.createDataFrame(rows, "g long, x double, y double, near double")
    ps = [0.0, 0.05, 0.25, 0.5, 0.95, 1.0]
    q = column_quantiles(df.withColumn("none", F.lit(None).cast("double")), ["x", "y", "near", "none"], ps, range_target=target)
    assert q["x"] == pytest.approx(np.percentile(x, [100 * p for p in ps]).tolist(), rel=1e-12)
    assert q["y"] == pytest.approx(np.percentile(y[g != 7], [100 * p for p in ps]).tolist(), abs=1e-12)
    assert q["near"] == pytest.approx(np.percentile(near, [100 * p for p in ps]).tolist(), rel=1e-15) and q["none"] == [None] * 6
    for p in (0.0, 0.37, 0.5, 1.0):
        got = {r["g"]: r for r in grouped_quantiles(df, ["g"], ["x", "y", "near"], p, suffix="_q", range_target=target).collect()}
        assert set(got) == {*range(8), None}
        for k in range(9):
            r = got[None if k == 8 else k]
            assert r["x_q"] == pytest.approx(np.percentile(x[g == k], 100 * p), rel=1e-12)
            assert r["near_q"] == pytest.approx(np.percentile(near[g == k], 100 * p), rel=1e-15)
            assert (r["y_q"] is None) if k == 7 else r["y_q"] == pytest.approx(np.percentile(y[g == k], 100 * p), abs=1e-12)
    s = np.sort(x[g == 0])
    assert kth_smallest(df, "g", "x", {0: 17, 1: 0, 77: 3}) == {0: s[16], 1: None, 77: None}


def _jobs(spark):
    return {i for i in spark.sparkContext.statusTracker().getJobIdsForGroup("counted")}


def test_describe_takes_few_jobs_and_roc_runs_its_input_once(spark):
    from ledgerscope.operators.aggregates import describe_features
    from ledgerscope.operators.evaluate import roc_auc
    df = spark.range(3000).selectExpr("id", "double(id % 97) as a", "sqrt(id) as b", "double(id % 2) as y")
    sc = spark.sparkContext
    sc.setJobGroup("counted", "")
    try:
        rows = {r["feature"]: r for r in describe_features(df, ["a", "b"]).collect()}
        assert len(_jobs(spark)) < 10
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert rows["a"]["p50"] == np.percentile(np.arange(3000) % 97, 50) and rows["b"]["count"] == 3000
    seen = sc.accumulator(0)

    def touch(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    roc = roc_auc(df.select("y", "b").mapInArrow(touch, "y double, b double"), "y", "b").first()
    assert seen.value == 3000
    assert roc["roc_auc"] == pytest.approx(0.500333, abs=1e-6) and roc["n_pos"] == 1500
