"""Operators against NumPy nested-loop references on random data with ties."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerscope.operators.neighbours import collapse, knn, kth_distance, radius_counts
from ledgerscope.operators.quantiles import column_quantiles, grouped_quantiles
from ledgerscope.operators.sequence import TrailingCount, user_sequence

US = 1_000_000


def _seq_data(rng, n=1500, users=7, span_s=40_000):
    uid = rng.integers(0, users, n)
    sec = rng.integers(0, span_s, n)
    sec[rng.random(n) < 0.2] = sec[0]  # many equal times
    frac = rng.integers(0, 3, n) * 250_000  # sub-second parts, with ties
    return [(int(i), int(u), int(s) * US + int(f)) for i, (u, s, f) in enumerate(zip(uid, sec, frac))]


def _brute(rows, window_us, cap, whole_seconds):
    by_user = {}
    for i, u, t in rows:
        by_user.setdefault(u, []).append((t, i))
    out, prev = {}, {}
    for u, lst in by_user.items():
        lst.sort()
        for pos, (t, i) in enumerate(lst):
            lo = 0 if cap is None else max(0, pos - (cap - 1))
            key = (lambda x: x // US) if whole_seconds else (lambda x: x)
            w = window_us // US if whole_seconds else window_us
            out[i] = sum(1 for j in range(lo, pos + 1) if key(t) - key(lst[j][0]) <= w)
            prev[i] = lst[pos - 1][0] if pos else None
    return out, prev


@pytest.mark.parametrize("window_s,cap,whole,bucket_s", [(360, 21, False, 400), (120, 50, True, 121),
                                                         (3600, 21, False, 3601), (900, None, False, 5000)])
def test_trailing_count_vs_loop(spark, window_s, cap, whole, bucket_s):
    rng = np.random.default_rng(7)
    rows = _seq_data(rng)
    df = spark.createDataFrame(rows, "transaction_id long, user_id long, us long").select(
        "transaction_id", "user_id", F.timestamp_micros("us").cast("timestamp_ntz").alias("timestamp"))
    spec = TrailingCount("cnt", window_s * US, cap, whole)
    got = user_sequence(df, counts=(spec,), previous=("transaction_id",), bucket_us=bucket_s * US).collect()
    want, prev = _brute(rows, window_s * US, cap, whole)
    assert len(got) == len(rows)
    for r in got:
        assert r["cnt"] == want[r["transaction_id"]], r
        assert r["_prev_us"] == prev[r["transaction_id"]]


def test_grouped_and_global_quantiles(spark):
    rng = np.random.default_rng(3)
    g = rng.integers(0, 5, 3000)
    x = np.round(rng.normal(size=3000), 2)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(g, x)], "g long, x double")
    got = {r["g"]: r["x"] for r in grouped_quantiles(df, ["g"], ["x"], 0.5).collect()}
    for k in range(5):
        assert got[k] == pytest.approx(np.percentile(x[g == k], 50), abs=1e-12)
    q = column_quantiles(df, ["x"], [0.05, 0.25, 0.5, 0.95], range_target=40)["x"]
    assert q == pytest.approx(list(np.percentile(x, [5, 25, 50, 95])), abs=1e-12)
    assert column_quantiles(spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,), (None,)], "x double"),
                            ["x"], [0.5])["x"][0] == 2.5


def _points(rng, n=600, d=4):
    x = np.round(rng.normal(size=(n, d)) * [1, 1, 0.3, 2], 1)
    x[50:80] = x[10]  # a block of exact duplicates
    x[100:103] = x[5]
    return x


def test_knn_and_radius_vs_brute(spark):
    rng = np.random.default_rng(11)
    x = _points(rng)
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, v array<double>")
    groups, rowmap = collapse(df, "id")
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    for k, incl in ((5, True), (20, False)):
        kd = kth_distance(knn(groups, k, include_self=incl)).withColumnRenamed("qid", "gid")
        got = {r["id"]: r["kdist"] for r in rowmap.join(kd, "gid").collect()}
        for i in range(len(x)):
            row = np.sort(d[i]) if incl else np.sort(np.delete(d[i], i))
            assert got[i] == pytest.approx(row[k - 1], abs=1e-9)
    eps = 0.7
    rc = radius_counts(groups, eps).withColumnRenamed("qid", "gid")
    got = {r["id"]: r["n_within"] for r in rowmap.join(rc, "gid").collect()}
    for i in range(len(x)):
        assert got[i] == int((d[i] <= eps).sum())


def test_lof_vs_formula(spark):
    from ledgerscope.operators.outliers import local_outlier_factor
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(300, 3)), 3)
    x[0] = [6, 6, 6]
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, v array<double>")
    got = {r["id"]: r["lof"] for r in local_outlier_factor(df, "id", k=10).collect()}
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    nn = np.argsort(d, axis=1, kind="stable")[:, :10]
    kd = d[np.arange(len(x)), nn[:, -1]]
    reach = np.maximum(d[np.arange(len(x))[:, None], nn], kd[nn])
    lrd = 1 / (reach.mean(1) + 1e-10)
    lof = lrd[nn].mean(1) / lrd
    for i in range(len(x)):
        assert got[i] == pytest.approx(lof[i], rel=1e-9)
    assert max(got, key=got.get) == 0


def test_grouped_quantiles_hot_group_ranges(spark):
    # one hot group with many distinct values is split into value ranges
    rng = np.random.default_rng(9)
    g = np.where(rng.random(6000) < 0.6, 0, rng.integers(1, 6, 6000))
    x = np.round(rng.exponential(size=6000) * 100, 3)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(g, x)], "g long, x double")
    for p in (0.5, 0.95, 0.0, 1.0):
        got = {r["g"]: r["x"] for r in grouped_quantiles(df, ["g"], ["x"], p, range_target=300).collect()}
        for k in range(6):
            assert got[k] == pytest.approx(np.percentile(x[g == k], 100 * p), abs=1e-9)


def test_dbscan_noise_list_vs_radius(spark):
    from ledgerscope.operators.outliers import dbscan_noise, lof_neighbours
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(500, 3)), 2)
    x[20:40] = x[3]  # duplicates
    x[7] = [5, 5, 5]
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, v array<double>")
    g = collapse(df, "id")
    nb = lof_neighbours(g[0], len(x))
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    for eps in (0.2, 0.35):
        a = {r["id"]: (r["is_core"], r["anomaly_model_dbscan"]) for r in dbscan_noise(df, "id", eps, groups=g).collect()}
        b = {r["id"]: (r["is_core"], r["anomaly_model_dbscan"]) for r in
             dbscan_noise(df, "id", eps, groups=g, neighbours=nb).collect()}
        core = (d <= eps).sum(1) >= 5
        noise = ~core & ~((d <= eps) & core[None, :]).any(1)
        want = {i: (int(core[i]), int(noise[i])) for i in range(len(x))}
        assert a == want and b == want


def test_knn_dense_cluster_levels(spark):
    # a dense cluster of distinct near-duplicates forces finer grid levels
    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal(size=(300, 3)), 5 + rng.normal(scale=1e-4, size=(400, 3))])
    x = np.round(x, 7)
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, v array<double>")
    groups, rowmap = collapse(df, "id")
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    nb = knn(groups, 5, include_self=False, max_candidates=60)
    assert knn.last_rounds > 1
    kd = kth_distance(nb).withColumnRenamed("qid", "gid")
    got = {r["id"]: r["kdist"] for r in rowmap.join(kd, "gid").collect()}
    for i in range(len(x)):
        assert got[i] == pytest.approx(np.sort(np.delete(d[i], i))[4], abs=1e-12)
