"""Neighbours by tiles: nothing is stored or sent per pair of points, and what follows equals brute force."""
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerscope.operators import neighbours, outliers
from ledgerscope.operators.ensemble import detect_generic, distance_points, prepare
from ledgerscope.operators.neighbours import collapse
from ledgerscope.plans import generic_queries


def _kept(spark):
    """Bytes in the folder of intermediate tables."""
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(spark.conf.get("spark.checkpoint.dir")) for f in names)


def _written(spark, df):
    """Rows of ``df``, and the bytes that it and what it was made of leave."""
    rows = df.collect()
    return rows, _kept(spark)


def _lof(x, k=20):
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    nn = np.argsort(d, axis=1, kind="stable")[:, :k]
    kd = np.take_along_axis(d, nn, 1)[:, -1]
    lrd = 1 / (np.maximum(np.take_along_axis(d, nn, 1), kd[nn]).mean(1) + 1e-10)
    return lrd[nn].mean(1) / lrd


@pytest.mark.parametrize("dim", [3, 10])
def test_models_over_many_tiles(spark, monkeypatch, dim):
    def refused(*_, **__):
        raise AssertionError("a row per neighbour")
    monkeypatch.setattr(neighbours, "knn", refused)
    monkeypatch.setattr(neighbours.Neighbourhood, "table", refused)
    monkeypatch.setattr(neighbours, "TILE", 100)
    monkeypatch.setattr(neighbours, "SENT", 70)
    x = np.random.default_rng(11).normal(size=(900, dim))
    x[:300] = 4 + x[:300] / 50
    x[899] = 300.0
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(900), "v": list(x)})).selectExpr("id", "v")
    g = collapse(df, "id")
    nb = outliers.lof_neighbours(g[0], 900)
    assert nb.count >= 9
    got = {r["id"]: r["lof"] for r in outliers.local_outlier_factor(df, "id", groups=g, neighbours=nb).collect()}
    assert [got[i] for i in range(900)] == pytest.approx(_lof(x).tolist(), rel=1e-9)
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    eps, _ = outliers.dynamic_eps(df, "id", groups=g, neighbours=nb)
    assert eps == pytest.approx(np.percentile(np.sort(d, axis=1)[:, 4], 95), rel=1e-12)
    eps *= 0.8
    core = (d <= eps).sum(1) >= 5
    noise = ~core & ~((d <= eps) & core[None, :]).any(1)
    got = {r["id"]: (r["is_core"], r["anomaly_model_dbscan"]) for r in outliers.dbscan_noise(df, "id", eps, groups=g, neighbours=nb).collect()}
    assert [got[i] for i in range(900)] == list(zip(core.astype(int), noise.astype(int))) and noise.any() and not noise.all()


def test_points_lent_once_to_a_tile(spark):
    x = np.random.default_rng(12).normal(size=(1_200, 10))
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(1_200), "v": list(x)})).selectExpr("id", "v")
    nb = neighbours.neighbourhood(collapse(df, "id")[0], 20, most=150)
    def seen(own, lists):
        return own.select(["gid"])
    met = nb.ask(seen, "gid long")
    assert nb.count == 8 and sorted(r["gid"] for r in met.collect()) == list(range(1_200))
    both = nb._placed(nb.points.select("gid", "w", *nb._cs())).withColumn("looks", F.lit(-1)).unionByName(nb.asked, allowMissingColumns=True)
    lent = (both.repartitionById(nb.count, "tile").sortWithinPartitions("looks")
            .mapInArrow(neighbours._lend(10, both.columns[:13]), "gid long, w long, " + ", ".join(f"c{i} double" for i in range(10)) + ", tile int"))
    rows = [(r["gid"], r["tile"]) for r in lent.collect()]
    assert len(set(rows)) == len(rows) <= 1_200 * 7  # a point per tile at most, not per pair of points


def test_rows_without_id_leave_little(spark):
    # 4,000 rows of three measures, none repeated
    rng = np.random.default_rng(13)
    df = spark.createDataFrame(pd.DataFrame({"k": np.arange(4_000) // 4, "q": rng.integers(1, 51, 4_000).astype(float),
                                             "p": rng.uniform(1, 1e5, 4_000).round(2), "r": rng.integers(0, 11, 4_000) / 100}))
    before = _kept(spark)
    rows, after = _written(spark, detect_generic(df, exclude=("k",), n_trees=20).df)
    assert len(rows) == 4_000 and after - before < 100 * 4_000  # the lists alone were above 800 bytes a row
    q = np.quantile(df.select("q", "p", "r").toPandas().to_numpy(), [0.25, 0.5, 0.75], axis=0)
    x = np.array([[r["q"], r["p"], r["r"]] for r in rows])
    x = (x - q[1]) / (q[2] - q[0])
    assert [r["lof"] for r in rows] == pytest.approx(_lof(x).tolist(), rel=1e-6)


def test_report_stores_places_not_rows(spark, tmp_path, monkeypatch):
    # 30,000 events in 60 places
    n = 30_000
    ts = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n), unit="s")
    events = pd.DataFrame({"event_id": np.arange(n) * 5300 + 1, "ts": ts, "user_id": np.arange(n) % 3, "event_type": "view", "value": (np.arange(n) % 60) ** 2 / 10})
    spark.createDataFrame(events).write.parquet(f"{tmp_path}/events.parquet")
    sizes = []

    def counted(method, frame):
        def run(self, *args, **named):
            sizes.append(frame(self).count())
            return method(self, *args, **named)
        return run
    frame, writer = type(spark.range(1)), type(spark.range(1).write)
    monkeypatch.setattr(frame, "checkpoint", counted(frame.checkpoint, lambda f: f))
    monkeypatch.setattr(writer, "parquet", counted(writer.parquet, lambda w: w._df))
    rows = generic_queries.q_ensemble_report(spark, str(tmp_path)).collect()
    assert sizes and max(sizes) < 1_000  # all 30,000 scaled rows were stored
    assert sum(r["support"] for r in rows if str(r[0]) in ("0", "1")) == n


def test_pca_distances_leave_little(spark, tmp_path):
    # projected to ten dimensions, where every ball meets every part
    x = np.random.default_rng(14).normal(size=(1_500, 16)).astype("float32")
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    before = _kept(spark)
    rows, after = _written(spark, generic_queries.q_pca_distances(spark, str(tmp_path)))
    assert after - before < 700 * 1_500  # lists and points sent to blocks were above 3,000 bytes a row
    table = spark.read.parquet(f"{tmp_path}/embeddings.parquet").select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(16)])
    scaled, cols = prepare(table, "vec_id")
    places = {r["_rid"]: r["v"] for r in distance_points(scaled, cols).collect()}
    want = _lof(np.array([places[i] for i in range(1_500)]))
    got = {r["vec_id"]: r["lof"] for r in rows}
    assert [got[i] for i in range(1_500)] == pytest.approx(want.tolist(), abs=2e-6)


def test_repeated_ids_as_before(spark):
    # the models of rows that share an id are joined by it
    x = np.random.default_rng(15).normal(size=(60, 2))
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows + rows[:1], "id long, a double, b double")
    r = detect_generic(df, "id", exclude=("id",), n_trees=10)
    assert not r.unique_ids and r.df.where("id = 0").count() == 16 and r.df.where("id > 0").count() == 59
    once = detect_generic(df.distinct(), "id", exclude=("id",), n_trees=10)
    assert once.unique_ids and once.df.count() == 60
