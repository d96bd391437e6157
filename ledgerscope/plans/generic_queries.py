"""Registered queries: the generic ensemble (2.3 J7/J8, 2.10, E9, E10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerscope.operators import iforest
from ledgerscope.operators.aggregates import value_counts
from ledgerscope.operators.ensemble import detect_generic, distance_points, prepare
from ledgerscope.operators.evaluate import classification_report
from ledgerscope.operators.neighbours import collapse, knn, kth_distance, radius_counts
from ledgerscope.operators.outliers import (
    dbscan_noise, dynamic_eps, impute_median, local_outlier_factor, lof_neighbours, vote)
from ledgerscope.operators.pca import pca_projection
from ledgerscope.plans.common import table, txn
from ledgerscope.session import checkpoint_dir
from ledgerscope.sources.adapters import TXN_SQL
from ledgerscope.sources.transactions import detect_label_column

Q: dict = {}
SQL: dict = {}


def register(name, sql=None):
    def deco(fn):
        Q[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


# ---- oracle building blocks (brute force over all pairs, DuckDB) -----------

def _scaled_sql(src: str, id_expr: str, cols: list[str]) -> str:
    qs = ", ".join(f"quantile_cont({c}, 0.25) AS {c}_q1, quantile_cont({c}, 0.5) AS {c}_q2, "
                   f"quantile_cont({c}, 0.75) AS {c}_q3" for c in cols)
    xs = ", ".join(f"({c} - {c}_q2) / COALESCE(NULLIF({c}_q3 - {c}_q1, 0), 1.0) AS x{i}" for i, c in enumerate(cols))
    return f"""base AS (SELECT {id_expr} AS id, {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in cols)} FROM {src}),
qs AS (SELECT {qs} FROM base),
sc AS (SELECT id, {xs} FROM base, qs)"""


def _neigh_sql(ncols: int, k_lof: int = 20) -> str:
    dist = " + ".join(f"(s.x{i} - t.x{i}) * (s.x{i} - t.x{i})" for i in range(ncols))
    return f""",
pairs AS (SELECT s.id AS qid, t.id AS nid, sqrt({dist}) AS d FROM sc s, sc t),
r5 AS (SELECT qid, d, row_number() OVER (PARTITION BY qid ORDER BY d, nid) AS rk FROM pairs),
kd5 AS (SELECT qid, d AS k5 FROM r5 WHERE rk = 5),
eps AS (SELECT greatest(quantile_cont(k5, 0.95), 0.01) AS eps FROM kd5),
cnt AS (SELECT qid, count(*) FILTER (WHERE d <= (SELECT eps FROM eps)) AS n_within FROM pairs GROUP BY qid),
core AS (SELECT qid, n_within, n_within >= 5 AS is_core FROM cnt),
near AS (SELECT DISTINCT p.qid FROM pairs p JOIN core c ON p.nid = c.qid
         WHERE c.is_core AND p.d <= (SELECT eps FROM eps)),
db AS (SELECT c.qid AS id, n_within AS n_within_eps, CAST(is_core AS INTEGER) AS is_core,
              CAST(NOT is_core AND n.qid IS NULL AS INTEGER) AS anomaly_model_dbscan
       FROM core c LEFT JOIN near n ON c.qid = n.qid),
r20 AS (SELECT qid, nid, d, row_number() OVER (PARTITION BY qid ORDER BY d, nid) AS rk FROM pairs WHERE qid <> nid),
nb AS (SELECT * FROM r20 WHERE rk <= {k_lof}),
kd20 AS (SELECT qid, d AS k20 FROM r20 WHERE rk = {k_lof}),
lrd AS (SELECT nb.qid, 1.0 / (avg(greatest(nb.d, k.k20)) + 1e-10) AS lrd FROM nb JOIN kd20 k ON nb.nid = k.qid GROUP BY nb.qid),
lofs AS (SELECT nb.qid AS id, avg(l2.lrd) / l1.lrd AS lof FROM nb JOIN lrd l2 ON nb.nid = l2.qid
         JOIN lrd l1 ON nb.qid = l1.qid GROUP BY nb.qid, l1.lrd)"""


PART_COLS = ["p_partkey", "p_size", "p_retailprice"]
PART_SQL = "WITH " + _scaled_sql("part", "p_partkey", PART_COLS) + _neigh_sql(3)


def _part_points(spark, sf):
    scaled, cols = prepare(table(spark, sf, "part"), "p_partkey")
    return distance_points(scaled, cols)


# ---- 2.10 preprocessing -----------------------------------------------------

@register("impute_median", """
WITH c AS (SELECT c_custkey, CAST(c_nationkey AS DOUBLE) AS c_nationkey,
                  CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS c_acctbal FROM customer)
SELECT c_custkey, c_nationkey, round(COALESCE(c_acctbal, (SELECT median(c_acctbal) FROM c)), 6) AS c_acctbal FROM c""")
def q_impute(spark, sf):
    # negative balances are treated as missing, to exercise the imputation
    c = table(spark, sf, "customer").select(
        "c_custkey", F.col("c_nationkey").cast("double").alias("c_nationkey"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("c_acctbal"))
    out, _ = impute_median(c, ["c_nationkey", "c_acctbal"])
    return out.withColumn("c_acctbal", F.round("c_acctbal", 6))


@register("robust_scale", "WITH " + _scaled_sql("part", "p_partkey", PART_COLS) + """
SELECT id AS p_partkey, round(x0, 6) AS s_partkey, round(x1, 6) AS s_size, round(x2, 6) AS s_retailprice FROM sc""")
def q_robust(spark, sf):
    scaled, _ = prepare(table(spark, sf, "part"), "p_partkey")
    return scaled.select(F.col("_rid").alias("p_partkey"), F.round("p_partkey", 6).alias("s_partkey"),
                         F.round("p_size", 6).alias("s_size"), F.round("p_retailprice", 6).alias("s_retailprice"))


# ---- 2.3 neighbour joins ------------------------------------------------------

@register("knn_self_join", PART_SQL + """
SELECT kd5.qid AS p_partkey, round(kd5.k5, 6) AS k5_distance, round(kd20.k20, 6) AS k20_distance
FROM kd5 JOIN kd20 USING (qid)""")
def q_knn(spark, sf):
    pts = _part_points(spark, sf)
    groups, rowmap = collapse(pts, "_rid")
    k5 = kth_distance(knn(groups, 5, include_self=True)).select(F.col("qid").alias("gid"), F.col("kdist").alias("k5"))
    k20 = kth_distance(knn(groups, 20, include_self=False)).select(F.col("qid").alias("gid"), F.col("kdist").alias("k20"))
    return (rowmap.join(k5, "gid").join(k20, "gid")
            .select(F.col("_rid").alias("p_partkey"), F.round("k5", 6).alias("k5_distance"),
                    F.round("k20", 6).alias("k20_distance")))


@register("eps_neighbours", PART_SQL + " SELECT qid AS p_partkey, n_within AS n_within_eps FROM cnt")
def q_eps_neighbours(spark, sf):
    pts = _part_points(spark, sf)
    groups, rowmap = collapse(pts, "_rid")
    eps, _ = dynamic_eps(pts, "_rid", groups=(groups, rowmap))
    rc = radius_counts(groups, eps).select(F.col("qid").alias("gid"), F.col("n_within").cast("long").alias("n_within_eps"))
    return rowmap.join(rc, "gid").select(F.col("_rid").alias("p_partkey"), "n_within_eps")


@register("dynamic_eps", PART_SQL + """
SELECT round((SELECT eps FROM eps), 6) AS eps, count(*) AS n_rows,
       count(*) FILTER (WHERE k5 > (SELECT eps FROM eps)) AS n_above FROM kd5""")
def q_eps(spark, sf):
    pts = _part_points(spark, sf)
    eps, per_row = dynamic_eps(pts, "_rid")
    return per_row.agg(F.round(F.lit(eps), 6).alias("eps"), F.count(F.lit(1)).alias("n_rows"),
                       F.count(F.when(F.col("kdist") > F.lit(eps), 1)).alias("n_above"))


@register("dbscan_noise", PART_SQL + " SELECT id AS p_partkey, is_core, anomaly_model_dbscan FROM db")
def q_dbscan(spark, sf):
    checkpoint_dir(spark)
    pts = _part_points(spark, sf).checkpoint(eager=True)
    n = pts.count()
    g, rowmap = collapse(pts, "_rid")
    nb = lof_neighbours(g, n)
    eps, _ = dynamic_eps(pts, "_rid", groups=(g, rowmap), neighbours=nb)
    return dbscan_noise(pts, "_rid", eps, groups=(g, rowmap), neighbours=nb).withColumnRenamed("_rid", "p_partkey")


@register("lof", PART_SQL + """
SELECT id AS p_partkey, round(lof, 6) AS lof, CAST(lof > 1.5 AS INTEGER) AS anomaly_model_lof FROM lofs""")
def q_lof(spark, sf):
    pts = _part_points(spark, sf)
    r = local_outlier_factor(pts, "_rid")
    return r.select(F.col("_rid").alias("p_partkey"), F.round("lof", 6).alias("lof"), "anomaly_model_lof")


# ---- 2.10 models with no SQL form (rows-only) -------------------------------------

@register("isolation_forest")
def q_iforest(spark, sf):
    scaled, cols = prepare(table(spark, sf, "part"), "p_partkey")
    r = iforest.isolation_forest(scaled, "_rid", cols)
    return r.select(F.col("_rid").alias("p_partkey"), F.round("iforest_score", 6).alias("iforest_score"),
                    "anomaly_model_iforest")


def _wide_embeddings(spark, sf):
    """One column per vector element; the length is the data's own and has to
    be the same on every row."""
    e = table(spark, sf, "embeddings")
    size = F.size("embedding")
    lo, hi = e.agg(F.min(size), F.max(size)).first()
    if lo != hi:
        raise ValueError(f"vectors of {lo} to {hi} elements in one table")
    return e.select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(hi or 0)])


@register("pca_distances")
def q_pca_distances(spark, sf):
    # embeddings -> PCA(10) distance space -> LOF
    scaled, cols = prepare(_wide_embeddings(spark, sf), "vec_id")
    pts = distance_points(scaled, cols)
    r = local_outlier_factor(pts, "_rid")
    return r.select(F.col("_rid").alias("vec_id"), F.round("lof", 6).alias("lof"), "anomaly_model_lof")


@register("pca_projection")
def q_pca_projection(spark, sf):
    scaled, cols = prepare(_wide_embeddings(spark, sf), "vec_id")
    proj, evr = pca_projection(scaled, "_rid", cols, 2)
    return proj.select(F.col("_rid").alias("vec_id"), F.round("pc1", 6).alias("pc1"), F.round("pc2", 6).alias("pc2"),
                       F.lit(round(float(evr[0]), 6)).alias("evr1"), F.lit(round(float(evr[1]), 6)).alias("evr2"))


# two columns have their principal axes in closed form
PLANE_SQL = "WITH " + _scaled_sql("part", "p_partkey", ["p_size", "p_retailprice"]) + """,
c AS (SELECT avg(x0) AS m0, avg(x1) AS m1, var_samp(x0) AS a, covar_samp(x0, x1) AS b, var_samp(x1) AS d FROM sc),
e AS (SELECT *, (a + d) / 2 + sqrt((a - d) * (a - d) / 4 + b * b) AS l1 FROM c),
v AS (SELECT *, CASE WHEN a >= d THEN l1 - d ELSE b END AS u0, CASE WHEN a >= d THEN b ELSE l1 - a END AS u1 FROM e),
w AS (SELECT *, sqrt(u0 * u0 + u1 * u1) * sign(CASE WHEN abs(u0) >= abs(u1) THEN u0 ELSE u1 END) AS n1,
             sqrt(u0 * u0 + u1 * u1) * sign(CASE WHEN abs(u1) >= abs(u0) THEN -u1 ELSE u0 END) AS n2 FROM v)
SELECT id AS p_partkey, round(((x0 - m0) * u0 + (x1 - m1) * u1) / n1, 6) AS pc1, round((-(x0 - m0) * u1 + (x1 - m1) * u0) / n2, 6) AS pc2,
       round(l1 / (a + d), 6) AS evr1, round((a + d - l1) / (a + d), 6) AS evr2 FROM sc, w"""


@register("pca_plane", PLANE_SQL)
def q_pca_plane(spark, sf):
    scaled, _ = prepare(table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice"), "p_partkey", exclude=("p_partkey",))
    proj, evr = pca_projection(scaled, "_rid", ["p_size", "p_retailprice"], 2)
    return proj.select(F.col("_rid").alias("p_partkey"), F.round("pc1", 6).alias("pc1"), F.round("pc2", 6).alias("pc2"),
                       F.lit(round(float(evr[0]), 6)).alias("evr1"), F.lit(round(float(evr[1]), 6)).alias("evr2"))


@register("generic_pipeline")
def q_generic(spark, sf):
    r = detect_generic(table(spark, sf, "part"), "p_partkey")
    return r.df.select("p_partkey", "anomaly_model_iforest", "anomaly_model_dbscan", "anomaly_model_lof",
                       "anomaly_votes", "is_anomaly_ensemble")


# ---- U9 / E10 with SQL-expressible members ----------------------------------
# The forest has no SQL form; in these oracle keys its vote is held at 0 so the
# vote and the evaluation are checked exactly.

@register("ensemble_vote", PART_SQL + """
SELECT db.id AS p_partkey, 0 AS anomaly_model_iforest, anomaly_model_dbscan,
       CAST(lof > 1.5 AS INTEGER) AS anomaly_model_lof,
       CAST(anomaly_model_dbscan + CAST(lof > 1.5 AS INTEGER) AS INTEGER) AS anomaly_votes,
       CAST(anomaly_model_dbscan + CAST(lof > 1.5 AS INTEGER) >= 2 AS INTEGER) AS is_anomaly_ensemble
FROM db JOIN lofs USING (id)""")
def q_vote(spark, sf):
    return _vote_part(spark, sf)


def _distance_members(pts):
    """DBSCAN noise and LOF flags from one shared exact kNN pass."""
    checkpoint_dir(pts.sparkSession)
    pts = pts.checkpoint(eager=True)
    n = pts.count()
    g, rowmap = collapse(pts, "_rid")
    nb = lof_neighbours(g, n)
    eps, _ = dynamic_eps(pts, "_rid", groups=(g, rowmap), neighbours=nb)
    db = dbscan_noise(pts, "_rid", eps, groups=(g, rowmap), neighbours=nb).select("_rid", "anomaly_model_dbscan")
    lf = local_outlier_factor(pts, "_rid", groups=(g, rowmap), neighbours=nb).select("_rid", "anomaly_model_lof")
    return db, lf


def _vote_part(spark, sf):
    pts = _part_points(spark, sf)
    db, lf = _distance_members(pts)
    res = db.join(lf, "_rid").withColumn("anomaly_model_iforest", F.lit(0))
    return vote(res).select(F.col("_rid").alias("p_partkey"), "anomaly_model_iforest",
                                          "anomaly_model_dbscan", "anomaly_model_lof", "anomaly_votes",
                                          "is_anomaly_ensemble")


@register("vote_distribution", PART_SQL + """
SELECT CAST(anomaly_model_dbscan + CAST(lof > 1.5 AS INTEGER) AS INTEGER) AS anomaly_votes, count(*) AS count
FROM db JOIN lofs USING (id) GROUP BY 1""")
def q_vote_dist(spark, sf):
    return value_counts(_vote_part(spark, sf), "anomaly_votes", descending=True)


TXN3 = ["amount", "lat", "lon"]


@register("evaluate_ensemble", "WITH " + TXN_SQL + ", " + _scaled_sql("txn", "transaction_id", TXN3) + _neigh_sql(3) + """,
pred AS (SELECT db.id, CAST(anomaly_model_dbscan + CAST(lof > 1.5 AS INTEGER) >= 2 AS INTEGER) AS p
         FROM db JOIN lofs USING (id)),
lab AS (SELECT transaction_id AS id, is_fraud FROM txn),
j AS (SELECT lab.is_fraud, pred.p FROM lab JOIN pred USING (id)),
c AS (SELECT count(*) FILTER (WHERE is_fraud = 0 AND p = 0) AS tn, count(*) FILTER (WHERE is_fraud = 0 AND p = 1) AS fp,
             count(*) FILTER (WHERE is_fraud = 1 AND p = 0) AS fn, count(*) FILTER (WHERE is_fraud = 1 AND p = 1) AS tp FROM j)
SELECT CAST(tn AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tp AS BIGINT) AS tp,
       round((tp + tn) / (tn + fp + fn + tp), 6) AS accuracy FROM c""")
def q_eval_ensemble(spark, sf):
    # transactions' numeric behaviour columns, label found by name; members
    # with an SQL form (DBSCAN noise, LOF), forest vote held at 0
    t, _ = detect_label_column(txn(spark, sf).select("transaction_id", *TXN3, "is_fraud"))
    scaled, cols = prepare(t.drop("is_fraud"), "transaction_id", exclude=("transaction_id",))
    pts = distance_points(scaled, cols)
    db, lf = _distance_members(pts)
    res = vote(db.join(lf, "_rid").withColumn("anomaly_model_iforest", F.lit(0)))
    j = t.join(res.withColumnRenamed("_rid", "transaction_id"), "transaction_id")
    cells = j.agg(*[F.count(F.when((F.col("is_fraud") == a) & (F.col("is_anomaly_ensemble") == p), 1)).alias(n)
                    for n, a, p in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))])
    return cells.withColumn("accuracy", F.round((F.col("tp") + F.col("tn")) /
                                                (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")), 6))


@register("ensemble_report")
def q_ensemble_report(spark, sf):
    # the full ensemble (forest included) on the transactions, evaluated
    t = txn(spark, sf).select("transaction_id", *TXN3, "is_fraud")
    r = detect_generic(t, "transaction_id", exclude=("transaction_id", "is_fraud"))
    j = r.df
    if not r.unique_ids:  # a verdict belongs to an id, and to all rows that have it
        j = t.select("transaction_id", "is_fraud").join(r.df.select("transaction_id", "is_anomaly_ensemble"), "transaction_id")
    return classification_report(j, "is_fraud", "is_anomaly_ensemble")


# ---- the whole vote: forest, DBSCAN and LOF -------------------------------------

@register("full_ensemble_vote")
def q_full_vote(spark, sf):
    # any table, no single unique id: rows are told apart by their contents
    c = table(spark, sf, "customer").select("c_nationkey", "c_acctbal", "c_mktsegment")
    r = detect_generic(c)
    return r.df.select("c_nationkey", "c_acctbal", "c_mktsegment", "anomaly_model_iforest", "anomaly_model_dbscan", "anomaly_model_lof",
                       "anomaly_votes", "is_anomaly_ensemble")


@register("full_vote_distribution")
def q_full_vote_distribution(spark, sf):
    return value_counts(detect_generic(table(spark, sf, "part"), "p_partkey").df, "anomaly_votes", descending=True)


@register("lineitem_ensemble")
def q_lineitem_ensemble(spark, sf):
    # no column is unique: (l_orderkey, l_linenumber) is
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount")
    r = detect_generic(items, exclude=("l_orderkey", "l_linenumber"))
    return r.df.select("l_orderkey", "l_linenumber", "anomaly_model_iforest", "anomaly_model_dbscan", "anomaly_model_lof", "anomaly_votes",
                       "is_anomaly_ensemble")


@register("ensemble_members", PART_SQL + """
SELECT db.id AS p_partkey, anomaly_model_dbscan, CAST(lof > 1.5 AS INTEGER) AS anomaly_model_lof FROM db JOIN lofs USING (id)""")
def q_members(spark, sf):
    # the members of the whole vote that have an SQL form, out of the same run
    return detect_generic(table(spark, sf, "part"), "p_partkey").df.select("p_partkey", "anomaly_model_dbscan", "anomaly_model_lof")
