"""Registered queries: features (2.2, 2.4, 2.5) and the supervised model (2.9)."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import functions as F

from ledgerscope.functions.geo import haversine_sql
from ledgerscope.operators import aggregates as A
from ledgerscope.operators import supervised as M
from ledgerscope.operators.evaluate import classification_report
from ledgerscope.operators.features import FEATURE_COLS, category_codes, engineer_features, feature_matrix
from ledgerscope.operators.rules import run_rules
from ledgerscope.plans.common import table, txn
from ledgerscope.plans.oracle_sql import with_rules
from ledgerscope.sources.adapters import TXN_SQL

Q: dict = {}
SQL: dict = {}


def register(name, sql=None):
    def deco(fn):
        Q[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


FEATURE_CTES = TXN_SQL + f""",
fseq AS (
  SELECT *, epoch_us("timestamp") AS us, epoch_us("timestamp") // 1000000 AS sec,
         row_number() OVER (PARTITION BY user_id ORDER BY "timestamp", transaction_id) AS rn
  FROM txnm
),
c1h AS (
  SELECT a.transaction_id, count(*) AS cnt
  FROM fseq a JOIN fseq b ON a.user_id = b.user_id AND b.rn <= a.rn AND a.sec - b.sec <= 3600
  GROUP BY a.transaction_id
),
fprev AS (SELECT a.transaction_id, b.us AS prev_us FROM fseq a LEFT JOIN fseq b ON a.user_id = b.user_id AND b.rn = a.rn - 1),
fu AS (
  SELECT user_id, avg(amount) AS m, stddev_samp(amount) AS s, median(amount) AS md,
         median(lat) AS clat, median(lon) AS clon
  FROM txnm GROUP BY user_id
),
fcat AS (
  SELECT category, CAST(dense_rank() OVER (ORDER BY category) - 1 AS INTEGER) AS code
  FROM (SELECT DISTINCT category FROM txnm WHERE category IS NOT NULL)
),
feat AS (
  SELECT f.transaction_id, f.user_id, f."timestamp", f.category, f.is_fraud, f.amount,
    (f.amount - fu.m) / COALESCE(NULLIF(fu.s, 0), 1.0) AS amount_z_score,
    f.amount / COALESCE(NULLIF(fu.md, 0), 1.0) AS amount_to_median,
    CAST(hour(f."timestamp") AS INTEGER) AS hour,
    CAST(isodow(f."timestamp") - 1 AS INTEGER) AS day_of_week,
    CAST(isodow(f."timestamp") - 1 IN (5, 6) AS INTEGER) AS is_weekend,
    CAST(hour(f."timestamp") BETWEEN 0 AND 5 AS INTEGER) AS is_night,
    {haversine_sql('f.lat', 'f.lon', 'fu.clat', 'fu.clon')} AS location_distance_km,
    {haversine_sql('f.lat', 'f.lon', 'f.merch_lat', 'f.merch_lon')} AS merch_distance_km,
    COALESCE((f.us - p.prev_us) / 1e6, -1.0) AS time_since_last_txn,
    CAST(COALESCE(c.cnt, 0) AS INTEGER) AS txn_count_1h,
    COALESCE(k.code, -1) AS category_encoded
  FROM fseq f
  LEFT JOIN fu ON f.user_id = fu.user_id
  LEFT JOIN fprev p ON f.transaction_id = p.transaction_id
  LEFT JOIN c1h c ON f.transaction_id = c.transaction_id
  LEFT JOIN fcat k ON f.category = k.category
)"""


def with_features(select: str) -> str:
    return "WITH " + FEATURE_CTES + "\n" + select


_ROUND_F = {"amount_z_score": 6, "amount_to_median": 6, "location_distance_km": 4,
            "merch_distance_km": 4, "time_since_last_txn": 6}


def _sel_spark(df, cols):
    return df.select(*[F.round(c, _ROUND_F[c]).alias(c) if c in _ROUND_F else F.col(c) for c in cols])


def _sel_sql(cols):
    return ", ".join(f"round({c}, {_ROUND_F[c]}) AS {c}" if c in _ROUND_F else c for c in cols)


def features(spark, sf, wanted=None):
    return engineer_features(txn(spark, sf), wanted=wanted)


def _feature_query(name, cols):
    def q(spark, sf):
        return _sel_spark(features(spark, sf, [c for c in cols if c in FEATURE_COLS]), cols)
    q.__name__ = f"q_{name}"
    register(name, with_features(f"SELECT {_sel_sql(cols)} FROM feat"))(q)


_feature_query("temporal_features", ["transaction_id", "hour", "day_of_week", "is_weekend", "is_night"])
_feature_query("amount_features", ["transaction_id", "user_id", "amount_z_score", "amount_to_median"])
_feature_query("location_features", ["transaction_id", "location_distance_km", "merch_distance_km"])
_feature_query("time_since_last", ["transaction_id", "user_id", "time_since_last_txn"])
_feature_query("txn_count_1h", ["transaction_id", "user_id", "txn_count_1h"])
_feature_query("engineer_features", ["transaction_id", "user_id"] + FEATURE_COLS)


@register("feature_matrix", with_features("SELECT transaction_id, " + ", ".join(
    f"round(COALESCE(CAST({c} AS DOUBLE), 0.0), {_ROUND_F.get(c, 6)}) AS {c}" for c in FEATURE_COLS) + " FROM feat"))
def q_feature_matrix(spark, sf):
    # the vectors that the models read, taken apart again
    from pyspark.ml.functions import vector_to_array
    v = feature_matrix(features(spark, sf)).select("transaction_id", vector_to_array("features").alias("v"))
    return v.select("transaction_id", *[F.round(F.col("v")[i], _ROUND_F.get(c, 6)).alias(c) for i, c in enumerate(FEATURE_COLS)])


@register("category_encode", with_features("SELECT category, code AS category_encoded FROM fcat"))
def q_category_encode(spark, sf):
    return category_codes(txn(spark, sf))


def _describe_sql(cols):
    parts = []
    for c in cols:
        parts.append(
            f"SELECT '{c}' AS feature, count({c}) AS count, round(avg({c}), 6) AS mean, "
            f"round(stddev_samp({c}), 6) AS std, round(CAST(min({c}) AS DOUBLE), 6) AS min, "
            f"round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50, "
            f"round(quantile_cont({c}, 0.75), 6) AS p75, round(CAST(max({c}) AS DOUBLE), 6) AS max FROM feat")
    return with_features("\nUNION ALL\n".join(parts))


@register("describe_features", _describe_sql(FEATURE_COLS))
def q_describe(spark, sf):
    return A.describe_features(features(spark, sf), FEATURE_COLS)


@register("quantile_threshold", with_features("""
SELECT round(quantile_cont(amount_z_score, 0.95), 6) AS threshold,
       count(*) FILTER (WHERE amount_z_score >= (SELECT quantile_cont(amount_z_score, 0.95) FROM feat)) AS n_at_or_above
FROM feat"""))
def q_quantile_threshold(spark, sf):
    f = features(spark, sf, ["amount_z_score"])
    thr = A.quantile_threshold(f, "amount_z_score", 0.95)
    return f.agg(F.round(F.lit(thr), 6).alias("threshold"),
                 F.count(F.when(F.col("amount_z_score") >= F.lit(thr), 1)).alias("n_at_or_above"))


@register("anomaly_rate_by_hour", with_rules("""
SELECT hour, count(*) AS n_rows, round(avg(CAST(predicted_fraud AS DOUBLE)) * 100.0, 6) AS anomaly_rate_pct
FROM scored GROUP BY hour"""))
def q_rate_by_hour(spark, sf):
    return A.rate_by(run_rules(txn(spark, sf)).df, "hour", "predicted_fraud")


@register("label_balance", "WITH " + TXN_SQL + """
SELECT sum(is_fraud) AS n_positive, count(*) AS n_rows, round(avg(CAST(is_fraud AS DOUBLE)), 6) AS positive_rate FROM txnm""")
def q_label_balance(spark, sf):
    return A.label_balance(txn(spark, sf), "is_fraud")


# ---- 2.9 labels, weights, split --------------------------------------------

@register("labels_ground_truth", "WITH " + TXN_SQL + " SELECT transaction_id, CAST(is_fraud AS INTEGER) AS label FROM txnm")
def q_labels_gt(spark, sf):
    lab, _ = M.derive_labels(txn(spark, sf))
    return lab.select("transaction_id", "label")


@register("labels_from_rules", with_rules("SELECT transaction_id, predicted_fraud AS label FROM scored"))
def q_labels_rules(spark, sf):
    lab, _ = M.derive_labels(run_rules(txn(spark, sf)).df.drop("is_fraud"))
    return lab.select("transaction_id", "label")


@register("labels_top5pct", with_features("""
SELECT transaction_id,
       CAST(COALESCE(amount_z_score >= (SELECT quantile_cont(amount_z_score, 0.95) FROM feat), FALSE) AS INTEGER) AS label
FROM feat"""))
def q_labels_top(spark, sf):
    lab, _ = M.derive_labels(features(spark, sf, ["amount_z_score"]).drop("is_fraud"))
    return lab.select("transaction_id", "label")


@register("class_weights", "WITH " + TXN_SQL + """
SELECT sum(is_fraud) AS n_pos, count(*) - sum(is_fraud) AS n_neg,
       round((count(*) - sum(is_fraud)) / greatest(sum(is_fraud), 1), 6) AS scale_pos_weight
FROM txnm""")
def q_class_weights(spark, sf):
    t = txn(spark, sf)
    lab, _ = M.derive_labels(t)
    return lab.agg(F.sum("label").cast("long").alias("n_pos"),
                   (F.count(F.lit(1)) - F.sum("label")).cast("long").alias("n_neg"),
                   F.round((F.count(F.lit(1)) - F.sum("label")) / F.greatest(F.sum("label"), F.lit(1)), 6)
                   .alias("scale_pos_weight"))


@register("stratified_split", "WITH " + TXN_SQL + """,
k AS (
  SELECT transaction_id, is_fraud AS label, CAST('0x' || substr(md5(CAST(transaction_id AS VARCHAR) || ':42'), 1, 13) AS BIGINT) AS key,
         count(*) OVER (PARTITION BY is_fraud) AS n_class
  FROM txnm
)
SELECT transaction_id, CAST(label AS INTEGER) AS label,
       CAST(row_number() OVER (PARTITION BY label ORDER BY key) <= floor(0.25 * n_class + 0.5) AS INTEGER) AS is_test
FROM k""")
def q_split(spark, sf):
    lab, _ = M.derive_labels(txn(spark, sf))
    return M.stratified_split(lab).select("transaction_id", "label", "is_test")


@register("stratified_split_text_ids", """
WITH k AS (
  SELECT c_name, c_nationkey % 2 AS label, CAST('0x' || substr(md5(c_name || ':42'), 1, 13) AS BIGINT) AS key,
         count(*) OVER (PARTITION BY c_nationkey % 2) AS n_class
  FROM customer
)
SELECT c_name, CAST(label AS INTEGER) AS label,
       CAST(row_number() OVER (PARTITION BY label ORDER BY key) <= floor(0.25 * n_class + 0.5) AS INTEGER) AS is_test
FROM k""")
def q_split_text_ids(spark, sf):
    # ids that are no numbers
    c = table(spark, sf, "customer").select("c_name", (F.col("c_nationkey") % 2).cast("int").alias("label"))
    return M.stratified_split(c, id_col="c_name").select("c_name", "label", "is_test")


# ---- 2.9 model (rows-only checks) -----------------------------------------

@lru_cache(maxsize=1)
def _fitted(spark, sf):
    """The model at its full setting (200 rounds), fitted once per session and
    folder: the six queries below are reports on one model.  Its table of
    features and scores is a checkpoint."""
    return M.train_and_score(features(spark, sf))


@register("supervised_rows", SQL["stratified_split"])
def q_supervised_rows(spark, sf):
    # what can be said of the trained table without the trees: every row once, its label, its side of the split
    scored = _fitted(spark, sf).scored
    fine = (F.col("fraud_prob") >= 0) & (F.col("fraud_prob") <= 1) & ((F.col("fraud_prob") > 0.5).cast("int") == F.col("predicted_fraud_model"))
    return scored.where(fine).select("transaction_id", "label", "is_test")


@register("boosted_trees_scores")
def q_gbt_scores(spark, sf):
    r = _fitted(spark, sf)
    return r.scored.select("transaction_id", "label", "is_test", F.round("fraud_prob", 6).alias("fraud_prob"),
                           "predicted_fraud_model")


@register("supervised_pipeline")
def q_supervised(spark, sf):
    r = _fitted(spark, sf)
    return classification_report(r.test, "label", "predicted_fraud_model")


@register("feature_importance")
def q_importance(spark, sf):
    r = _fitted(spark, sf)
    rows = M.feature_importance(r.model, r.features)
    return spark.createDataFrame([(n, float(round(v, 6))) for n, v in rows], "feature string, importance double")


@register("model_report_tables")
def q_model_tables(spark, sf):
    """The boosted-tree evaluation tables on the held-out set: AUC, ROC
    points, a 50-bin probability histogram per predicted class, anomaly
    rate by hour, as one long table (table, key, value)."""
    from ledgerscope.operators import evaluate as E
    r = _fitted(spark, sf)
    test = r.test
    auc = E.roc_auc(test, "label", "fraud_prob").select(
        F.lit("roc_auc").alias("table"), F.lit("auc").alias("key"), F.col("roc_auc").alias("value"))
    roc = E.roc_curve(test, "label", "fraud_prob").select(
        F.lit("roc_curve").alias("table"), F.format_string("%.6f", "threshold").alias("key"),
        F.col("tpr").alias("value"))
    hist = E.score_histogram(r.scored, "fraud_prob", "predicted_fraud_model").select(
        F.lit("histogram").alias("table"), F.concat_ws(":", F.col("predicted_fraud_model").cast("string"),
                                                         F.col("bin").cast("string")).alias("key"),
        F.col("count").cast("double").alias("value"))
    rate = A.rate_by(r.scored, "hour", "predicted_fraud_model").select(
        F.lit("rate_by_hour").alias("table"), F.col("hour").cast("string").alias("key"),
        F.col("anomaly_rate_pct").alias("value"))
    return auc.unionByName(roc).unionByName(hist).unionByName(rate)


@register("top_suspicious_model")
def q_top_model(spark, sf):
    """The 15 most probable frauds with display columns."""
    from ledgerscope.operators.evaluate import top_k
    r = _fitted(spark, sf)
    return top_k(r.scored, "fraud_prob", 15, ["user_id", "timestamp", "amount", "category", "fraud_prob",
                                             "predicted_fraud_model", "transaction_id"])


@register("flagged_model")
def q_flagged_model(spark, sf):
    """D10 for the model: flagged rows, most probable first."""
    from ledgerscope.sources.sinks import flagged
    r = _fitted(spark, sf)
    return flagged(r.scored, "predicted_fraud_model", "fraud_prob").select(
        "transaction_id", "user_id", F.round("fraud_prob", 6).alias("fraud_prob"))
