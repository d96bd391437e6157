"""Registered queries for the rule pipeline (sections 2.1-2.7)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope.functions.geo import haversine_km, haversine_sql
from ledgerscope.operators import aggregates as A
from ledgerscope.operators import rules as R
from ledgerscope.operators.evaluate import head_sample
from ledgerscope.operators.sequence import TrailingCount, user_sequence
from ledgerscope.operators.user_stats import (
    user_amount_stats, user_category_share, user_centers, user_hour_share)
from ledgerscope.plans.common import rounded, table, txn
from ledgerscope.plans.oracle_sql import RULE_CTES, with_rules
from ledgerscope.session import checkpoint_dir
from ledgerscope.sources import transactions as S
from ledgerscope.sources.adapters import TXN_SQL
from ledgerscope.sources.sinks import write_results

Q: dict = {}
SQL: dict = {}


def register(name, sql=None):
    def deco(fn):
        Q[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def scored(spark, sf_dir) -> DataFrame:
    return R.run_rules(txn(spark, sf_dir)).df


# ---- 2.1 sources ---------------------------------------------------------

@register("read_transactions", "SELECT event_id, ts, user_id, event_type, value, props FROM events")
def q_read(spark, sf):
    return S.read_transactions(spark, f"{sf}/events.parquet")


@register("standardise_columns", "WITH " + TXN_SQL + """
SELECT transaction_id, user_id, "timestamp", amount AS amount, lat, lon AS lon, merch_lat, merch_lon,
       category, is_fraud
FROM txnm""")
def q_standardise(spark, sf):
    # the card feed's column names, rebuilt from txn, then standardised
    raw = txn(spark, sf).select(
        "transaction_id", F.col("user_id").alias("cc_num"),
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("trans_date_trans_time"),
        F.col("amount").alias("amt"), "lat", F.col("lon").alias("long"),
        "merch_lat", F.col("merch_lon").alias("merch_long"), "category", "is_fraud")
    return S.standardise_columns(raw).select(
        "transaction_id", "user_id", "timestamp", "amount", "lat", "lon", "merch_lat", "merch_lon",
        "category", "is_fraud")


@register("map_generic_columns", """
SELECT event_id, ts AS "timestamp", user_id, event_type AS category, value AS amount, props FROM events""")
def q_map_generic(spark, sf):
    df, _ = S.map_generic_columns(table(spark, sf, "events"))
    return df


@register("global_user_fallback", """
WITH p AS (SELECT p_partkey, p_retailprice AS amount, p_type AS category FROM part),
u AS (SELECT avg(amount) AS m, stddev_samp(amount) AS s, count(*) AS n FROM p),
c AS (SELECT category, count(*) AS cnt FROM p GROUP BY category),
f AS (
  SELECT p.p_partkey, p.amount, p.category, 'GlobalUser' AS user_id,
         COALESCE((p.amount - u.m) / COALESCE(NULLIF(u.s, 0), 1.0), 0.0) AS z,
         COALESCE(c.cnt / u.n, 0.0) AS cat_pct
  FROM p CROSS JOIN u LEFT JOIN c ON p.category = c.category
)
SELECT p_partkey, amount, category, user_id, round(z, 6) AS amount_z_score,
       CAST(abs(z) > 3.0 AS INTEGER) AS flag_amount_anomaly, round(cat_pct, 6) AS cat_pct,
       CAST(cat_pct < 0.05 AS INTEGER) AS flag_category_deviation,
       CAST(CAST(abs(z) > 3.0 AS INTEGER) + CAST(cat_pct < 0.05 AS INTEGER) AS INTEGER) AS fraud_score,
       CAST(CAST(abs(z) > 3.0 AS INTEGER) + CAST(cat_pct < 0.05 AS INTEGER) >= 1 AS INTEGER) AS predicted_fraud,
       CAST(2 AS INTEGER) AS rules_run
FROM f""")
def q_global_user(spark, sf):
    # part has no user-like column: every row falls into one 'GlobalUser'
    # group (p_retailprice -> amount, p_type -> category); the two rules
    # that can run use partial aggregates, so the single group is no
    # single task
    df, _ = S.map_generic_columns(table(spark, sf, "part"))
    r = R.run_rules(df)
    return r.df.select("p_partkey", "amount", "category", "user_id",
                       F.round("amount_z_score", 6).alias("amount_z_score"), "flag_amount_anomaly",
                       F.round("cat_pct", 6).alias("cat_pct"), "flag_category_deviation",
                       "fraud_score", "predicted_fraud", F.lit(r.rules_run).cast("int").alias("rules_run"))


@register("detect_label", "SELECT vec_id, CAST(label AS INTEGER) AS is_fraud FROM embeddings")
def q_detect_label(spark, sf):
    df, _ = S.detect_label_column(table(spark, sf, "embeddings"))
    return df.select("vec_id", F.col("is_fraud").cast("int").alias("is_fraud"))


@register("numeric_features", """
SELECT CAST(p_partkey AS DOUBLE) AS p_partkey, CAST(p_size AS DOUBLE) AS p_size, p_retailprice FROM part""")
def q_numeric(spark, sf):
    df, _ = S.select_numeric_features(table(spark, sf, "part"))
    return df


@register("dataset_profile", "WITH " + TXN_SQL + """
SELECT count(*) AS n_rows, CAST(10 AS BIGINT) AS n_columns, count(DISTINCT user_id) AS n_users FROM txnm""")
def q_profile(spark, sf):
    return S.profile(txn(spark, sf))


@register("flagged_transactions", with_rules("""
SELECT transaction_id, user_id, fraud_score FROM scored WHERE predicted_fraud = 1"""))
def q_flagged(spark, sf):
    from ledgerscope.sources.sinks import flagged
    return flagged(scored(spark, sf), "predicted_fraud", "fraud_score").select(
        "transaction_id", "user_id", "fraud_score")


# ---- 2.2 scalar functions -------------------------------------------------

@register("haversine", "WITH " + TXN_SQL + f"""
SELECT transaction_id, round({haversine_sql('lat', 'lon', 'merch_lat', 'merch_lon')}, 4) AS merch_distance_km,
       round({haversine_sql('lat', 'lon', '40.71', '-74.01')}, 4) AS km_to_new_york
FROM txnm""")
def q_haversine(spark, sf):
    t = txn(spark, sf)
    return t.select("transaction_id",
                    F.round(haversine_km("lat", "lon", "merch_lat", "merch_lon"), 4).alias("merch_distance_km"),
                    F.round(haversine_km("lat", "lon", F.lit(40.71), F.lit(-74.01)), 4).alias("km_to_new_york"))


# ---- 2.4 aggregates ------------------------------------------------------

@register("user_amount_stats", "WITH " + TXN_SQL + """
SELECT user_id, round(avg(amount), 6) AS user_mean, round(stddev_samp(amount), 6) AS user_std,
       count(*) AS user_txn_count, round(median(amount), 6) AS user_median
FROM txnm GROUP BY user_id""")
def q_user_amount_stats(spark, sf):
    st = user_amount_stats(txn(spark, sf), with_median=True)
    return st.select("user_id", F.round("user_mean", 6).alias("user_mean"),
                     F.round("user_std", 6).alias("user_std"), "user_txn_count",
                     F.round("user_median", 6).alias("user_median"))


@register("user_centers", "WITH " + TXN_SQL + """
SELECT user_id, round(median(lat), 6) AS center_lat, round(median(lon), 6) AS center_lon
FROM txnm GROUP BY user_id""")
def q_user_centers(spark, sf):
    c = user_centers(txn(spark, sf))
    return c.select("user_id", F.round("center_lat", 6).alias("center_lat"),
                    F.round("center_lon", 6).alias("center_lon"))


@register("user_hour_share", "WITH " + TXN_SQL + """,
h AS (SELECT user_id, CAST(hour("timestamp") AS INTEGER) AS hour, count(*) AS hour_pct_count FROM txnm GROUP BY 1, 2),
t AS (SELECT user_id, count(*) AS total_count FROM txnm GROUP BY 1)
SELECT h.user_id, h.hour, h.hour_pct_count, t.total_count, round(h.hour_pct_count / t.total_count, 6) AS hour_pct
FROM h JOIN t USING (user_id)""")
def q_user_hour_share(spark, sf):
    s = user_hour_share(txn(spark, sf))
    return s.withColumn("hour_pct", F.round("hour_pct", 6))


@register("user_category_share", "WITH " + TXN_SQL + """,
h AS (SELECT user_id, category, count(*) AS cat_pct_count FROM txnm GROUP BY 1, 2),
t AS (SELECT user_id, count(*) AS total_count FROM txnm GROUP BY 1)
SELECT h.user_id, h.category, h.cat_pct_count, t.total_count, round(h.cat_pct_count / t.total_count, 6) AS cat_pct
FROM h JOIN t USING (user_id)""")
def q_user_category_share(spark, sf):
    s = user_category_share(txn(spark, sf))
    return s.withColumn("cat_pct", F.round("cat_pct", 6))


@register("join_user_stats", "WITH " + TXN_SQL + """,
u AS (SELECT user_id, avg(amount) AS user_mean, stddev_samp(amount) AS user_std FROM txnm GROUP BY user_id)
SELECT transaction_id, user_id, amount, round(user_mean, 6) AS user_mean, round(user_std, 6) AS user_std
FROM txnm LEFT JOIN u USING (user_id)""")
def q_join_user_stats(spark, sf):
    t = txn(spark, sf)
    st = user_amount_stats(t).select("user_id", "user_mean", "user_std")
    return t.join(st, "user_id", "left").select(
        "transaction_id", "user_id", "amount", F.round("user_mean", 6).alias("user_mean"),
        F.round("user_std", 6).alias("user_std"))


# ---- 2.5 windows ---------------------------------------------------------

@register("velocity_count", with_rules("SELECT transaction_id, user_id, txn_count_in_window FROM scored"))
def q_velocity_count(spark, sf):
    s = user_sequence(txn(spark, sf), counts=(TrailingCount("txn_count_in_window", 3_600_000_000),))
    return s.select("transaction_id", "user_id", "txn_count_in_window")


@register("travel_speed", with_rules("SELECT transaction_id, user_id, round(travel_speed_kmh, 3) AS travel_speed_kmh FROM scored"))
def q_travel_speed(spark, sf):
    df, _ = R.detect_geographic_impossibility(txn(spark, sf))
    return df.select("transaction_id", "user_id", F.round("travel_speed_kmh", 3).alias("travel_speed_kmh"))


# ---- 2.7 rules -----------------------------------------------------------

def _rule_query(name, fn, cols):
    sel = ", ".join(["transaction_id", "user_id"] + [
        f"round({c}, {d}) AS {c}" if d is not None else c for c, d in cols])
    sql = with_rules(f"SELECT {sel} FROM scored")

    def q(spark, sf):
        df, _ = fn(txn(spark, sf))
        return df.select("transaction_id", "user_id", *[
            F.round(c, d).alias(c) if d is not None else F.col(c) for c, d in cols])
    q.__name__ = f"q_{name}"
    register(name, sql)(q)


_rule_query("rule_amount", R.detect_amount_anomaly, [("amount_z_score", 6), ("flag_amount_anomaly", None)])
_rule_query("rule_location", R.detect_location_deviation,
            [("location_distance_km", 4), ("flag_location_deviation", None)])
_rule_query("rule_temporal", R.detect_temporal_anomaly,
            [("hour", None), ("hour_pct", 6), ("flag_temporal_anomaly", None)])
_rule_query("rule_velocity", R.detect_velocity, [("txn_count_in_window", None), ("flag_velocity", None)])
_rule_query("rule_category", R.detect_category_deviation, [("cat_pct", 6), ("flag_category_deviation", None)])
_rule_query("rule_geo_speed", R.detect_geographic_impossibility,
            [("travel_speed_kmh", 3), ("flag_geo_impossible", None)])

FRAUD_SCORE_COLS = ["transaction_id", "user_id", "timestamp", "amount", "category",
                    *R.FLAG_COLS, "fraud_score", "predicted_fraud"]


@register("fraud_score", with_rules("SELECT " + ", ".join(f'"{c}"' for c in FRAUD_SCORE_COLS) + " FROM scored"))
def q_fraud_score(spark, sf):
    return scored(spark, sf).select(*FRAUD_SCORE_COLS)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q_fraud_score(spark, sf_dir)


_DYN_SQL = "WITH " + TXN_SQL + f""",
seq AS (
  SELECT *, epoch_us("timestamp") AS us,
         row_number() OVER (PARTITION BY user_id ORDER BY "timestamp", transaction_id) AS rn
  FROM txn
),
vel AS (
  SELECT a.transaction_id, count(*) AS cnt
  FROM seq a JOIN seq b ON a.user_id = b.user_id AND b.rn <= a.rn AND a.us - b.us <= 3600000000
  GROUP BY a.transaction_id
),
u AS (SELECT user_id, avg(amount) AS m, stddev_samp(amount) AS s, count(*) AS total FROM txn GROUP BY 1),
h AS (SELECT user_id, hour("timestamp") AS hr, count(*) AS cnt FROM txn GROUP BY 1, 2),
f AS (
  SELECT s.transaction_id, s.user_id,
    CAST(abs(COALESCE((s.amount - u.m) / COALESCE(NULLIF(u.s, 0), 1.0), 0.0)) > 3.0 AS INTEGER) AS flag_amount_anomaly,
    CAST(COALESCE(h.cnt / u.total, 0.0) < 0.05 AS INTEGER) AS flag_temporal_anomaly,
    CAST(COALESCE(v.cnt, 0) > 5 AS INTEGER) AS flag_velocity
  FROM seq s LEFT JOIN u USING (user_id)
  LEFT JOIN h ON s.user_id = h.user_id AND hour(s."timestamp") = h.hr
  LEFT JOIN vel v ON s.transaction_id = v.transaction_id
)
SELECT transaction_id, user_id, flag_amount_anomaly, 0 AS flag_location_deviation, flag_temporal_anomaly,
       flag_velocity, 0 AS flag_category_deviation, 0 AS flag_geo_impossible,
       CAST(flag_amount_anomaly + flag_temporal_anomaly + flag_velocity AS INTEGER) AS fraud_score,
       CAST(flag_amount_anomaly + flag_temporal_anomaly + flag_velocity >= 2 AS INTEGER) AS predicted_fraud,
       CAST(3 AS INTEGER) AS rules_run
FROM f"""


@register("fraud_score_dynamic", _DYN_SQL)
def q_fraud_score_dynamic(spark, sf):
    t = txn(spark, sf, with_merchant=False).drop("lat", "lon", "category")
    r = R.run_rules(t)
    return r.df.select("transaction_id", "user_id", *R.FLAG_COLS, "fraud_score", "predicted_fraud",
                       F.lit(r.rules_run).cast("int").alias("rules_run"))


@register("fraud_score_amount_only", "WITH " + TXN_SQL + """,
u AS (SELECT user_id, avg(amount) AS m, stddev_samp(amount) AS s FROM txn GROUP BY 1),
f AS (SELECT transaction_id, user_id,
        CAST(abs(COALESCE((amount - m) / COALESCE(NULLIF(s, 0), 1.0), 0.0)) > 3.0 AS INTEGER) AS flag_amount_anomaly
      FROM txn LEFT JOIN u USING (user_id))
SELECT transaction_id, user_id, flag_amount_anomaly, CAST(flag_amount_anomaly AS INTEGER) AS fraud_score,
       CAST(flag_amount_anomaly >= 1 AS INTEGER) AS predicted_fraud, CAST(1 AS INTEGER) AS rules_run
FROM f""")
def q_fraud_score_amount_only(spark, sf):
    t = txn(spark, sf, with_merchant=False).select("transaction_id", "user_id", "amount")
    r = R.run_rules(t)
    return r.df.select("transaction_id", "user_id", "flag_amount_anomaly", "fraud_score", "predicted_fraud",
                       F.lit(r.rules_run).cast("int").alias("rules_run"))


@register("mapped_fraud_score", """
WITH e AS (SELECT event_id, ts, epoch_us(ts) AS us, user_id, event_type AS category, value AS amount FROM events),
u AS (SELECT user_id, avg(amount) AS m, stddev_samp(amount) AS s, count(*) AS total FROM e GROUP BY 1),
h AS (SELECT user_id, hour(ts) AS hr, count(*) AS cnt FROM e GROUP BY 1, 2),
c AS (SELECT user_id, category, count(*) AS cnt FROM e GROUP BY 1, 2),
v AS (SELECT a.event_id, count(*) AS cnt FROM e a JOIN e b ON a.user_id = b.user_id AND b.us <= a.us
      AND a.us - b.us <= 3600000000 GROUP BY 1),
f AS (
  SELECT e.event_id, e.user_id, CAST(v.cnt AS INTEGER) AS txn_count_in_window,
    CAST(abs(COALESCE((e.amount - u.m) / COALESCE(NULLIF(u.s, 0), 1.0), 0.0)) > 3.0 AS INTEGER) AS flag_amount_anomaly,
    CAST(COALESCE(h.cnt / u.total, 0.0) < 0.05 AS INTEGER) AS flag_temporal_anomaly,
    CAST(v.cnt > 5 AS INTEGER) AS flag_velocity,
    CAST(COALESCE(c.cnt / u.total, 0.0) < 0.05 AS INTEGER) AS flag_category_deviation
  FROM e LEFT JOIN u USING (user_id)
  LEFT JOIN h ON e.user_id = h.user_id AND hour(e.ts) = h.hr
  LEFT JOIN c ON e.user_id = c.user_id AND e.category = c.category
  LEFT JOIN v ON e.event_id = v.event_id
)
SELECT *, CAST(flag_amount_anomaly + flag_temporal_anomaly + flag_velocity + flag_category_deviation AS INTEGER) AS fraud_score,
       CAST(4 AS INTEGER) AS rules_run FROM f""")
def q_mapped_fraud_score(spark, sf):
    # a feed without transaction_id: columns mapped by name, then the rules
    df, _ = S.map_generic_columns(table(spark, sf, "events"))
    r = R.run_rules(df)
    return r.df.select("event_id", "user_id", "txn_count_in_window", "flag_amount_anomaly", "flag_temporal_anomaly",
                       "flag_velocity", "flag_category_deviation", "fraud_score",
                       F.lit(r.rules_run).cast("int").alias("rules_run"))


@register("rules_run_report", with_rules("""
SELECT rule, CAST(rule_order AS INTEGER) AS rule_order, ran, flagged FROM (
  SELECT 'amount' AS rule, 1 AS rule_order, TRUE AS ran, sum(flag_amount_anomaly) AS flagged FROM scored
  UNION ALL SELECT 'location', 2, TRUE, sum(flag_location_deviation) FROM scored
  UNION ALL SELECT 'temporal', 3, TRUE, sum(flag_temporal_anomaly) FROM scored
  UNION ALL SELECT 'velocity', 4, TRUE, sum(flag_velocity) FROM scored
  UNION ALL SELECT 'category', 5, TRUE, sum(flag_category_deviation) FROM scored
  UNION ALL SELECT 'geo_speed', 6, TRUE, sum(flag_geo_impossible) FROM scored)"""))
def q_rules_run_report(spark, sf):
    r = R.run_rules(txn(spark, sf))
    return A.rules_run_report(r.df, r.ran)


@register("amount_fallback", """
SELECT s_suppkey AS amount, s_acctbal AS user_id, s_nationkey, s_name FROM supplier""")
def q_amount_fallback(spark, sf):
    # no column is named like an amount: the first number without another role is it
    df, _ = S.map_generic_columns(table(spark, sf, "supplier"))
    return df.select("amount", "user_id", "s_nationkey", "s_name")


@register("global_user_velocity", """
SELECT o_orderdate AS day, count(*) AS n_rows, CAST(count(*) AS INTEGER) AS most_in_window,
       CAST(greatest(count(*) - 5, 0) AS BIGINT) AS n_flagged
FROM orders GROUP BY o_orderdate""")
def q_global_user_velocity(spark, sf):
    # orders name no user: all rows are one user's, and all of a day lie at one time
    df, _ = S.map_generic_columns(table(spark, sf, "orders"))
    out, _ = R.detect_velocity(df)
    return out.groupBy(F.col("timestamp").cast("date").alias("day")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.max("txn_count_in_window").alias("most_in_window"), F.sum("flag_velocity").alias("n_flagged"))


@register("head_sample", "WITH " + TXN_SQL + " SELECT transaction_id, user_id, amount, category FROM txnm ORDER BY transaction_id LIMIT 5")
def q_head_sample(spark, sf):
    return head_sample(txn(spark, sf)).select("transaction_id", "user_id", "amount", "category")


@register("written_results", with_rules("""
SELECT transaction_id, fraud_score, predicted_fraud FROM scored"""))
def q_written(spark, sf):
    # the full result as files by verdict, read again
    path = f"{checkpoint_dir(spark).rstrip('/')}/written-{uuid.uuid4().hex}"
    write_results(scored(spark, sf).select("transaction_id", "fraud_score", "predicted_fraud"), path, partition_by=["predicted_fraud"])
    return spark.read.parquet(path).select("transaction_id", "fraud_score", "predicted_fraud")
