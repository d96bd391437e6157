"""Registered queries: evaluation and report tables (2.4 A5-A7, 2.6, 2.8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerscope.operators import aggregates as A
from ledgerscope.operators import evaluate as E
from ledgerscope.operators.rules import FLAG_COLS, run_rules
from ledgerscope.plans.common import txn
from ledgerscope.plans.oracle_sql import with_rules

Q: dict = {}
SQL: dict = {}


def register(name, sql=None):
    def deco(fn):
        Q[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def scored(spark, sf):
    df = run_rules(txn(spark, sf)).df
    # the comparison score: |z| rounded, so both engines see identical ties
    return df.withColumn("score", F.round(F.abs("amount_z_score"), 6))


SCORE_SQL = "round(abs(amount_z_score), 6)"


@register("score_distribution", with_rules("SELECT fraud_score, count(*) AS count FROM scored GROUP BY fraud_score"))
def q_score_dist(spark, sf):
    return A.value_counts(scored(spark, sf), "fraud_score")


def _flag_counts_sql():
    parts = [f"SELECT '{f}' AS flag, CAST({v} AS INTEGER) AS value, count(*) FILTER (WHERE {f} = {v}) AS count FROM scored"
             for f in FLAG_COLS for v in (0, 1)]
    return with_rules("\nUNION ALL\n".join(parts))


@register("flag_counts", _flag_counts_sql())
def q_flag_counts(spark, sf):
    return A.flag_counts(scored(spark, sf))


@register("rule_hit_rates", with_rules("\nUNION ALL\n".join(
    f"SELECT '{f}' AS rule, sum({f}) AS flagged, round(sum({f}) * 100.0 / count(*), 6) AS pct FROM scored"
    for f in FLAG_COLS)))
def q_hit_rates(spark, sf):
    return A.rule_hit_rates(scored(spark, sf))


@register("run_summary", with_rules("""
SELECT count(*) AS n_rows, sum(predicted_fraud) AS n_predicted,
       round(avg(predicted_fraud) * 100.0, 6) AS pct_predicted,
       round(avg(fraud_score), 6) AS mean_score, round(CAST(max(fraud_score) AS DOUBLE), 6) AS max_score
FROM scored"""))
def q_run_summary(spark, sf):
    return A.run_summary(scored(spark, sf), "predicted_fraud", "fraud_score")


@register("top_suspicious", with_rules(f"""
SELECT transaction_id, user_id, "timestamp", amount, category, {SCORE_SQL} AS score
FROM scored ORDER BY score DESC, transaction_id LIMIT 20"""))
def q_top(spark, sf):
    return E.top_k(scored(spark, sf), "score", 20,
                   ["transaction_id", "user_id", "timestamp", "amount", "category", "score"])


@register("top_flagged_rules", with_rules("""
SELECT transaction_id, user_id, "timestamp", amount, category, fraud_score, """ + ", ".join(FLAG_COLS) + """
FROM scored WHERE predicted_fraud = 1 ORDER BY fraud_score DESC, transaction_id LIMIT 10"""))
def q_top_flagged(spark, sf):
    df = scored(spark, sf).where("predicted_fraud = 1")
    return E.top_k(df, "fraud_score", 10,
                   ["transaction_id", "user_id", "timestamp", "amount", "category", "fraud_score", *FLAG_COLS])


@register("confusion_matrix", with_rules("""
SELECT CAST(a AS INTEGER) AS actual, CAST(p AS INTEGER) AS predicted,
       (SELECT count(*) FROM scored WHERE is_fraud = a AND predicted_fraud = p) AS count
FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS g(a, p)"""))
def q_confusion(spark, sf):
    return E.confusion_matrix(scored(spark, sf), "is_fraud", "predicted_fraud")


def _report_sql(pred_expr: str, source: str, rule: str | None = None) -> str:
    """Classification report as SQL over (actual=is_fraud, pred)."""
    r = f"'{rule}' AS rule, " if rule else ""
    return f"""
SELECT {r}label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1_score, support FROM (
  SELECT *, 
    CASE WHEN lbl IN ('0', '1') THEN CASE WHEN pr + rc = 0 THEN 0.0 ELSE 2 * pr * rc / (pr + rc) END END AS f1c
  FROM (SELECT 1) AS dummy(x) CROSS JOIN (
    WITH c AS (SELECT
        count(*) FILTER (WHERE is_fraud = 0 AND {pred_expr} = 0) AS tn,
        count(*) FILTER (WHERE is_fraud = 0 AND {pred_expr} = 1) AS fp,
        count(*) FILTER (WHERE is_fraud = 1 AND {pred_expr} = 0) AS fn,
        count(*) FILTER (WHERE is_fraud = 1 AND {pred_expr} = 1) AS tp FROM {source}),
    m AS (SELECT *,
        CASE WHEN tn + fn = 0 THEN 0.0 ELSE tn / (tn + fn) END AS p0, CASE WHEN tn + fp = 0 THEN 0.0 ELSE tn / (tn + fp) END AS r0,
        CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS p1, CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS r1,
        tn + fp AS s0, tp + fn AS s1, tn + fp + fn + tp AS n FROM c),
    f AS (SELECT *, CASE WHEN p0 + r0 = 0 THEN 0.0 ELSE 2 * p0 * r0 / (p0 + r0) END AS f0,
                   CASE WHEN p1 + r1 = 0 THEN 0.0 ELSE 2 * p1 * r1 / (p1 + r1) END AS f1v FROM m)
    SELECT '0' AS lbl, p0 AS pr, r0 AS rc, f0 AS fx, s0 AS sup FROM f
    UNION ALL SELECT '1', p1, r1, f1v, s1 FROM f
    UNION ALL SELECT 'accuracy', NULL, NULL, CASE WHEN n = 0 THEN 0.0 ELSE (tp + tn) / n END, n FROM f
    UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1v) / 2, n FROM f
    UNION ALL SELECT 'weighted avg', CASE WHEN n = 0 THEN 0.0 ELSE (p0 * s0 + p1 * s1) / n END,
                     CASE WHEN n = 0 THEN 0.0 ELSE (r0 * s0 + r1 * s1) / n END,
                     CASE WHEN n = 0 THEN 0.0 ELSE (f0 * s0 + f1v * s1) / n END, n FROM f
  ) AS t
) AS z(x, label, precision, recall, f1, support, f1c)"""


@register("classification_report", with_rules(_report_sql("predicted_fraud", "scored")))
def q_report(spark, sf):
    return E.classification_report(scored(spark, sf), "is_fraud", "predicted_fraud")


@register("per_rule_report", with_rules("\nUNION ALL\n".join(
    _report_sql(f, "scored", rule=f) for f in FLAG_COLS)))
def q_per_rule(spark, sf):
    return E.per_flag_report(scored(spark, sf), "is_fraud", FLAG_COLS)


@register("roc_auc", with_rules(f"""
, s AS (SELECT is_fraud AS y, {SCORE_SQL} AS score FROM scored),
r AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS ar FROM s)
SELECT round(CASE WHEN sum(y) > 0 AND sum(1 - y) > 0
             THEN (sum(ar) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)) END, 6) AS roc_auc,
       sum(y) AS n_pos, sum(1 - y) AS n_neg
FROM r"""))
def q_auc(spark, sf):
    return E.roc_auc(scored(spark, sf), "is_fraud", "score")


@register("roc_curve", with_rules(f"""
, st AS (SELECT {SCORE_SQL} AS score, sum(is_fraud) AS np, sum(1 - is_fraud) AS nn FROM scored GROUP BY 1),
tot AS (SELECT sum(np) AS P, sum(nn) AS N FROM st)
SELECT score AS threshold,
       round(CASE WHEN N = 0 THEN 0.0 ELSE sum(nn) OVER (ORDER BY score DESC) / N END, 6) AS fpr,
       round(CASE WHEN P = 0 THEN 0.0 ELSE sum(np) OVER (ORDER BY score DESC) / P END, 6) AS tpr
FROM st, tot"""))
def q_roc_curve(spark, sf):
    return E.roc_curve(scored(spark, sf), "is_fraud", "score")


@register("score_histogram", with_rules(f"""
, s AS (SELECT predicted_fraud, {SCORE_SQL} AS score FROM scored),
rg AS (SELECT predicted_fraud, CASE WHEN min(score) = max(score) THEN min(score) - 0.5 ELSE min(score) END AS lo,
              CASE WHEN min(score) = max(score) THEN max(score) + 0.5 ELSE max(score) END AS hi
       FROM s GROUP BY 1),
c AS (SELECT s.predicted_fraud, CAST(least(floor((score - lo) / (hi - lo) * 50), 49) AS INTEGER) AS bin, count(*) AS cnt
      FROM s JOIN rg USING (predicted_fraud) GROUP BY 1, 2),
g AS (SELECT predicted_fraud, lo, hi, CAST(b AS INTEGER) AS bin FROM rg, range(50) AS t(b))
SELECT g.predicted_fraud, g.bin, round(lo + bin * (hi - lo) / 50, 6) AS bin_start,
       round(lo + (bin + 1) * (hi - lo) / 50, 6) AS bin_end, COALESCE(cnt, 0) AS count
FROM g LEFT JOIN c USING (predicted_fraud, bin)"""))
def q_hist(spark, sf):
    return E.score_histogram(scored(spark, sf), "score", "predicted_fraud")
