"""DuckDB oracle SQL for the registered queries.

Written independently of the Spark plans where that makes the check
stronger: trailing counts are a self-join (the nested-loop
definition), not the window formula the Spark side uses.
"""

from __future__ import annotations

from ledgerscope.functions.geo import haversine_sql
from ledgerscope.sources.adapters import TXN_SQL

H = 3_600_000_000

RULE_CTES = TXN_SQL + f""",
seq AS (
  SELECT *, epoch_us("timestamp") AS us,
         row_number() OVER (PARTITION BY user_id ORDER BY "timestamp", transaction_id) AS rn
  FROM txnm
),
vel AS (
  SELECT a.transaction_id, count(*) AS cnt
  FROM seq a JOIN seq b ON a.user_id = b.user_id AND b.rn <= a.rn
       AND a.us - b.us <= {H}
  GROUP BY a.transaction_id
),
prev AS (
  SELECT a.transaction_id, b.us AS prev_us, b.lat AS prev_lat, b.lon AS prev_lon
  FROM seq a LEFT JOIN seq b ON a.user_id = b.user_id AND b.rn = a.rn - 1
),
ustats AS (
  SELECT user_id, avg(amount) AS user_mean, stddev_samp(amount) AS user_std, count(*) AS total,
         median(lat) AS center_lat, median(lon) AS center_lon
  FROM txnm GROUP BY user_id
),
hours AS (SELECT user_id, hour("timestamp") AS hour, count(*) AS cnt FROM txnm GROUP BY 1, 2),
cats AS (SELECT user_id, category, count(*) AS cnt FROM txnm GROUP BY 1, 2),
r0 AS (
  SELECT s.*, u.user_mean, u.user_std, u.total, u.center_lat, u.center_lon,
         CAST(hour(s."timestamp") AS INTEGER) AS hour,
         COALESCE(h.cnt / u.total, 0.0) AS hour_pct,
         COALESCE(c.cnt / u.total, 0.0) AS cat_pct,
         CAST(COALESCE(v.cnt, 0) AS INTEGER) AS txn_count_in_window,
         p.prev_us, p.prev_lat, p.prev_lon
  FROM seq s
  LEFT JOIN ustats u ON s.user_id = u.user_id
  LEFT JOIN hours h ON s.user_id = h.user_id AND hour(s."timestamp") = h.hour
  LEFT JOIN cats c ON s.user_id = c.user_id AND s.category = c.category
  LEFT JOIN vel v ON s.transaction_id = v.transaction_id
  LEFT JOIN prev p ON s.transaction_id = p.transaction_id
),
r1 AS (
  SELECT *,
    COALESCE((amount - user_mean) / COALESCE(NULLIF(user_std, 0), 1.0), 0.0) AS amount_z_score,
    CASE WHEN lat IS NULL OR lon IS NULL OR center_lat IS NULL OR center_lon IS NULL THEN 0.0
         ELSE {haversine_sql('lat', 'lon', 'center_lat', 'center_lon')} END AS location_distance_km,
    CASE WHEN prev_us IS NOT NULL AND us > prev_us
         THEN {haversine_sql('prev_lat', 'prev_lon', 'lat', 'lon')} / ((us - prev_us) / 1e6 / 3600.0)
         ELSE 0.0 END AS travel_speed_kmh
  FROM r0
),
rules AS (
  SELECT *,
    CAST(abs(amount_z_score) > 3.0 AS INTEGER) AS flag_amount_anomaly,
    CAST(location_distance_km > 500.0 AS INTEGER) AS flag_location_deviation,
    CAST(hour_pct < 0.05 AS INTEGER) AS flag_temporal_anomaly,
    CAST(txn_count_in_window > 5 AS INTEGER) AS flag_velocity,
    CAST(cat_pct < 0.05 AS INTEGER) AS flag_category_deviation,
    CAST(travel_speed_kmh > 900.0 AS INTEGER) AS flag_geo_impossible
  FROM r1
),
scored AS (
  SELECT *,
    CAST(flag_amount_anomaly + flag_location_deviation + flag_temporal_anomaly + flag_velocity
         + flag_category_deviation + flag_geo_impossible AS INTEGER) AS fraud_score,
    CAST(flag_amount_anomaly + flag_location_deviation + flag_temporal_anomaly + flag_velocity
         + flag_category_deviation + flag_geo_impossible >= 2 AS INTEGER) AS predicted_fraud
  FROM rules
)"""


def with_rules(select: str) -> str:
    return "WITH " + RULE_CTES + "\n" + select
