"""Adapter from the driver's ``events`` table to the canonical transaction
schema.  Integer arithmetic only, so Spark and DuckDB build identical rows:
bursts (every 10th user) for the velocity rule, night rows for the
temporal rule, a far-away city for the location / speed rules, a rare
category, and a label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope.functions.temporal import epoch_micros, from_epoch_micros

# fixed values: one hour / one day in microseconds
HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US

# fixed values: the planted far-away point (Tokyo)
FAR_LAT, FAR_LON = 35.68, 139.69


def txn_from_events(events: DataFrame, with_merchant: bool = True) -> DataFrame:
    """Canonical transactions derived from ``events`` (one projection)."""
    eid, uid = F.col("event_id"), F.col("user_id")
    us = epoch_micros("ts")
    day = us - F.pmod(us, F.lit(DAY_US))
    offset = (F.when(F.pmod(uid, F.lit(10)) == 0, F.lit(12 * HOUR_US) + F.pmod(us, F.lit(HOUR_US)))
               .when(F.pmod(eid, F.lit(29)) == 0, F.pmod(us, F.lit(5 * HOUR_US)))
               .otherwise(F.lit(9 * HOUR_US) + F.pmod(us, F.lit(9 * HOUR_US))))
    far = F.pmod(eid, F.lit(53)) == 0
    lat = F.when(far, F.lit(FAR_LAT)).otherwise(
        F.lit(30) + F.pmod(uid * 7, F.lit(20)) + F.pmod(eid * 13, F.lit(100)) / F.lit(100.0))
    lon = F.when(far, F.lit(FAR_LON)).otherwise(
        F.lit(-120) + F.pmod(uid * 11, F.lit(50)) + F.pmod(eid * 17, F.lit(100)) / F.lit(100.0))
    cols = [
        eid.alias("transaction_id"),
        uid.alias("user_id"),
        from_epoch_micros(day + offset).alias("timestamp"),
        F.col("value").alias("amount"),
        F.when(F.pmod(eid, F.lit(41)) == 0, F.lit("travel")).otherwise(F.col("event_type")).alias("category"),
        lat.alias("lat"),
        lon.alias("lon"),
        F.when(far | (F.col("value") > 200), F.lit(1)).otherwise(F.lit(0)).alias("is_fraud"),
    ]
    out = events.select(*cols)
    if with_merchant:
        out = out.withColumns({
            "merch_lat": F.col("lat") + (F.pmod(F.col("transaction_id") * 19, F.lit(11)) - 5) / F.lit(100.0),
            "merch_lon": F.col("lon") + (F.pmod(F.col("transaction_id") * 23, F.lit(11)) - 5) / F.lit(100.0),
        })
    return out


def load_txn(spark: SparkSession, sf_dir: str, with_merchant: bool = True) -> DataFrame:
    return txn_from_events(spark.read.parquet(f"{sf_dir}/events.parquet"), with_merchant)


# The same adapter as DuckDB SQL text (the correctness oracle).
TXN_SQL = f"""
txn AS (
  SELECT
    event_id AS transaction_id,
    user_id,
    make_timestamp((epoch_us(ts) - epoch_us(ts) % {DAY_US}) +
      CASE WHEN user_id % 10 = 0 THEN {12 * HOUR_US} + epoch_us(ts) % {HOUR_US}
           WHEN event_id % 29 = 0 THEN epoch_us(ts) % {5 * HOUR_US}
           ELSE {9 * HOUR_US} + epoch_us(ts) % {9 * HOUR_US} END) AS "timestamp",
    value AS amount,
    CASE WHEN event_id % 41 = 0 THEN 'travel' ELSE event_type END AS category,
    CASE WHEN event_id % 53 = 0 THEN CAST({FAR_LAT} AS DOUBLE)
         ELSE 30 + (user_id * 7 % 20) + (event_id * 13 % 100) / 100.0 END AS lat,
    CASE WHEN event_id % 53 = 0 THEN CAST({FAR_LON} AS DOUBLE)
         ELSE -120 + (user_id * 11 % 50) + (event_id * 17 % 100) / 100.0 END AS lon,
    CASE WHEN event_id % 53 = 0 OR value > 200 THEN 1 ELSE 0 END AS is_fraud
  FROM events
),
txnm AS (
  SELECT *, lat + ((transaction_id * 19 % 11) - 5) / 100.0 AS merch_lat,
            lon + ((transaction_id * 23 % 11) - 5) / 100.0 AS merch_lon
  FROM txn
)"""
