"""Shared plumbing for registered queries: table loading and the
rounding convention used when comparing engines (z 6, km 4, km/h 3,
shares 6 decimals; flags are taken from the unrounded values)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope.sources.adapters import load_txn

ROUND = {"amount_z_score": 6, "location_distance_km": 4, "travel_speed_kmh": 3,
         "hour_pct": 6, "cat_pct": 6, "merch_distance_km": 4, "amount_to_median": 6,
         "time_since_last_txn": 6}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def txn(spark: SparkSession, sf_dir: str, with_merchant: bool = True) -> DataFrame:
    return load_txn(spark, sf_dir, with_merchant)


def rounded(df: DataFrame, extra: dict | None = None) -> DataFrame:
    spec = dict(ROUND, **(extra or {}))
    return df.withColumns({c: F.round(F.col(c), d) for c, d in spec.items() if c in df.columns})


def sql_round(col: str, digits: int | None = None, alias: str | None = None) -> str:
    d = ROUND.get(col, 6) if digits is None else digits
    return f"round({col}, {d}) AS {alias or col}"
