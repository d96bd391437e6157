"""Seeded synthetic card transactions with ~5 % injected anomalies.

Same distributions as the specification (user profiles around five US
cities, anomalies of six kinds), generated in parallel from
``spark.range`` with hash-derived uniforms, so the output does not depend
on partitioning.  It is *not* the same random stream as a NumPy generator.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: city -> (lat, lon)
CITIES = {
    "New York": (40.71, -74.01), "Boston": (42.36, -71.06),
    "Chicago": (41.88, -87.63), "Los Angeles": (34.05, -118.24),
    "Miami": (25.76, -80.19), "Tokyo": (35.68, 139.69),
    "London": (51.51, -0.13), "Paris": (48.86, 2.35),
}
# fixed values: merchant categories (the first five are "usual" ones)
CATEGORIES = ["grocery", "gas_transport", "food_dining", "shopping_net",
              "entertainment", "health_fitness", "electronics", "travel"]
# fixed values: where users live, where fraud is placed, categories and kinds of fraud
US_CITIES = ["New York", "Boston", "Chicago", "Los Angeles", "Miami"]
FOREIGN_CITIES = ["Tokyo", "London", "Paris"]
RARE_CATEGORIES = ["electronics", "travel", "entertainment"]
FRAUD_TYPES = ["amount", "location", "time", "velocity", "category", "geo_impossible"]

_MASK53 = (1 << 53) - 1


def _u(seed: int, stream: int, *cols) -> F.Column:
    """Uniform [0, 1) from a 64-bit hash of (seed, stream, cols)."""
    h = F.xxhash64(F.lit(seed), F.lit(stream), *cols)
    return h.bitwiseAND(F.lit(_MASK53)).cast("double") / float(1 << 53)


def _normal(seed: int, stream: int, *cols) -> F.Column:
    u1 = F.greatest(_u(seed, stream, *cols), F.lit(1e-300))
    u2 = _u(seed, stream + 1, *cols)
    return F.sqrt(-2.0 * F.log(u1)) * F.cos(2 * math.pi * u2)


def _pick(u: F.Column, options: list[str]) -> F.Column:
    arr = F.array(*[F.lit(o) for o in options])
    return F.element_at(arr, (F.floor(u * len(options)) + 1).cast("int"))


def synthetic_transactions(spark: SparkSession, n_users: int = 50, n_transactions: int = 5000,
                           seed: int = 42, num_partitions: int | None = None) -> DataFrame:
    uid = F.col("id")
    city = _pick(_u(seed, 1, uid), US_CITIES)
    lat_map = F.create_map(*[x for c in US_CITIES for x in (F.lit(c), F.lit(CITIES[c][0]))])
    lon_map = F.create_map(*[x for c in US_CITIES for x in (F.lit(c), F.lit(CITIES[c][1]))])
    # three distinct usual categories out of the first five: a random start
    # and a step of 1 or 2 (coprime with 5) give three different ones
    first5 = F.array(*[F.lit(c) for c in CATEGORIES[:5]])
    profiles = (spark.range(n_users)
                .select(uid.alias("user_id"), city.alias("home"))
                .select("user_id",
                        lat_map[F.col("home")].alias("home_lat"),
                        lon_map[F.col("home")].alias("home_lon"),
                        (20 + 180 * _u(seed, 5, F.col("user_id"))).alias("avg_amount"),
                        (10 + 40 * _u(seed, 6, F.col("user_id"))).alias("std_amount"),
                        F.array(*[F.element_at(first5, F.pmod(
                            F.floor(_u(seed, 3, F.col("user_id")) * 5).cast("int")
                            + (F.floor(_u(seed, 4, F.col("user_id")) * 2) + 1).cast("int") * k,
                            F.lit(5)) + 1) for k in range(3)]).alias("usual"),
                        (7 + F.floor(_u(seed, 7, F.col("user_id")) * 3)).cast("int").alias("active_start"),
                        (18 + F.floor(_u(seed, 8, F.col("user_id")) * 4)).cast("int").alias("active_end")))
    i = F.col("id")
    tx = spark.range(0, n_transactions, numPartitions=num_partitions).select(
        i.alias("i"),
        F.floor(_u(seed, 10, i) * n_users).cast("long").alias("user_id"),
        (_u(seed, 11, i) < 0.05).alias("fraud"),
        _pick(_u(seed, 12, i), FRAUD_TYPES).alias("ftype"),
    )
    j = tx.join(profiles, "user_id")
    i = F.col("i")
    fraud, ftype = F.col("fraud"), F.col("ftype")
    normal_amt = F.col("avg_amount") + F.col("std_amount") * _normal(seed, 20, i)
    big_amt = F.col("avg_amount") + F.col("std_amount") * (4 + 16 * _u(seed, 22, i))
    amount = F.when(fraud & (ftype == "amount"), big_amt).otherwise(normal_amt)
    foreign = fraud & ftype.isin("location", "geo_impossible")
    fcity = _pick(_u(seed, 23, i), FOREIGN_CITIES)
    flat = F.create_map(*[x for c in FOREIGN_CITIES for x in (F.lit(c), F.lit(CITIES[c][0]))])[fcity]
    flon = F.create_map(*[x for c in FOREIGN_CITIES for x in (F.lit(c), F.lit(CITIES[c][1]))])[fcity]
    lat = F.when(foreign, flat + 0.1 * _normal(seed, 24, i)).otherwise(F.col("home_lat") + 0.5 * _normal(seed, 26, i))
    lon = F.when(foreign, flon + 0.1 * _normal(seed, 28, i)).otherwise(F.col("home_lon") + 0.5 * _normal(seed, 30, i))
    span = F.col("active_end") - F.col("active_start")
    hour = F.when(fraud & (ftype == "time"), 1 + F.floor(_u(seed, 32, i) * 4)).otherwise(
        F.col("active_start") + F.floor(_u(seed, 33, i) * span)).cast("int")
    category = F.when(fraud & (ftype == "category"), _pick(_u(seed, 34, i), RARE_CATEGORIES)).otherwise(
        F.element_at(F.col("usual"), (F.floor(_u(seed, 35, i) * 3) + 1).cast("int")))
    minute = F.floor(_u(seed, 36, i) * 60).cast("int")
    ts = F.timestamp_micros(
        F.lit(1_704_067_200_000_000) + F.floor(i / 20) * F.lit(86_400_000_000)
        + hour.cast("long") * F.lit(3_600_000_000) + minute.cast("long") * F.lit(60_000_000)).cast("timestamp_ntz")
    out = j.select(
        F.format_string("TXN_%06d", i).alias("transaction_id"),
        F.col("user_id").cast("int").alias("user_id"),
        ts.alias("trans_date_trans_time"),
        F.round(F.greatest(F.lit(1.0), amount), 2).alias("amt"),
        F.round(lat, 4).alias("lat"), F.round(lon, 4).alias("long"),
        category.alias("category"),
        fraud.cast("int").alias("is_fraud"),
        i.alias("_i"),
    )
    out = out.withColumns({
        "merch_lat": F.round(F.col("lat") + 0.05 * _normal(seed, 40, F.col("_i")), 4),
        "merch_long": F.round(F.col("long") + 0.05 * _normal(seed, 42, F.col("_i")), 4),
    })
    return out.select("transaction_id", "user_id", "trans_date_trans_time", "amt", "lat", "long",
                      "merch_lat", "merch_long", "category", "is_fraud")
