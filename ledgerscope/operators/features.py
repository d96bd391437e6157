"""The twelve model features in one plan.

Shape: one bucketed window stage on ``(user, day)`` (seconds since the
previous row, trailing one-hour count on whole seconds), to whose table of buckets
one packed row per user (mean, sample std, exact medians of amount / lat / lon)
is attached, and the category dictionary.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope.functions.geo import haversine_km
from ledgerscope.functions.guards import safe_ratio_denominator, safe_std
from ledgerscope.functions.temporal import day_of_week, hour_of, is_night, is_weekend
from ledgerscope.operators.quantiles import RANGE_TARGET, grouped_quantiles
from ledgerscope.operators.sequence import TrailingCount, busiest, user_sequence
from ledgerscope.operators.user_stats import user_profile
from ledgerscope.session import checkpoint_dir

# fixed values: model feature columns, in order
FEATURE_COLS = [
    "amount", "amount_z_score", "amount_to_median",
    "hour", "day_of_week", "is_weekend", "is_night",
    "location_distance_km", "merch_distance_km",
    "time_since_last_txn", "txn_count_1h",
    "category_encoded",
]

FEATURE_WINDOW_SECONDS = 3600


def category_codes(df: DataFrame, col: str = "category") -> DataFrame:
    """code = position of the value among the sorted distinct values
    (the column keeps its type).

    The distinct values are range-partitioned, sorted within partitions and
    checkpointed (eager: the ranges must not be drawn again); a value's code is
    its place in its partition plus the sizes of the partitions before, so only
    one number per partition meets in one task."""
    checkpoint_dir(df.sparkSession)
    d = (df.select(col).where(F.col(col).isNotNull()).distinct().repartitionByRange(col).sortWithinPartitions(col)
         .withColumn("_m", F.monotonically_increasing_id()).checkpoint(eager=True)
         .select(col, F.shiftright("_m", 33).alias("_p"), F.col("_m").bitwiseAND((1 << 33) - 1).alias("_i")))
    earlier = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = d.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("_p", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    return d.join(starts, "_p").select(col, (F.col("_start") + F.col("_i")).cast("int").alias("category_encoded"))


#: codes up to which the dictionary is sent to all tasks
BROADCAST_CODES = 100_000


def encode_category(df: DataFrame, col: str = "category") -> DataFrame:
    codes = category_codes(df, col)
    if codes.count() <= BROADCAST_CODES:  # else the codes are joined by a shuffle
        codes = F.broadcast(codes)
    return df.join(codes, col, "left").withColumn(
        "category_encoded", F.coalesce(F.col("category_encoded"), F.lit(-1)))


def engineer_features(df: DataFrame, window_seconds: int = FEATURE_WINDOW_SECONDS,
                      lookback_rows: int | None = None, wanted: list[str] | None = None) -> DataFrame:
    """Input columns plus the twelve features (absent inputs give the
    documented constants: hour etc. 0, time gap -1, count 1, z 0, ratio 1,
    distances 0, code 0).  ``wanted``: only these features, and only the work
    that they need."""
    cols = set(df.columns)
    given = df.columns
    wanted = list(wanted or FEATURE_COLS)
    want = lambda *names: any(n in wanted for n in names)
    has_ts = "timestamp" in cols
    has_user = "user_id" in cols
    out = df
    calendar = {"hour": hour_of, "day_of_week": day_of_week, "is_weekend": is_weekend, "is_night": is_night}
    out = out.withColumns({n: f("timestamp") if has_ts else F.lit(0) for n, f in calendar.items()})

    has_amt = "amount" in cols and has_user
    has_loc = {"lat", "lon"} <= cols and has_user
    sequence = has_ts and has_user and want("time_since_last_txn", "txn_count_1h")
    most_rows, fullest, n_rows = busiest(df) if sequence else (None, None, None)
    medians = {}
    if has_amt and want("amount_to_median"):
        medians["amount_median"] = "amount"
    if has_loc and want("location_distance_km"):
        medians |= {"lat_median": "lat", "lon_median": "lon"}
    spread = has_amt and want("amount_z_score")
    per_user = None
    if medians and (most_rows is None or most_rows > RANGE_TARGET):  # selected by passes where a user has very many rows
        per_user = grouped_quantiles(df, ["user_id"], list(medians.values()), 0.5, suffix="_median")
        medians = {}
    if medians or spread:
        one = user_profile(df, amount="amount" if spread else None, medians=medians, amount_name="_amount")
        per_user = one if per_user is None else one.join(per_user, "user_id", "left")

    if sequence:
        cap = None if lookback_rows is None else lookback_rows + 1
        counts = (TrailingCount("txn_count_1h", window_seconds * 1_000_000, cap, True),) if want("txn_count_1h") else ()
        previous = ("timestamp",) if want("time_since_last_txn") else ()
        out = user_sequence(out, counts=counts, previous=previous, per_user=per_user, fullest=fullest, n_rows=n_rows)
        if previous:
            gap = (F.col("_us") - F.col("_prev_us")) / F.lit(1e6)
            out = out.withColumn("time_since_last_txn", F.coalesce(gap, F.lit(-1.0)))
    elif per_user is not None:
        out = out.join(per_user, "user_id", "left")
    if "time_since_last_txn" not in out.columns:
        out = out.withColumn("time_since_last_txn", F.lit(-1.0))
    if "txn_count_1h" not in out.columns:
        out = out.withColumn("txn_count_1h", F.lit(1))

    if spread:
        out = out.withColumn("amount_z_score", (F.col("amount") - F.col("_amount_mean")) / safe_std(F.col("_amount_std")))
    else:
        out = out.withColumn("amount_z_score", F.lit(0.0))
    if has_amt and want("amount_to_median"):
        out = out.withColumn("amount_to_median", F.col("amount") / safe_ratio_denominator(F.col("amount_median")))
    else:
        out = out.withColumn("amount_to_median", F.lit(1.0))
    if has_loc and want("location_distance_km"):
        anynull = (F.col("lat").isNull() | F.col("lon").isNull()
                   | F.col("lat_median").isNull() | F.col("lon_median").isNull())
        out = out.withColumn("location_distance_km", F.when(anynull, F.lit(0.0)).otherwise(
            haversine_km("lat", "lon", "lat_median", "lon_median")))
    else:
        out = out.withColumn("location_distance_km", F.lit(0.0))
    if {"lat", "lon", "merch_lat", "merch_lon"} <= cols:
        anynull = (F.col("lat").isNull() | F.col("lon").isNull()
                   | F.col("merch_lat").isNull() | F.col("merch_lon").isNull())
        out = out.withColumn("merch_distance_km", F.when(anynull, F.lit(0.0)).otherwise(
            haversine_km("lat", "lon", "merch_lat", "merch_lon")))
    else:
        out = out.withColumn("merch_distance_km", F.lit(0.0))
    if "category" in cols and want("category_encoded"):
        out = encode_category(out)
    else:
        out = out.withColumn("category_encoded", F.lit(0))
    return out.select(*[c for c in given if c not in FEATURE_COLS or c == "amount"], *[c for c in wanted if c != "amount"])


def feature_matrix(df: DataFrame, features: list[str] | None = None, output: str = "features") -> DataFrame:
    """Available features, NULL -> 0, assembled into one vector."""
    from pyspark.ml.feature import VectorAssembler
    feats = [c for c in (features or FEATURE_COLS) if c in df.columns]
    filled = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in feats})
    return VectorAssembler(inputCols=feats, outputCol=output, handleInvalid="keep").transform(filled)
