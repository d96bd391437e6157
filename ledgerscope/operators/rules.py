"""Six explainable per-user rules, the composite score and the
skip protocol.

Every rule is a function ``df -> (df + columns, ran)``; ``ran`` is decided
from the schema alone (a missing or non-timestamp column skips the rule and
adds zero columns).  ``run_rules`` builds all six in one plan: one packed row
per user, one bucketed window stage for velocity and travel speed, and one
join of both to the rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerscope.functions.geo import haversine_km
from ledgerscope.functions.guards import flag, safe_std
from ledgerscope.functions.temporal import hour_of
from ledgerscope.operators.quantiles import RANGE_TARGET
from ledgerscope.operators.sequence import TrailingCount, busiest, user_sequence
from ledgerscope.operators.user_stats import (
    few_categories, share_lookup, user_amount_stats, user_category_share, user_centers, user_hour_share, user_profile)

# fixed values: flag columns in rule order
FLAG_COLS = ["flag_amount_anomaly", "flag_location_deviation", "flag_temporal_anomaly",
             "flag_velocity", "flag_category_deviation", "flag_geo_impossible"]
RULE_NAMES = ["amount", "location", "temporal", "velocity", "category", "geo_speed"]

# fixed values: default thresholds
Z_THRESHOLD = 3.0
DISTANCE_KM = 500.0
HOUR_SHARE = 0.05
WINDOW_MINUTES = 60
MAX_TXN = 5
CATEGORY_SHARE = 0.05
MAX_SPEED_KMH = 900.0


@dataclass
class RuleResult:
    df: DataFrame
    ran: dict = field(default_factory=dict)

    @property
    def rules_run(self) -> int:
        return sum(bool(v) for v in self.ran.values())


def _is_ts(df: DataFrame, c: str) -> bool:
    return c in df.columns and isinstance(df.schema[c].dataType, (T.TimestampType, T.TimestampNTZType))


def _has(df: DataFrame, *cols: str) -> bool:
    return all(c in df.columns for c in cols)


def can_run(df: DataFrame) -> dict:
    return {
        "amount": _has(df, "amount", "user_id"),
        "location": _has(df, "lat", "lon", "user_id"),
        "temporal": _has(df, "user_id") and _is_ts(df, "timestamp"),
        "velocity": _has(df, "user_id") and _is_ts(df, "timestamp"),
        "category": _has(df, "category", "user_id"),
        "geo_speed": _has(df, "lat", "lon", "user_id") and _is_ts(df, "timestamp"),
    }


# ---- column expressions shared by single rules and the combined plan ----

def _z_expr(z_threshold):
    z = F.coalesce((F.col("amount") - F.col("user_mean")) / safe_std(F.col("user_std")), F.lit(0.0))
    return z, flag(F.abs(F.col("amount_z_score")) > F.lit(z_threshold))


def _km_expr():
    anynull = (F.col("lat").isNull() | F.col("lon").isNull()
               | F.col("center_lat").isNull() | F.col("center_lon").isNull())
    return F.when(anynull, F.lit(0.0)).otherwise(haversine_km("lat", "lon", "center_lat", "center_lon"))


def _speed_expr():
    dt_h = (F.col("_us") - F.col("_prev_us")) / F.lit(1e6) / F.lit(3600.0)
    ok = (F.col("_prev_us").isNotNull() & (F.col("_us") > F.col("_prev_us"))
          & F.col("lat").isNotNull() & F.col("lon").isNotNull()
          & F.col("_prev_lat").isNotNull() & F.col("_prev_lon").isNotNull())
    dist = haversine_km("_prev_lat", "_prev_lon", "lat", "lon")
    return F.when(ok, dist / dt_h).otherwise(F.lit(0.0))


def _zero(df: DataFrame, cols: dict) -> DataFrame:
    return df.withColumns({k: F.lit(v) for k, v in cols.items()})


# ---- single rules --------------------------------------------------------

def detect_amount_anomaly(df: DataFrame, z_threshold: float = Z_THRESHOLD) -> tuple[DataFrame, bool]:
    """|amount z-score within the user| > threshold."""
    if not can_run(df)["amount"]:
        return _zero(df, {"amount_z_score": 0.0, "flag_amount_anomaly": 0}), False
    st = user_amount_stats(df).select("user_id", "user_mean", "user_std")
    j = df.join(st, "user_id", "left")
    z, fl = _z_expr(z_threshold)
    return j.withColumn("amount_z_score", z).withColumn("flag_amount_anomaly", fl).drop(
        "user_mean", "user_std"), True


def detect_location_deviation(df: DataFrame, distance_threshold_km: float = DISTANCE_KM):
    """R2: km from the user's median point > threshold (0 if any coordinate
    is missing)."""
    if not can_run(df)["location"]:
        return _zero(df, {"location_distance_km": 0.0, "flag_location_deviation": 0}), False
    j = df.join(user_centers(df), "user_id", "left")
    return (j.withColumn("location_distance_km", _km_expr())
             .withColumn("flag_location_deviation",
                         flag(F.col("location_distance_km") > F.lit(distance_threshold_km)))
             .drop("center_lat", "center_lon")), True


def detect_temporal_anomaly(df: DataFrame, unusual_pct_threshold: float = HOUR_SHARE):
    """The share of the user's rows in this hour of day < threshold."""
    if not can_run(df)["temporal"]:
        return _zero(df, {"hour": 0, "hour_pct": 0.0, "flag_temporal_anomaly": 0}), False
    share = user_hour_share(df)
    j = share_lookup(df.withColumn("hour", hour_of("timestamp")), share, "hour", "hour_pct")
    return j.withColumn("flag_temporal_anomaly", flag(F.col("hour_pct") < F.lit(unusual_pct_threshold))), True


def detect_velocity(df: DataFrame, window_minutes: int = WINDOW_MINUTES, max_transactions: int = MAX_TXN,
                    lookback_rows: int | None = None):
    """Rows in the trailing window (inclusive, own row included) >
    max_transactions.  ``lookback_rows`` stops the count at so many earlier
    rows; the default counts all."""
    if not can_run(df)["velocity"]:
        return _zero(df, {"txn_count_in_window": 0, "flag_velocity": 0}), False
    cap = None if lookback_rows is None else lookback_rows + 1
    s = user_sequence(df, counts=(TrailingCount("txn_count_in_window", window_minutes * 60_000_000, cap),))
    return s.withColumn("flag_velocity", flag(F.col("txn_count_in_window") > F.lit(max_transactions))).drop("_us"), True


def detect_category_deviation(df: DataFrame, rare_threshold: float = CATEGORY_SHARE):
    """The share of the user's rows in this category < threshold."""
    if not can_run(df)["category"]:
        return _zero(df, {"cat_pct": 0.0, "flag_category_deviation": 0}), False
    j = share_lookup(df, user_category_share(df), "category", "cat_pct")
    return j.withColumn("flag_category_deviation", flag(F.col("cat_pct") < F.lit(rare_threshold))), True


def detect_geographic_impossibility(df: DataFrame, max_speed_kmh: float = MAX_SPEED_KMH):
    """km/h from the user's previous transaction > max (0 for the first
    row, equal times or missing coordinates)."""
    if not can_run(df)["geo_speed"]:
        return _zero(df, {"travel_speed_kmh": 0.0, "flag_geo_impossible": 0}), False
    s = user_sequence(df, previous=("lat", "lon"))
    return (s.withColumn("travel_speed_kmh", _speed_expr())
             .withColumn("flag_geo_impossible", flag(F.col("travel_speed_kmh") > F.lit(max_speed_kmh)))
             .drop("_us", "_prev_us", "_prev_lat", "_prev_lon")), True


# ---- composite -----------------------------------------------------------

def dynamic_threshold(rules_run: int) -> int | None:
    """2 votes if at least three rules ran, 1 if one or two, none if 0."""
    if rules_run == 0:
        return None
    return 2 if rules_run >= 3 else 1


def composite_score(df: DataFrame, threshold: int | None = 2) -> DataFrame:
    """``fraud_score`` = sum of the flag columns present;
    ``predicted_fraud`` = score >= threshold (all 0 if threshold is None)."""
    present = [c for c in FLAG_COLS if c in df.columns]
    score = sum((F.col(c) for c in present), F.lit(0)) if present else F.lit(0)
    pred = F.lit(0) if threshold is None else (F.col("fraud_score") >= F.lit(threshold)).cast("int")
    return df.withColumn("fraud_score", score.cast("int")).withColumn("predicted_fraud", pred)


def run_rules(df: DataFrame, *, z_threshold: float = Z_THRESHOLD, distance_threshold_km: float = DISTANCE_KM,
              unusual_pct_threshold: float = HOUR_SHARE, window_minutes: int = WINDOW_MINUTES,
              max_transactions: int = MAX_TXN, lookback_rows: int | None = None,
              rare_threshold: float = CATEGORY_SHARE, max_speed_kmh: float = MAX_SPEED_KMH,
              threshold: int | str | None = "dynamic") -> RuleResult:
    """All six rules and the score in one logical plan.

    Plan shape: one packed row per user (mean, std, total, medians, hour and
    category counts) is attached to the table of ``(user, day)`` buckets that
    the sequence rules need anyway, and this table is joined to the rows, which
    move once.  Small jobs while this is called ask for the sizes on which
    the plan depends: rows of the table, of the busiest user and day, number of categories."""
    ran = can_run(df)
    cols = df.columns
    out = df
    if ran["temporal"]:
        out = out.withColumn("hour", hour_of("timestamp"))

    counts, previous = (), ()
    if ran["velocity"]:
        cap = None if lookback_rows is None else lookback_rows + 1
        counts = (TrailingCount("txn_count_in_window", window_minutes * 60_000_000, cap),)
    if ran["geo_speed"]:
        previous = ("lat", "lon")
    if counts:
        most_rows, fullest, n_rows = busiest(df)
    else:
        most_rows, fullest, n_rows = None, None, None

    # a user of very many rows has its medians selected by passes, not in one buffer
    medians = {"center_lat": "lat", "center_lon": "lon"} if ran["location"] else {}
    by_passes = medians and (most_rows is None or most_rows > RANGE_TARGET)
    mapped = ran["category"] and few_categories(df)
    per_user = None
    if any(ran[r] for r in ("amount", "location", "temporal", "category")):
        per_user = user_profile(out, amount="amount" if ran["amount"] else None, medians={} if by_passes else medians,
                                hour="hour" if ran["temporal"] else None, category="category" if mapped else None)
    if by_passes:
        per_user = per_user.join(user_centers(df), "user_id", "left")
    if counts or previous:
        out = user_sequence(out, counts=counts, previous=previous, per_user=per_user, fullest=fullest, n_rows=n_rows)
    elif per_user is not None:
        out = out.join(per_user, "user_id", "left")

    new = {}
    if ran["amount"]:
        z, fl = _z_expr(z_threshold)
        out = out.withColumn("amount_z_score", z)
        new["flag_amount_anomaly"] = fl
    if ran["location"]:
        out = out.withColumn("location_distance_km", _km_expr())
        new["flag_location_deviation"] = flag(F.col("location_distance_km") > F.lit(distance_threshold_km))
    if ran["temporal"]:
        cnt = F.get("_hour_counts", F.col("hour"))
        pct = F.when(F.col("user_id").isNull() | F.col("hour").isNull(), F.lit(0.0)).otherwise(
            F.coalesce(cnt / F.col("_total"), F.lit(0.0)))
        out = out.withColumn("hour_pct", pct)
        new["flag_temporal_anomaly"] = flag(F.col("hour_pct") < F.lit(unusual_pct_threshold))
    if ran["velocity"]:
        new["flag_velocity"] = flag(F.col("txn_count_in_window") > F.lit(max_transactions))
    if ran["category"]:
        if mapped:
            out = out.withColumn("_ccnt", F.try_element_at("_category_counts", F.col("category")))
        else:
            share = user_category_share(df).select("user_id", "category", F.col("cat_pct_count").alias("_ccnt"))
            out = out.join(share, ["user_id", "category"], "left")
        pct = F.when(F.col("user_id").isNull() | F.col("category").isNull(), F.lit(0.0)).otherwise(
            F.coalesce(F.col("_ccnt") / F.col("_total"), F.lit(0.0)))
        out = out.withColumn("cat_pct", pct)
        new["flag_category_deviation"] = flag(F.col("cat_pct") < F.lit(rare_threshold))
    if ran["geo_speed"]:
        out = out.withColumn("travel_speed_kmh", _speed_expr())
        new["flag_geo_impossible"] = flag(F.col("travel_speed_kmh") > F.lit(max_speed_kmh))
    out = out.withColumns(new)

    zero_cols = {
        "amount": {"amount_z_score": 0.0, "flag_amount_anomaly": 0},
        "location": {"location_distance_km": 0.0, "flag_location_deviation": 0},
        "temporal": {"hour": 0, "hour_pct": 0.0, "flag_temporal_anomaly": 0},
        "velocity": {"txn_count_in_window": 0, "flag_velocity": 0},
        "category": {"cat_pct": 0.0, "flag_category_deviation": 0},
        "geo_speed": {"travel_speed_kmh": 0.0, "flag_geo_impossible": 0},
    }
    for rule, ok in ran.items():
        if not ok:
            out = _zero(out, zero_cols[rule])
    result_cols = ["amount_z_score", "flag_amount_anomaly", "location_distance_km", "flag_location_deviation",
                   "hour", "hour_pct", "flag_temporal_anomaly", "txn_count_in_window", "flag_velocity",
                   "cat_pct", "flag_category_deviation", "travel_speed_kmh", "flag_geo_impossible"]
    out = out.select(*[c for c in cols if c not in result_cols], *result_cols)
    n_ran = sum(ran.values())
    thr = dynamic_threshold(n_ran) if threshold == "dynamic" else threshold
    if n_ran == 0:
        thr = None
    return RuleResult(composite_score(out, thr), ran)
