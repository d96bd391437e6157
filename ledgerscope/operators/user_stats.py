"""A1-A4 and the left joins J1-J5: per-user statistics as small,
partially aggregated tables joined back by key.

Every table here is an aggregate (one row per user, per (user, hour) or per
(user, category)), so a hot user costs one row, not one task.  Joins are
plain equi-joins: AQE turns them into broadcasts only after measuring the
aggregate at runtime below ``spark.sql.adaptive.autoBroadcastJoinThreshold``;
above that they stay shuffle joins (with AQE skew splitting).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.functions.temporal import hour_of
from ledgerscope.operators.quantiles import grouped_quantiles


def user_amount_stats(df: DataFrame, user: str = "user_id", amount: str = "amount",
                      with_median: bool = False) -> DataFrame:
    """A1: mean, sample std (NULL for one row) and optionally exact median."""
    st = df.groupBy(user).agg(F.avg(amount).alias("user_mean"),
                              F.stddev_samp(amount).alias("user_std"),
                              F.count(F.lit(1)).alias("user_txn_count"))
    if with_median:
        med = grouped_quantiles(df, [user], [amount], 0.5, suffix="_median").withColumnRenamed(
            f"{amount}_median", "user_median")
        st = st.join(med, user, "left")
    return st


def user_centers(df: DataFrame, user: str = "user_id", lat: str = "lat", lon: str = "lon") -> DataFrame:
    """A2: exact per-user median latitude and longitude."""
    q = grouped_quantiles(df, [user], [lat, lon], 0.5)
    return q.select(user, F.col(lat).alias("center_lat"), F.col(lon).alias("center_lon"))


def user_share(df: DataFrame, key: str, user: str = "user_id", name: str = "pct") -> DataFrame:
    """A3/A4: per (user, key) row count over the user's total row count
    (the total includes rows whose key is NULL)."""
    totals = df.groupBy(user).agg(F.count(F.lit(1)).alias("_total"))
    counts = df.where(F.col(key).isNotNull()).groupBy(user, key).agg(F.count(F.lit(1)).alias("_cnt"))
    return (counts.join(totals, user)
            .select(user, key, F.col("_cnt").alias(f"{name}_count"), F.col("_total").alias("total_count"),
                    (F.col("_cnt") / F.col("_total")).alias(name)))


def user_hour_share(df: DataFrame, user: str = "user_id", ts: str = "timestamp") -> DataFrame:
    return user_share(df.withColumn("hour", hour_of(ts)), "hour", user, "hour_pct")


def user_category_share(df: DataFrame, user: str = "user_id", category: str = "category") -> DataFrame:
    return user_share(df, category, user, "cat_pct")


def share_lookup(df: DataFrame, share: DataFrame, key: str, name: str, user: str = "user_id") -> DataFrame:
    """Left join of rows to a share table; a NULL user or key, or a pair
    not seen, gets share 0."""
    j = df.join(share.select(user, key, F.col(name).alias("_share")), [user, key], "left")
    val = F.when(F.col(user).isNull() | F.col(key).isNull(), F.lit(0.0)).otherwise(
        F.coalesce(F.col("_share"), F.lit(0.0)))
    return j.withColumn(name, val).drop("_share")


#: distinct categories up to which a user's counts travel as one map
MAP_CATEGORIES = 1_024


def few_categories(df: DataFrame, category: str = "category", limit: int = MAP_CATEGORIES) -> bool:
    """Whether the table has at most ``limit`` categories (a small job)."""
    return df.select(category).distinct().limit(limit + 1).count() <= limit


def user_profile(df: DataFrame, user: str = "user_id", amount: str | None = None, medians: dict | None = None,
                 hour: str | None = None, category: str | None = None, amount_name: str = "user") -> DataFrame:
    """One row per user from one scan and two small exchanges.

    ``_total``; ``<amount_name>_mean``, ``<amount_name>_std`` of ``amount``; the exact
    median of each column of ``medians`` {name: column}; ``_hour_counts``, 24
    counts; ``_category_counts``, a map (categories must be few, see
    ``few_categories``).  Every row is counted for its user and, if a category
    is given, for its (user, category); a user's lines are then put side by side."""
    hours = [F.sum(F.when(F.col("_whole") & (F.col(hour) == h), 1).otherwise(0)).alias(f"_h{h}") for h in range(24)] if hour else []
    whole = lambda c: F.when(F.col("_whole"), F.col(c).cast("double"))
    aggs = [F.count(F.lit(1)).alias("_total"), *hours]
    if amount:
        aggs += [F.avg(whole(amount)).alias(f"{amount_name}_mean"), F.stddev_samp(whole(amount)).alias(f"{amount_name}_std")]
    aggs += [F.percentile(whole(c), F.lit(0.5)).alias(n) for n, c in (medians or {}).items()]
    rows = df.select(*dict.fromkeys([user, *[c for c in (amount, hour, category) if c], *(medians or {}).values()]))
    if category:
        line = lambda w, c: F.struct(F.lit(w).alias("whole"), c.alias("category"))
        nothing = F.lit(None).cast(df.schema[category].dataType)
        rows = (rows.withColumn("_line", F.explode(F.array(line(True, nothing), line(False, F.col(category)))))
                .withColumn("_whole", F.col("_line.whole")).withColumn("_category", F.col("_line.category")))
        lines = rows.groupBy(user, "_whole", "_category").agg(*aggs)
        own = [F.max(F.when(F.col("_whole"), F.col(c))).alias(c) for c in lines.columns if c not in (user, "_whole", "_category")]
        counted = F.when(~F.col("_whole") & F.col("_category").isNotNull(), F.struct("_category", "_total"))
        packed = lines.groupBy(user).agg(*own, F.map_from_entries(F.collect_list(counted)).alias("_category_counts"))
    else:
        packed = rows.withColumn("_whole", F.lit(True)).groupBy(user).agg(*aggs)
    if hour:
        packed = packed.withColumn("_hour_counts", F.array(*[F.col(f"_h{h}") for h in range(24)])).drop(*[f"_h{h}" for h in range(24)])
    return packed
