"""Report aggregates.  Each is one partial aggregate (map-side
combine) followed by a tiny final step; long forms use ``stack`` instead
of one query per column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.operators.quantiles import column_quantiles
from ledgerscope.operators.rules import FLAG_COLS, RULE_NAMES


def value_counts(df: DataFrame, col: str, descending: bool = False) -> DataFrame:
    """A5: value -> count, ordered by value."""
    c = df.groupBy(col).agg(F.count(F.lit(1)).alias("count"))
    return c.orderBy(F.col(col).desc() if descending else F.col(col).asc())


def _stack(df: DataFrame, pairs: list[tuple[str, str]], names: tuple[str, str]) -> DataFrame:
    body = ", ".join(f"'{k}', `{v}`" for k, v in pairs)
    return df.selectExpr(f"stack({len(pairs)}, {body}) AS ({names[0]}, {names[1]})")


def flag_counts(df: DataFrame, flags: list[str] | None = None) -> DataFrame:
    """Normal and flagged counts per rule flag, long form."""
    flags = [f for f in (flags or FLAG_COLS) if f in df.columns]
    aggs = []
    for f in flags:
        aggs += [F.sum((F.col(f) == 0).cast("long")).alias(f"{f}__0"),
                 F.sum((F.col(f) == 1).cast("long")).alias(f"{f}__1")]
    row = df.agg(*aggs)
    body = ", ".join(f"'{f}', {v}, `{f}__{v}`" for f in flags for v in (0, 1))
    return row.selectExpr(f"stack({2 * len(flags)}, {body}) AS (flag, value, count)").withColumn(
        "value", F.col("value").cast("int"))


def rule_hit_rates(df: DataFrame) -> DataFrame:
    """Flagged count and percent per rule (one aggregate, unpivoted)."""
    flags = [f for f in FLAG_COLS if f in df.columns]
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[F.sum(f).cast("long").alias(f) for f in flags])
    long = row.selectExpr("_n", "stack({}, {}) AS (rule, flagged)".format(
        len(flags), ", ".join(f"'{f}', `{f}`" for f in flags)))
    return long.select("rule", "flagged", F.round(F.col("flagged") * 100.0 / F.col("_n"), 6).alias("pct"))


def rules_run_report(df: DataFrame, ran: dict) -> DataFrame:
    """R9 report: which rules ran and how many rows each flagged."""
    row = df.agg(*[F.sum(f).cast("long").alias(f) for f in FLAG_COLS])
    body = ", ".join(f"'{r}', {i + 1}, {str(bool(ran.get(r))).lower()}, `{f}`"
                     for i, (r, f) in enumerate(zip(RULE_NAMES, FLAG_COLS)))
    return row.selectExpr(f"stack(6, {body}) AS (rule, rule_order, ran, flagged)").withColumn(
        "rule_order", F.col("rule_order").cast("int"))


def run_summary(df: DataFrame, pred: str, score: str) -> DataFrame:
    """Total, predicted count and percent, mean and max score."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.sum(pred).cast("long").alias("n_predicted"),
                  F.round(F.avg(pred) * 100.0, 6).alias("pct_predicted"),
                  F.round(F.avg(score), 6).alias("mean_score"),
                  F.round(F.max(score).cast("double"), 6).alias("max_score"))


def describe_features(df: DataFrame, cols: list[str], digits: int = 6) -> DataFrame:
    """Count, mean, std, min, 25 %, 50 %, 75 %, max per feature (exact
    interpolated quartiles), one row per feature.

    The features are kept once; one aggregate gives the moments and a few
    counting passes the quartiles."""
    values = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).persist()
    try:
        aggs = [f(c).alias(f"{n}_{i}") for i, c in enumerate(cols)
                for n, f in (("n", F.count), ("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))]
        m = values.agg(*aggs).first()
        quartiles = column_quantiles(values, cols, [0.25, 0.5, 0.75])
    finally:
        values.unpersist()
    rows = []
    for i, c in enumerate(cols):
        if m[f"n_{i}"]:
            rows.append((c, int(m[f"n_{i}"]), *[None if v is None else round(float(v), digits) for v in (
                m[f"mean_{i}"], m[f"std_{i}"], m[f"min_{i}"], *quartiles[c], m[f"max_{i}"])]))
    schema = ("feature string, count long, mean double, std double, min double, p25 double, p50 double, "
              "p75 double, max double")
    # one row per feature: a small report computed from the data above
    return df.sparkSession.createDataFrame(rows, schema)


def quantile_threshold(df: DataFrame, col: str, p: float = 0.95) -> float | None:
    """Exact interpolated p-quantile of a column (driver scalar)."""
    return column_quantiles(df, [col], [p])[col][0]


def rate_by(df: DataFrame, key: str, pred: str) -> DataFrame:
    """A10: percent of predicted rows per key value."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"),
                               F.round(F.avg(F.col(pred).cast("double")) * 100.0, 6).alias("anomaly_rate_pct"))


def label_balance(df: DataFrame, label: str) -> DataFrame:
    """Positives, total, positive rate."""
    return df.agg(F.sum(F.col(label)).cast("long").alias("n_positive"),
                  F.count(F.lit(1)).alias("n_rows"),
                  F.round(F.avg(F.col(label).cast("double")), 6).alias("positive_rate"))
