"""Reading a transaction table and mapping it to one schema.

All mapping decisions are made from ``df.schema`` on the driver (no data
scan); the data itself is touched by a single lazy projection.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerscope.functions.guards import nan_to_null

# fixed values: tokens a CSV reader must treat as missing
NULL_TOKENS = ["", "NA", "N/A", "NaN", "nan", "null", "NULL", "None", "#N/A", "n/a", "<NA>"]

# fixed values: source column -> canonical name for the known card feed
CANONICAL_MAP = {
    "trans_date_trans_time": "timestamp",
    "amt": "amount",
    "lat": "lat",
    "long": "lon",
    "merch_lat": "merch_lat",
    "merch_long": "merch_lon",
    "category": "category",
    "cc_num": "user_id",
    "is_fraud": "is_fraud",
}

# fixed values: fallback user-key columns, in priority order
USER_FALLBACKS = ["cc_num", "customer_id", "card_id"]

# fixed values: label column names, matched case-insensitively
LABEL_NAMES = ["is_fraud", "class", "label", "fraud", "is_anomaly", "target"]

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
            T.DoubleType, T.DecimalType)
_DATETIME = (T.TimestampType, T.TimestampNTZType, T.DateType)


def is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, _NUMERIC)


def clean_numeric(df: DataFrame) -> DataFrame:
    """NaN -> NULL in every floating column (one projection)."""
    exprs = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            exprs.append(nan_to_null(F.col(f"`{f.name}`")).cast(f.dataType).alias(f.name))
        else:
            exprs.append(F.col(f"`{f.name}`"))
    return df.select(*exprs)


#: types a CSV column may turn out to have, narrowest first
_CSV_TYPES = ["int", "bigint", "double", "boolean", "timestamp"]


def _inferred(df: DataFrame) -> DataFrame:
    """Text columns as the narrowest type that every value present converts
    to (one aggregate pass over all rows); text where none fits."""
    cols = [f"`{f.name}`" for f in df.schema.fields]
    tried = [F.count(F.col(c).try_cast(t)).alias(f"c{i}_{t}") for i, c in enumerate(cols) for t in _CSV_TYPES]
    n = df.agg(*[F.count(F.col(c)).alias(f"c{i}") for i, c in enumerate(cols)], *tried).first()
    types = [next((t for t in _CSV_TYPES if n[f"c{i}"] and n[f"c{i}_{t}"] == n[f"c{i}"]), "string") for i in range(len(cols))]
    return df.select(*[F.col(c).try_cast(t).alias(f.name) for c, t, f in zip(cols, types, df.schema.fields)])


def read_transactions(spark: SparkSession, path: str, fmt: str = "parquet",
                      schema: T.StructType | str | None = None) -> DataFrame:
    """Lazy scan of a transaction table (parquet, csv, json, orc).

    CSV: header row; the missing-value tokens become NULL before types are
    found or applied, so a token never turns a numeric column into text.
    Without a schema the types take an extra pass over the data — pass one
    for production feeds."""
    if fmt != "csv":
        reader = spark.read if schema is None else spark.read.schema(schema)
        return clean_numeric(reader.format(fmt).load(path))
    text = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    text = text.select(*[F.when(~F.trim(F.col(f"`{c}`")).isin(NULL_TOKENS), F.col(f"`{c}`")).alias(c) for c in text.columns])
    if schema is None:
        return clean_numeric(_inferred(text))
    fields = (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
    # as Spark's reader does, a schema's fields take the file's columns in order
    columns = [F.col(f"`{c}`") for c in text.columns] + [F.lit(None)] * len(fields)
    return clean_numeric(text.select(*[c.try_cast(f.dataType).alias(f.name) for c, f in zip(columns, fields)]))


def _to_timestamp(c, dt: T.DataType):
    if isinstance(dt, T.TimestampNTZType):
        return c
    if isinstance(dt, (T.TimestampType, T.DateType)):
        return c.cast("timestamp_ntz")
    if isinstance(dt, T.StringType):
        return F.try_to_timestamp(c).cast("timestamp_ntz")
    return None


def standardise_columns(df: DataFrame) -> DataFrame:
    """Fixed renames, timestamp parsing, ``user_id`` from the first
    available fallback key.  (Row order is not kept: every later window
    orders explicitly by ``(timestamp, transaction_id)``.)"""
    names = df.columns
    taken = set(names)
    exprs = []
    for n in names:
        target = CANONICAL_MAP.get(n, n)
        if target != n and target in taken and target not in CANONICAL_MAP:
            target = n  # never create a duplicate
        exprs.append((n, target))
    out = df.select(*[F.col(f"`{n}`").alias(t) for n, t in exprs])
    if "timestamp" in out.columns:
        ts = _to_timestamp(F.col("timestamp"), out.schema["timestamp"].dataType)
        if ts is not None:
            out = out.withColumn("timestamp", ts)
    if "user_id" not in out.columns:
        for c in USER_FALLBACKS:
            if c in out.columns:
                out = out.withColumn("user_id", F.col(c))
                break
    return out


@dataclass(frozen=True)
class NameRule:
    """A canonical column and what a source column needs to become it: one of
    the tokens in its lower-cased name (and a number type, if asked for), or
    one of the types by itself."""
    target: str
    tokens: tuple[str, ...]
    numeric: bool = False
    types: tuple = ()

    def fits(self, name: str, dtype: T.DataType) -> bool:
        named = any(t in name.lower() for t in self.tokens)
        return (named and (is_numeric(dtype) or not self.numeric)) or isinstance(dtype, self.types)


# fixed values: name tokens per canonical column, by priority
NAME_RULES = (
    NameRule("timestamp", ("time", "date"), types=_DATETIME),
    NameRule("amount", ("amt", "amount", "val", "price"), numeric=True),
    NameRule("user_id", ("id", "user", "num", "account", "cc")),
    NameRule("category", ("cat", "type")),
    NameRule("lat", ("lat",)),
    NameRule("lon", ("lon", "lng")),
)
CANONICAL = {r.target for r in NAME_RULES} | {"merch_lat", "merch_lon", "transaction_id"}


def choose_targets(schema: T.StructType) -> dict[str, str]:
    """Source column -> canonical column; each canonical column at most once.

    Canonical names keep themselves, the known feed's names come next, then
    every other column, in file order, takes the first free target whose rule
    it fits.  With no amount among them, the first unmapped number is it.
    """
    names = set(schema.names)
    chosen = {c: c for c in schema.names if c in CANONICAL}
    for c in schema.names:
        t = CANONICAL_MAP.get(c)
        if t and t not in names and t not in chosen.values():
            chosen[c] = t
    labels = {x.lower() for x in LABEL_NAMES}
    rest = [f for f in schema.fields if f.name not in chosen and f.name.lower() not in labels]
    for f in rest:
        free = (r.target for r in NAME_RULES if r.target not in chosen.values() and r.fits(f.name, f.dataType))
        if target := next(free, None):
            chosen[f.name] = target
    if "amount" not in chosen.values():
        chosen |= {f.name: "amount" for f in [f for f in rest if f.name not in chosen and is_numeric(f.dataType)][:1]}
    return chosen


def map_generic_columns(df: DataFrame) -> tuple[DataFrame, dict]:
    """Any table's columns under canonical names.

    Targets by ``choose_targets``; a table without a user column has the one
    user ``'GlobalUser'``; the label column becomes ``is_fraud``.  No column is
    created twice (a deliberate divergence from a plain substring scan, where
    ``transaction_id`` would shadow the real user key).  Returns the table and
    the renames made."""
    chosen = choose_targets(df.schema)
    out = df.select(*[F.col(f"`{c}`").alias(chosen.get(c, c)) for c in df.columns])
    renames = {c: t for c, t in chosen.items() if c != t}
    if "user_id" not in out.columns:
        out = out.withColumn("user_id", F.lit("GlobalUser"))
        renames["<constant>"] = "user_id"
    if "timestamp" in out.columns:
        ts = _to_timestamp(F.col("timestamp"), out.schema["timestamp"].dataType)
        if ts is not None:
            out = out.withColumn("timestamp", ts)
    out, label = detect_label_column(out)
    if label and label != "is_fraud":
        renames[label] = "is_fraud"
    return out, renames


def detect_label_column(df: DataFrame) -> tuple[DataFrame, str | None]:
    """First column whose lower-cased name is a known label name,
    renamed to ``is_fraud`` (int)."""
    wanted = [x.lower() for x in LABEL_NAMES]
    for c in df.columns:
        if c.lower() in wanted:
            if c == "is_fraud":
                return df, c
            if "is_fraud" in df.columns:
                return df, None
            return df.withColumnRenamed(c, "is_fraud"), c
    return df, None


def select_numeric_features(df: DataFrame, exclude=(), with_counts: bool = False):
    """Numeric columns only, minus all-null ones (one aggregate pass).
    ``with_counts``: also return (row count, {column: non-null count})."""
    cand = [f.name for f in df.schema.fields
            if is_numeric(f.dataType) and f.name not in set(exclude)]
    if not cand:
        raise ValueError("the table has no number column with a value")
    counts = df.agg(F.count(F.lit(1)).alias("_n"),
                    *[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(cand)]).first()
    keep = [c for i, c in enumerate(cand) if counts[f"c{i}"] > 0]
    if not keep:
        raise ValueError("the table has no number column with a value")
    out = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in keep])
    if with_counts:
        return out, keep, (counts["_n"], {c: counts[f"c{i}"] for i, c in enumerate(cand) if c in keep})
    return out, keep


def profile(df: DataFrame, user_col: str = "user_id") -> DataFrame:
    """Row count, column count and distinct users, as one row
    (the distinct count is exact: a partial aggregate per user)."""
    aggs = [F.count(F.lit(1)).cast("long").alias("n_rows"),
            F.lit(len(df.columns)).cast("long").alias("n_columns")]
    if user_col in df.columns:
        aggs.append(F.countDistinct(user_col).cast("long").alias("n_users"))
    return df.agg(*aggs)
