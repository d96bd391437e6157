"""Result sinks.  Writes are distributed (one file per task);
``partition_by`` makes the output prunable by later readers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_results(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                  partition_by: list[str] | None = None) -> None:
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def flagged(df: DataFrame, flag_col: str, order_col: str, id_col: str = "transaction_id") -> DataFrame:
    """Flagged rows only, strongest first; ties by id.  The global sort is a
    range-partitioned sort (sampled boundaries), not a single task."""
    return df.where(F.col(flag_col) == 1).orderBy(F.col(order_col).desc(), F.col(id_col).asc())
