"""Shared plumbing: intermediate tables, global ranks, Arrow batch helpers."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerscope.session import checkpoint_dir, ship_package

#: a word, and the white space between words, as every contract here has them
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


_scratch: list[str] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share (inside ``scratch``, in its own part of it)."""
    folder = _scratch[-1] if _scratch else checkpoint_dir(spark).rstrip("/")
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Intermediate tables that are made inside go at the end; a result that
    reads them has to be written before, under a path from outside."""
    _scratch.append(shared_path(spark, "scratch"))
    try:
        yield _scratch[-1]
    finally:
        _delete(spark, _scratch.pop())


#: Spark removes the shuffle files of a query at its end
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def keep(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: later steps start
    from the files, whatever executors are lost, and do the work once.  What is
    written needs its shuffle files no more, so disk use doesn't add up."""
    spark = df.sparkSession
    path, before = path or shared_path(spark, name), spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    found = spark.read.schema(df.schema).parquet(path)
    found.kept_at = path
    return found


def drop_kept(table: DataFrame) -> None:
    """Delete a table of ``keep`` that no later step reads."""
    _delete(table.sparkSession, table.kept_at)


def map_arrow(df: DataFrame, fn, schema: str) -> DataFrame:
    """``mapInArrow`` with this package at the workers' disposal."""
    ship_package(df.sparkSession)
    return df.mapInArrow(fn, schema)


def global_rank(df: DataFrame, order: list[Column], name: str, rank: str) -> DataFrame:
    """``df`` with 0-based ``rank`` in ``order`` over all rows.

    Range partitions are sorted one by one; only the row count of each
    partition (one number a partition) meets in one place.
    """
    part = keep(df.repartitionByRange(*order).sortWithinPartitions(*order)
                .withColumn("__m", F.monotonically_increasing_id()), name)
    part = part.withColumn("__p", F.shiftright("__m", 33)).withColumn("__i", F.col("__m").bitwiseAND((1 << 33) - 1))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    counts = (part.groupBy("__p").agg(F.count("*").alias("__n"))
              .select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")))
    return (part.join(counts, "__p").withColumn(rank, F.col("__before") + F.col("__i"))
            .drop("__m", "__p", "__i", "__before"))


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text of an Arrow column; null as empty."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def pieces_of(batches: Iterator[pa.RecordBatch], limit: int = 4 << 20, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``limit`` bytes of ``column`` each (one
    row at least), so that the arrays made for a slice stay small."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = [0 if x is None else x for x in pc.binary_length(batch.column(column)).to_pylist()]
        start = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        yield batch.slice(start)
