"""Session helper: UTC wall clock, ANSI arithmetic, AQE, no UI."""

from __future__ import annotations

import contextlib
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # joins against per-user / per-bucket aggregates become broadcasts only
    # when AQE has *measured* the aggregate below this size at runtime
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64MB",
    "spark.ui.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # checkpoint files of tables no longer referenced are removed
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}

# applied only when this helper starts the JVM (local runs, tests)
_LOCAL_DEFAULTS = {"spark.driver.memory": "8g"}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "ledgerscope", extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the settings every module relies on.

    On a cluster, pass ``master=None`` and let spark-submit decide; the
    shuffle partition count should then be sized to the data (about
    128-256 MB per post-shuffle partition), AQE coalesces the rest.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
        for k, v in _LOCAL_DEFAULTS.items():
            b = b.config(k, v)
    for k, v in _DEFAULTS.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints / intermediate tables.

    Reads ``spark.checkpoint.dir`` from the session (the cluster names a
    shared, fault-tolerant folder there).  Only a session whose master is
    ``local`` may go without: it gets a scratch folder, as in tests.  Anywhere
    else a machine-local folder would be invisible to the other machines, so
    an unset name is an error.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="ledgerscope-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", d)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


#: Spark removes the shuffle files of a query at its end
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_cleaned(spark: SparkSession) -> Iterator[None]:
    """What a query inside shuffled is removed when it ends."""
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN, before)


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it again: lineage is cut like by a
    checkpoint, columns are packed, and what the write shuffled is removed at once."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    with shuffles_cleaned(spark):
        df.write.option("compression", "zstd").parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.kept_at = path
    return found


def drop_kept(table: DataFrame) -> None:
    """Delete a table of ``keep`` that no later step reads."""
    spark = table.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(table.kept_at)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Functions that run inside tasks are pickled by reference; workers started
    from another folder or on another machine import them from this archive,
    which Spark's own file distribution carries (also to executors that join
    later).
    """
    sc = spark.sparkContext
    if getattr(sc, "_ledgerscope_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="ledgerscope-code-"), "ledgerscope_code.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
    sc.addPyFile(archive)
    sc._ledgerscope_shipped = True
