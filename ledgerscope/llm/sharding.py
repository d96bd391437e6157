"""Sharding by best-fit-decreasing bin packing.

Rows with equal texts are a group, and a group is never divided: it enters one
shard whole.  The groups, sorted by size from the largest, each enter the
shard with the least remaining capacity that still holds them, found in a
balanced tree of the remaining capacities; a new shard is opened when none
does.  With a fixed capacity this keeps the number of shards small; for a fixed number of
shards the capacity itself is searched: the least with which best fit needs no
more shards, which brings their sizes as near to each other as whole groups allow.

What is packed is bounded whatever the corpus: a group larger than 1 / ``UNITS``
of all bytes is an item of its own (there are fewer than ``UNITS`` of them); the
smaller groups are dealt by hash into ``UNITS`` items of whole groups.  A group
larger than a shard cannot stay whole under any packing; its rows are dealt by
doc_id into ``PARTS`` items.  Only the items' sizes reach the driver, and the
item of a row follows from its text, so no row is joined to another.

Defined results: a null text has no bytes, size 1, and is in one group with
empty texts; texts that share a 64-bit hash are one group; rows alike in doc_id
and text stay together even in a divided group; a row larger than a shard's
capacity has a shard of its own; a null doc_id is kept; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscope.llm.common import global_rank, keep

#: items that hold the small groups, and items of a group larger than a shard
UNITS, PARTS = 16_384, 2_048


class Capacities:
    """Balanced tree (AA) of (remaining capacity, shard) pairs."""

    def __init__(self):
        self.root = None

    # a node: [key, level, left, right]
    @staticmethod
    def _skew(t):
        left = t[2]
        if left is not None and left[1] == t[1]:
            t[2], left[3] = left[3], t
            return left
        return t

    @staticmethod
    def _split(t):
        right = t[3]
        if right is not None and right[3] is not None and right[3][1] == t[1]:
            t[3], right[2] = right[2], t
            right[1] += 1
            return right
        return t

    def add(self, key: tuple[int, int]) -> None:
        self.root = self._added(self.root, key)

    def _added(self, t, key):
        if t is None:
            return [key, 1, None, None]
        side = 2 if key < t[0] else 3
        t[side] = self._added(t[side], key)
        return self._split(self._skew(t))

    def remove(self, key: tuple[int, int]) -> None:
        self.root = self._removed(self.root, key)

    def _removed(self, t, key):
        if t is None:
            return None
        if key != t[0]:
            side = 2 if key < t[0] else 3
            t[side] = self._removed(t[side], key)
        elif t[2] is None:
            return t[3]
        else:  # the next smaller key takes its place
            near = t[2]
            while near[3] is not None:
                near = near[3]
            t[0] = near[0]
            t[2] = self._removed(t[2], near[0])
        low = min((c[1] if c is not None else 0) for c in t[2:])
        if low < t[1] - 1:
            t[1] -= 1
            if t[3] is not None and t[3][1] > t[1]:
                t[3][1] = t[1]
            t = self._skew(t)
            if t[3] is not None:
                t[3] = self._skew(t[3])
                if t[3][3] is not None:
                    t[3][3] = self._skew(t[3][3])
            t = self._split(t)
            if t[3] is not None:
                t[3] = self._split(t[3])
        return t

    def tightest(self, size: int) -> tuple[int, int] | None:
        """The smallest pair whose capacity is ``size`` at least."""
        t, best, key = self.root, None, (size, -1)
        while t is not None:
            if t[0] > key:
                best, t = t[0], t[2]
            else:
                t = t[3]
        return best


def best_fit_decreasing(sizes: list[int], capacity: int, most: int | None = None) -> list[int] | None:
    """The shard of each item; an item above the capacity has one of its own.
    None as soon as more than ``most`` shards are needed."""
    tree, out, shards = Capacities(), [0] * len(sizes), 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[i]
        spot = tree.tightest(size)
        if spot is None:
            if shards == most:
                return None
            spot, shards = (max(capacity, size), shards), shards + 1
        else:
            tree.remove(spot)
        left, out[i] = spot[0] - size, spot[1]
        if left:
            tree.add((left, spot[1]))
    return out


def level_shards(sizes: list[int], shards: int) -> list[int]:
    """The shard of each item for the least capacity, to 1 in 4,096 of a fair
    share, with which best fit needs no more than ``shards``."""
    if not sizes:
        return []
    total = sum(sizes)
    low = max(-(-total // shards), max(sizes))  # no packing does with less
    found = best_fit_decreasing(sizes, low, shards)
    step = max(1, low // 4096)
    high = 1
    while found is None:  # best fit needs less than twice the least capacity
        found = best_fit_decreasing(sizes, low + step * high, shards)
        high *= 2
    a, b = high // 4, high // 2  # fails with a, does with b
    while b - a > 1:
        middle = (a + b) // 2
        better = best_fit_decreasing(sizes, low + step * middle, shards)
        a, b, found = (a, middle, better) if better is not None else (middle, b, found)
    return found


def _sized(docs: DataFrame) -> DataFrame:
    """``docs`` with __size and __group (a hash of the text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return (docs.withColumn("__size", (F.octet_length(text) + 1).cast("long"))
            .withColumn("__group", F.xxhash64(F.lit(11), text)))


def _shard_column(sized: DataFrame, capacity: int | None, shards: int | None):
    """Adds __shard to the rows of ``_sized``; also returns the rows of each shard."""
    spark = sized.sparkSession
    narrow = keep(sized.select("doc_id", "__size", "__group"), "sizes")
    groups = keep(narrow.groupBy("__group").agg(F.sum("__size").alias("__bytes")), "groups")
    total = groups.agg(F.sum("__bytes")).first()[0] or 0
    room = capacity or -(-total // shards)
    # fewer than UNITS groups are larger than a UNITS-th of all bytes
    large = groups.where(F.col("__bytes") * UNITS > total).select("__group", (F.col("__bytes") > room).alias("__over"))

    def with_item(df: DataFrame) -> DataFrame:
        part = F.pmod(F.xxhash64(F.lit(12), "doc_id", "__group"), F.lit(PARTS))
        unit = F.pmod(F.xxhash64(F.lit(13), "__group"), F.lit(UNITS))
        df = df.join(F.broadcast(large), "__group", "left")
        return (df.withColumn("__of", F.when(F.col("__over").isNotNull(), F.col("__group")))
                .withColumn("__nth", F.when(F.col("__over"), part).when(F.col("__over").isNull(), unit).otherwise(F.lit(0)).cast("int"))
                .drop("__over"))

    items = (with_item(narrow).groupBy("__of", "__nth").agg(F.sum("__size").alias("size"), F.count("*").alias("n"))
             .orderBy("__of", "__nth").collect())
    sizes = [r["size"] for r in items]
    found = best_fit_decreasing(sizes, capacity) if capacity else level_shards(sizes, shards)
    counts: dict[int, int] = {s: 0 for s in range(shards or max(found, default=-1) + 1)}
    for r, s in zip(items, found):
        counts[s] += r["n"]
    plan = spark.createDataFrame([(r["__of"], r["__nth"], s) for r, s in zip(items, found)], "__f long, __i int, __shard int")
    # fewer than 2 * UNITS rows, and PARTS for each group above a shard's capacity
    placed = (with_item(sized).join(F.broadcast(plan), F.col("__of").eqNullSafe(F.col("__f")) & (F.col("__nth") == F.col("__i")))
              .drop("__of", "__nth", "__f", "__i"))
    return placed, counts


def _by_shard(count: dict[int, int], shard: Column) -> Column:
    """Rows of the shards before ``shard``, from the rows of each."""
    before, start = [], 0
    for s in sorted(count):
        before.append(F.lit(start).cast("long"))
        start += count[s]
    return F.element_at(F.array(*before), shard + 1) if before else F.lit(0).cast("long")


def shard_rows(docs: DataFrame, shards: int | None = None, capacity: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    Either a number of ``shards``, which come out as near in size as whole
    groups allow, or a ``capacity`` in bytes, with as many shards as it takes.
    """
    if (shards is None) == (capacity is None):
        raise ValueError("give either shards or capacity")
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = _sized(docs.select("doc_id", "text")).withColumn("text_crc32", F.crc32(text.cast("binary"))).drop("text")
    placed, counts = _shard_column(sized, capacity, shards)
    ranked = global_rank(placed.withColumn("__nth_row", F.monotonically_increasing_id()),
                         [F.col("__shard"), F.col("doc_id").asc_nulls_last(), F.col("text_crc32"), F.col("__nth_row")], "shards", "rank")
    return ranked.select("doc_id", F.col("__size").alias("size"), "text_crc32", F.lit("bytes").alias("law"),
                         F.col("__shard").alias("shard"), (F.col("rank") - _by_shard(counts, F.col("__shard"))).alias("slot"),
                         F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int | None = None, capacity: int | None = None) -> None:
    """The rows of ``docs``, all columns, as Parquet below ``path/shard=<n>``,
    in files sorted by doc_id."""
    if (shards is None) == (capacity is None):
        raise ValueError("give either shards or capacity")
    placed, _ = _shard_column(_sized(docs), capacity, shards)
    rows = placed.select(*docs.columns, F.col("__shard").alias("shard")) if "shard" not in docs.columns else \
        placed.select(*[c for c in docs.columns if c != "shard"], F.col("shard").alias("shard_given"), F.col("__shard").alias("shard"))
    (rows.repartitionByRange("shard", F.col("doc_id").asc_nulls_last()).sortWithinPartitions("shard", F.col("doc_id").asc_nulls_last())
     .write.partitionBy("shard").parquet(path))
