"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight schedule over training time 0..1.  Integrated, it
is the source's cumulative demand in words; a document lies at a word offset
of its source's stream (documents in hash order, repeated from the start when
the demand is larger than the source), and the inverse of the demand at that
offset is its training position.  Sorting all documents by position by range
partitions interleaves the sources as the schedules ask.

Targets: the sources' weights share a budget of words; no source gives more
than ``max_epochs`` times its size, and what it cannot give is shared again
by weight among the rest.

Skew: prefix sums run in buckets of a source (hash ranges of the documents,
as many as the row count asks for) over sums of buckets, so no task sees a
whole source.

Defined results: null text has size 0 and is never taken; null is a source of
its own, the last; a source without words has target 0; an empty table gives
an empty result; rows that repeat a doc_id are rows of their own; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope.llm.common import WORD, global_rank, keep

#: rows of one bucket of a source, about
BUCKET_ROWS = 4_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: tuple[float, ...], share: float, max_epochs: int) -> DataFrame:
    """``sources`` (source, source_size) with its weight and target.

    The level (words per unit of weight) rises until no source is above its
    limit; each step brings three sums to the driver, never the sources.
    """
    ranked = global_rank(sources, [F.col("source").asc_nulls_last()], "source-rank", "nth")
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                                                      (F.col("nth") % len(weights) + 1).cast("int")))
    ranked = keep(ranked.withColumn("most", F.col("source_size") * float(max_epochs)), "sources")
    total = (ranked.agg(F.sum("source_size")).first()[0] or 0) * float(share)
    level, full = 0.0, -1
    while True:
        above = F.col("weight") * F.lit(level) > F.col("most")
        given, open_weight, n = ranked.agg(F.sum(F.when(above, F.col("most")).otherwise(0.0)),
                                           F.sum(F.when(above, 0.0).otherwise(F.col("weight"))),
                                           F.sum(above.cast("int"))).first()
        if not open_weight or n == full:
            break
        level, full = (total - given) / open_weight, n
    return ranked.withColumn("target", F.least(F.col("most"), F.col("weight") * F.lit(level)))


def linear_schedule(sources: DataFrame, tilt: float = 0.5) -> DataFrame:
    """Adds ``knots`` to (source, weight, target): (time, words per unit of
    time) pairs of a ramp whose integral is the target.  Heavier sources come
    later; at any time the rates of all sources add up to the same."""
    all_target, weighted, most = sources.agg(F.sum("target"), F.sum(F.col("target") * F.col("weight")),
                                             F.max("weight")).first()
    mean = (weighted or 0.0) / all_target if all_target else 0.0
    lean = F.lit(tilt) * (F.col("weight") - F.lit(mean)) / F.lit(float(most or 1.0))
    knot = lambda t, rate: F.struct(F.lit(float(t)).alias("t"), rate.alias("rate"))
    return sources.withColumn("knots", F.array(knot(0, F.col("target") * (1 - lean)), knot(1, F.col("target") * (1 + lean))))


def _integrated(knots: Column) -> Column:
    """Per stretch between two knots: begin, length, rates, demand before it."""
    stretch = F.transform(F.sequence(F.lit(1), F.size(knots) - 1), lambda i: F.struct(
        knots[i - 1]["t"].alias("t"), (knots[i]["t"] - knots[i - 1]["t"]).alias("dt"),
        knots[i - 1]["rate"].alias("r0"), knots[i]["rate"].alias("r1")))
    area = lambda s: s["dt"] * (s["r0"] + s["r1"]) / 2
    return F.transform(stretch, lambda s, i: F.struct(
        s["t"].alias("t"), s["dt"].alias("dt"), s["r0"].alias("r0"), s["r1"].alias("r1"), area(s).alias("area"),
        F.aggregate(F.slice(stretch, F.lit(1), i), F.lit(0.0), lambda a, p: a + area(p)).alias("before")))


def position_at(parts: Column, offset: Column) -> Column:
    """Time at which the integrated demand ``parts`` reaches ``offset``."""
    s = F.element_at(F.filter(parts, lambda p: (p["before"] <= offset) | (p["before"] == 0)), -1)
    x = F.greatest(F.lit(0.0), offset - s["before"])
    slope = (s["r1"] - s["r0"]) / s["dt"]
    root = F.sqrt(F.greatest(F.lit(0.0), s["r0"] * s["r0"] + 2 * slope * x))
    below = s["r0"] + root
    return s["t"] + F.least(s["dt"], F.when(below > 0, 2 * x / below).otherwise(0.0))


def _row_key(docs: DataFrame) -> Column:
    """A hash of all columns that can be hashed: rows that share it and the
    doc_id are alike."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()])


def mix_plan(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), share: float = 1.0, max_epochs: int = 3,
             schedule=linear_schedule) -> DataFrame:
    """doc_id, row_key, size, source_size, target, taken, passes, cut, positions
    per row: whole copies (``passes``), words of a last partial copy
    (``cut``), the position of the first copy, and of each further copy."""
    sized = keep(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"),
                             F.xxhash64("text").alias("key"), _row_key(docs).alias("row_key")), "sizes")
    sized = sized.withColumn("h", F.xxhash64(F.lit(9), "doc_id"))
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    buckets = max(1, -(-sized.count() // BUCKET_ROWS))
    sized = sized.withColumn("bucket", F.shiftright(F.shiftrightunsigned("h", 33) * F.lit(buckets), 31))
    plan = schedule(source_targets(sources, weights, share, max_epochs))
    plan = keep(plan.withColumn("parts", _integrated(F.col("knots"))), "curriculum")
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = (sized.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
            .withColumn("base", F.coalesce(F.sum("words").over(earlier), F.lit(0)))
            .join(plan.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
            .select(F.col("source").alias("s"), F.col("bucket").alias("b"), "base", "source_size", "target", "parts"))
    before = (Window.partitionBy("source", "bucket").orderBy("h", F.col("doc_id").asc_nulls_last(), "size", "key")
              .rowsBetween(Window.unboundedPreceding, -1))
    at = (sized.withColumn("inside", F.coalesce(F.sum("size").over(before), F.lit(0)))
          .join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
          .withColumn("offset", F.col("base") + F.col("inside")))
    words = F.floor(F.col("target")).cast("long")
    full = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0).cast("long")
    rest = words - full * F.col("source_size")
    cut = F.least(F.col("size"), F.greatest(F.lit(0), rest - F.col("offset"))).cast("long")
    at = at.withColumn("full", full).withColumn("cut", cut).withColumn("taken", F.col("full") * F.col("size") + F.col("cut"))
    spot = lambda p: position_at(F.col("parts"), p * F.col("source_size") + F.col("offset"))
    copies = F.col("full") + (F.col("cut") > 0).cast("long")
    positions = F.when((copies > 0) & (F.col("taken") > 0),
                       F.transform(F.sequence(F.lit(0).cast("long"), copies - 1), spot)).otherwise(F.array().cast("array<double>"))
    return at.select("doc_id", "row_key", "size", "source_size", "target", "taken", F.col("full").alias("passes"), "cut",
                     positions.alias("positions"))


def source_mix(docs: DataFrame, **options) -> DataFrame:
    """One row per document, sorted by its first training position."""
    plan = mix_plan(docs, **options).withColumn("position", F.when(F.size("positions") > 0, F.col("positions")[0]))
    order = [F.col("position").asc_nulls_last(), F.col("doc_id")]
    return (keep(plan.select("doc_id", "size", "source_size", "target", "taken", "position"), "mix")
            .repartitionByRange(*order).sortWithinPartitions(*order))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of ``docs`` with all their columns unchanged,
    once per copy, range-sorted by training position.  A last partial copy is
    taken whole where that comes nearer to the source's target than leaving it."""
    plan = mix_plan(docs, **options).withColumn("copies", F.col("passes") + (2 * F.col("cut") > F.col("size")).cast("long"))
    plan = plan.where("taken > 0 and copies > 0").select(
        F.col("doc_id").alias("__id"), F.col("row_key").alias("__key"),
        F.explode(F.slice("positions", F.lit(1), F.col("copies").cast("int"))).alias("__at"))
    keyed = docs.withColumn("__row_key", _row_key(docs))
    if not docs.groupBy("doc_id").count().where("count > 1").isEmpty():  # of rows alike one meets the copies of all
        keyed = keyed.dropDuplicates(["doc_id", "__row_key"])
    mixed = keyed.join(plan, keyed["doc_id"].eqNullSafe(F.col("__id")) & (F.col("__row_key") == F.col("__key")))
    order = [F.col("__at"), F.col("__id")]
    return mixed.repartitionByRange(*order).sortWithinPartitions(*order).select(*docs.columns)
