"""Per-user sequence columns that stay balanced under skew.

A plain ``Window.partitionBy(user)`` sends every row of a user to one task, and
a sliding RANGE frame does as much work per row as its frame holds rows.
Here both are avoided:

* Every row is an arrival at its time and, per trailing count, an expiry at
  the first time that no longer counts it.  A trailing count is the running
  sum of arrivals less expiries: one step per event, however many rows lie in
  the window.
* Events are dealt by ``(user, bucket of time)``.  A bucket is a day, or for
  a (user, day) of more than ``hot_rows`` events the widest of day / 2, day / 4,
  ... whose fullest slice has no more (down to about a millisecond), so one user's busy hour is
  spread over many tasks.
* What a bucket's first row needs from before, the count so far and the last row, comes from
  a table with one row per ``(user, bucket)``: a running sum over a user's
  buckets, not over its rows.  It is joined after the events are sorted, so that
  a task sorts narrow rows.

So the running sum has two levels, over buckets and inside a bucket; no row is
copied as context, and the events move once.  Rows with a NULL user or time
have no sequence; they are spread by hash and pass through.

Trailing count (the velocity rule): rows of the same user at or before the
row in ``(timestamp, transaction_id)`` order whose time is within the
window, own row included, capped.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope.functions.temporal import epoch_micros

SECOND_US = 1_000_000
DAY_US = 86_400 * SECOND_US
#: events of one user in one bucket, about; halvings of a day at most
HOT_ROWS, HALVINGS = 50_000, 26
#: events that a task sorts, about, once there are more of these tasks than cores
TASK_EVENTS = 250_000


@dataclass(frozen=True)
class TrailingCount:
    """Count of a user's rows in ``[t - window, t]`` at or before the row.

    ``cap``: at most this many rows counted (own row included), ``None`` =
    uncapped.  ``whole_seconds``: compare times truncated to the second.
    """
    name: str
    window_us: int
    cap: int | None = None
    whole_seconds: bool = False

    def expiry(self, us: Column) -> Column:
        """The first time at which a row of time ``us`` no longer counts."""
        if self.whole_seconds:
            return (F.floor(us / F.lit(SECOND_US)) + self.window_us // SECOND_US + 1).cast("long") * SECOND_US
        return us + F.lit(self.window_us + 1)


def row_hash(df: DataFrame):
    """A hash of all columns.  Only rows alike in every column share it for
    certain, and for those any order gives the same rows of results."""
    return F.xxhash64(*[F.to_json(F.col(f"`{f.name}`")) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`")
                        for f in df.schema.fields])


def _slice(at: Column, bucket_us: int) -> Column:
    """Which of the 2**HALVINGS parts of its bucket a time lies in."""
    return F.floor((at - F.floor(at / bucket_us).cast("long") * bucket_us) * F.lit(float(1 << HALVINGS)) / bucket_us).cast("long")


def hot_buckets(events: DataFrame, user: str, at: str, bucket_us: int, hot_rows: int) -> DataFrame:
    """(user, _day, _halvings): buckets of more than ``hot_rows`` events, and how
    often they are halved so that no part has more."""
    events = events.select(F.col(user), F.floor(F.col(at) / bucket_us).cast("long").alias("_day"), _slice(F.col(at), bucket_us).alias("_slice"))
    full = events.groupBy(user, "_day").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows)
    least = F.ceil(F.log2(F.col("_n") / F.lit(float(hot_rows)))).cast("int")
    cut = (events.join(full.withColumn("_h", F.explode(F.sequence(F.least(least, F.lit(HALVINGS)), F.lit(HALVINGS)))).drop("_n"), [user, "_day"])
           .groupBy(user, "_day", "_h", F.expr(f"shiftright(_slice, {HALVINGS} - _h)").alias("_part")).agg(F.count(F.lit(1)).alias("_n")))
    fullest = cut.groupBy(user, "_day", "_h").agg(F.max("_n").alias("_n"))
    return fullest.groupBy(user, "_day").agg(F.coalesce(F.min(F.when(F.col("_n") <= hot_rows, F.col("_h"))), F.lit(HALVINGS)).alias("_halvings"))


def busiest(df: DataFrame, user: str = "user_id", ts: str = "timestamp", bucket_us: int = DAY_US) -> tuple[int, int, int]:
    """Rows of the user with most, of the (user, bucket) with most, and of the table."""
    day = F.floor(epoch_micros(ts) / bucket_us).alias("_day")
    days = df.groupBy(user, day).agg(F.count(F.lit(1)).alias("_n"))
    users = days.groupBy(user).agg(F.sum("_n").alias("_rows"), F.max("_n").alias("_most"))
    known = lambda c: F.max(F.when(F.col(user).isNotNull(), F.col(c)))
    r = users.agg(known("_rows"), known("_most"), F.sum("_rows")).first()
    return r[0] or 0, r[1] or 0, r[2] or 0


def user_sequence(df: DataFrame, *, user: str = "user_id", ts: str = "timestamp",
                  tid: str = "transaction_id", counts: tuple[TrailingCount, ...] = (),
                  previous: tuple[str, ...] = (), bucket_us: int = DAY_US,
                  num_partitions: int | None = None, hot_rows: int = HOT_ROWS,
                  per_user: DataFrame | None = None, fullest: int | None = None,
                  n_rows: int | None = None) -> DataFrame:
    """Add trailing counts and previous-row columns.

    Adds one column per ``TrailingCount`` (0 for a NULL user or time) and,
    if ``previous`` is given, ``_prev_us`` (previous row's time in
    microseconds, NULL for the first row) plus ``_prev_<col>`` per column.
    Without a ``tid`` column, equal times are ordered by a hash of the row.
    ``per_user``, one row per user, is attached to the table of buckets and so
    reaches all rows of a user without moving them again.

    ``fullest``, ``n_rows``: rows of the busiest (user, bucket) and of the table, counted by a small
    job while this is called if not given; they only decide whether buckets are cut
    and into how many tasks the events are dealt (``num_partitions`` if given), so
    that what a task sorts doesn't grow with the table.
    """
    cols = df.columns
    us = "_us"
    bucket_us = min(int(bucket_us), (1 << 37) - 1)
    base = df.withColumn(us, epoch_micros(ts))
    if tid not in cols:
        tid = "_tie"
        base = base.withColumn(tid, row_hash(df))
    valid = F.col(user).isNotNull() & F.col(us).isNotNull()

    def events_of(rows: DataFrame) -> DataFrame:
        """Arrivals (_kind -1) and expiries (_kind i of the i-th count)."""
        if not counts:
            return rows.withColumn("_kind", F.lit(-1)).withColumn("_at", F.col(us))
        event = lambda kind, at: F.struct(F.lit(kind).alias("kind"), at.alias("at"))
        arrival = event(-1, F.col(us))
        all_of = F.array(arrival, *[event(i, c.expiry(F.col(us))) for i, c in enumerate(counts)])
        return (rows.withColumn("_e", F.explode(F.when(valid, all_of).otherwise(F.array(arrival))))
                .withColumn("_kind", F.col("_e.kind")).withColumn("_at", F.col("_e.at")).drop("_e"))

    if fullest is None or n_rows is None:
        _, fullest, n_rows = busiest(df, user, ts, bucket_us)
    needed = -(-n_rows * (1 + len(counts)) // TASK_EVENTS)
    if num_partitions is None and needed > df.sparkSession.sparkContext.defaultParallelism:
        num_partitions = needed
    day = F.floor(F.col("_at") / bucket_us).cast("long")
    # a bucket has its arrivals and the expiries of two buckets' arrivals at most, or of a longer window's
    reach = sum(2 + -(-c.window_us // bucket_us) for c in counts)
    hot = None
    if fullest * (1 + reach) > hot_rows:
        timed = events_of(df.select(F.col(user), epoch_micros(ts).alias(us)).where(valid))
        hot = hot_buckets(timed, user, "_at", bucket_us, hot_rows)

    def in_buckets(events: DataFrame) -> DataFrame:
        """With _b, ordered by time; rows without a sequence spread by hash."""
        events = events.withColumn("_day", day)
        part = F.lit(0).cast("long")
        if hot is not None:
            events = events.join(hot, [user, "_day"], "left")
            shift = F.lit(HALVINGS) - F.col("_halvings")
            part = F.coalesce(F.call_function("shiftleft", F.call_function("shiftright", _slice(F.col("_at"), bucket_us), shift), shift), part)
        b = F.when(valid, F.col("_day") * F.lit(1 << HALVINGS) + part).otherwise(F.pmod(F.xxhash64(tid), F.lit(4096)))
        return events.withColumn("_b", b).drop("_day", "_halvings")

    keys = [user, "_b"]
    arrived = F.col("_kind") == -1
    steps = {f"_step{i}": F.when(arrived & valid, 1).when(F.col("_kind") == i, -1).otherwise(0) for i in range(len(counts))}
    payload = F.struct(F.col(us).alias("_us"), *[F.col(c).alias(c) for c in previous])

    # one row per (user, bucket): the sums and the last row before it
    narrow = in_buckets(events_of(base.select(*dict.fromkeys([user, us, tid, *previous])).where(F.col(user).isNotNull())))
    tally = narrow.groupBy(*keys).agg(
        *[F.sum(s).alias(n) for n, s in steps.items()],
        *([F.max_by(F.when(arrived & valid, payload), F.when(arrived & valid, F.struct(F.col(us), F.col(tid)))).alias("_last")] if previous else []))
    earlier = Window.partitionBy(user).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = tally.select(*keys, *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_carry{n}") for n in steps],
                           *([F.last("_last", ignorenulls=True).over(earlier).alias("_bprev")] if previous else []))
    if per_user is not None:
        carried = carried.join(per_user, user, "left")

    events = in_buckets(events_of(base))
    if counts:  # an expiry takes no columns along
        events = events.select(user, "_b", "_kind", "_at", *[F.when(arrived, F.col(f"`{c}`")).alias(c)
                                                              for c in dict.fromkeys([*cols, us, tid]) if c != user])
    if num_partitions:
        events = events.repartition(num_partitions, *keys)
    else:
        events = events.repartition(*keys)
    # at one time, expiries come before arrivals
    inside = Window.partitionBy(*keys).orderBy(F.col("_at"), arrived, F.col(tid))
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    out = events.withColumns({f"_in{n}": F.sum(s).over(so_far) for n, s in steps.items()})
    if previous:
        out = out.withColumn("_lagged", F.last(F.when(arrived, payload), ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    # what a bucket and its user carry is wide: it meets the rows after they are sorted, in the same tasks
    out = out.where(arrived).join(carried, keys, "left")
    for i, c in enumerate(counts):
        n = F.col(f"_carry_step{i}") + F.col(f"_in_step{i}")
        if c.cap is not None:
            n = F.least(n, F.lit(c.cap))
        out = out.withColumn(c.name, F.when(valid, n).otherwise(F.lit(0)).cast("int"))
    extra = [c.name for c in counts]
    if previous:
        out = out.withColumn("_prev", F.when(valid, F.coalesce(F.col("_lagged"), F.col("_bprev"))))
        out = out.withColumn("_prev_us", F.col("_prev._us"))
        for c in previous:
            out = out.withColumn(f"_prev_{c}", F.col(f"_prev.{c}"))
        extra += ["_prev_us"] + [f"_prev_{c}" for c in previous]
    if per_user is not None:
        extra += [c for c in per_user.columns if c != user]
    return out.select(*cols, us, *extra)
