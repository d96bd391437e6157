"""Exact interpolated quantiles (``percentile`` / DuckDB ``quantile_cont``
semantics: h = p * (n - 1), linear between the order statistics at
floor(h) and ceil(h)), by radix selection.

A double's IEEE bits, sign folded in, are an integer in the same order
(``order_key``).  A pass counts rows by the next ``DIGIT`` bits of that integer
among the rows that agree with a wanted rank so far; the counts tell in which
of these buckets the rank lies.  After four passes at most a rank's value is
known bit by bit; a bucket that holds few rows is counted by whole values at once.  Nothing is
shuffled but counts, and no boundaries are drawn from the data.

Whole columns: the counts of a pass (at most 2**DIGIT per column) come to the driver.

Groups: one aggregate for all ordinary groups.  Groups above ``range_target``
rows go through the same passes together, their counts staying in a table;
groups whose wanted buckets have become small drop out of the passes.
"""

from __future__ import annotations

import math
import struct

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope.session import checkpoint_dir

DIGIT, KEY_BITS = 16, 64
#: rows of a group that one aggregation buffer holds, and of a bucket that is counted by value
RANGE_TARGET = 200_000
_INF = 2047 << 52


def order_key(v: Column) -> Column:
    """The double ``v`` as a long in the same order: its IEEE bits, negated for
    negative values; NaN after all others, both zeros alike, NULL as NULL."""
    v = v.cast("double")
    a = F.abs(v)
    near = F.floor(F.log2(a))
    # the logarithm may be off by one next to a power of two
    low = F.greatest(F.lit(-1022.0), near - 1)
    e = low + (a >= F.pow(F.lit(2.0), low + 1)).cast("int") + (a >= F.pow(F.lit(2.0), F.least(low + 2, F.lit(1023.0)))).cast("int")
    e = F.least(e, F.lit(1023.0))
    parts = a / F.pow(F.lit(2.0), e) * F.lit(float(1 << 52))  # exact: powers of two
    bits = (e + 1022).cast("long") * F.lit(1 << 52) + parts.cast("long")
    bits = F.when(a == 0, F.lit(0)).when(a == float("inf"), F.lit(_INF)).otherwise(bits).cast("long")
    return F.when(v.isNull(), F.lit(None).cast("long")).when(F.isnan(v), F.lit(_INF + 1)).when(v < 0, -bits).otherwise(bits)


def value_of(key: int) -> float:
    """The double whose ``order_key`` is ``key``."""
    if key > _INF:
        return math.nan
    return math.copysign(struct.unpack("<d", struct.pack("<q", abs(key)))[0], key or 1)


def interpolated(at: dict, n: int, p: float) -> float:
    """The p-quantile from the order statistics ``at`` {rank: value}."""
    h = p * (n - 1)
    lo, hi = math.floor(h), math.ceil(h)
    return at[lo] if lo == hi else at[lo] + (h - lo) * (at[hi] - at[lo])


def interpolation_ranks(n: int, ps) -> set[int]:
    return {r for p in ps for r in (math.floor(p * (n - 1)), math.ceil(p * (n - 1)))}


def select_ranks(df: DataFrame, columns: dict[str, Column], ranks_for, range_target: int = RANGE_TARGET,
                 weight: str | None = None) -> tuple[dict, dict]:
    """Order statistics of several columns (NULLs left out).  ``weight``: a column that
    says for how many rows a row stands.

    ``ranks_for(name, n)`` gives the 0-based ranks wanted of a column with
    ``n`` values.  Returns ``({(name, rank): value}, {name: n})``.  Each pass reads
    ``df`` once: two passes as a rule, four at most."""
    names = list(columns)
    rows = F.count(F.lit(1)) if weight is None else F.sum("_w")
    keyed = df.select(*[order_key(c).alias(f"_k{i}") for i, c in enumerate(columns.values())], (F.lit(1) if weight is None else F.col(weight)).alias("_w"))
    bits = KEY_BITS - DIGIT
    # wanted[i]: the prefixes (keys without their last ``bits`` bits) to go into; None: all
    wanted: list = [None] * len(names)
    open_ranks: dict = {}  # (i, rank) -> (prefix, values before it)
    ns: dict = {}
    done: dict = {}
    shift = KEY_BITS  # bits below the prefixes in ``wanted``
    while True:
        part = []
        for i in range(len(names)):
            k = F.col(f"_k{i}")
            if wanted[i] is not None:
                if not wanted[i]:
                    continue
                k = F.when(F.shiftright(k, shift).isin(sorted(wanted[i])), k)
            part.append(F.struct(F.lit(i).alias("i"), F.shiftright(k, bits).alias("b") if bits else k.alias("b")))
        counts = (keyed.select(F.explode(F.array(*part)).alias("x"), "_w").select("x.i", "x.b", "_w").where(F.col("b").isNotNull())
                  .groupBy("i", "b").agg(rows.alias("n")).collect())
        by: dict = {}
        for r in counts:
            by.setdefault(r["i"], []).append((r["b"], r["n"]))
        if wanted[0] is None and not ns:
            ns = {names[i]: sum(n for _, n in bins) for i, bins in by.items()}
            open_ranks = {(i, int(r)): (None, 0) for i in by for r in ranks_for(names[i], ns[names[i]])}
        fuller = 0
        nxt: dict = {}
        for (i, rank), (prefix, before) in open_ranks.items():
            for b, n in sorted(by[i]):
                if prefix is not None and b >> (shift - bits) != prefix:
                    continue
                if rank < before + n:
                    if bits:
                        nxt[(i, rank)] = (b, before)
                        fuller = max(fuller, n)
                    else:
                        done[(names[i], rank)] = value_of(b)
                    break
                before += n
        if not bits or not nxt:
            return done, ns
        open_ranks, shift = nxt, bits
        wanted = [{p for (j, _), (p, _) in nxt.items() if j == i} for i in range(len(names))]
        bits = 0 if fuller <= min(range_target, 1 << DIGIT) else bits - DIGIT


def column_quantiles(df: DataFrame, cols: list[str], ps: list[float], range_target: int = RANGE_TARGET,
                     weight: str | None = None) -> dict:
    """Exact interpolated p-quantiles of several columns, as driver scalars
    (``{col: [q for p in ps]}``; None for a column without values).  ``weight``: see ``select_ranks``."""
    at, ns = select_ranks(df, {c: F.col(f"`{c}`") for c in cols}, lambda name, n: interpolation_ranks(n, ps), range_target, weight)
    out = {}
    for c in cols:
        n = ns.get(c, 0)
        own = {r: v for (name, r), v in at.items() if name == c}
        out[c] = [interpolated(own, n, p) if n else None for p in ps]
    return out


def kth_smallest(df: DataFrame, group: str, value: str, ks: dict) -> dict:
    """Per group value of ``ks``, the k-th smallest (1-based) of a numeric
    column: ``{group_value: value}``."""
    want = {str(g): k for g, k in ks.items() if k > 0}
    if not want:
        return {g: None for g in ks}
    columns = {g: F.when(F.col(group).cast("string") == g, F.col(value).cast("double")) for g in want}
    at, _ = select_ranks(df, columns, lambda name, n: [want[name] - 1] if want[name] <= n else [])
    return {g: at.get((str(g), k - 1)) for g, k in ks.items()}


# ---- quantiles per group ------------------------------------------------------

def large_groups(df: DataFrame, keys: list[str], range_target: int = RANGE_TARGET) -> DataFrame:
    """The groups of more than ``range_target`` rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > range_target).select(*keys)


def grouped_quantiles(df: DataFrame, keys: list[str], cols: list[str], p: float = 0.5,
                      suffix: str = "", range_target: int | None = None) -> DataFrame:
    """One row per group with the exact p-quantile of each column (NULLs
    skipped; all-NULL group -> NULL).  Output columns ``<col><suffix>``.

    Groups up to ``range_target`` rows: one aggregate.  Whether there are
    larger ones is asked while this is called; those are selected by passes."""
    target = range_target or RANGE_TARGET
    plain = [F.percentile(F.col(c).cast("double"), F.lit(p)).alias(c + suffix) for c in cols]
    large = large_groups(df, keys, target)
    if large.isEmpty():
        return df.groupBy(*keys).agg(*plain)
    checkpoint_dir(df.sparkSession)
    large = large.select(*[F.col(k).alias(f"_l{i}") for i, k in enumerate(keys)]).checkpoint(eager=True)
    same = [F.col(k).eqNullSafe(F.col(f"_l{i}")) for i, k in enumerate(keys)]
    small = df.join(large, same, "left_anti").groupBy(*keys).agg(*plain)
    rows = df.join(large, same, "left_semi").select(*keys, *cols)
    return small.unionByName(_radix_groups(rows, keys, cols, p, suffix, target))


def _radix_groups(df: DataFrame, keys: list[str], cols: list[str], p: float, suffix: str, target: int) -> DataFrame:
    """Quantiles of large groups, all of them in the same passes."""
    parts = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in cols]))
    long = df.select(*keys, parts.alias("x")).select(*keys, F.col("x.name").alias("_name"), F.col("x.v").alias("_v"))
    # a group is one number, so that NULL keys need no care in joins
    g = F.xxhash64(*keys)
    rows = long.where(F.col("_v").isNotNull()).withColumn("_k", order_key(F.col("_v"))).withColumn("_g", g).checkpoint(eager=True)
    groups = df.select(*keys).distinct().withColumn("_g", g)
    totals = rows.groupBy("_g", "_name").agg(F.count(F.lit(1)).alias("_n"))
    h = F.lit(p) * (F.col("_n") - 1)
    wanted = totals.select("_g", "_name", F.explode(F.array_distinct(F.array(F.floor(h), F.ceil(h)))).alias("_rank"),
                           F.lit(None).cast("long").alias("_prefix"), F.lit(0).cast("long").alias("_before")).checkpoint(eager=True)
    bits, found = KEY_BITS - DIGIT, None
    pending = rows.select("_g", "_name", "_k", "_v", F.lit(None).cast("long").alias("_prefix"))
    while True:
        counts = pending.groupBy("_g", "_name", "_prefix", F.shiftright("_k", bits).alias("_b") if bits else F.col("_k").alias("_b")).agg(F.count(F.lit(1)).alias("_c"))
        upto = F.sum("_c").over(Window.partitionBy("_g", "_name", "_prefix").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))
        ranked = counts.withColumn("_upto", upto)
        w = wanted.select(F.col("_g").alias("_wg"), F.col("_name").alias("_wname"), F.col("_prefix").alias("_wprefix"), "_rank", "_before")
        hit = (ranked.join(w, (F.col("_g") == F.col("_wg")) & (F.col("_name") == F.col("_wname")) & F.col("_prefix").eqNullSafe(F.col("_wprefix")))
               .where((F.col("_rank") < F.col("_before") + F.col("_upto")) & (F.col("_rank") >= F.col("_before") + F.col("_upto") - F.col("_c")))
               .select("_g", "_name", "_rank", F.col("_b").alias("_prefix"), (F.col("_before") + F.col("_upto") - F.col("_c")).alias("_before"), "_c")
               .checkpoint(eager=True))
        if not bits:
            found = hit if found is None else found.unionByName(hit)
            break
        # few rows left in a bucket: the next pass counts whole values
        wanted = hit.drop("_c")
        small = (hit.agg(F.max("_c")).first()[0] or 0) <= target
        next_bits = 0 if small else bits - DIGIT
        chosen = hit.select("_g", "_name", "_prefix").distinct()
        pending = (rows.select("_g", "_name", "_k", "_v", F.shiftright("_k", bits).alias("_prefix"))
                   .join(chosen, ["_g", "_name", "_prefix"], "left_semi").checkpoint(eager=True))
        bits = next_bits
    # a value again from its key: no arithmetic on keys is needed, the rows have both
    exact = found.select("_g", "_name", "_rank", F.col("_prefix").alias("_k"))
    values = pending.join(exact.select("_g", "_name", "_k").distinct(), ["_g", "_name", "_k"], "left_semi")
    values = exact.join(values.groupBy("_g", "_name", "_k").agg(F.max("_v").alias("_v")), ["_g", "_name", "_k"])
    at = values.join(totals, ["_g", "_name"])
    lo = F.max(F.when(F.col("_rank") == F.floor(h), F.col("_v")))
    hi = F.max(F.when(F.col("_rank") == F.ceil(h), F.col("_v")))
    q = at.groupBy("_g", "_name").agg(lo.alias("_lo"), hi.alias("_hi"), F.first(h - F.floor(h)).alias("_f"))
    q = q.withColumn("_q", F.when(F.col("_f") == 0, F.col("_lo")).otherwise(F.col("_lo") + F.col("_f") * (F.col("_hi") - F.col("_lo"))))
    wide = q.groupBy("_g").agg(*[F.max(F.when(F.col("_name") == c, F.col("_q"))).alias(c + suffix) for c in cols])
    return groups.join(wide, "_g", "left").drop("_g")
