"""Evaluation tables.  Everything reduces to small aggregates:
the 2x2 matrix is one pass of four conditional counts; ROC / AUC use the
distinct-score table with a two-level (range, then within-range)
cumulative count, so no step sorts the whole column in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope.session import checkpoint_dir

_D = 6


def _cells(actual: str, pred: str):
    a, p = F.col(actual).cast("int"), F.col(pred).cast("int")
    return [F.sum(((a == x) & (p == y)).cast("long")).alias(f"c{x}{y}") for x in (0, 1) for y in (0, 1)]


def confusion_counts(df: DataFrame, actual: str, pred: str, by: list[str] | None = None) -> DataFrame:
    """One row (per group) with tn=c00, fp=c01, fn=c10, tp=c11 (zeros kept)."""
    g = df.groupBy(*by) if by else df
    r = g.agg(*_cells(actual, pred))
    return r.fillna(0, subset=["c00", "c01", "c10", "c11"])


def confusion_matrix(df: DataFrame, actual: str, pred: str) -> DataFrame:
    """(actual, predicted, count) for all four cells."""
    r = confusion_counts(df, actual, pred)
    return r.selectExpr("stack(4, 0, 0, c00, 0, 1, c01, 1, 0, c10, 1, 1, c11) AS (actual, predicted, count)").select(
        F.col("actual").cast("int"), F.col("predicted").cast("int"), F.col("count").cast("long"))


def _div(a, b):
    return F.coalesce(F.try_divide(a.cast("double"), F.nullif(b, F.lit(0)).cast("double")), F.lit(0.0))


def _report_rows(by: list[str]):
    tn, fp, fn, tp = (F.col(c) for c in ("c00", "c01", "c10", "c11"))
    n = tn + fp + fn + tp

    def cls(label, tp_, fp_, fn_):
        prec = _div(tp_, tp_ + fp_)
        rec = _div(tp_, tp_ + fn_)
        f1 = _div(2 * prec * rec, prec + rec)
        return prec, rec, f1, (tp_ + fn_)

    p0, r0, f0, s0 = cls("0", tn, fn, fp)
    p1, r1, f1, s1 = cls("1", tp, fp, fn)
    acc = _div(tp + tn, n)
    rows = [
        ("0", p0, r0, f0, s0),
        ("1", p1, r1, f1, s1),
        ("accuracy", F.lit(None).cast("double"), F.lit(None).cast("double"), acc, n),
        ("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n),
        ("weighted avg", _div(p0 * s0 + p1 * s1, n), _div(r0 * s0 + r1 * s1, n), _div(f0 * s0 + f1 * s1, n), n),
    ]
    return [F.struct(*[F.col(b) for b in by], F.lit(lbl).alias("label"),
                     F.round(p, _D).alias("precision"), F.round(r, _D).alias("recall"),
                     F.round(f, _D).alias("f1_score"), s.cast("long").alias("support"))
            for lbl, p, r, f, s in rows]


def classification_report(df: DataFrame, actual: str, pred: str) -> DataFrame:
    """Per class precision / recall / f1 / support, accuracy, macro and
    weighted averages; 0/0 -> 0."""
    c = confusion_counts(df, actual, pred)
    return c.select(F.explode(F.array(*_report_rows([]))).alias("r")).select("r.*")


def per_flag_report(df: DataFrame, actual: str, flags: list[str]) -> DataFrame:
    """The report for each flag column (flags stacked to long form, one
    grouped aggregate)."""
    body = ", ".join(f"'{f}', `{f}`" for f in flags)
    long = df.selectExpr(f"`{actual}` AS _actual", f"stack({len(flags)}, {body}) AS (rule, _pred)")
    c = confusion_counts(long, "_actual", "_pred", by=["rule"])
    return c.select(F.explode(F.array(*_report_rows(["rule"]))).alias("r")).select("r.*")


def score_table(df: DataFrame, label: str, score: str) -> DataFrame:
    """Distinct score -> (positives, negatives): the only input ROC needs."""
    y = F.col(label).cast("int")
    return (df.where(F.col(score).isNotNull())
              .groupBy(F.col(score).cast("double").alias("score"))
              .agg(F.sum(y).cast("long").alias("n_pos"), F.sum(1 - y).cast("long").alias("n_neg")))


def _cumulative(st: DataFrame, descending: bool) -> DataFrame:
    """Cumulative positives / negatives over distinct scores, in score order
    (inclusive of the current score), with the totals P and N.

    The score table is kept once, dealt into sorted ranges and kept again; the
    sums of a range's predecessors (one row per range) are added to the
    running sum inside it.  So the scoring plan runs once and no window sees
    more than a range."""
    checkpoint_dir(st.sparkSession)
    order = F.col("score").desc() if descending else F.col("score").asc()
    ranged = (st.checkpoint(eager=True).repartitionByRange(order).sortWithinPartitions(order)
              .withColumn("_r", F.shiftright(F.monotonically_increasing_id(), 33)).checkpoint(eager=True))
    tot = ranged.groupBy("_r").agg(F.sum("n_pos").alias("_rp"), F.sum("n_neg").alias("_rn"))
    before = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    all_of = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    off = tot.select("_r", F.coalesce(F.sum("_rp").over(before), F.lit(0)).alias("_op"),
                     F.coalesce(F.sum("_rn").over(before), F.lit(0)).alias("_on"),
                     F.sum("_rp").over(all_of).alias("P"), F.sum("_rn").over(all_of).alias("N"))
    w = Window.partitionBy("_r").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return (ranged.join(off, "_r")
                  .withColumn("cum_pos", F.col("_op") + F.sum("n_pos").over(w))
                  .withColumn("cum_neg", F.col("_on") + F.sum("n_neg").over(w))
                  .drop("_r", "_op", "_on"))


def roc_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """E5: (threshold, fpr, tpr) at each distinct score."""
    c = _cumulative(score_table(df, label, score), descending=True)
    return c.select(F.col("score").alias("threshold"),
                    F.round(_div(F.col("cum_neg"), F.col("N")), _D).alias("fpr"),
                    F.round(_div(F.col("cum_pos"), F.col("P")), _D).alias("tpr"))


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Exact tie-averaged AUC = P(score_pos > score_neg) + P(=)/2,
    NULL when only one class is present."""
    c = _cumulative(score_table(df, label, score), descending=False)
    below = F.col("cum_neg") - F.col("n_neg")  # negatives strictly below
    contrib = F.col("n_pos").cast("double") * (below + 0.5 * F.col("n_neg"))
    r = c.agg(F.sum(contrib).alias("_s"), F.sum("n_pos").alias("P"), F.sum("n_neg").alias("N"))
    auc = F.when((F.col("P") > 0) & (F.col("N") > 0), F.col("_s") / (F.col("P") * F.col("N")))
    return r.select(F.round(auc, _D).alias("roc_auc"), F.col("P").cast("long").alias("n_pos"),
                    F.col("N").cast("long").alias("n_neg"))


def score_histogram(df: DataFrame, score: str, by: str, bins: int = 50) -> DataFrame:
    """``bins``-bin histogram of ``score`` per value of ``by``, each group
    on its own min..max (max in the last bin; lo = hi -> lo-.5..hi+.5);
    empty bins are filled with 0 from a ``bins``-row grid."""
    checkpoint_dir(df.sparkSession)
    df = df.select(by, score).checkpoint(eager=True)  # read for the ranges and for the counts
    rng = df.groupBy(by).agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
    lo = F.when(F.col("_lo") == F.col("_hi"), F.col("_lo") - 0.5).otherwise(F.col("_lo"))
    hi = F.when(F.col("_lo") == F.col("_hi"), F.col("_hi") + 0.5).otherwise(F.col("_hi"))
    rng = rng.select(by, lo.alias("lo"), hi.alias("hi"))
    j = df.select(by, score).where(F.col(score).isNotNull()).join(rng, by)
    b = F.least(F.floor((F.col(score) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)).cast("int")
    counts = j.groupBy(by, b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    grid = rng.select(by, "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    out = grid.join(counts, [by, "bin"], "left").fillna(0, subset=["count"])
    width = (F.col("hi") - F.col("lo")) / bins
    return out.select(by, "bin", F.round(F.col("lo") + F.col("bin") * width, _D).alias("bin_start"),
                      F.round(F.col("lo") + (F.col("bin") + 1) * width, _D).alias("bin_end"),
                      F.col("count").cast("long").alias("count"))


def top_k(df: DataFrame, score: str, k: int, cols: list[str], tid: str = "transaction_id") -> DataFrame:
    """The k highest scores, ties by id (TakeOrderedAndProject: each
    task keeps k rows, the driver merges k * tasks)."""
    return df.orderBy(F.col(score).desc(), F.col(tid).asc()).limit(k).select(*cols)


def head_sample(df: DataFrame, n: int = 5, order: tuple[str, ...] = ("transaction_id",)) -> DataFrame:
    """T5: the first ``n`` rows in a stated order (a table's rows have none of
    their own), with all columns."""
    return df.orderBy(*order).limit(n)
