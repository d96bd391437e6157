"""The label-free ensemble end to end.

numeric columns -> exact median imputation -> robust scaling -> isolation
forest on all scaled columns; distance space = PCA(min(10, d)) when d > 10
(for d <= 10 a full-rank PCA is a rotation, distances are unchanged, so it
is skipped) -> dynamic eps -> DBSCAN noise -> LOF -> vote.  All three
models run and two votes decide, at any number of rows.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.operators import iforest
from ledgerscope.operators.neighbours import collapse, numbered
from ledgerscope.operators.outliers import (
    EPS_K, dbscan_noise, dynamic_eps, impute_median, local_outlier_factor, lof_neighbours,
    robust_scale, to_vector_points, vote)
from ledgerscope.operators.pca import fit_pca, project
from ledgerscope.operators.quantiles import column_quantiles
from ledgerscope.session import checkpoint_dir, drop_kept, keep, shuffles_cleaned
from ledgerscope.sources.transactions import select_numeric_features

PCA_MAX = 10


@dataclass
class EnsembleResult:
    df: DataFrame
    features: list
    eps: float | None
    n_rows: int
    unique_ids: bool


def scaling(df: DataFrame, exclude=()) -> tuple[dict, int]:
    """D7 + U1 + U2: per numeric column its imputed and scaled value, as an
    expression over ``df``; and the number of rows.

    Scaling statistics are taken *after* imputation.  Without NULLs the
    two coincide, so one exact quantile pass serves both."""
    _, cols, (n, nonnull) = select_numeric_features(
        df.drop(*[c for c in exclude if c in df.columns]), with_counts=True)
    base = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in cols])
    whole = {c: F.col(f"`{c}`").cast("double") for c in cols}
    q = None
    if all(nonnull[c] == n for c in cols):
        q = column_quantiles(base, cols, [0.25, 0.5, 0.75])
    else:
        base, med = impute_median(base, cols)
        whole = {c: F.coalesce(x, F.lit(med[c])) for c, x in whole.items()}
    _, stats = robust_scale(base, cols, q)
    return {c: (x - F.lit(stats[c][0])) / F.lit(stats[c][1]) for c, x in whole.items()}, n


def prepare(df: DataFrame, id_col: str, exclude=()) -> tuple[DataFrame, list[str]]:
    """The scaled columns (``scaling``), the id column kept apart as ``_rid``."""
    scaled, _ = scaling(df, exclude)
    return _scaled_rows(df, id_col, scaled), list(scaled)


def _scaled_rows(df: DataFrame, id_col: str, scaled: dict) -> DataFrame:
    return df.select(F.col(id_col).alias("_rid"), *[x.alias(c) for c, x in scaled.items()])


def distance_points(scaled: DataFrame, cols: list[str]) -> DataFrame:
    if len(cols) > PCA_MAX:
        fitted, _, _ = fit_pca(scaled, cols, PCA_MAX)
        checkpoint_dir(scaled.sparkSession)
        # evaluate the projection once, not in every search round
        return keep(project(scaled, cols, fitted, "v").select("_rid", "v"), "projected")
    return to_vector_points(scaled, "_rid", cols)


def with_row_names(df: DataFrame, name: str = "_row", stored: bool = False) -> DataFrame:
    """``df`` with a unique name per row: a hash of all columns and the number
    of the row among those equal to it, so that names don't depend on how rows
    lie in partitions.  Equal rows are counted, one line for all of them, and laid out
    again (a negative zero as zero).  ``stored``: the counted rows are kept, names
    are made anew wherever they are read."""
    cols = [F.col(f"`{c}`") for c in df.columns]
    counted = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_copies"))
    counted = keep(counted, "rows") if stored else counted
    parts = [F.hex(F.xxhash64(F.lit(k), *cols)) for k in (0, 1)]
    laid = counted.withColumn("_nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    return laid.select(*cols, F.concat_ws(":", *parts, F.col("_nth").cast("string")).alias(name))


def _required(col: str):
    """The column, or an error for a row that a model gave no value."""
    return F.when(F.col(col).isNull(), F.raise_error(F.lit(f"a row has no {col}"))).otherwise(F.col(col)).alias(col)


VOTED = ["iforest_score", "anomaly_model_iforest", "anomaly_model_dbscan", "lof", "anomaly_model_lof", "anomaly_votes", "is_anomaly_ensemble"]


def _unique(df: DataFrame, key: str) -> bool:
    """Whether every row has a ``key`` of its own."""
    k = F.col(f"`{key}`")
    with shuffles_cleaned(df.sparkSession):
        return df.groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR k IS NULL").isEmpty()


def detect_generic(df: DataFrame, id_col: str | None = None, exclude=(),
                   n_trees: int = iforest.N_TREES) -> EnsembleResult:
    """Every input row once, with the three model flags, votes and verdict.

    ``id_col`` names a unique non-null column, by which the forest draws its
    samples.  Without one, or where ids may repeat or be NULL, leave it out:
    rows get names of their own from their contents (``with_row_names``) and
    none is lost or doubled.
    """
    checkpoint_dir(df.sparkSession)
    if id_col is None:
        df = with_row_names(df, stored=True)
    key = id_col or "_row"
    scaling_of, n = scaling(df, exclude if id_col else (*exclude, "_row"))
    scaled, cols = _scaled_rows(df, key, scaling_of), list(scaling_of)
    pts = distance_points(scaled, cols)
    g, rowmap = collapse(pts, "_rid")
    if id_col is None:
        named, g = g, numbered(g)
        drop_kept(named)
    groups = (g, rowmap)
    # one exact neighbour search serves both models: LOF's 20 neighbours
    # (self excluded) also give the 5-NN distance (self included) for eps
    nb = lof_neighbours(g, n) if n > 1 else None
    listed = nb if n > EPS_K else None
    eps, _ = dynamic_eps(pts, "_rid", groups=groups, neighbours=listed)
    # the forest's columns have names of their own: a place may be called like a column of the table
    inputs = [f"_s{i}" for i in range(len(cols))]
    rows = scaled.toDF("_rid", *inputs)
    unique = id_col is None or _unique(df, key)
    if unique and len(cols) <= PCA_MAX:
        # the place of a row is its scaled values: all follows from it, once per group, the forest's score too
        db = dbscan_noise(pts, "_rid", eps, groups=groups, neighbours=listed, per_row=False).select("gid", "anomaly_model_dbscan")
        lf = local_outlier_factor(pts, "_rid", groups=groups, neighbours=nb, per_row=False)
        found = lf.join(db, "gid").select(*[F.col(f"c{i}").alias(s) for i, s in enumerate(inputs)], "anomaly_model_dbscan", "lof", "anomaly_model_lof")
        forest = iforest.isolation_forest(rows, "_rid", inputs, n_trees=n_trees, n=n, onto=found)
        res = keep(vote(forest).select(*inputs, *VOTED), "votes")
        if nb is not None:
            nb.drop()
        drop_kept(g)
        out = df.join(res, reduce(operator.and_, [scaling_of[c] == F.col(s) for c, s in zip(cols, inputs)]), "left")
    else:
        forest = iforest.isolation_forest(rows, "_rid", inputs, n_trees=n_trees, n=n).select(
            "_rid", "iforest_score", "anomaly_model_iforest")
        db = dbscan_noise(pts, "_rid", eps, groups=groups, neighbours=listed).select("_rid", "anomaly_model_dbscan")
        lf = local_outlier_factor(pts, "_rid", groups=groups, neighbours=nb).select("_rid", "lof", "anomaly_model_lof")
        res = vote(forest.join(db, "_rid", "left").join(lf, "_rid", "left"))
        out = df.join(res, F.col(f"`{key}`") == F.col("_rid"), "left")
    models = ["anomaly_model_iforest", "anomaly_model_dbscan", "anomaly_model_lof"]
    own = [c for c in [key, *[c for c in df.columns if c != key]] if c != "_row"]
    out = out.select(*[F.col(f"`{c}`") for c in own], *[_required(c) if c in models else F.col(c) for c in VOTED])
    return EnsembleResult(out, cols, eps, n, unique)
