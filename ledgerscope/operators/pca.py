"""Principal components with MLlib (distributed d x d Gramian).

MLlib's ``PCAModel.transform`` does not centre; distances do not care, the
2-D projection subtracts the projected mean.  Component signs are fixed so
that each component's largest-magnitude loading is positive."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit_pca(df: DataFrame, cols: list[str], k: int):
    """Returns (model, signed d x k loadings, explained variance)."""
    from pyspark.ml.feature import PCA, VectorAssembler
    va = VectorAssembler(inputCols=cols, outputCol="_x", handleInvalid="keep")
    model = PCA(k=k, inputCol="_x", outputCol="_pc").fit(va.transform(df))
    pc = model.pc.toArray()  # d x k
    signs = np.sign(pc[np.abs(pc).argmax(axis=0), np.arange(pc.shape[1])])
    signs[signs == 0] = 1.0
    return (model, signs), pc * signs, model.explainedVariance.toArray()


def project(df: DataFrame, cols: list[str], fitted, out: str = "v", center: bool = False) -> DataFrame:
    """Projection with the fitted MLlib model (a JVM matrix-vector product
    per row, compact plan); signs fixed per component.  ``center``
    subtracts the projected column means (for display, E9)."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    model, signs = fitted
    va = VectorAssembler(inputCols=cols, outputCol="_x", handleInvalid="keep")
    t = model.transform(va.transform(df)).drop("_x")
    sg = F.array(*[F.lit(float(x)) for x in signs])
    t = t.withColumn(out, F.transform(vector_to_array("_pc"), lambda x, i: x * sg[i])).drop("_pc")
    if center:
        k = len(signs)
        means = t.agg(*[F.avg(F.col(out)[j]).alias(f"m{j}") for j in range(k)]).first()
        mv = F.array(*[F.lit(float(means[f"m{j}"])) for j in range(k)])
        t = t.withColumn(out, F.transform(F.col(out), lambda x, i: x - mv[i]))
    return t


def pca_projection(df: DataFrame, id_col: str, cols: list[str], k: int = 2):
    """Centred k-D projection and explained-variance ratios."""
    fitted, _, evr = fit_pca(df, cols, k)
    p = project(df, cols, fitted, "_p", center=True)
    return p.select(id_col, *[F.col("_p")[j].alias(f"pc{j + 1}") for j in range(k)]), evr
