"""Ridge regression as one aggregation and a small solve."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gram_matrix(df: DataFrame, cols: list[str], label: str) -> DataFrame:
    """(row, col, value): sums of products, upper triangle, the label as the last column."""
    names = [*cols, label]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:] if (a, b) != (label, label)]
    sums = df.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}|{b}") for a, b in pairs])
    rows = [
        F.struct(F.lit(a).alias("row"), F.lit(b).alias("col"), F.col(f"`{a}|{b}`").alias("value")) for a, b in pairs
    ]
    return sums.select(F.explode(F.array(*rows)).alias("g")).select("g.*")


def ridge_from_gram(scaled_train: DataFrame, cols: list[str], label: str, alpha: float) -> tuple[dict, float]:
    """Coefficients and intercept for inputs of mean zero.

    The driver receives the gram matrix only, whose size depends on the number
    of columns and not on the rows.
    """
    gram = {(r["row"], r["col"]): r["value"] for r in gram_matrix(scaled_train, cols, label).collect()}
    intercept = scaled_train.agg(F.avg(label)).first()[0]
    k = len(cols)
    xtx, xty = np.empty((k, k)), np.empty(k)
    for i, a in enumerate(cols):
        xty[i] = gram[(a, label)]
        for j in range(i, k):
            xtx[i, j] = xtx[j, i] = gram[(a, cols[j])]
    coefficients = np.linalg.solve(xtx + alpha * np.eye(k), xty)
    return dict(zip(cols, coefficients.tolist())), float(intercept)
