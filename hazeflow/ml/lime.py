"""Local linear explanations of any model that turns columns into ``prediction``.

Around each row, inputs are moved by normal numbers times the training deviation, and a ridge fits the predictions there, near rows
counting more. All in one job: rows are exploded into their moved copies, the model scores these, sums of products per row go into the normal equations, and
those of a batch are solved at once. The moves come from a hash of key, seed and number, so a row is always explained alike.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.once import compute_once
from ..schema import KEY_COLS

SAMPLES = 500
ALPHA = 1.0
#: Width of the neighbourhood, in deviations, times the square root of the number of inputs.
WIDTH = 0.75


def move(number: Column, place: int, seed: int) -> Column:
    """A normal number of a key, a sample and an input; two inputs share the two uniform numbers behind theirs. Sample 0 stays where it is."""
    uniform = [
        (F.shiftrightunsigned(F.xxhash64(*KEY_COLS, number, F.lit(seed), F.lit(place // 2), F.lit(i)), 11).cast("double") + 0.5) / F.lit(float(1 << 53)) for i in (0, 1)
    ]
    turn = F.cos if place % 2 == 0 else F.sin
    return F.when(number == 0, F.lit(0.0)).otherwise(F.sqrt(-2.0 * F.log(uniform[0])) * turn(F.lit(2 * np.pi) * uniform[1]))


def neighbourhood(df: DataFrame, train: DataFrame, cols: list[str], samples: int = SAMPLES, seed: int = 7) -> DataFrame:
    """Every distinct (key, inputs) of ``df`` ``samples`` times: the row's own inputs ``_own_<input>``, the moves ``_z_<input>`` and the moved inputs.

    Rows with a missing input are left out.
    """
    own = df.select(*KEY_COLS, *[F.col(c).cast("double").alias(f"_own_{c}") for c in cols]).dropna(subset=[f"_own_{c}" for c in cols]).distinct()
    spread = train.agg(F.struct(*[F.coalesce(F.stddev_pop(F.col(c).cast("double")), F.lit(0.0)).alias(c) for c in cols])).scalar()
    each = compute_once(own, {"_spread": spread}).withColumn("_sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    moved = compute_once(each, {f"_z_{c}": move(F.col("_sample"), i, seed) for i, c in enumerate(cols)})
    return moved.withColumns({c: F.col(f"_own_{c}") + F.col("_spread").getField(c) * F.col(f"_z_{c}") for c in cols}).drop("_spread")


def lime(model, df: DataFrame, train: DataFrame, cols: list[str], samples: int = SAMPLES, alpha: float = ALPHA, width: float = WIDTH, seed: int = 7) -> DataFrame:
    """Keys, ``lime_<input>`` (change of the prediction per training deviation of the input), ``lime_intercept`` and ``lime_r2``, how well the line fits.

    Repeated rows are explained once; rows with a missing input or prediction have NULL. An input that does not vary in
    ``train`` has 0. A neighbourhood in which the prediction does not vary has ``lime_r2`` 1. The copies of a row are made and added up in the same
    task: what moves is one row per (key, inputs).
    """
    if samples < len(cols) + 2:
        raise ValueError("fewer samples than unknowns")
    m, z = len(cols), [F.col(f"_z_{c}") for c in cols]
    near = F.exp(-sum((x * x for x in z), F.lit(0.0)) / F.lit(2.0 * width * width * m))
    scored = model.transform(neighbourhood(df, train, cols, samples, seed)).withColumn("_w", near)
    y, w = F.col("prediction"), F.col("_w")
    pairs = [(i, j) for i in range(m) for j in range(i, m)]
    sums = [w, w * y, w * y * y, *(w * x for x in z), *(w * x * y for x in z), *(w * z[i] * z[j] for i, j in pairs)]
    by_row = scored.groupBy(*KEY_COLS, *[f"_own_{c}" for c in cols]).agg(F.array(*[F.sum(s) for s in sums]).alias("_sums"), (F.count("prediction") == samples).alias("_all"))
    names, n_sums = [*(f"lime_{c}" for c in cols), "lime_intercept", "lime_r2"], len(sums)

    @F.pandas_udf(", ".join(f"`{n}` double" for n in names))
    def solve(s: pd.Series) -> pd.DataFrame:
        nothing = np.full(n_sums, np.nan)
        s = np.stack([nothing if v is None else np.asarray(v, float) for v in s]) if len(s) else np.zeros((0, n_sums))
        s = np.where(np.isnan(s[:, :1]), 1.0, s)  # not used
        total, zs, zy = s[:, 0], s[:, 3 : 3 + m], s[:, 3 + m : 3 + 2 * m]
        mean, mean_y = zs / total[:, None], s[:, 1] / total
        gram = np.zeros((len(s), m, m))
        for at, (i, j) in enumerate(pairs):
            gram[:, i, j] = gram[:, j, i] = s[:, 3 + 2 * m + at]
        gram -= total[:, None, None] * mean[:, :, None] * mean[:, None, :]
        right = zy - zs * mean_y[:, None]
        slope = np.linalg.solve(gram + alpha * np.eye(m), right[:, :, None])[:, :, 0]
        varies = s[:, 2] - total * mean_y**2
        lost = varies - 2 * (slope * right).sum(axis=1) + np.einsum("ni,nij,nj->n", slope, gram, slope)
        flat = varies <= 1e-12 * np.maximum(s[:, 2], 1e-300)
        r2 = np.where(flat, 1.0, 1.0 - lost / np.where(flat, 1.0, varies))
        return pd.DataFrame(np.column_stack((slope, mean_y - (slope * mean).sum(axis=1), r2)), columns=names)

    own = [f"_own_{c}" for c in cols]
    told = by_row.withColumn("_told", solve(F.when(F.col("_all"), F.col("_sums")))).select(*KEY_COLS, F.when(F.col("_all"), F.col("_told")).alias("_told"))
    missing = df.select(*KEY_COLS, *[F.col(c).cast("double").alias(o) for c, o in zip(cols, own)]).where(" OR ".join(f"`{o}` IS NULL" for o in own))
    nothing = missing.select(*KEY_COLS).distinct().withColumn("_told", F.lit(None).cast(told.schema["_told"].dataType))
    return told.unionByName(nothing).select(*KEY_COLS, *[F.col("_told").getField(n).alias(n) for n in names])
