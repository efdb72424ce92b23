"""Shapley values of histogram trees.

What a tree predicts from some of a row's inputs is the mean over its leaves, where a split on an unknown input goes both ways
in the shares of the training rows. Every leaf is then a game of its own among the distinct inputs on its path: an input
contributes 1 or 0 when the row's value is known (does it stay within the path's bounds?) and the product of the shares when it is not. The
path weights are the coefficients of the product over inputs of (unknown + known * t): multiplied up once per leaf, and divided by one
input's factor for what that input adds. Rows and leaves with equally long paths go through this as arrays, so a batch has no loop over rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .trees import TreeModel, descend

#: Numbers of an intermediate array.
CHUNK = 1 << 20
#: Nodes whose paths are held at a time.
STRETCH = 1 << 15


class Paths:
    """Bounds of every leaf per input (lower < x <= upper), its shares, and which inputs its path asks."""

    def __init__(self, roots: np.ndarray, arrays: tuple[np.ndarray, ...], n_inputs: int) -> None:
        _, feature, threshold, left, value, weight = arrays
        node, shape = roots.astype(np.int64), (len(roots), n_inputs)
        lower, upper, share, asked = np.full(shape, -np.inf), np.full(shape, np.inf), np.ones(shape), np.zeros(shape, bool)
        leaves = []
        while len(node):
            end = left[node] < 0
            leaves.append((lower[end], upper[end], share[end], asked[end], value[node[end]]))
            node, lower, upper, share, asked = node[~end], lower[~end], upper[~end], share[~end], asked[~end]
            at, f, t, w = np.arange(len(node)), feature[node], threshold[node], weight[node]
            sides = []
            for right in (0, 1):
                child = left[node] + right
                low, up, part, seen = lower.copy(), upper.copy(), share.copy(), asked.copy()
                if right:
                    low[at, f] = np.maximum(low[at, f], t)
                else:
                    up[at, f] = np.minimum(up[at, f], t)
                # Where no row came, both sides count alike.
                part[at, f] *= np.where(w > 0, weight[child] / np.maximum(w, 1), 0.5)
                seen[at, f] = True
                sides.append((child, low, up, part, seen))
            node, lower, upper, share, asked = (np.concatenate(x) for x in zip(*sides))
        self.lower, self.upper, self.share, self.asked, self.value = (np.concatenate(x) for x in zip(*leaves))

    def by_length(self) -> Iterator[tuple[np.ndarray, ...]]:
        """(inputs, lower, upper, share, value) of the leaves that ask equally many inputs; inputs are (leaf, place on the path)."""
        length = self.asked.sum(axis=1)
        for m in np.unique(length[length > 0]):
            own = np.flatnonzero(length == m)
            inputs = np.nonzero(self.asked[own])[1].reshape(len(own), m)
            pick = lambda x: np.take_along_axis(x[own], inputs, axis=1)
            yield inputs, pick(self.lower), pick(self.upper), pick(self.share), self.value[own]


def path_shares(known: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Shapley value of each input in each leaf's game of value 1: ``known`` (rows, leaves, inputs) is 0 or 1, ``share`` (leaves, inputs)."""
    m = share.shape[1]
    p = np.zeros((*known.shape[:2], m + 1))
    p[..., 0] = 1.0
    for j in range(m):
        z, o = share[:, j, None], known[:, :, j, None]
        p[..., 1:] = p[..., 1:] * z + p[..., :-1] * o
        p[..., 0] *= z[:, 0]
    within, divisor = known > 0, np.where(share > 0, share, 1.0)
    q, total = np.zeros(known.shape), np.zeros(known.shape)
    for k in range(m - 1, -1, -1):
        # (share + t) * q = p from the top; without t it is a division. A share of 0 that is not kept adds nothing in the end.
        q = np.where(within, p[..., k + 1, None] - share * q, p[..., k, None] / divisor)
        total += q / (m * comb(m - 1, k))
    return total * (known - share)


def contributions(x: np.ndarray, arrays: tuple[np.ndarray, ...]) -> tuple[np.ndarray, float]:
    """((rows, inputs) Shapley values, what is predicted when no input is known) of a model's trees, its base apart."""
    roots, n_nodes = arrays[0], len(arrays[1])
    out, unknown, n_inputs = np.zeros(x.shape), 0.0, x.shape[1]
    size = np.diff(np.r_[roots, n_nodes])
    for number in np.split(np.arange(len(roots)), np.flatnonzero(np.diff(np.cumsum(size) // STRETCH)) + 1):
        if not len(number):
            continue
        paths = Paths(roots[number], arrays, n_inputs)
        unknown += float((paths.share.prod(axis=1) * paths.value).sum())
        for inputs, lower, upper, share, value in paths.by_length():
            m = inputs.shape[1]
            few = max(1, min(len(value), CHUNK // m))
            for a in range(0, len(value), few):
                leaf = slice(a, a + few)
                to = np.zeros((inputs[leaf].size, n_inputs))
                to[np.arange(len(to)), inputs[leaf].ravel()] = np.repeat(value[leaf], m)
                step = max(1, CHUNK // inputs[leaf].size)
                for b in range(0, len(x), step):
                    own = x[b : b + step][:, inputs[leaf]]
                    known = ((own > lower[leaf]) & (own <= upper[leaf])).astype(float)
                    out[b : b + step] += path_shares(known, share[leaf]).reshape(len(own), -1) @ to
    return out, unknown


def tree_shap(model: TreeModel, df: DataFrame) -> DataFrame:
    """``df`` with ``shap_<input>`` and ``shap_base``, which add up to the prediction.

    Rows with a missing input have NULL in all of them. No rows move; the nodes are sent to the tasks. The work of a row is the number of
    leaves times the square of the distinct inputs on a path.
    """
    shared, base = df.sparkSession.sparkContext.broadcast(model.arrays()), model.base
    names = [*(f"shap_{c}" for c in model.cols), "shap_base"]

    @F.pandas_udf(", ".join(f"`{n}` double" for n in names))
    def explain(*inputs: pd.Series) -> pd.DataFrame:
        x = np.stack([i.to_numpy(float) for i in inputs], axis=1)
        values, unknown = contributions(x, shared.value)
        table = np.concatenate((values, np.full((len(x), 1), base + unknown)), axis=1)
        table[np.isnan(x).any(axis=1)] = np.nan
        return pd.DataFrame(table, columns=names)

    told = df.drop(*names).withColumn("_shap", explain(*[F.col(c).cast("double") for c in model.cols]))
    return told.select(*[c for c in df.columns if c not in names], *[F.nanvl(F.col("_shap").getField(n), F.lit(None).cast("double")).alias(n) for n in names])


def mean_shap(explained: DataFrame, cols: list[str]) -> DataFrame:
    """(feature, mean_abs_shap): how much an input moves the prediction on average."""
    means = explained.agg(*[F.avg(F.abs(f"shap_{c}")).alias(c) for c in cols])
    return means.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("mean_abs_shap")) for c in cols]))).select("col.*")


def counted_on(model: TreeModel, df: DataFrame) -> TreeModel:
    """The model with the rows of ``df`` as those its splits are weighted by: for trees from elsewhere, or another background.

    Rows with a missing input do not count. The tasks count leaves; one number per leaf reaches the driver.
    """
    shared = df.sparkSession.sparkContext.broadcast(model.arrays())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots, feature, threshold, left, *_ = shared.value
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns], axis=1)
            for root in roots:
                leaf, n = np.unique(descend(x, root, feature, threshold, left), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int64()), pa.array(n, pa.int64())], names=["leaf", "n"])

    rows = df.select(*[F.col(c).cast("double").alias(c) for c in model.cols]).dropna()
    found = rows.mapInArrow(count, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).collect()
    left, weight = model.arrays()[3], np.zeros(len(model.nodes), np.int64)
    for r in found:
        weight[r.leaf] = r.n
    for node in range(len(left) - 1, -1, -1):
        if left[node] >= 0:
            weight[node] = weight[left[node]] + weight[left[node] + 1]
    return TreeModel(model.cols, model.base, model.nodes.assign(weight=weight))
