"""A small neural regressor, trained data-parallel with parameter averaging.

Each round every partition continues from the common parameters over its own
rows in minibatches (Adam), and the results are averaged, weighted by rows
(Zinkevich et al., 2010). The rows stay where they are; per round one vector
of fixed length travels each way. The same pass measures the common parameters on the
validation rows, so a round is one job.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import KEY_COLS, LABEL_COL
from .split import hash_bucket

# Network and training settings.
HIDDEN = (64, 32)
DROPOUT = 0.2
BATCH = 32
MAX_EPOCHS = 100
PATIENCE = 10
VALIDATION_PERCENT = 20
ADAM = {"lr": 0.001, "beta1": 0.9, "beta2": 0.999, "eps": 1e-7}

#: Copies of the network that are trained side by side and averaged each round.
REPLICAS = 2


def layer_shapes(n_inputs: int) -> list[tuple[int, int]]:
    sizes = [n_inputs, *HIDDEN, 1]
    return list(zip(sizes[:-1], sizes[1:]))


def unpack(flat: np.ndarray, n_inputs: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Views of weights and biases into the flat vector."""
    layers, at = [], 0
    for rows, cols in layer_shapes(n_inputs):
        w = flat[at : at + rows * cols].reshape(rows, cols)
        at += rows * cols
        layers.append((w, flat[at : at + cols]))
        at += cols
    return layers


def initial_parameters(n_inputs: int, seed: int) -> np.ndarray:
    """Glorot uniform weights, zero biases."""
    rng = np.random.default_rng(seed)
    parts = []
    for rows, cols in layer_shapes(n_inputs):
        limit = np.sqrt(6.0 / (rows + cols))
        parts += [rng.uniform(-limit, limit, rows * cols), np.zeros(cols)]
    return np.concatenate(parts)


def forward(flat: np.ndarray, x: np.ndarray) -> np.ndarray:
    layers = unpack(flat, x.shape[1])
    for w, b in layers[:-1]:
        x = np.maximum(x @ w + b, 0.0)
    w, b = layers[-1]
    return (x @ w + b)[:, 0]


def gradient(flat: np.ndarray, x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Of the mean squared error, with inverted dropout on the hidden layers."""
    layers = unpack(flat, x.shape[1])
    inputs, masks = [x], []
    for w, b in layers[:-1]:
        z = inputs[-1] @ w + b
        mask = (z > 0) * (rng.random(z.shape) >= DROPOUT) / (1.0 - DROPOUT)
        masks.append(mask)
        inputs.append(z * mask)
    w, b = layers[-1]
    delta = 2.0 * (inputs[-1] @ w + b - y[:, None]) / len(y)
    grads = []
    for i in reversed(range(len(layers))):
        grads.append(delta.sum(axis=0))
        grads.append((inputs[i].T @ delta).ravel())
        if i:
            delta = (delta @ layers[i][0].T) * masks[i - 1]
    return np.concatenate(grads[::-1])


@dataclass
class NeuralModel:
    """Fitted parameters; scoring is a vectorised function of an array column."""

    parameters: np.ndarray
    n_inputs: int
    history: list[float] = field(default_factory=list)

    def predict(self, inputs: Column) -> Column:
        parameters = self.parameters

        @F.pandas_udf("double")
        def run(batch: pd.Series) -> pd.Series:
            return pd.Series(forward(parameters, np.stack(batch.to_numpy())) if len(batch) else [], dtype="float64")

        return run(inputs)


@dataclass
class NeuralUnit:
    """A fitted network with its scaler: saved, registered and applied as one, like a pipeline."""

    scaler: SQLTransformer
    model: NeuralModel
    inputs: list[str]

    #: Nothing that would have to be told to keep rows: a missing input gives a NULL prediction here.
    stages = ()

    def transform(self, df: DataFrame) -> DataFrame:
        known = F.lit(True)
        for c in self.inputs:
            known = known & F.col(c).isNotNull()
        scaled = [F.coalesce(F.col(f"z_{c}"), F.lit(0.0)) for c in self.inputs]
        out = self.scaler.transform(df).withColumn("prediction", self.model.predict(F.array(*scaled)))
        return out.withColumn("prediction", F.when(known, F.col("prediction"))).drop(*[f"z_{c}" for c in self.inputs])

    def save(self, spark: SparkSession, path: str) -> None:
        """Parameters and names as a one-row table beside the scaler; nothing is overwritten."""
        row = [(self.inputs, self.model.parameters.tolist(), [float(x) for x in self.model.history])]
        spark.createDataFrame(row, NEURAL_SCHEMA).coalesce(1).write.parquet(f"{path}/network")
        self.scaler.write().save(f"{path}/scaler")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> NeuralUnit:
        row = spark.read.schema(NEURAL_SCHEMA).parquet(f"{path}/network").first()
        model = NeuralModel(np.array(row.parameters), len(row.inputs), list(row.history))
        return cls(SQLTransformer.load(f"{path}/scaler"), model, list(row.inputs))


NEURAL_SCHEMA = "inputs array<string>, parameters array<double>, history array<double>"


class _Steps:
    """Adam on minibatches of the mean squared error, with inverted dropout on the hidden layers: ``gradient`` and the update, in place."""

    def __init__(self, state: np.ndarray, n_inputs: int, step: int, rng: np.random.Generator) -> None:
        self.flat, self.m, self.v = (x.copy() for x in np.split(state, 3))
        self.t, self.rng = step, rng
        self.g, self.a, self.b = (np.empty_like(self.flat) for _ in range(3))
        self.layers, self.slopes = unpack(self.flat, n_inputs), unpack(self.g, n_inputs)

    def take(self, x: np.ndarray, y: np.ndarray) -> None:
        inputs, masks = [x], []
        for w, bias in self.layers[:-1]:
            z = inputs[-1] @ w
            z += bias
            masks.append((z > 0) * (self.rng.random(z.shape) >= DROPOUT) / (1.0 - DROPOUT))
            z *= masks[-1]
            inputs.append(z)
        w, bias = self.layers[-1]
        delta = inputs[-1] @ w
        delta += bias
        delta -= y[:, None]
        delta *= 2.0
        delta /= len(y)
        for i in reversed(range(len(self.layers))):
            delta.sum(axis=0, out=self.slopes[i][1])
            np.matmul(inputs[i].T, delta, out=self.slopes[i][0])
            if i:
                delta = delta @ self.layers[i][0].T
                delta *= masks[i - 1]
        self._update()

    def _update(self) -> None:
        self.t += 1
        g, m, v, a, b = self.g, self.m, self.v, self.a, self.b
        m *= ADAM["beta1"]
        m += np.multiply(g, 1 - ADAM["beta1"], out=a)
        np.multiply(g, 1 - ADAM["beta2"], out=a)
        a *= g
        v *= ADAM["beta2"]
        v += a
        np.divide(v, 1 - ADAM["beta2"] ** self.t, out=a)
        np.sqrt(a, out=a)
        a += ADAM["eps"]
        np.divide(m, 1 - ADAM["beta1"] ** self.t, out=b)
        b *= ADAM["lr"]
        b /= a
        self.flat -= b


def _round(state: np.ndarray, step: int, seed: int, n_inputs: int):
    """One pass over a partition: measure, then train; emits one summed vector."""
    size = (len(state)) // 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng([seed, step, TaskContext.get().partitionId()])
        shared, steps = state[:size], _Steps(state, n_inputs, step, rng)
        n_train, n_valid, squared = 0, 0, 0.0
        for batch in batches:
            *x, y, held = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            x = np.stack(x, axis=1)
            if held.any():
                squared += float(((forward(shared, x[held]) - y[held]) ** 2).sum())
                n_valid += int(held.sum())
            x, y = x[~held], y[~held]
            order = rng.permutation(len(y))
            x, y = x[order], y[order]
            for lo in range(0, len(y), BATCH):
                steps.take(x[lo : lo + BATCH], y[lo : lo + BATCH])
            n_train += len(y)
        took = steps.t - step
        sums = np.concatenate([n_train * np.concatenate([steps.flat, steps.m, steps.v]), [n_train, n_train * took, n_valid, squared]])
        yield pa.RecordBatch.from_arrays([pa.array([sums], pa.list_(pa.float64()))], names=["sums"])

    return run


def fit_neural(
    train: DataFrame, inputs: list[str], replicas: int = REPLICAS, seed: int = 42, max_epochs: int = MAX_EPOCHS
) -> NeuralModel:
    """Train on scaled input columns; stops early and keeps the best parameters.

    ``replicas`` is a setting of the training, like the size of a minibatch: it is
    never derived from the number of rows. Set it to the cluster's cores for large tables.
    """
    data = (
        train.select(
            *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(inputs)],
            F.col(LABEL_COL).cast("double").alias("y"),
            (hash_bucket(KEY_COLS, seed + 2, 100) < VALIDATION_PERCENT).alias("held_out"),
            F.xxhash64(*KEY_COLS).alias("_place"),
        )
        .repartition(replicas, "_place")
        .drop("_place")
        .persist()
    )
    n_inputs = len(inputs)
    start = initial_parameters(n_inputs, seed)
    state = np.concatenate([start, np.zeros(2 * len(start))])
    best, best_loss, waited, history, step = start, np.inf, 0, [], 0
    try:
        # One round more than there are epochs: it measures the last parameters.
        for epoch in range(max_epochs + 1):
            sums = data.mapInArrow(_round(state, step, seed + epoch, n_inputs), "sums array<double>")
            total = sums.select(F.posexplode("sums").alias("i", "s")).groupBy("i").agg(F.sum("s").alias("s"))
            vector = np.empty(len(state) + 4)
            for row in total.collect():
                vector[row["i"]] = row["s"]
            n_train, steps, n_valid, squared = vector[-4:]
            if epoch:
                loss = squared / max(n_valid, 1)
                history.append(loss)
                if loss < best_loss:
                    best, best_loss, waited = state[: len(start)].copy(), loss, 0
                else:
                    waited += 1
                    if waited >= PATIENCE:
                        break
            state = vector[:-4] / max(n_train, 1)
            step += int(round(steps / max(n_train, 1)))
    finally:
        data.unpersist()
    return NeuralModel(best, n_inputs, history)
