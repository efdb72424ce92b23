"""Grid search with folds fixed by the row key.

Settings that differ only in the number of trees or iterations share their fits. Boosting's first n iterations are the model of n
iterations, so one fit of the largest number gives the scores of all. A forest is grown in steps: the smallest number of trees, as a fit of its own
would have them, and then the trees that the next number has more, under another seed; its prediction is the mean over all trees so far.
"""

from __future__ import annotations

from itertools import product
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import LABEL_COL
from .metrics import METRICS
from .models import DEEPEST, boosted_trees, evaluate, random_forest, usable
from .scaling import assembler, fit_scaler, model_columns
from .split import with_fold

# The search grids. No depth means unlimited.
FOREST_GRID = {"numTrees": [100, 200], "maxDepth": [15, 25, None], "minSamplesSplit": [2, 5]}
BOOSTED_GRID = {
    "maxIter": [100, 200],
    "stepSize": [0.01, 0.05, 0.1],
    "maxDepth": [3, 5, 7],
    "subsamplingRate": [0.8, 1.0],
}
FOLDS = 3


#: Number of trees or iterations: the parameter along which fits are shared.
ALONG = {"forest": "numTrees", "boosted": "maxIter"}
#: Between the seeds of a forest's steps; MLlib adds partition numbers to a seed.
SEED_STEP = 1_000_003


def _fit(estimator, ready: DataFrame, **values):
    """MLlib has no unlimited depth and no smallest split: depth 30 stands for the one, half as large a smallest leaf for the other."""
    if "minSamplesSplit" in values:
        values["minInstancesPerNode"] = max(1, values.pop("minSamplesSplit") // 2)
    if "maxDepth" in values:
        values["maxDepth"] = DEEPEST if values["maxDepth"] is None else values["maxDepth"]
    return estimator.copy({estimator.getParam(n): v for n, v in values.items()}).fit(ready)


def forest_scores(estimator, setting: dict, counts: list[int], train: DataFrame, held: DataFrame) -> list[float]:
    """R2 on ``held`` of forests of each of the rising ``counts`` of trees."""
    sums, total, before, columns = held.select("features", F.col(LABEL_COL).alias("y")), F.lit(0.0), 0, []
    for k, n in enumerate(counts):
        step = _fit(estimator, train, **setting, numTrees=n - before, seed=estimator.getSeed() + k * SEED_STEP)
        sums = step.setPredictionCol(f"step_{k}").transform(sums)
        total = total + F.col(f"step_{k}") * F.lit(float(n - before))
        before = n
        columns.append(F.sum(F.pow(F.col("y") - total / F.lit(float(n)), F.lit(2.0))).alias(f"error_{k}"))
    row = sums.agg(F.count("y").alias("n"), F.var_pop("y").alias("variance"), *columns).first()
    return [1.0 - row[f"error_{k}"] / (row["n"] * row["variance"]) for k in range(len(counts))]


def boosted_scores(estimator, setting: dict, counts: list[int], train: DataFrame, held: DataFrame) -> list[float]:
    """R2 on ``held`` after each of the rising ``counts`` of iterations of one fit."""
    errors = _fit(estimator, train, **setting, maxIter=counts[-1]).evaluateEachIteration(held, "squared")
    variance = held.agg(F.var_pop(LABEL_COL)).first()[0]
    return [1.0 - errors[n - 1] / variance for n in counts]


def grid_search(train: DataFrame, test: DataFrame, kind: str, grid: dict | None = None, parallelism: int = 4):
    """(best model, metrics on test, results): results has (parameters, mean R2) per setting.

    The best setting by mean R2 over the folds is fitted again on all of train.
    The training rows are assembled once and kept for all fits; a lost executor
    costs only the recomputation of its part.
    """
    cols = model_columns()
    scaled = kind == "forest"
    estimator = random_forest() if kind == "forest" else boosted_trees()
    grid = grid or (FOREST_GRID if kind == "forest" else BOOSTED_GRID)
    train = usable(train, cols)
    prepare = Pipeline(stages=[*([fit_scaler(train, cols)[0]] if scaled else []), assembler(cols, scaled)]).fit(train)
    ready = with_fold(prepare.transform(train), FOLDS).select("features", LABEL_COL, "fold").persist()
    along, scores_of = ALONG[kind], forest_scores if kind == "forest" else boosted_scores
    counts = sorted(set(grid.get(along, [estimator.getOrDefault(along)])))
    names = [n for n in grid if n != along]
    shared = [dict(zip(names, values)) for values in product(*(grid[n] for n in names))]

    def scores(task):
        setting, fold = task
        return scores_of(estimator, setting, counts, ready.where(F.col("fold") != fold), ready.where(F.col("fold") == fold))

    pool = ThreadPool(parallelism)
    try:
        tasks = list(product(shared, range(FOLDS)))
        by_task = pool.map(inheritable_thread_target(train.sparkSession)(scores), tasks, chunksize=1)
        results = []
        for i, setting in enumerate(shared):
            folds = by_task[i * FOLDS : (i + 1) * FOLDS]
            results += [({along: n, **setting}, sum(f[k] for f in folds) / FOLDS) for k, n in enumerate(counts)]
        best = _fit(estimator, ready, **max(results, key=lambda r: r[1])[0])
    finally:
        pool.close()
        ready.unpersist()
    prepare.stages.append(best)
    row = evaluate(prepare, test).first()
    return prepare, {m: row[m] for m in METRICS}, results
