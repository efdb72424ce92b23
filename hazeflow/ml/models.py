"""Estimators with the reference settings, and the train-evaluate job."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import LABEL_COL
from .metrics import METRICS, regression_metrics
from .scaling import assembler, fit_scaler, model_columns

# Model settings.
RIDGE_ALPHA = 1.0
FOREST = {"numTrees": 200, "seed": 42}
BOOSTED = {"maxIter": 100, "stepSize": 0.1, "maxDepth": 5, "seed": 42}

#: Unlimited depth; the deepest tree MLlib grows.
DEEPEST = 30
#: Threshold candidates per input; enough that calendar inputs keep all their values.
BINS = 128


def ridge(train: DataFrame, alpha: float = RIDGE_ALPHA) -> LinearRegression:
    """Ridge with penalty ``alpha * |w|^2`` on the sum of squares.

    MLlib minimises the mean squared error on a label it has scaled by its
    standard deviation, so the same penalty is alpha * std(y) / n there.
    """
    y = train.agg(F.stddev_pop(LABEL_COL).alias("std"), F.count(LABEL_COL).alias("n")).first()
    return LinearRegression(
        labelCol=LABEL_COL,
        elasticNetParam=0.0,
        standardization=False,
        solver="normal",
        regParam=alpha * (y["std"] or 0.0) / max(y["n"], 1),
    )


def random_forest(**overrides) -> RandomForestRegressor:
    # Node ids are kept with the rows, so that deep trees are not sent out again at each level.
    settings = {"featureSubsetStrategy": "all", "maxDepth": DEEPEST, "maxBins": BINS, "cacheNodeIds": True, **FOREST}
    return RandomForestRegressor(labelCol=LABEL_COL, maxMemoryInMB=1024, **{**settings, **overrides})


def boosted_trees(**overrides) -> GBTRegressor:
    return GBTRegressor(labelCol=LABEL_COL, maxMemoryInMB=1024, **{"maxBins": BINS, **BOOSTED, **overrides})


def usable(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows with a label and all inputs."""
    return df.dropna(subset=[*cols, LABEL_COL])


def fit(train: DataFrame, estimator, scaled: bool, cols: list[str] | None = None) -> PipelineModel:
    """Scaler (if any), assembler and estimator as one saved unit that scores raw rows.

    A linear model gets only the inputs that vary: the others have coefficient 0,
    and would make its normal equations singular.
    """
    cols, stages = cols or model_columns(), []
    if scaled:
        scaler, varying = fit_scaler(train, cols)
        stages, cols = [scaler], varying if isinstance(estimator, LinearRegression) else cols
    return Pipeline(stages=[*stages, assembler(cols, scaled), estimator]).fit(train)


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Keys, label and ``prediction``."""
    return model.transform(df).select("city", "timestamp", LABEL_COL, "prediction")


def evaluate(model: PipelineModel, test: DataFrame) -> DataFrame:
    return regression_metrics(score(model, test), LABEL_COL)


def train_and_evaluate(train: DataFrame, test: DataFrame, kind: str, exclude_leaky: bool = False, **overrides):
    """(model, metrics dict) of one kind: ridge, forest or boosted."""
    cols = model_columns(exclude_leaky)
    train = usable(train, cols)
    if kind == "ridge":
        model = fit(train, ridge(train, **overrides), True, cols)
    elif kind == "forest":
        model = fit(train, random_forest(**overrides), True, cols)
    elif kind == "boosted":
        model = fit(train, boosted_trees(**overrides), False, cols)
    else:
        raise ValueError(f"unknown kind of model: {kind}")
    row = evaluate(model, test).first()
    return model, {m: row[m] for m in METRICS}
