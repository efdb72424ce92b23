"""Batch scoring and alerts."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import aqi_category
from ..schema import MODEL_COLS


def hazard_alerts(scored: DataFrame, column: str = "prediction", threshold: float = 151.0) -> DataFrame:
    """Rows at or above the threshold, with the category; works on streams too."""
    return scored.where(F.col(column) >= threshold).select(
        "city", "timestamp", column, aqi_category(F.col(column)).alias("category")
    )


def score_with(model: PipelineModel, features: DataFrame) -> DataFrame:
    """Key and prediction of every row; NULL where an input of the model is missing. Works on streams too."""
    known = F.lit(True)
    for stage in model.stages:
        if isinstance(stage, VectorAssembler):
            stage.setHandleInvalid("keep")
            for c in stage.getInputCols():
                known = known & F.col(c).isNotNull()
    return model.transform(features).select("city", "timestamp", F.when(known, F.col("prediction")).alias("prediction"))


def unscored(features: DataFrame, cols: list[str] = MODEL_COLS) -> DataFrame:
    """Keys of the rows that get no prediction, and why: the inputs that are missing."""
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in cols]))
    found = features.select("city", "timestamp", F.concat(F.lit("missing: "), F.array_join(missing, ", ")).alias("reject_reason"))
    return found.where(F.col("reject_reason") != "missing: ")


def forecast(features: DataFrame, models: dict[int, PipelineModel]) -> DataFrame:
    """One row per feature row and horizon: the label expected h hours later."""
    parts = [
        score_with(model, features).select("city", "timestamp", F.lit(h).alias("horizon_h"), "prediction")
        for h, model in sorted(models.items())
    ]
    return reduce(DataFrame.unionByName, parts)
