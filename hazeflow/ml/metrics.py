"""Regression metrics and the choice among registered models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

METRICS = ["mae", "rmse", "r2"]


def regression_metrics(
    scored: DataFrame, label: str = "label", prediction: str = "prediction", by: list[str] = []
) -> DataFrame:
    """MAE, RMSE, R2 and the number of rows in one pass.

    For a constant label R2 is 1.0 if every prediction is right, else 0.0.
    """
    y, p = F.col(label), F.col(prediction)
    both = scored.where(y.isNotNull() & p.isNotNull())
    sums = both.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(y - p)).alias("mae"),
        F.avg((y - p) * (y - p)).alias("mse"),
        F.var_pop(y).alias("variance"),
    )
    constant = F.when(F.col("mse") == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    r2 = F.when(F.col("variance") > 0, F.lit(1.0) - F.try_divide(F.col("mse"), F.col("variance"))).when(
        F.col("variance") == 0, constant
    )
    return sums.select(*by, "n", "mae", F.sqrt("mse").alias("rmse"), r2.alias("r2"))


def champion_select(registry: DataFrame, metric: str = "r2", higher_is_better: bool = True) -> DataFrame:
    """The best entry per model name; the older version wins a tie, a missing metric loses."""
    score = F.col("metrics")[metric]
    order = score.desc_nulls_last() if higher_is_better else score.asc_nulls_last()
    # One row per trained model: a registry is small by nature.
    ranked = registry.withColumn("_rank", F.row_number().over(W.partitionBy("name").orderBy(order, "version")))
    return ranked.where("_rank = 1").drop("_rank")
