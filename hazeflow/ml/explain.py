"""Contributions of the inputs to a prediction."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.once import compute_once
from ..schema import LABEL_COL
from .metrics import regression_metrics

BUCKETS = 64


def linear_shap(df: DataFrame, train: DataFrame, coefficients: dict[str, float]) -> DataFrame:
    """Shapley values of a linear model: coefficient * (x - mean of x), exact."""
    means = train.agg(F.struct(*[F.avg(c).alias(c) for c in coefficients]).alias("means")).scalar()
    mean = F.col("_means")
    shares = {f"shap_{c}": F.lit(float(w)) * (F.col(c) - mean.getField(c)) for c, w in coefficients.items()}
    return compute_once(df, {"_means": means}).withColumns(shares).drop("_means")


def scaled_coefficients(model: PipelineModel, cols: list[str]) -> dict[str, float]:
    """Coefficients of a ridge pipeline by (scaled) input; the inputs have mean zero."""
    fitted = dict(zip(model.stages[-2].getInputCols(), model.stages[-1].coefficients.toArray().tolist()))
    return {c: fitted.get(f"z_{c}", 0.0) for c in cols}


def tree_importance(model: PipelineModel, cols: list[str]) -> dict[str, float]:
    return dict(zip(cols, model.stages[-1].featureImportances.toArray().tolist()))


def permutation_importance(model: PipelineModel, df: DataFrame, cols: list[str], seed: int = 7, buckets: int = BUCKETS) -> DataFrame:
    """(feature, r2_drop): loss of R2 when one input is permuted, for all inputs in one job.

    All rows form one ring in the order of a hash of their key, and each takes the input of
    the next. Buckets are stretches of that order: within one the next row is near, and the last
    row of a bucket gets the first of the following one from a summary with a row
    per bucket. So the result does not depend on the number of buckets. Each row is then
    scored once as it is and once per input.
    """
    order = F.struct(F.xxhash64("city", "timestamp", F.lit(seed)).alias("h"), "city", "timestamp")
    width = F.lit(float(2**64 // buckets + 1))
    rows = df.withColumns({"_order": order, "_values": F.struct(*cols)}).withColumn(
        "_bucket", F.floor((F.col("_order.h").cast("double") + F.lit(float(2**63))) / width)
    )
    heads = rows.groupBy("_bucket").agg(F.min_by("_values", "_order").alias("_head"))
    along = W.orderBy("_bucket")
    first = F.first("_head").over(along.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    next_head = heads.select("_bucket", F.coalesce(F.lead("_head").over(along), first).alias("_next"))
    ring = W.partitionBy("_bucket").orderBy("_order")
    shuffled = rows.withColumn("_lead", F.lead("_values").over(ring)).join(next_head, "_bucket").withColumn(
        "_other", F.coalesce("_lead", "_next")
    )
    versions = [F.struct(F.lit("").alias("feature"), *[F.col(c).alias(c) for c in cols])]
    for replaced in cols:
        versions.append(
            F.struct(
                F.lit(replaced).alias("feature"),
                *[(F.col("_other").getField(c) if c == replaced else F.col(c)).alias(c) for c in cols],
            )
        )
    exploded = shuffled.select("city", "timestamp", LABEL_COL, F.explode(F.array(*versions)).alias("v")).select(
        "city", "timestamp", LABEL_COL, "v.*"
    )
    by_feature = regression_metrics(model.transform(exploded), LABEL_COL, by=["feature"])
    # One row per input and one for the unchanged rows.
    whole = F.max(F.when(F.col("feature") == "", F.col("r2"))).over(W.partitionBy())
    return by_feature.select("feature", (whole - F.col("r2")).alias("r2_drop")).where("feature <> ''")
