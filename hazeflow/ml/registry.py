"""Saved models and the table that lists them."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .metrics import champion_select
from .neural import NeuralUnit

NEURAL = "neural"

REGISTRY_SCHEMA = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("version", T.LongType()),
        T.StructField("algo", T.StringType()),
        T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("description", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)


def read_registry(spark: SparkSession, root: str) -> DataFrame:
    try:
        entries = spark.read.schema(REGISTRY_SCHEMA).parquet(f"{root}/entries")
        # One row per trained model: a registry is small by nature.
        made = W.partitionBy("name").orderBy("version", "created_at", "path")
        return entries.withColumn("version", F.row_number().over(made).cast("bigint")).select(*REGISTRY_SCHEMA.names)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], REGISTRY_SCHEMA)
        raise


def register_model(
    spark: SparkSession, root: str, name: str, algo: str, model: PipelineModel | NeuralUnit, metrics: dict, description: str
) -> int:
    """Save the model in a folder of its own, then append its entry; returns the version.

    An entry exists only for a model that was saved whole, and nothing is ever
    overwritten. Versions count the entries of a name in the order they were made; two writers at
    once get two entries, and readers agree on which came first.
    """
    newest = read_registry(spark, root).where(F.col("name") == name).agg(F.max("version")).first()[0]
    version = (newest or 0) + 1
    path = f"{root}/models/{name}/{uuid.uuid4().hex}"
    if algo == NEURAL:
        model.save(spark, path)
    else:
        model.write().save(path)
    entry = spark.createDataFrame(
        [(name, version, algo, {k: float(v) for k, v in metrics.items()}, description, path, None)], REGISTRY_SCHEMA
    ).withColumn("created_at", F.current_timestamp())
    entry.coalesce(1).write.mode("append").parquet(f"{root}/entries")
    return read_registry(spark, root).where(F.col("path") == path).first()["version"]


def load_champion(spark: SparkSession, root: str, name: str, metric: str = "r2") -> PipelineModel | NeuralUnit:
    best = champion_select(read_registry(spark, root).where(F.col("name") == name), metric).first()
    if best is None:
        raise LookupError(f"no registered model named {name}")
    return NeuralUnit.load(spark, best["path"]) if best["algo"] == NEURAL else PipelineModel.load(best["path"])
