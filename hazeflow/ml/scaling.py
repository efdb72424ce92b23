"""Standardisation with population statistics of the training part."""

from __future__ import annotations

from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.missing import nan_to_null
from ..operators.once import compute_once
from ..schema import LABEL_COL, LEAKY_COLS, MODEL_COLS


def model_columns(exclude_leaky: bool = False) -> list[str]:
    return [c for c in MODEL_COLS if not (exclude_leaky and c in LEAKY_COLS)]


def scaler_stats(train: DataFrame, cols: list[str]) -> DataFrame:
    """(column, mean, std) in one pass; std is the population value."""
    moments = train.agg(
        *[F.avg(c).alias(f"mean_{c}") for c in cols], *[F.stddev_pop(c).alias(f"std_{c}") for c in cols]
    )
    rows = [
        F.struct(F.lit(c).alias("column"), F.col(f"mean_{c}").alias("mean"), F.col(f"std_{c}").alias("std"))
        for c in cols
    ]
    return moments.select(F.explode(F.array(*rows)).alias("s")).select("s.*")


def standard_scale(df: DataFrame, train: DataFrame, cols: list[str]) -> DataFrame:
    """Replace ``cols`` by (x - mean) / std of the training part; a constant column becomes 0.

    The statistics enter as a scalar subquery: one aggregation, then a plain
    projection without a join.
    """
    stats = train.agg(F.struct(
        *[F.avg(c).alias(f"mean_{c}") for c in cols],
        *[F.coalesce(F.nullif(F.stddev_pop(c), F.lit(0.0)), F.lit(1.0)).alias(f"std_{c}") for c in cols],
    ).alias("stats")).scalar()
    known = F.col("_stats")
    scaled = {c: (F.col(c) - known.getField(f"mean_{c}")) / known.getField(f"std_{c}") for c in cols}
    return compute_once(df, {"_stats": stats}).withColumns(scaled).drop("_stats")


def fit_scaler(train: DataFrame, cols: list[str]) -> tuple[SQLTransformer, list[str]]:
    """A stage with the fitted statistics written into it, saved with the model, and the inputs that vary."""
    stats = {r["column"]: (r["mean"], r["std"]) for r in scaler_stats(train, cols).collect()}
    scaled = ", ".join(f"(`{c}` - {m or 0.0!r}D) / {s or 1.0!r}D AS `z_{c}`" for c, (m, s) in stats.items())
    return SQLTransformer(statement=f"SELECT *, {scaled} FROM __THIS__"), [c for c in cols if stats[c][1]]


def assembler(cols: list[str], scaled: bool = True, handle_invalid: str = "skip") -> VectorAssembler:
    """Trainers skip rows with a missing input (see ``count_incomplete``); scoring keeps them, see ``score_with``."""
    inputs = [f"z_{c}" for c in cols] if scaled else cols
    return VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid=handle_invalid)


def count_incomplete(df: DataFrame, cols: list[str]) -> DataFrame:
    missing = F.lit(False)
    for c in cols:
        missing = missing | F.col(c).isNull()
    return df.agg(F.count_if(missing).alias("n_incomplete"))


def design_matrix(df: DataFrame, cols: list[str] = MODEL_COLS, label: str = LABEL_COL) -> DataFrame:
    """Key, ``features`` vector and ``label`` of every row; a missing input is NaN in the vector."""
    return assembler(cols, scaled=False, handle_invalid="keep").transform(df).select("city", "timestamp", "features", F.col(label).alias("label"))


def design_columns(matrix: DataFrame, cols: list[str] = MODEL_COLS) -> DataFrame:
    """The vector laid out again as one column per input; missing inputs are NULL."""
    values = matrix.withColumn("_x", vector_to_array("features"))
    return values.select("city", "timestamp", *[nan_to_null(F.col("_x")[i]).alias(c) for i, c in enumerate(cols)], "label")
