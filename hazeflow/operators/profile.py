"""Profiling of a feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import nan_to_null
from ..functions.missing import is_missing
from .quantiles import approx_quantiles, exact_quantiles, long_values

NOT_A_MEASURE = {"timestamp"}


def numeric_columns(df: DataFrame) -> list[str]:
    """Numeric columns other than the key; calendar columns and the label count."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in NOT_A_MEASURE]


def dataset_profile(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)).cast("bigint"))


def null_counts(df: DataFrame) -> DataFrame:
    """(column, null_count) for every column, in one pass."""
    counts = df.agg(*[F.count_if(is_missing(df, c)).alias(c) for c in df.columns])
    return counts.unpivot([], df.columns, "column", "null_count")


def iqr_bounds(
    df: DataFrame, cols: list[str] | None = None, approx: bool = False, k: float = 1.5, rounds: int | None = None
) -> DataFrame:
    """(column, q1, q3, lower_bound, upper_bound) per numeric column; NULLs for a column without values."""
    cols = cols or numeric_columns(df)
    probs = [0.25, 0.75]
    found = approx_quantiles(df, cols, probs) if approx else exact_quantiles(df, cols, probs, rounds=rounds)
    q = found.groupBy("column").agg(
        F.max(F.when(F.col("p") == 0.25, F.col("value"))).alias("q1"),
        F.max(F.when(F.col("p") == 0.75, F.col("value"))).alias("q3"),
    )
    names = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in cols])).alias("column"))
    spread = F.lit(k) * (F.col("q3") - F.col("q1"))
    # One row per profiled column.
    return names.join(F.broadcast(q), "column", "left").select(
        "column", "q1", "q3", (F.col("q1") - spread).alias("lower_bound"), (F.col("q3") + spread).alias("upper_bound")
    )


def iqr_outliers(
    df: DataFrame, cols: list[str] | None = None, approx: bool = False, k: float = 1.5, rounds: int | None = None
) -> DataFrame:
    """(column, outlier_count, percentage): values strictly outside the fences.

    The percentage is of all rows, those with a missing value included, and NULL
    for an empty frame.
    """
    cols = cols or numeric_columns(df)
    fences = iqr_bounds(df, cols, approx, k, rounds)
    outside = (F.col("value") < F.col("lower_bound")) | (F.col("value") > F.col("upper_bound"))
    # One row per profiled column.
    found = (
        long_values(df, cols)
        .join(F.broadcast(fences.select("column", "lower_bound", "upper_bound")), "column")
        .groupBy("column")
        .agg(F.count_if(outside).alias("n_outside"))
    )
    n_rows = df.agg(F.count(F.lit(1)).alias("n_rows")).scalar()
    names = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in cols])).alias("column"))
    return (
        names.join(F.broadcast(found), "column", "left")
        .select("column", F.coalesce("n_outside", F.lit(0).cast("bigint")).alias("outlier_count"))
        .withColumn("percentage", F.round(F.try_divide(F.lit(100.0) * F.col("outlier_count"), n_rows), 2))
    )


def correlation_matrix(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column_a, column_b, corr) for all pairs, in one pass; NULL where a column is constant.

    Each row is laid out once per column_a and aggregated against all columns, so
    that the aggregation is narrow enough to be compiled; its state is one row
    per column. Rows where either value is missing do not count for a pair.
    """
    cols = cols or numeric_columns(df)
    values = df.select(*[nan_to_null(F.col(c)).alias(c) for c in cols])
    anchors = F.explode(F.array(*[F.struct(F.lit(c).alias("column_a"), F.col(c).alias("a")) for c in cols]))
    moments = (
        values.select(*cols, anchors.alias("anchor"))
        .select(*cols, "anchor.*")
        .groupBy("column_a")
        .agg(
            *[
                m(F.col("a"), F.col(c)).alias(f"{tag}_{c}")
                for c in cols
                for tag, m in (("ab", F.regr_sxy), ("bb", F.regr_sxx), ("aa", F.regr_syy))
            ]
        )
    )

    def entry(c):
        scale = F.sqrt(F.col(f"aa_{c}") * F.col(f"bb_{c}"))
        return F.struct(F.lit(c).alias("column_b"), F.try_divide(F.col(f"ab_{c}"), scale).alias("corr"))

    pairs = moments.select("column_a", F.explode(F.array(*[entry(c) for c in cols])).alias("e"))
    return pairs.select("column_a", "e.*").where(F.col("column_a") != F.col("column_b"))


def quality_gate(df: DataFrame, label: str = "target_aqi") -> DataFrame:
    """Is the label there, numeric and known on every row?"""
    numeric = isinstance(df.schema[label].dataType, T.NumericType)
    return df.agg(
        F.coalesce(F.bool_and(~is_missing(df, label)), F.lit(True)).alias("all_present"),
        F.count(F.lit(1)).alias("n_rows"),
    ).withColumn("is_numeric", F.lit(numeric))


def hourly_axis(df: DataFrame, step_hours: int = 1) -> DataFrame:
    """Every hour from a city's first to its last row."""
    span = df.groupBy("city").agg(F.min("event_ts").alias("lo"), F.max("event_ts").alias("hi"))
    step = F.make_dt_interval(hours=F.lit(step_hours))
    return span.select("city", F.explode(F.sequence("lo", "hi", step)).alias("event_ts"))


def gap_report(df: DataFrame) -> DataFrame:
    """(city, event_ts): hours between a city's first and last row that have no row."""
    return hourly_axis(df).join(df.select("city", "event_ts"), ["city", "event_ts"], "left_anti")


__all__ = [
    "correlation_matrix",
    "dataset_profile",
    "gap_report",
    "hourly_axis",
    "iqr_bounds",
    "iqr_outliers",
    "null_counts",
    "numeric_columns",
    "quality_gate",
]
