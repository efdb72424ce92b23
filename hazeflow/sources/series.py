"""Columnar hourly series: start, end, step and one array per measure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import nan_to_null
from ..schema import series_schema


def time_axis(start: Column, end: Column, interval: Column) -> Column:
    """Epoch seconds of a regular half-open axis [start, end)."""
    # sequence() includes its end, and would run backwards on an empty axis.
    return F.when(end > start, F.sequence(start, end - F.lit(1), interval)).otherwise(
        F.array().cast("array<bigint>")
    )


def explode_axis(df: DataFrame, keep: list[str]) -> DataFrame:
    """One row per step of each (start, end, interval) row."""
    axis = time_axis(F.col("start"), F.col("end"), F.col("interval"))
    return df.select(*keep, F.explode(axis).alias("_s")).select(
        *keep, F.timestamp_seconds("_s").alias("event_ts")
    )


def explode_series(df: DataFrame, measures: list[str]) -> DataFrame:
    """One row (city, event_ts, measures) per step; the arrays are read by name.

    An array shorter than the axis leaves NULLs at its end.
    """
    axis = time_axis(F.col("start"), F.col("end"), F.col("interval"))
    steps = df.select("city", *measures, F.posexplode(axis).alias("_i", "_s"))
    return steps.select(
        "city",
        F.timestamp_seconds("_s").alias("event_ts"),
        *[nan_to_null(F.get(F.col(m), F.col("_i"))).alias(m) for m in measures],
    )


def read_series(spark: SparkSession, path: str, measures: list[str]) -> DataFrame:
    """Landed JSON lines, one series per line, with a declared schema."""
    return explode_series(spark.read.schema(series_schema(measures)).json(path), measures)


def pack_daily(df: DataFrame, measures: list[str]) -> DataFrame:
    """The inverse: one series row per (city, day), 24 slots per array, NULL where unknown."""
    day = F.date_trunc("day", F.col("event_ts"))
    slots = {
        m: F.array(*[F.max(F.when(F.hour("event_ts") == h, F.col(m))) for h in range(24)]).alias(m) for m in measures
    }
    return (
        df.groupBy("city", day.alias("_day"))
        .agg(*slots.values())
        .select(
            "city",
            F.unix_seconds("_day").alias("start"),
            (F.unix_seconds("_day") + F.lit(86400)).alias("end"),
            F.lit(3600).cast("bigint").alias("interval"),
            *measures,
        )
    )
