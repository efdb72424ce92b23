"""Irregular readings onto an hourly grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRID_KEY = ["city", "event_ts"]


def hourly_measures(readings: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """One row per (city, hour) with the given aggregates.

    ``event_ts`` is the start of the hour. The aggregates combine before the
    shuffle, so what travels is one row per task and hour, however many readings
    one station sends.
    """
    return readings.groupBy(*GRID_KEY).agg(*[c.alias(name) for name, c in measures.items()])


def hourly_grid(readings: DataFrame) -> DataFrame:
    """Number, smallest and largest value of all readings of an hour."""
    return hourly_measures(
        readings,
        {"n": F.count("value"), "min_value": F.min("value"), "max_value": F.max("value")},
    )
