"""Historical features: two hourly series to the feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .. import schema as S
from ..operators.chunks import difference, difference_filled, fill_series
from ..operators.enrich import cast_features, to_feature_columns, with_humidex, with_time_features
from ..operators.joins import join_air_weather


def feature_table(joined: DataFrame, fill_label: bool = True) -> DataFrame:
    """Gap-fill, derive and project a joined hourly series to the 13 feature columns.

    Filling the label is the default; without it rows keep an unknown label.
    """
    if fill_label:
        filled = fill_series(joined, S.MEASURE_COLS, previous=S.LABEL_COL)
        with_rate = difference_filled(filled, S.LABEL_COL, "aqi_change_rate")
    else:
        inputs = [c for c in S.MEASURE_COLS if c != S.LABEL_COL]
        with_rate = difference(fill_series(joined, inputs), S.LABEL_COL, "aqi_change_rate")
    return (
        with_rate.transform(with_humidex)
        .transform(with_time_features)
        .transform(cast_features)
        .transform(to_feature_columns)
    )


def backfill(air: DataFrame, weather: DataFrame, fill_label: bool = True) -> DataFrame:
    return feature_table(join_air_weather(air, weather), fill_label)
