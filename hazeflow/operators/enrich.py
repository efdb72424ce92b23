"""Derived columns, defaults and casts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import calendar_columns, epoch_millis, humidex, humidex_rounded


def with_time_features(df: DataFrame, ts: str = "event_ts") -> DataFrame:
    return df.withColumns({"timestamp": epoch_millis(F.col(ts)), **calendar_columns(F.col(ts))})


def with_humidex(df: DataFrame) -> DataFrame:
    return df.withColumn("humidex", humidex(F.col("temperature"), F.col("humidity")))


def with_live_humidex(df: DataFrame) -> DataFrame:
    """Rounded, with a stand-in where it cannot be computed."""
    computed = humidex_rounded(F.col("temperature"), F.col("humidity"))
    return df.withColumn("humidex", F.coalesce(computed, F.lit(S.HUMIDEX_UNKNOWN)))


def impute_pm10(df: DataFrame) -> DataFrame:
    """A missing pm10 from pm25, or a fixed value if that is missing too."""
    from_pm25 = F.round(F.col("pm25") * F.lit(S.PM10_PER_PM25), 2)
    return df.withColumn("pm10", F.coalesce(F.col("pm10"), from_pm25, F.lit(S.PM10_UNKNOWN)))


def impute_weather(df: DataFrame) -> DataFrame:
    """Optional stand-ins for temperature and humidity; the live path leaves NULLs alone."""
    return df.withColumns(
        {
            "temperature": F.coalesce("temperature", F.lit(S.TEMPERATURE_UNKNOWN)),
            "humidity": F.coalesce("humidity", F.lit(S.HUMIDITY_UNKNOWN)),
        }
    )


def choose_label(df: DataFrame, first: str = "aqi", second: str = "aqi_target") -> DataFrame:
    present = [c for c in (first, second) if c in df.columns]
    return df.withColumn(S.LABEL_COL, F.coalesce(*present))


def split_labelled(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with a label, and the rejected rest with a reason."""
    known = F.col(S.LABEL_COL).isNotNull()
    return df.where(known), df.where(~known).withColumn("reject_reason", F.lit("no_label"))


def cast_features(df: DataFrame, trusted: bool = True) -> DataFrame:
    """Measures to double where present; text that is no number becomes NULL unless trusted."""
    present = [c for c in S.DOUBLE_COLS if c in df.columns]
    return df.withColumns({c: F.col(c).cast("double") if trusted else F.col(c).try_cast("double") for c in present})


def to_feature_columns(df: DataFrame) -> DataFrame:
    return df.select(*S.FEATURE_COLS)
