"""Joins of hourly series. Both sides hold at most one row per (city, hour)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import BREAKPOINTS
from .chunks import carry_before


def join_air_weather(air: DataFrame, weather: DataFrame) -> DataFrame:
    """Hours that both series have.

    Both inputs are usually aggregates by the join key and arrive partitioned by
    it, so the join itself adds no shuffle; a small side is broadcast at run time.
    """
    return air.join(weather, ["city", "event_ts"], "inner")


def source_fallback(primary: DataFrame, secondary: DataFrame, fields: list[str]) -> DataFrame:
    """The primary record of a (city, hour) if there is one, else the secondary.

    A record is taken whole: a NULL field of a present primary record stays NULL.
    """
    keys = ["city", "event_ts"]
    first = primary.select(*keys, F.struct(*fields).alias("first_choice"))
    second = secondary.select(*keys, F.struct(*fields).alias("second_choice"))
    record = F.coalesce("first_choice", "second_choice")
    return first.join(second, keys, "full_outer").select(
        *keys,
        F.when(F.col("first_choice").isNotNull(), F.lit("primary")).otherwise(F.lit("secondary")).alias("source"),
        *[record.getField(f).alias(f) for f in fields],
    )


def horizon_labels(features: DataFrame, horizons: list[int], label: str = "target_aqi") -> DataFrame:
    """Add ``label_<h>h``: the label of the same city exactly h hours later, if known.

    Time decides, not row distance, since the grid has holes. Each label row is
    sent to the hours it is a future of, so one narrow shuffle serves all horizons.
    """
    keys = ["city", "event_ts"]
    future = (
        features.select("city", "event_ts", label, F.explode(F.array(*[F.lit(h) for h in horizons])).alias("h"))
        .select(
            "city",
            (F.col("event_ts") - F.make_dt_interval(hours=F.col("h"))).alias("event_ts"),
            "h",
            label,
        )
        .groupBy(*keys)
        .agg(*[F.max(F.when(F.col("h") == h, F.col(label))).alias(f"label_{h}h") for h in horizons])
    )
    return features.join(future, keys, "left")


def point_in_time_join(
    labels: DataFrame, features: DataFrame, fields: list[str], label_ts: str = "label_ts", step: str = "hour"
) -> DataFrame:
    """For each label row the latest feature row of its city at or before the label time.

    Feature times are multiples of ``step``, so the answer depends on the city
    and the step the label falls into, and nothing else. The labels
    are reduced to those pairs (which combines before the shuffle), the pairs and the feature
    rows are merged in time order within (city, month), with the last feature row of
    earlier months carried in, and the labels pick up their answer by an equi-join,
    which adaptive execution splits where one pair has very many labels.
    """
    answer = F.struct(F.col("event_ts").alias("feature_ts"), *[F.col(f) for f in fields])
    stepped = labels.withColumn("_step", F.date_trunc(step, F.col(label_ts)))
    asked = stepped.select("city", F.col("_step").alias("ts")).distinct()
    line = asked.select("city", "ts", F.lit(1).alias("is_label"), F.lit(None).cast(_struct_of(features, fields)).alias("row"))
    line = line.unionByName(
        features.select("city", F.col("event_ts").alias("ts"), F.lit(0).alias("is_label"), answer.alias("row"))
    )
    known = carry_before(line, "row", keys=["city"], ts="ts", tie="is_label", grain="month")
    matched = known.where(F.col("is_label") == 1).select("city", F.col("ts").alias("_step"), F.col("row.*"))
    return stepped.join(matched, ["city", "_step"], "left").drop("_step")


def _struct_of(features: DataFrame, fields: list[str]) -> T.StructType:
    return T.StructType(
        [T.StructField("feature_ts", features.schema["event_ts"].dataType)]
        + [T.StructField(f, features.schema[f].dataType) for f in fields]
    )


def breakpoint_buckets(df: DataFrame) -> DataFrame:
    """The breakpoint ranges, once per whole number they touch (about 1,100 rows, fixed)."""
    rows = [
        (p, float(lo), float(hi), float(ilo), float(ihi))
        for p, table in BREAKPOINTS.items()
        for lo, hi, ilo, ihi in table
    ]
    ranges = df.sparkSession.createDataFrame(
        rows, "pollutant string, c_low double, c_high double, i_low double, i_high double"
    )
    return ranges.withColumn(
        "bucket", F.explode(F.sequence(F.floor("c_low").cast("bigint"), F.floor("c_high").cast("bigint")))
    )


def range_join_subindex(df: DataFrame, pollutant: Column, concentration: Column) -> DataFrame:
    """Sub-index through a range join with the breakpoint table.

    The range condition is turned into an equality on the whole part, so this is
    a broadcast hash join against a table of fixed size, with the range as a
    residual. It checks the expression form, which needs no join at all.
    """
    left = df.withColumns({"_p": pollutant, "_v": concentration}).withColumn("_b", F.floor("_v").cast("bigint"))
    table = F.broadcast(breakpoint_buckets(df))
    hit = (
        (left["_p"] == table["pollutant"])
        & (left["_b"] == table["bucket"])
        & left["_v"].between(table["c_low"], table["c_high"])
    )
    slope = (F.col("i_high") - F.col("i_low")) / (F.col("c_high") - F.col("c_low"))
    index = F.col("i_low") + slope * (F.col("_v") - F.col("c_low"))
    return left.join(table, hit, "left").select(*[left[c] for c in df.columns], index.alias("aqi_subindex"))


__all__ = [
    "breakpoint_buckets",
    "horizon_labels",
    "join_air_weather",
    "point_in_time_join",
    "range_join_subindex",
    "source_fallback",
]
