"""The driver's tables seen as telemetry.

A station is a block of 25 users, so the number of stations grows with the data
and each keeps the same density of readings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import event_time, nan_to_null
from .operators.grid import hourly_measures
from .operators.joins import join_air_weather
from .session import pin_utc

USERS_PER_STATION = 25

AIR_TYPES = ["view", "click", "error"]
WEATHER_TYPES = ["purchase", "signup"]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return pin_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def station_key(user_id: Column) -> Column:
    return F.concat(F.lit("st"), F.floor(user_id / F.lit(USERS_PER_STATION)).cast("string"))


def to_readings(events: DataFrame, city: Column | None = None) -> DataFrame:
    """(city, event_ts, event_type, value) for a batch or a stream of events."""
    key = station_key(F.col("user_id")) if city is None else city
    return events.select(
        key.alias("city"),
        F.date_trunc("hour", event_time(F.col("ts"))).alias("event_ts"),
        "event_type",
        nan_to_null(F.col("value")).alias("value"),
    )


def readings(spark: SparkSession, sf_dir: str, city: Column | None = None) -> DataFrame:
    return to_readings(load(spark, sf_dir, "events"), city)


def _largest(event_type: str) -> Column:
    return F.max(F.when(F.col("event_type") == event_type, F.col("value")))


def air(spark: SparkSession, sf_dir: str, city: Column | None = None) -> DataFrame:
    return hourly_measures(
        readings(spark, sf_dir, city).where(F.col("event_type").isin(AIR_TYPES)),
        {"pm25": _largest("view"), "pm10": _largest("click"), "target_aqi": _largest("error")},
    )


def weather(spark: SparkSession, sf_dir: str, city: Column | None = None) -> DataFrame:
    return hourly_measures(
        readings(spark, sf_dir, city).where(F.col("event_type").isin(WEATHER_TYPES)),
        {
            "temperature": F.lit(0.1) * _largest("purchase"),
            "humidity": F.least(_largest("signup"), F.lit(100.0)),
        },
    )


def joined(spark: SparkSession, sf_dir: str, city: Column | None = None) -> DataFrame:
    return join_air_weather(air(spark, sf_dir, city), weather(spark, sf_dir, city))


def landed(events: DataFrame) -> DataFrame:
    """Raw payloads as three sources would land them, one fetch cycle per event.

    They come in all shapes a decoder has to tell apart: complete, with keys left
    out, with explicit nulls, numbers as text, text that is no number or not a finite one, an empty or
    a failed envelope, one with unknown keys only, and no JSON at all.
    """
    v = F.col("value").cast("string")
    twice = (F.col("value") * 2).cast("string")
    aqi = (F.col("event_id") % 5 + 1).cast("string")
    temp = (F.col("user_id") % 40 + F.lit(0.5)).cast("string")
    hum = (F.col("event_id") % 100).cast("string")

    def text(*parts):
        return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])

    def pollution_body(components, main):
        return text('{"list":[{"components":{', components, '},"main":{', main, "}}]}")

    pm25, pm10, main_aqi = text('"pm2_5":', v), text('"pm10":', twice), text('"aqi":', aqi)
    p_shape = F.col("event_id") % 10
    pollution = (
        F.when(p_shape == 2, pollution_body(text('"pm2_5":"NaN",', pm10), main_aqi))
        .when(p_shape == 3, pollution_body(pm10, main_aqi))
        .when(p_shape == 4, pollution_body(pm25, ""))
        .when(p_shape == 5, pollution_body(text('"pm2_5":"', v, '",', pm10), main_aqi))
        .when(p_shape == 6, pollution_body(text('"pm2_5":null,', pm10), main_aqi))
        .when(p_shape == 7, pollution_body(text(pm25, ',"pm10":"n/a"'), main_aqi))
        .when(p_shape == 8, F.lit("<html>busy</html>"))
        .when(p_shape == 9, F.lit('{"list":[]}'))
        .otherwise(pollution_body(text(pm25, ",", pm10), main_aqi))
    )
    w_shape = F.floor(F.col("event_id") / 10) % 5
    weather_raw = (
        F.when(w_shape == 3, text('{"main":{"temp":', temp, "}}"))
        .when(w_shape == 4, text('{"main":{"temp":"', temp, '","humidity":', hum, "}}"))
        .otherwise(text('{"main":{"temp":', temp, ',"humidity":', hum, "}}"))
    )

    def station_body(aqi_value, pollutant, city, pm):
        return text(
            '{"status":"ok","data":{"aqi":', aqi_value, pollutant, ',"city":{', city, '},"iaqi":{', pm,
            '"t":{"v":', temp, '},"h":{"v":', hum, '},"p":{"v":1010.5},"w":{"v":2.25},"dew":{"v":', temp, "}}}}",
        )

    name = text('"name":"station ', F.col("user_id").cast("string"), '"')
    s_shape = F.col("event_id") % 11
    station = (
        F.when(s_shape == 2, F.lit('{"status":"error","data":"Invalid key"}'))
        .when(s_shape == 3, F.lit('{"status":"ok","data":{}}'))
        .when(s_shape == 4, station_body(aqi, "", "", ""))
        .when(s_shape == 5, station_body("null", ',"dominentpol":null', name, '"pm25":{"v":null},'))
        .when(s_shape == 6, F.lit("gateway timeout"))
        .when(s_shape == 7, F.lit('{"status":"ok","data":{"idx":7}}'))
        .when(s_shape == 8, station_body(aqi, ',"dominentpol":"pm25"', name, '"pm25":{"v":"NaN"},'))
        .when(s_shape == 9, station_body('"Infinity"', ',"dominentpol":"pm25"', name, text('"pm25":{"v":', v, "},")))
        .otherwise(station_body(aqi, ',"dominentpol":"pm25"', name, text('"pm25":{"v":', v, "},")))
    )
    return events.select(
        station_key(F.col("user_id")).alias("city"),
        event_time(F.col("ts")).alias("fetched_at"),
        "event_id",
        pollution.alias("pollution"),
        weather_raw.alias("weather"),
        station.alias("station"),
    )
