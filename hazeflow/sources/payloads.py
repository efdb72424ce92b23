"""Raw JSON payloads to typed records.

A payload is parsed once, with a declared structure whose leaves are VARIANT:
that keeps an absent key, an explicit null and a value of another type apart,
and a level that is no object simply is not there. All of it is column
expressions, so the same functions serve batches and streams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.missing import finite_or_null
from ..operators.once import compute_once

# The parts of each payload that are used.
STATION_KEYS = {
    "pm25": "pm25",
    "temperature": "t",
    "humidity": "h",
    "pressure": "p",
    "wind_speed": "w",
    "dew_point": "dew",
}
STATION_LAYOUT = (
    "status VARIANT, data STRUCT<aqi: VARIANT, dominentpol: VARIANT, city: STRUCT<name: VARIANT>, iaqi: STRUCT<"
    + ", ".join(f"{k}: STRUCT<v: VARIANT>" for k in STATION_KEYS.values())
    + ">>"
)
STATION_KEYS_LAYOUT = "data MAP<STRING, VARIANT>"
POLLUTION_LAYOUT = (
    "list ARRAY<STRUCT<components: STRUCT<pm2_5: VARIANT, pm10: VARIANT>, main: STRUCT<aqi: VARIANT>>>"
)
WEATHER_LAYOUT = "main STRUCT<temp: VARIANT, humidity: VARIANT>"
LIVE_FIELDS = ["pm25", "pm10", "temperature", "humidity", "aqi"]


def _number(leaf: Column) -> Column:
    """A finite number, also if it is written as text; NULL for anything else, NaN and infinities included."""
    return finite_or_null(F.try_variant_get(leaf, "$", "double"))


def _text(leaf: Column) -> Column:
    return F.try_variant_get(leaf, "$", "string")


def _text_or(leaf: Column, default: str) -> Column:
    """The default stands for an absent key only; an explicit null stays NULL."""
    return F.when(leaf.isNotNull(), _text(leaf)).otherwise(F.lit(default))


def _read_station(df: DataFrame, raw: str) -> tuple[DataFrame, dict[str, Column]]:
    """The reply's parts as columns ``_s_*``, and the fields of its record in terms of them."""
    reply = F.col("_reply")
    data = reply.data
    known = F.coalesce(data.aqi, data.dominentpol).isNotNull() | data.city.isNotNull() | data.iaqi.isNotNull()
    # Only a reply without any known key is read a second time, for whether it has others.
    any_key = F.coalesce(F.size(F.from_json(F.col(raw), STATION_KEYS_LAYOUT).data), F.lit(0)) > 0
    error = (
        F.when(F.coalesce(reply.status.isNull() & data.isNull(), F.lit(True)), F.lit("unreadable"))
        .when(F.coalesce(_text(reply.status), F.lit("")) != "ok", F.lit("status_not_ok"))
        .when(data.isNull(), F.lit("no_data"))
        .when(known, F.lit(None))
        .when(~any_key, F.lit("no_data"))
    )
    parts = {
        "_s_error": error,
        "_s_name": _text_or(data.city.getField("name"), S.STATION_UNKNOWN),
        "_s_aqi": _number(data.aqi),
        "_s_pollutant": _text_or(data.dominentpol, S.POLLUTANT_UNKNOWN),
        **{f"_s_{name}": _number(data.iaqi.getField(key).v) for name, key in STATION_KEYS.items()},
    }
    fields = {
        "station_name": F.col("_s_name"),
        "aqi": F.col("_s_aqi"),
        "aqi_target": F.col("_s_aqi"),
        "dominant_pollutant": F.col("_s_pollutant"),
        **{name: F.col(f"_s_{name}") for name in STATION_KEYS},
    }
    parsed = df.withColumn("_reply", F.from_json(F.col(raw), STATION_LAYOUT))
    return parsed.select(*df.columns, *[c.alias(n) for n, c in parts.items()]), fields


def _struct(fields: dict[str, Column]) -> Column:
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def check_envelope(df: DataFrame, raw: str = "station") -> DataFrame:
    """Add ``envelope_error``: why a station reply cannot be used, or NULL if it can."""
    read, _ = _read_station(df, raw)
    return compute_once(read, {"envelope_error": F.col("_s_error")}).select(*df.columns, "envelope_error")


def split_rejects(df: DataFrame, reason: str) -> tuple[DataFrame, DataFrame]:
    """Usable rows, and the rest for the dead-letter table."""
    good = F.col(reason).isNull()
    return df.where(good).drop(reason), df.where(~good)


def decode_station(df: DataFrame, raw: str = "station", out: str = "station_record") -> DataFrame:
    """Add a struct of the station's readings, NULL if the reply cannot be used."""
    read, fields = _read_station(df, raw)
    record = F.when(F.col("_s_error").isNull(), _struct(fields))
    return compute_once(read, {out: record}).select(*df.columns, out)


def _read_pollution(df: DataFrame, pollution: str, weather: str) -> tuple[DataFrame, Column]:
    """The values of both payloads as columns ``_p_*``, and the record in terms of them."""
    entry = F.get(F.col("_pollution").getField("list"), F.lit(0))
    main = F.col("_weather").main
    leaves = {
        "pm25": (entry.components.pm2_5, S.DEFAULT_PM25),
        "pm10": (entry.components.pm10, S.DEFAULT_PM10),
        "aqi": (entry.main.aqi, S.DEFAULT_AQI),
    }
    parts = {
        "_p_levels": entry.components.isNotNull() & entry.main.isNotNull(),
        "_p_temperature": _number(main.temp),
        "_p_humidity": _number(main.humidity),
        # Either the value, or the stand-in if the key is absent; NULL is neither.
        **{f"_p_{n}": F.when(leaf.isNull(), F.lit(d)).otherwise(_number(leaf)) for n, (leaf, d) in leaves.items()},
    }
    fields = {n: F.col(f"_p_{n}") for n in LIVE_FIELDS}
    usable = F.col("_p_levels")
    for c in fields.values():
        usable = usable & c.isNotNull()
    parsed = df.withColumns(
        {
            "_pollution": F.from_json(F.col(pollution), POLLUTION_LAYOUT),
            "_weather": F.from_json(F.col(weather), WEATHER_LAYOUT),
        }
    )
    return parsed.select(*df.columns, *[c.alias(n) for n, c in parts.items()]), F.when(usable, _struct(fields))


def decode_pollution(
    df: DataFrame, pollution: str = "pollution", weather: str = "weather", out: str = "pollution_record"
) -> DataFrame:
    """Add a struct (pm25, pm10, temperature, humidity, aqi) from the two payloads of a cycle.

    Absent pollution keys have stand-ins and the weather keys are required.
    A value that is present but is no number, or a missing level of the
    payload, rejects the whole record: the struct is then NULL itself. So does a
    number that is not finite.
    """
    read, record = _read_pollution(df, pollution, weather)
    return compute_once(read, {out: record}).select(*df.columns, out)


def decode_cycle(df: DataFrame) -> DataFrame:
    """Both records of each fetch cycle, then the pollution record if there is one, else the station's.

    ``source`` is NULL, and so are all fields, if neither could be decoded. The
    label scale differs between the two and is recorded.
    """
    read, record = _read_pollution(df, "pollution", "weather")
    read, station = _read_station(read, "station")
    as_live = {n: station.get(n, F.lit(None).cast("double")) for n in LIVE_FIELDS}
    primary = read.withColumn("_record", record)
    from_station = F.col("_s_error").isNull()

    def by_source(pollution, station):
        return F.when(F.col("_record").isNotNull(), pollution).when(from_station, station)

    return compute_once(
        primary,
        {
            "source": by_source(F.lit("pollution"), F.lit("station")),
            "label_scale": by_source(F.lit(S.SCALE_INDEX_5), F.lit(S.SCALE_INDEX_500)),
            **{n: by_source(F.col("_record").getField(n), as_live[n]) for n in LIVE_FIELDS},
        },
    ).select(*df.columns, "source", "label_scale", *LIVE_FIELDS)
