"""Table layouts and fixed values."""

from __future__ import annotations

from pyspark.sql import types as T

KEY_COLS = ["city", "timestamp"]
LABEL_COL = "target_aqi"

# Column order of the feature table.
FEATURE_COLS = [
    "city",
    "timestamp",
    "pm25",
    "pm10",
    "temperature",
    "humidity",
    "humidex",
    "aqi_change_rate",
    "hour",
    "day",
    "month",
    "day_of_week",
    "target_aqi",
]

DOUBLE_COLS = ["pm25", "pm10", "temperature", "humidity", "humidex", "aqi_change_rate", "target_aqi"]
CALENDAR_COLS = ["hour", "day", "month", "day_of_week"]
AIR_COLS = ["pm25", "pm10", "target_aqi"]
WEATHER_COLS = ["temperature", "humidity"]
MEASURE_COLS = AIR_COLS + WEATHER_COLS

#: Model inputs: every feature column that is neither key nor label.
MODEL_COLS = [c for c in FEATURE_COLS if c not in {*KEY_COLS, LABEL_COL}]
#: Inputs that carry the label of the same hour.
LEAKY_COLS = ["aqi_change_rate"]

# Which scale a label is on: hourly archive labels run from 0 to 500, live labels from 1 to 5.
SCALE_INDEX_500 = "aqi_500"
SCALE_INDEX_5 = "aqi_5"


def _field(name: str) -> T.StructField:
    if name == "city":
        return T.StructField(name, T.StringType())
    if name == "timestamp" or name in CALENDAR_COLS:
        return T.StructField(name, T.LongType())
    return T.StructField(name, T.DoubleType())


FEATURE_SCHEMA = T.StructType([_field(c) for c in FEATURE_COLS])

# Landed hourly series: half-open [start, end) in epoch seconds, a step, one array per measure.
def series_schema(measures: list[str]) -> T.StructType:
    return T.StructType(
        [
            T.StructField("city", T.StringType()),
            T.StructField("start", T.LongType()),
            T.StructField("end", T.LongType()),
            T.StructField("interval", T.LongType()),
            *[T.StructField(m, T.ArrayType(T.DoubleType())) for m in measures],
        ]
    )


# One fetch cycle: up to three raw payloads per city and moment.
LANDED_SCHEMA = T.StructType(
    [
        T.StructField("city", T.StringType()),
        T.StructField("fetched_at", T.TimestampType()),
        T.StructField("pollution", T.StringType()),
        T.StructField("weather", T.StringType()),
        T.StructField("station", T.StringType()),
    ]
)

# Concentration ranges (closed) and the index range of each.
PM25_BREAKPOINTS = [
    (0.0, 12.0, 0, 50),
    (12.1, 35.4, 51, 100),
    (35.5, 55.4, 101, 150),
    (55.5, 150.4, 151, 200),
    (150.5, 250.4, 201, 300),
    (250.5, 350.4, 301, 400),
    (350.5, 500.4, 401, 500),
]
PM10_BREAKPOINTS = [
    (0.0, 54.0, 0, 50),
    (55.0, 154.0, 51, 100),
    (155.0, 254.0, 101, 150),
    (255.0, 354.0, 151, 200),
    (355.0, 424.0, 201, 300),
    (425.0, 504.0, 301, 400),
    (505.0, 604.0, 401, 500),
]
BREAKPOINTS = {"pm25": PM25_BREAKPOINTS, "pm10": PM10_BREAKPOINTS}
# Decimal places a reading is cut to before the lookup under gap_policy="truncate".
BREAKPOINT_SCALE = {"pm25": 1, "pm10": 0}

# Stand-ins for what a live record may lack.
DEFAULT_PM25 = 25.0
DEFAULT_PM10 = 45.0
DEFAULT_AQI = 3.0
PM10_PER_PM25 = 1.8
PM10_UNKNOWN = 40.0
HUMIDEX_UNKNOWN = 35.0
TEMPERATURE_UNKNOWN = 30.0
HUMIDITY_UNKNOWN = 60.0
STATION_UNKNOWN = "Unknown"
POLLUTANT_UNKNOWN = "N/A"
