"""Registration of queries, and views shared by their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register


def plain(df: DataFrame, decimals: int | None = None, cols: list[str] | None = None) -> DataFrame:
    """Zone-free timestamps, and the given (or all) doubles rounded, for comparison."""
    changed = {}
    for f in df.schema:
        if isinstance(f.dataType, T.TimestampType):
            changed[f.name] = F.col(f.name).cast("timestamp_ntz")
        elif decimals is not None and isinstance(f.dataType, T.DoubleType) and (cols is None or f.name in cols):
            # Adding 0.0 turns a negative zero into zero.
            changed[f.name] = F.round(F.col(f.name), decimals) + F.lit(0.0)
    return df.withColumns(changed) if changed else df


READINGS = """
readings AS (
  SELECT 'st' || (user_id // 25) AS city, date_trunc('hour', ts) AS event_ts, event_type, value FROM events
)"""

AIR = READINGS + """,
air AS (
  SELECT city, event_ts,
         max(value) FILTER (WHERE event_type = 'view') AS pm25,
         max(value) FILTER (WHERE event_type = 'click') AS pm10,
         max(value) FILTER (WHERE event_type = 'error') AS target_aqi
  FROM readings WHERE event_type IN ('view', 'click', 'error') GROUP BY city, event_ts
)"""

JOINED = AIR + """,
weather AS (
  SELECT city, event_ts,
         0.1e0 * max(value) FILTER (WHERE event_type = 'purchase') AS temperature,
         least(max(value) FILTER (WHERE event_type = 'signup'), 100e0) AS humidity
  FROM readings WHERE event_type IN ('purchase', 'signup') GROUP BY city, event_ts
),
joined AS (
  SELECT city, event_ts, pm25, pm10, target_aqi, temperature, humidity
  FROM air JOIN weather USING (city, event_ts)
)"""

MEASURES = ["pm25", "pm10", "target_aqi", "temperature", "humidity"]


def last_known(c: str) -> str:
    return (
        f"last_value({c} IGNORE NULLS) OVER (PARTITION BY city ORDER BY event_ts"
        " ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    )


def next_known(c: str) -> str:
    return (
        f"first_value({c} IGNORE NULLS) OVER (PARTITION BY city ORDER BY event_ts"
        " ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    )


def humidex_sql(t: str = "temperature", h: str = "humidity") -> str:
    return (
        f"({t} + (5e0 / 9e0) * (6.11e0 * pow(10e0, (7.5e0 * {t}) / nullif(237.7e0 + {t}, 0))"
        f" * ({h} / 100e0) - 10e0))"
    )


FILLED = JOINED + ",\nfilled AS (SELECT city, event_ts, " + ", ".join(
    f"coalesce({last_known(c)}, {next_known(c)}) AS {c}" for c in MEASURES
) + " FROM joined)"

CALENDAR = """CAST(hour(event_ts) AS BIGINT) AS hour, CAST(day(event_ts) AS BIGINT) AS day,
         CAST(month(event_ts) AS BIGINT) AS month, CAST(isodow(event_ts) - 1 AS BIGINT) AS day_of_week"""

FEATURES = FILLED + f""",
features AS (
  SELECT city, epoch_ms(event_ts) AS timestamp, pm25, pm10, temperature, humidity,
         {humidex_sql()} AS humidex,
         coalesce(target_aqi - lag(target_aqi) OVER (PARTITION BY city ORDER BY event_ts), 0e0) AS aqi_change_rate,
         {CALENDAR}, target_aqi, event_ts
  FROM filled
)"""

FEATURE_SELECT = """city, timestamp, pm25, pm10, temperature, humidity, round(humidex, 6) AS humidex,
       aqi_change_rate, hour, day, month, day_of_week, target_aqi"""
