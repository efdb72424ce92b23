"""Historical path: grid, join, fill, derive, scan."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from .. import schema as S
from ..functions import aqi_category, aqi_overall, aqi_subindex, calendar_columns, dominant_pollutant, epoch_millis
from ..functions import humidex_rounded
from ..functions.aqi import CATEGORIES, TOP_CATEGORY
from ..operators.chunks import difference, fill_series
from ..operators.enrich import with_humidex
from ..operators.grid import hourly_grid
from ..functions.sql import register_sql_functions
from ..operators.joins import range_join_subindex
from ..operators.store import merge_into_table
from ..plans.history import feature_table
from ..session import work_dir
from ..sources.series import explode_axis, explode_series, pack_daily
from ..sources.tables import date_range, feature_scan
from .base import (
    AIR, CALENDAR, FEATURE_SELECT, FEATURES, FILLED, JOINED, MEASURES, READINGS, humidex_sql, last_known, plain, query,
)


def features_of(spark, sf_dir):
    return feature_table(X.joined(spark, sf_dir))


@query("feature_table", f"WITH {FEATURES} SELECT {FEATURE_SELECT} FROM features")
def q_feature_table(spark, sf_dir):
    return plain(features_of(spark, sf_dir), 6, ["humidex"])


@query(
    "hourly_grid",
    f"""WITH {READINGS}
    SELECT city, event_ts, count(value) AS n, min(value) AS min_value, max(value) AS max_value
    FROM readings GROUP BY city, event_ts""",
)
def q_hourly_grid(spark, sf_dir):
    return plain(hourly_grid(X.readings(spark, sf_dir)))


@query("air_weather_join", f"WITH {JOINED} SELECT * FROM joined")
def q_join(spark, sf_dir):
    return plain(X.joined(spark, sf_dir))


@query(
    "ffill",
    f"WITH {JOINED} SELECT city, event_ts, " + ", ".join(f"{last_known(c)} AS {c}" for c in MEASURES) + " FROM joined",
)
def q_ffill(spark, sf_dir):
    return plain(fill_series(X.joined(spark, sf_dir), MEASURES, backward=False))


@query("ffill_bfill", f"WITH {FILLED} SELECT * FROM filled")
def q_ffill_bfill(spark, sf_dir):
    return plain(fill_series(X.joined(spark, sf_dir), MEASURES))


@query(
    "aqi_change_rate",
    f"""WITH {JOINED}
    SELECT city, event_ts,
           coalesce(target_aqi - lag(target_aqi) OVER (PARTITION BY city ORDER BY event_ts), 0e0) AS aqi_change_rate
    FROM joined""",
)
def q_change_rate(spark, sf_dir):
    d = difference(X.joined(spark, sf_dir), "target_aqi", "aqi_change_rate")
    return plain(d.select("city", "event_ts", "aqi_change_rate"))


@query("humidex", f"WITH {JOINED} SELECT city, event_ts, round({humidex_sql()}, 6) AS humidex FROM joined")
def q_humidex(spark, sf_dir):
    return plain(with_humidex(X.joined(spark, sf_dir)).select("city", "event_ts", "humidex"), 6)


@query("humidex_rounded", f"WITH {JOINED} SELECT city, event_ts, round({humidex_sql()}, 2) AS humidex FROM joined")
def q_humidex_rounded(spark, sf_dir):
    j = X.joined(spark, sf_dir)
    return plain(
        j.select("city", "event_ts", humidex_rounded(F.col("temperature"), F.col("humidity")).alias("humidex"))
    )


@query(
    "time_features",
    f"SELECT event_id, epoch_us(event_ts) // 1000 AS timestamp, {CALENDAR} FROM (SELECT event_id, ts AS event_ts FROM events)",
)
def q_time_features(spark, sf_dir):
    ts = F.col("ts").cast("timestamp")
    cols = {"timestamp": epoch_millis(ts), **calendar_columns(ts)}
    return X.load(spark, sf_dir, "events").select("event_id", *[c.alias(n) for n, c in cols.items()])


@query(
    "time_axis",
    f"""WITH {READINGS},
    span AS (SELECT city, min(event_ts) AS lo, max(event_ts) AS hi FROM readings GROUP BY city)
    SELECT city, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS event_ts FROM span""",
)
def q_time_axis(spark, sf_dir):
    span = (
        X.readings(spark, sf_dir)
        .groupBy("city")
        .agg(
            F.unix_seconds(F.min("event_ts")).alias("start"),
            (F.unix_seconds(F.max("event_ts")) + F.lit(3600)).alias("end"),
        )
        .withColumn("interval", F.lit(3600).cast("bigint"))
    )
    return plain(explode_axis(span, ["city"]))


def _series_sql(cte: str, name: str, measures: list[str]) -> str:
    return f"""WITH {cte},
    days AS (SELECT DISTINCT city, date_trunc('day', event_ts) AS d FROM {name}),
    axis AS (SELECT city, unnest(generate_series(d, d + INTERVAL 23 HOUR, INTERVAL 1 HOUR)) AS event_ts FROM days)
    SELECT city, event_ts, {', '.join(measures)} FROM axis LEFT JOIN {name} USING (city, event_ts)"""


def _through_payload(df, measures):
    """Pack into one JSON document per city and day, as landed, and decode that again."""
    schema = S.series_schema(measures)
    packed = pack_daily(df, measures)
    raw = packed.select(F.to_json(F.struct("city", "start", "end", "interval", *measures)).alias("raw"))
    return plain(explode_series(raw.select(F.from_json("raw", schema).alias("s")).select("s.*"), measures))


@query("series_explode", _series_sql(AIR, "air", S.AIR_COLS))
def q_series(spark, sf_dir):
    return _through_payload(X.air(spark, sf_dir), S.AIR_COLS)


@query("weather_series_explode", _series_sql(JOINED, "weather", S.WEATHER_COLS))
def q_weather_series(spark, sf_dir):
    return _through_payload(X.weather(spark, sf_dir), S.WEATHER_COLS)


@query(
    "date_range_scan",
    """SELECT event_id, event_type, value FROM events
    WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-13'""",
)
def q_date_range(spark, sf_dir):
    events = X.load(spark, sf_dir, "events")
    return date_range(events, "2024-01-05", "2024-01-12", ts="ts").select("event_id", "event_type", "value")


@query("feature_scan", f"WITH {FEATURES} SELECT {FEATURE_SELECT} FROM features")
def q_feature_scan(spark, sf_dir):
    path = work_dir(spark, "feature-table")
    merge_into_table(features_of(spark, sf_dir), path, load_seq=0)
    return plain(feature_scan(spark, path), 6, ["humidex"])


@query("feature_head", f"WITH {FEATURES} SELECT {FEATURE_SELECT} FROM features ORDER BY city, timestamp LIMIT 5")
def q_feature_head(spark, sf_dir):
    return plain(features_of(spark, sf_dir).orderBy("city", "timestamp").limit(5), 6, ["humidex"])


def subindex_sql(v: str, pollutant: str) -> str:
    arms = " ".join(
        f"WHEN {v} BETWEEN {lo}e0 AND {hi}e0"
        f" THEN {ilo}e0 + ({ihi - ilo}e0) * (({v} - {lo}e0) / ({hi}e0 - {lo}e0))"
        for lo, hi, ilo, ihi in S.BREAKPOINTS[pollutant]
    )
    return f"(CASE {arms} END)"


@query(
    "aqi_subindex",
    f"""SELECT event_id, round({subindex_sql('value', 'pm25')}, 6) AS pm25_index,
           round({subindex_sql('value', 'pm10')}, 6) AS pm10_index,
           round({subindex_sql('v25', 'pm25')}, 6) AS pm25_index_truncated,
           round({subindex_sql('v10', 'pm10')}, 6) AS pm10_index_truncated
    FROM (SELECT *, floor(round(value * 10e0, 6)) / 10e0 AS v25, floor(round(value, 6)) AS v10 FROM events)""",
)
def q_subindex(spark, sf_dir):
    v = F.col("value")
    return plain(
        X.load(spark, sf_dir, "events").select(
            "event_id",
            aqi_subindex(v, "pm25").alias("pm25_index"),
            aqi_subindex(v, "pm10").alias("pm10_index"),
            aqi_subindex(v, "pm25", "truncate").alias("pm25_index_truncated"),
            aqi_subindex(v, "pm10", "truncate").alias("pm10_index_truncated"),
        ),
        6,
    )


@query(
    "sql_functions",
    f"""WITH {JOINED}
    SELECT city, event_ts, round({humidex_sql()}, 6) AS humidex, round({subindex_sql('pm25', 'pm25')}, 6) AS pm25_index,
           round({subindex_sql('pm10', 'pm10')}, 6) AS pm10_index,
           round(greatest({subindex_sql('pm25', 'pm25')}, {subindex_sql('pm10', 'pm10')}), 6) AS aqi
    FROM joined""",
)
def q_sql_functions(spark, sf_dir):
    register_sql_functions(spark)
    out = X.joined(spark, sf_dir).selectExpr(
        "city", "event_ts", "humidex(temperature, humidity) AS humidex", "aqi_pm25(pm25) AS pm25_index",
        "aqi_pm10(pm10) AS pm10_index", "aqi_overall(pm25, pm10) AS aqi",
    )
    return plain(out, 6)


@query(
    "aqi_rangejoin",
    f"""SELECT event_id, round(CASE WHEN event_type IN ('view', 'purchase') THEN {subindex_sql('value', 'pm25')}
           ELSE {subindex_sql('value', 'pm10')} END, 6) AS aqi_subindex FROM events""",
)
def q_rangejoin(spark, sf_dir):
    events = X.load(spark, sf_dir, "events").select("event_id", "event_type", "value")
    pollutant = F.when(F.col("event_type").isin("view", "purchase"), F.lit("pm25")).otherwise(F.lit("pm10"))
    return plain(range_join_subindex(events, pollutant, F.col("value")).select("event_id", "aqi_subindex"), 6)


def _category_sql(a: str) -> str:
    arms = " ".join(f"WHEN {a} <= {u}e0 THEN '{n}'" for u, n in CATEGORIES)
    return f"CASE WHEN {a} IS NULL THEN NULL {arms} ELSE '{TOP_CATEGORY}' END"


@query(
    "aqi_overall",
    f"""WITH {JOINED},
    parts AS (SELECT city, event_ts, {subindex_sql('pm25', 'pm25')} AS i25, {subindex_sql('pm10', 'pm10')} AS i10
              FROM joined),
    top AS (SELECT *, greatest(i25, i10) AS aqi FROM parts)
    SELECT city, event_ts, round(aqi, 6) AS aqi,
           CASE WHEN i25 IS NOT NULL AND (i10 IS NULL OR i25 >= i10) THEN 'pm25'
                WHEN i10 IS NOT NULL THEN 'pm10' END AS dominant_pollutant,
           {_category_sql('aqi')} AS category
    FROM top""",
)
def q_overall(spark, sf_dir):
    p25, p10 = F.col("pm25"), F.col("pm10")
    return plain(
        X.joined(spark, sf_dir).select(
            "city",
            "event_ts",
            aqi_overall(p25, p10).alias("aqi"),
            dominant_pollutant(aqi_subindex(p25, "pm25"), aqi_subindex(p10, "pm10")).alias("dominant_pollutant"),
            aqi_category(aqi_overall(p25, p10)).alias("category"),
        ),
        6,
    )
