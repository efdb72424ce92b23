"""Live path: payload decoding, fallback, imputation, vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from .. import schema as S
from ..operators.enrich import choose_label, impute_pm10, split_labelled
from ..operators.grid import hourly_measures
from ..operators.joins import source_fallback
from ..plans.inference import hazard_alerts
from ..plans.live import live_vectors, vectors_from_records
from ..sources.payloads import check_envelope, decode_pollution, decode_station, split_rejects
from .base import CALENDAR, FEATURES, JOINED, READINGS, humidex_sql, plain, query
from .features import _category_sql, features_of

# What the payloads of the fixture hold, said without JSON.
LANDED = """
landed AS (
  SELECT event_id, 'st' || (user_id // 25) AS city, ts AS event_ts, user_id, value,
         event_id % 10 AS p_shape, (event_id // 10) % 5 AS w_shape, event_id % 11 AS s_shape,
         CAST(event_id % 5 + 1 AS DOUBLE) AS sent_aqi, CAST(user_id % 40 AS DOUBLE) + 0.5e0 AS sent_temp,
         CAST(event_id % 100 AS DOUBLE) AS sent_hum
  FROM events
),
pollution AS (
  SELECT *, p_shape NOT IN (2, 6, 7, 8, 9) AND w_shape <> 3 AS p_ok,
         CASE WHEN p_shape = 3 THEN 25e0 ELSE value END AS p_pm25,
         CASE WHEN p_shape = 4 THEN 45e0 ELSE value * 2e0 END AS p_pm10,
         CASE WHEN p_shape = 4 THEN 3e0 ELSE sent_aqi END AS p_aqi
  FROM landed
),
station AS (
  SELECT *, s_shape NOT IN (2, 3, 6) AS s_ok,
         CASE WHEN s_shape IN (4, 7) THEN 'Unknown' ELSE 'station ' || user_id END AS s_name,
         CASE WHEN s_shape IN (4, 7) THEN 'N/A' WHEN s_shape = 5 THEN NULL ELSE 'pm25' END AS s_pollutant,
         CASE WHEN s_shape IN (4, 5, 7, 8) THEN NULL ELSE value END AS s_pm25,
         CASE WHEN s_shape IN (5, 7, 9) THEN NULL ELSE sent_aqi END AS s_aqi,
         s_shape NOT IN (2, 3, 6, 7) AS s_full
  FROM pollution
)"""


def _landed(spark, sf_dir):
    return X.landed(X.load(spark, sf_dir, "events"))


@query(
    "station_decode",
    f"""WITH {LANDED}
    SELECT event_id, s_ok AS decoded,
           CASE WHEN s_ok THEN s_name END AS station_name, CASE WHEN s_ok THEN s_aqi END AS aqi,
           CASE WHEN s_ok THEN s_aqi END AS aqi_target, CASE WHEN s_ok THEN s_pollutant END AS dominant_pollutant,
           CASE WHEN s_ok THEN s_pm25 END AS pm25, CASE WHEN s_full THEN sent_temp END AS temperature,
           CASE WHEN s_full THEN sent_hum END AS humidity, CASE WHEN s_full THEN 1010.5e0 END AS pressure,
           CASE WHEN s_full THEN 2.25e0 END AS wind_speed, CASE WHEN s_full THEN sent_temp END AS dew_point
    FROM station""",
)
def q_station(spark, sf_dir):
    d = decode_station(_landed(spark, sf_dir))
    return d.select("event_id", F.col("station_record").isNotNull().alias("decoded"), "station_record.*")


@query(
    "envelope_filter",
    f"""WITH {LANDED}
    SELECT event_id, CASE s_shape WHEN 2 THEN 'status_not_ok' WHEN 3 THEN 'no_data' WHEN 6 THEN 'unreadable' END
             AS envelope_error
    FROM landed""",
)
def q_envelope(spark, sf_dir):
    good, bad = split_rejects(check_envelope(_landed(spark, sf_dir)), "envelope_error")
    return good.select("event_id", F.lit(None).cast("string").alias("envelope_error")).unionByName(
        bad.select("event_id", "envelope_error")
    )


@query(
    "pollution_decode",
    f"""WITH {LANDED}
    SELECT event_id, p_ok AS decoded, CASE WHEN p_ok THEN p_pm25 END AS pm25, CASE WHEN p_ok THEN p_pm10 END AS pm10,
           CASE WHEN p_ok THEN sent_temp END AS temperature, CASE WHEN p_ok THEN sent_hum END AS humidity,
           CASE WHEN p_ok THEN p_aqi END AS aqi
    FROM pollution""",
)
def q_pollution(spark, sf_dir):
    d = decode_pollution(_landed(spark, sf_dir))
    return d.select("event_id", F.col("pollution_record").isNotNull().alias("decoded"), "pollution_record.*")


LIVE_COLUMNS = f"""epoch_us(event_ts) // 1000 AS timestamp, pm25,
           coalesce(pm10, round(pm25 * 1.8e0, 2), 40e0) AS pm10, temperature, humidity,
           coalesce(round({humidex_sql()}, 2), 35e0) AS humidex, 0e0 AS aqi_change_rate, {CALENDAR}"""

LANDED_VECTORS = f"""WITH {LANDED},
    chosen AS (
      SELECT event_id, city, event_ts, sent_temp AS temperature, sent_hum AS humidity,
             CASE WHEN p_ok THEN p_pm25 ELSE s_pm25 END AS pm25, CASE WHEN p_ok THEN p_pm10 END AS pm10,
             CASE WHEN p_ok THEN p_aqi ELSE s_aqi END AS target_aqi,
             CASE WHEN p_ok THEN 'pollution' ELSE 'station' END AS source,
             CASE WHEN p_ok THEN 'aqi_5' ELSE 'aqi_500' END AS label_scale
      FROM station WHERE p_ok OR s_ok
    )
    SELECT city, {LIVE_COLUMNS}, target_aqi, source, label_scale FROM chosen WHERE target_aqi IS NOT NULL"""


@query("landed_vectors", LANDED_VECTORS)
def q_landed_vectors(spark, sf_dir):
    return live_vectors(_landed(spark, sf_dir))[0]


@query(
    "landed_rejects",
    f"""WITH {LANDED}
    SELECT reject_reason, count(*) AS n FROM (
      SELECT CASE WHEN NOT p_ok AND NOT s_ok THEN 'no_source'
                  WHEN NOT p_ok AND s_aqi IS NULL THEN 'no_label' END AS reject_reason FROM station)
    WHERE reject_reason IS NOT NULL GROUP BY reject_reason""",
)
def q_landed_rejects(spark, sf_dir):
    rejects = live_vectors(_landed(spark, sf_dir))[1]
    return rejects.groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    "live_feature_vector",
    f"WITH {JOINED} SELECT city, {LIVE_COLUMNS}, target_aqi FROM joined WHERE target_aqi IS NOT NULL",
)
def q_live_vector(spark, sf_dir):
    records = X.joined(spark, sf_dir).withColumnRenamed("target_aqi", "aqi")
    return split_labelled(vectors_from_records(records, "event_ts"))[0].select(*S.FEATURE_COLS)


@query(
    "pm10_impute",
    f"WITH {JOINED} SELECT city, event_ts, pm25, coalesce(pm10, round(pm25 * 1.8e0, 2), 40e0) AS pm10 FROM joined",
)
def q_pm10(spark, sf_dir):
    return plain(impute_pm10(X.joined(spark, sf_dir)).select("city", "event_ts", "pm25", "pm10"))


@query(
    "label_filter",
    f"""WITH {JOINED}
    SELECT city, event_ts, target_aqi, CASE WHEN target_aqi IS NULL THEN 'no_label' END AS reject_reason
    FROM joined""",
)
def q_label(spark, sf_dir):
    records = X.joined(spark, sf_dir).withColumnRenamed("target_aqi", "aqi").withColumn("aqi_target", F.col("aqi"))
    kept, rejected = split_labelled(choose_label(records))
    cols = ["city", "event_ts", "target_aqi"]
    return plain(
        kept.select(*cols, F.lit(None).cast("string").alias("reject_reason")).unionByName(
            rejected.select(*cols, "reject_reason")
        )
    )


@query(
    "source_fallback",
    f"""WITH {READINGS},
    p AS (SELECT city, event_ts, max(value) AS peak, count(*) AS n FROM readings WHERE event_type = 'view'
          GROUP BY city, event_ts),
    s AS (SELECT city, event_ts, max(value) AS peak, count(*) AS n FROM readings WHERE event_type = 'click'
          GROUP BY city, event_ts)
    SELECT coalesce(p.city, s.city) AS city, coalesce(p.event_ts, s.event_ts) AS event_ts,
           CASE WHEN p.city IS NOT NULL THEN 'primary' ELSE 'secondary' END AS source,
           CASE WHEN p.city IS NOT NULL THEN p.peak ELSE s.peak END AS peak,
           CASE WHEN p.city IS NOT NULL THEN p.n ELSE s.n END AS n
    FROM p FULL JOIN s ON p.city = s.city AND p.event_ts = s.event_ts""",
)
def q_fallback(spark, sf_dir):
    r = X.readings(spark, sf_dir)

    def side(event_type):
        return hourly_measures(
            r.where(F.col("event_type") == event_type), {"peak": F.max("value"), "n": F.count(F.lit(1))}
        )

    return plain(source_fallback(side("view"), side("click"), ["peak", "n"]))


HAZARD_THRESHOLD = 151.0


@query(
    "hazard_alerts",
    f"""WITH {FEATURES}
    SELECT city, timestamp, target_aqi, {_category_sql('target_aqi')} AS category
    FROM features WHERE target_aqi >= {HAZARD_THRESHOLD}e0""",
)
def q_hazard(spark, sf_dir):
    return hazard_alerts(features_of(spark, sf_dir), "target_aqi", HAZARD_THRESHOLD)

