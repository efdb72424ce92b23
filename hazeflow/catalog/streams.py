"""Streaming jobs over the given tables; their SQL twins say what a batch would give."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from .. import schema as S
from ..session import materialize, pin_utc, work_dir
from ..operators.store import latest_per_city, merge_into_table
from ..sources.tables import feature_scan
from ..streaming import (
    alert_episodes, change_rates, change_rates_in_time, dedup_stream, fallback_streams, hourly_stream, join_streams, read_updates, run_features, run_to_table, run_updates,
    run_upsert,
)
from .base import FEATURE_SELECT, FEATURES, JOINED, READINGS, plain, query
from ..operators.grid import hourly_measures
from .features import _category_sql, features_of
from .live import HAZARD_THRESHOLD, LANDED_VECTORS


#: Micro-batches that a table is fed in, and rows of one file of a micro-batch: the tasks of a micro-batch are its files.
SLICES, FILE_ROWS = 4, 1 << 16


def _event_stream(spark, sf_dir):
    """The events in the order of their time, a stretch of time per micro-batch: watermarks need that."""
    return _in_time_order(X.load(spark, sf_dir, "events"), "ts", "events")


def _in_time_order(df, ts, purpose, bounds=None):
    """Land a table stretch of time by stretch of time, and read it as a stream of one micro-batch per stretch. Rows without a time come first.

    A stretch has as many files as its rows need, but all stretches the same number, which is what a micro-batch takes: one with too few rows is filled up with empty files.
    """
    spark = pin_utc(df.sparkSession)
    path = work_dir(spark, purpose)
    bounds = bounds or _bounds(df, ts)
    stretches = []
    for lower, upper in zip([None, *bounds], [*bounds, None]):
        inside = F.lit(True) if lower is None else F.col(ts) >= F.lit(lower)
        if upper is not None:
            inside = inside & ((F.col(ts) < F.lit(upper)) | (F.col(ts).isNull() if lower is None else F.lit(False)))
        stretches.append(inside)
    rows = df.agg(*[F.count_if(inside).alias(f"n{i}") for i, inside in enumerate(stretches)]).first()
    n_files = max(1, -(-max(rows) // FILE_ROWS))
    for k, inside in enumerate(stretches, 1):
        part = df.where(inside)
        (part.coalesce(1) if n_files == 1 else part.repartition(n_files)).write.mode("append").parquet(path)
        for _ in range(k * n_files - len(spark.read.schema(df.schema).parquet(path).inputFiles())):
            df.limit(0).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", n_files).parquet(path)


def _bounds(df, ts):
    """Inner bounds of SLICES equal stretches of time."""
    lo, hi = df.agg(F.min(ts), F.max(ts)).first()
    return [lo + (hi - lo) * i // SLICES if isinstance(lo, int) else lo + (hi - lo) * i / SLICES for i in range(1, SLICES)]


@query(
    "stream_hourly",
    f"""WITH {READINGS}
    SELECT city, event_ts, count(value) AS n, min(value) AS min_value, max(value) AS max_value
    FROM readings GROUP BY city, event_ts""",
)
def q_hourly(spark, sf_dir):
    raw = _event_stream(spark, sf_dir).select(
        X.station_key(F.col("user_id")).alias("city"), F.col("ts").cast("timestamp").alias("ts"), "value"
    )
    measures = {"n": F.count("value"), "min_value": F.min("value"), "max_value": F.max("value")}
    path = work_dir(spark, "stream-hourly")
    run_updates(hourly_stream(raw, "ts", "2 hours", measures), path)
    return plain(read_updates(spark, path, ["city", "event_ts"]))


@query("stream_dedup", f"WITH {READINGS} SELECT DISTINCT city, epoch_ms(event_ts) AS timestamp FROM readings")
def q_dedup(spark, sf_dir):
    raw = _event_stream(spark, sf_dir)
    keyed = X.to_readings(raw.withColumn("event_type", F.col("event_id").cast("string"))).withColumn(
        "timestamp", F.unix_millis("event_ts")
    )
    path = work_dir(spark, "stream-dedup")
    run_to_table(
        dedup_stream(keyed, ["city", "timestamp"], "event_ts", "2 hours", F.col("event_type")).select("city", "timestamp"),
        path,
    )
    return spark.read.parquet(f"{path}/data")


@query("stream_join", f"WITH {JOINED} SELECT * FROM joined")
def q_stream_join(spark, sf_dir):
    both = [materialize(side(spark, sf_dir), "hourly") for side in (X.air, X.weather)]
    bounds = _bounds(both[0], "event_ts")
    air, weather = (_in_time_order(side, "event_ts", "stream-side", bounds) for side in both)
    path = work_dir(spark, "stream-join")
    run_to_table(join_streams(air, weather, "2 hours"), path)
    return plain(spark.read.parquet(f"{path}/data"))


# What waits for a partner is given when both feeds are two hours past it.
@query(
    "stream_fallback",
    f"""WITH {READINGS},
    p AS (SELECT city, event_ts, max(value) AS peak, count(*) AS n FROM readings WHERE event_type = 'view' GROUP BY city, event_ts),
    s AS (SELECT city, event_ts, max(value) AS peak, count(*) AS n FROM readings WHERE event_type = 'click' GROUP BY city, event_ts),
    reached AS (SELECT least((SELECT max(event_ts) FROM p), (SELECT max(event_ts) FROM s)) - INTERVAL 2 HOUR AS mark)
    SELECT coalesce(p.city, s.city) AS city, coalesce(p.event_ts, s.event_ts) AS event_ts,
           CASE WHEN p.city IS NOT NULL THEN 'primary' ELSE 'secondary' END AS source,
           CASE WHEN p.city IS NOT NULL THEN p.peak ELSE s.peak END AS peak, CASE WHEN p.city IS NOT NULL THEN p.n ELSE s.n END AS n
    FROM p FULL JOIN s ON p.city = s.city AND p.event_ts = s.event_ts, reached
    WHERE (p.city IS NOT NULL AND s.city IS NOT NULL) OR coalesce(p.event_ts, s.event_ts) <= mark""",
)
def q_stream_fallback(spark, sf_dir):
    r = X.readings(spark, sf_dir)
    measures = {"peak": F.max("value"), "n": F.count(F.lit(1))}
    both = [materialize(hourly_measures(r.where(F.col("event_type") == t), measures), "hourly") for t in ("view", "click")]
    bounds = _bounds(both[0], "event_ts")
    view, click = (_in_time_order(side, "event_ts", "fallback-side", bounds) for side in both)
    path = work_dir(spark, "stream-fallback")
    run_to_table(fallback_streams(view, click, ["peak", "n"], "2 hours"), path)
    return plain(spark.read.parquet(f"{path}/data"))


@query(
    "stream_alerts",
    f"""WITH {FEATURES},
    high AS (SELECT city, event_ts, target_aqi FROM features WHERE target_aqi >= {HAZARD_THRESHOLD}e0),
    starts AS (SELECT *, CASE WHEN event_ts - lag(event_ts) OVER (PARTITION BY city ORDER BY event_ts) <= INTERVAL 90 MINUTE THEN 0 ELSE 1 END AS fresh FROM high),
    islands AS (SELECT *, sum(fresh) OVER (PARTITION BY city ORDER BY event_ts) AS island FROM starts),
    episodes AS (SELECT city, min(event_ts) AS started_at, max(event_ts) AS ended_at, count(*) AS hours, max(target_aqi) AS peak FROM islands GROUP BY city, island)
    SELECT *, {_category_sql('peak')} AS category FROM episodes
    WHERE ended_at + INTERVAL 90 MINUTE <= (SELECT max(event_ts) FROM features) - INTERVAL 2 HOUR""",
)
def q_stream_alerts(spark, sf_dir):
    """Episodes that have ended: what may still grow when the input ends is not given."""
    features = features_of(spark, sf_dir).select("city", F.timestamp_millis("timestamp").alias("event_ts"), "target_aqi")
    path = work_dir(spark, "stream-alerts")
    run_to_table(alert_episodes(_in_time_order(materialize(features, "features"), "event_ts", "alert-stream"), "event_ts", "2 hours", "target_aqi", HAZARD_THRESHOLD), path)
    return plain(spark.read.parquet(f"{path}/data"))


LATE_HOURS = 6
HOUR_MS = 3_600_000


@query(
    "stream_rate_in_time",
    f"""WITH {FEATURES},
    span AS (SELECT min(timestamp) AS lo, max(timestamp) AS hi FROM features)
    SELECT city, timestamp, target_aqi, aqi_change_rate FROM features, span
    WHERE timestamp >= lo + (hi - lo) // 3 AND timestamp <= hi - {LATE_HOURS * HOUR_MS}""",
)
def q_rate_in_time(spark, sf_dir):
    """The last two thirds arrive up to six hours late, in any order, behind an archive of the first third; rates are those of the whole history."""
    features = materialize(features_of(spark, sf_dir), "features")
    lo, hi = features.agg(F.min("timestamp"), F.max("timestamp")).first()
    live = F.col("timestamp") >= lo + (hi - lo) // 3
    table = work_dir(spark, "rate-archive")
    merge_into_table(features.where(~live), table, load_seq=0)
    late = F.pmod(F.xxhash64("city", "timestamp"), F.lit(LATE_HOURS * HOUR_MS))
    arriving = features.where(live).select("city", "timestamp", "target_aqi", (F.col("timestamp") + late).alias("arrives"))
    stream = _in_time_order(materialize(arriving, "arrivals"), "arrives", "late-stream")
    path = work_dir(spark, "stream-rate-in-time")
    archive = latest_per_city(feature_scan(spark, table, ["city", "timestamp", "target_aqi"]))
    run_to_table(change_rates_in_time(stream, f"{LATE_HOURS} hours", archive), path)
    return spark.read.parquet(f"{path}/data")


@query("stream_change_rate", f"WITH {FEATURES} SELECT city, timestamp, target_aqi, aqi_change_rate FROM features")
def q_stream_rate(spark, sf_dir):
    stream = _in_time_order(materialize(features_of(spark, sf_dir), "features"), "timestamp", "feature-stream")
    path = work_dir(spark, "stream-rate")
    run_to_table(change_rates(stream), path)
    return spark.read.parquet(f"{path}/data")


@query("stream_upsert", f"WITH {FEATURES} SELECT {FEATURE_SELECT} FROM features")
def q_stream_upsert(spark, sf_dir):
    root = work_dir(spark, "stream-upsert")
    run_upsert(_in_time_order(materialize(features_of(spark, sf_dir), "features"), "timestamp", "feature-stream"), f"{root}/table", f"{root}/checkpoint")
    return plain(feature_scan(spark, f"{root}/table"), 6, ["humidex"])


VALUES = [c for c in S.FEATURE_COLS if c not in S.KEY_COLS]


@query(
    "stream_features",
    f"""SELECT {', '.join([*S.FEATURE_COLS, 'label_scale', 'source'])} FROM ({LANDED_VECTORS})
    QUALIFY row_number() OVER (PARTITION BY city, timestamp ORDER BY {', '.join(f'{c} DESC NULLS LAST' for c in [*VALUES, 'label_scale', 'source'])}) = 1""",
)
def q_stream_features(spark, sf_dir):
    root = work_dir(spark, "stream-features")
    landed = X.landed(_event_stream(pin_utc(spark), sf_dir)).drop("event_id")
    run_features(landed, f"{root}/table", f"{root}/dead-letters", f"{root}/checkpoint")
    return feature_scan(spark, f"{root}/table", [*S.FEATURE_COLS, "label_scale", "source"])
