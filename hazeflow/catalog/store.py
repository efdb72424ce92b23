"""Queries on the stored table."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from ..operators.joins import horizon_labels, point_in_time_join
from ..operators.parity import parity_report
from ..operators.sketches import refresh_sketches, table_quantiles
from ..operators.store import compact, merge_into_table, month_of, read_online, retain, save_online, vacuum
from ..session import materialize, work_dir
from ..sources.tables import feature_scan
from .base import FEATURE_SELECT, FEATURES, plain, query
from .features import features_of
from .profile import FEATURE_NUMERIC, _long

THREE_DAYS_MS = 3 * 86_400_000


@query(
    "feature_upsert",
    f"""WITH {FEATURES},
    corrected AS (
      SELECT * REPLACE (CASE WHEN timestamp > max(timestamp) OVER () - {THREE_DAYS_MS} THEN target_aqi + 1e0
                        ELSE target_aqi END AS target_aqi) FROM features)
    SELECT {FEATURE_SELECT} FROM corrected""",
)
def q_upsert(spark, sf_dir):
    """A base load, a correction of the last three days, that correction once more, and its months compacted."""
    path = work_dir(spark, "feature-table")
    base = materialize(features_of(spark, sf_dir), "features")
    newest = base.agg(F.max("timestamp").alias("t")).scalar()
    correction = base.where(F.col("timestamp") > newest - F.lit(THREE_DAYS_MS)).withColumn(
        "target_aqi", F.col("target_aqi") + F.lit(1.0)
    )
    merge_into_table(base, path, load_seq=0)
    merge_into_table(correction, path, load_seq=1)
    merge_into_table(correction, path, load_seq=1)
    compact(spark, path, [r[0] for r in correction.select(month_of("timestamp")).distinct().collect()])
    return plain(feature_scan(spark, path), 6, ["humidex"])


@query(
    "latest_per_city",
    f"""WITH {FEATURES}
    SELECT {FEATURE_SELECT} FROM features QUALIFY row_number() OVER (PARTITION BY city ORDER BY timestamp DESC) = 1""",
)
def q_latest(spark, sf_dir):
    path = work_dir(spark, "online")
    save_online(features_of(spark, sf_dir), path)
    return plain(read_online(spark, path), 6, ["humidex"])


@query(
    "online_correction",
    f"""WITH {FEATURES},
    newest AS (SELECT * FROM features QUALIFY row_number() OVER (PARTITION BY city ORDER BY timestamp DESC) = 1)
    SELECT {FEATURE_SELECT.replace("target_aqi", "target_aqi - 1e0 AS target_aqi")} FROM newest""",
)
def q_online_correction(spark, sf_dir):
    """The online copy after a correction of the newest hour to smaller values, followed by a repeat of the first load."""
    path, features = work_dir(spark, "online"), materialize(features_of(spark, sf_dir), "features")
    save_online(features, path, 0)
    save_online(features.withColumn("target_aqi", F.col("target_aqi") - 1.0), path, 1)
    save_online(features, path, 0)
    return plain(read_online(spark, path), 6, ["humidex"])


CORRECTED = f"""corrected AS (
      SELECT * REPLACE (CASE WHEN timestamp > max(timestamp) OVER () - {THREE_DAYS_MS} THEN target_aqi + 1e0
                        ELSE target_aqi END AS target_aqi) FROM features)"""


def _corrected_table(spark, sf_dir, purpose):
    """A table of a base load and a correction of the last three days: (path, base, correction, their commits)."""
    path = work_dir(spark, purpose)
    base = materialize(features_of(spark, sf_dir), "features")
    newest = base.agg(F.max("timestamp").alias("t")).scalar()
    correction = base.where(F.col("timestamp") > newest - F.lit(THREE_DAYS_MS)).withColumn(
        "target_aqi", F.col("target_aqi") + F.lit(1.0)
    )
    return path, base, correction, [merge_into_table(base, path, load_seq=0), merge_into_table(correction, path, load_seq=1)]


@query(
    "feature_versions",
    f"""WITH {FEATURES}, {CORRECTED}
    SELECT 'first load' AS version, {FEATURE_SELECT} FROM features
    UNION ALL SELECT 'correction' AS version, {FEATURE_SELECT} FROM corrected""",
)
def q_versions(spark, sf_dir):
    """The table as of its first load and as of a correction, both read after a compaction has replaced them."""
    path, _, correction, (first, second) = _corrected_table(spark, sf_dir, "versions")
    compact(spark, path, [r[0] for r in correction.select(month_of("timestamp")).distinct().collect()])
    views = [feature_scan(spark, path, as_of=commit).select(F.lit(name).alias("version"), "*") for name, commit in (("first load", first), ("correction", second))]
    return plain(views[0].unionByName(views[1]), 6, ["humidex"])


@query(
    "feature_retention",
    f"""WITH {FEATURES}, {CORRECTED}
    SELECT {FEATURE_SELECT} FROM corrected""",
)
def q_retention(spark, sf_dir):
    """The newest version, after a compaction of all months, with all earlier versions given up and their folders removed."""
    path, base, _, _ = _corrected_table(spark, sf_dir, "retention")
    kept = compact(spark, path, [r[0] for r in base.select(month_of("timestamp")).distinct().collect()])
    retain(spark, path, kept)
    vacuum(spark, path)
    return plain(feature_scan(spark, path), 6, ["humidex"])


def _parity_sql():
    per_column = " UNION ALL ".join(
        f"""SELECT view, '{c}' AS "column", count(*) FILTER (WHERE has_base AND has_row) AS n_shared,
             count(*) FILTER (WHERE has_base AND NOT has_row) AS n_missing, count(*) FILTER (WHERE NOT has_base AND has_row) AS n_extra,
             count(*) FILTER (WHERE has_base AND has_row AND coalesce(abs(new_{c} - old_{c}) > 1e-9, new_{c} IS DISTINCT FROM old_{c})) AS n_differs,
             round(max(CASE WHEN has_base AND has_row THEN abs(new_{c} - old_{c}) END), 6) AS max_abs_diff FROM held GROUP BY view"""
        for c in FEATURE_NUMERIC
    )
    old = ", ".join(f"f.{c} AS old_{c}" for c in FEATURE_NUMERIC)
    held = " UNION ALL ".join(
        f"SELECT '{name}' AS view, f.city IS NOT NULL AS has_base, v.city IS NOT NULL AS has_row, {old}, "
        + ", ".join(f"v.{c} AS new_{c}" for c in FEATURE_NUMERIC)
        + f" FROM features f FULL JOIN {view} v ON f.city = v.city AND f.timestamp = v.timestamp"
        for name, view in (("stored", "corrected"), ("first load", "features"), ("online", "newest"))
    )
    return f"""WITH {FEATURES}, {CORRECTED},
    newest AS (SELECT * FROM corrected QUALIFY row_number() OVER (PARTITION BY city ORDER BY timestamp DESC) = 1),
    held AS ({held})
    {per_column}"""


@query("feature_parity", _parity_sql())
def q_parity(spark, sf_dir):
    """What training reads (newest and first version) and what serving reads, held against features computed anew."""
    path, base, correction, (first, _) = _corrected_table(spark, sf_dir, "parity")
    online = work_dir(spark, "online")
    save_online(base, online, 0)
    save_online(correction, online, 1)
    views = {"stored": feature_scan(spark, path), "first load": feature_scan(spark, path, as_of=first), "online": read_online(spark, online)}
    return plain(parity_report(base, views, FEATURE_NUMERIC, 1e-9), 6, ["max_abs_diff"])


QUARTILES = [0.25, 0.5, 0.75]
RANK_ERROR = 0.01


@query(
    "monthly_sketches",
    f"""WITH {FEATURES}, {CORRECTED}, long AS ({_long(FEATURE_NUMERIC, "corrected")})
    SELECT col AS "column", p, count(v) AS n, true AS within_bound
    FROM long, (SELECT unnest([0.25e0, 0.5e0, 0.75e0]) AS p) GROUP BY col, p HAVING count(v) > 0""",
)
def q_sketches(spark, sf_dir):
    """Quartiles of the corrected table from sketches per month, refreshed after each load; do their true ranks lie within one percent?"""
    path = work_dir(spark, "sketched")
    base = materialize(features_of(spark, sf_dir), "features")
    newest = base.agg(F.max("timestamp").alias("t")).scalar()
    merge_into_table(base, path, load_seq=0)
    refresh_sketches(spark, path, FEATURE_NUMERIC)
    late = base.where(F.col("timestamp") > newest - F.lit(THREE_DAYS_MS))
    merge_into_table(late.withColumn("target_aqi", F.col("target_aqi") + F.lit(1.0)), path, load_seq=1)
    refresh_sketches(spark, path, FEATURE_NUMERIC)
    found = materialize(table_quantiles(spark, path, FEATURE_NUMERIC, QUARTILES), "quartiles")
    # A row per column and probability.
    asked = found.groupBy("column").agg(F.sort_array(F.collect_list(F.struct("p", "n", "value"))).alias("asked"))
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in FEATURE_NUMERIC]))
    rows = feature_scan(spark, path).select(each.alias("e")).select("e.*").where("v IS NOT NULL")
    counted = rows.groupBy("column", "v").agg(F.count(F.lit(1)).alias("c")).join(F.broadcast(asked), "column")
    ranks = counted.select("c", "v", "column", F.explode("asked").alias("q")).groupBy("column", "q.p", "q.n", "q.value").agg(
        F.sum(F.when(F.col("v") < F.col("q.value"), F.col("c")).otherwise(0)).alias("below"),
        F.sum(F.when(F.col("v") <= F.col("q.value"), F.col("c")).otherwise(0)).alias("through"),
    )
    # Of few values the rank moves by whole ones.
    slack = F.lit(RANK_ERROR) * F.col("n") + F.lit(1)
    near = (F.col("below") - slack <= F.col("p") * F.col("n")) & (F.col("p") * F.col("n") <= F.col("through") + slack)
    return ranks.select("column", "p", "n", near.alias("within_bound"))


def _with_event_ts(features):
    return features.withColumn("event_ts", F.timestamp_millis("timestamp"))


@query(
    "point_in_time_join",
    f"""WITH {FEATURES},
    asked AS (SELECT event_id, 'st' || (user_id // 25) AS city, ts AS label_ts, value AS label FROM events)
    SELECT asked.event_id, asked.city, asked.label_ts, asked.label, features.event_ts AS feature_ts,
           features.pm25, features.target_aqi
    FROM asked ASOF LEFT JOIN features ON asked.city = features.city AND asked.label_ts >= features.event_ts""",
)
def q_point_in_time(spark, sf_dir):
    labels = X.load(spark, sf_dir, "events").select(
        "event_id",
        X.station_key(F.col("user_id")).alias("city"),
        F.col("ts").cast("timestamp").alias("label_ts"),
        F.col("value").alias("label"),
    )
    return plain(point_in_time_join(labels, _with_event_ts(features_of(spark, sf_dir)), ["pm25", "target_aqi"]))


HORIZONS = [24, 48, 72]


@query(
    "horizon_label",
    f"WITH {FEATURES} SELECT f.city, f.timestamp, f.target_aqi, "
    + ", ".join(f"h{h}.target_aqi AS label_{h}h" for h in HORIZONS)
    + " FROM features f "
    + " ".join(
        f"LEFT JOIN features h{h} ON h{h}.city = f.city AND h{h}.event_ts = f.event_ts + INTERVAL {h} HOUR"
        for h in HORIZONS
    ),
)
def q_horizon(spark, sf_dir):
    features = _with_event_ts(features_of(spark, sf_dir)).select("city", "timestamp", "event_ts", "target_aqi")
    return horizon_labels(features, HORIZONS).drop("event_ts")
