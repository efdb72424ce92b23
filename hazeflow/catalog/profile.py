"""Profiling queries."""

from __future__ import annotations

from .. import fixtures as X
from ..operators import profile as P
from ..session import materialize
from .base import FEATURES, JOINED, plain, query
from .features import features_of

FEATURE_NUMERIC = [
    "pm25", "pm10", "temperature", "humidity", "humidex", "aqi_change_rate", "hour", "day", "month", "day_of_week",
    "target_aqi",
]
LINEITEM_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _long(cols: list[str], table: str) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS col, CAST({c} AS DOUBLE) AS v FROM {table}" for c in cols)


def _quantiles(cols: list[str], table: str) -> str:
    return f"""long AS ({_long(cols, table)}),
    q AS (SELECT col, quantile_cont(v, 0.25e0) AS q1, quantile_cont(v, 0.75e0) AS q3 FROM long GROUP BY col),
    fences AS (SELECT *, q1 - 1.5e0 * (q3 - q1) AS lo, q3 + 1.5e0 * (q3 - q1) AS hi FROM q)"""


BOUNDS = """SELECT col AS "column", round(q1, 6) AS q1, round(q3, 6) AS q3, round(lo, 6) AS lower_bound,
           round(hi, 6) AS upper_bound FROM fences"""
OUTLIERS = """SELECT col AS "column", CAST(count(*) FILTER (WHERE v < lo OR v > hi) AS BIGINT) AS outlier_count,
           round(100e0 * count(*) FILTER (WHERE v < lo OR v > hi) / count(*), 2) AS percentage
    FROM long JOIN fences USING (col) GROUP BY col"""


def _stored(spark, sf_dir):
    return materialize(features_of(spark, sf_dir), "features")


@query("iqr_bounds", f"WITH {FEATURES}, {_quantiles(FEATURE_NUMERIC, 'features')} {BOUNDS}")
def q_bounds(spark, sf_dir):
    return plain(P.iqr_bounds(_stored(spark, sf_dir)), 6)


@query("iqr_outliers", f"WITH {FEATURES}, {_quantiles(FEATURE_NUMERIC, 'features')} {OUTLIERS}")
def q_outliers(spark, sf_dir):
    return P.iqr_outliers(_stored(spark, sf_dir))


@query("iqr_bounds_lineitem", f"WITH {_quantiles(LINEITEM_NUMERIC, 'lineitem')} {BOUNDS}")
def q_bounds_lineitem(spark, sf_dir):
    return plain(P.iqr_bounds(X.load(spark, sf_dir, "lineitem"), LINEITEM_NUMERIC), 6)


@query("iqr_outliers_lineitem", f"WITH {_quantiles(LINEITEM_NUMERIC, 'lineitem')} {OUTLIERS}")
def q_outliers_lineitem(spark, sf_dir):
    return P.iqr_outliers(X.load(spark, sf_dir, "lineitem"), LINEITEM_NUMERIC)


@query("dataset_profile", f"WITH {FEATURES} SELECT count(*) AS n_rows, CAST(13 AS BIGINT) AS n_columns FROM features")
def q_profile(spark, sf_dir):
    return P.dataset_profile(features_of(spark, sf_dir))


@query(
    "null_counts",
    f"WITH {JOINED} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS null_count FROM joined"
        for c in ["city", "event_ts", "pm25", "pm10", "target_aqi", "temperature", "humidity"]
    ),
)
def q_nulls(spark, sf_dir):
    return P.null_counts(X.joined(spark, sf_dir))


def _corr_sql() -> str:
    pairs = [(a, b) for a in FEATURE_NUMERIC for b in FEATURE_NUMERIC if a != b]
    return " UNION ALL ".join(
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, CASE WHEN var_pop({a}) > 0 AND var_pop({b}) > 0"
        f" THEN round(corr({a}, {b}), 6) + 0e0 END AS corr FROM features"
        for a, b in pairs
    )


@query("corr_matrix", f"WITH {FEATURES} {_corr_sql()}")
def q_corr(spark, sf_dir):
    return plain(P.correlation_matrix(features_of(spark, sf_dir)), 6)


@query(
    "gap_report",
    f"""WITH {JOINED},
    span AS (SELECT city, min(event_ts) AS lo, max(event_ts) AS hi FROM joined GROUP BY city),
    axis AS (SELECT city, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS event_ts FROM span)
    SELECT city, event_ts FROM axis ANTI JOIN joined USING (city, event_ts)""",
)
def q_gaps(spark, sf_dir):
    return plain(P.gap_report(X.joined(spark, sf_dir)))


@query(
    "quality_gate",
    f"""WITH {FEATURES}
    SELECT bool_and(target_aqi IS NOT NULL) AS all_present, count(*) AS n_rows, true AS is_numeric FROM features""",
)
def q_gate(spark, sf_dir):
    return P.quality_gate(features_of(spark, sf_dir))
