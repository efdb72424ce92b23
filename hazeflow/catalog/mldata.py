"""Data preparation for training, metrics, and what SQL can say about models."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from .. import schema as S
from ..ml.explain import linear_shap
from ..ml.gram import gram_matrix
from ..ml.metrics import champion_select, regression_metrics
from ..ml.scaling import design_columns, design_matrix, scaler_stats, standard_scale
from ..ml.split import linear_bucket, split, with_exact_fold, with_exact_split, with_fold, with_split
from ..session import materialize
from .base import FEATURES, plain, query
from .features import features_of

COLS = S.MODEL_COLS

# Buckets both engines can compute. Feature rows are numbered by hour and station.
FEATURE_TERMS = {"_hour_no": 31, "_station_no": 17}
LINE_TERMS = {"l_orderkey": 31, "l_linenumber": 17}
LINE_FOLD_TERMS = {"l_orderkey": 13, "l_linenumber": 7}


def _numbered(features):
    return features.withColumns(
        {
            "_hour_no": F.floor(F.col("timestamp") / F.lit(3_600_000)),
            "_station_no": F.substring("city", 3, 10).cast("bigint"),
        }
    )


def _bucket():
    return linear_bucket(FEATURE_TERMS, 42, 100)


def _parts(spark, sf_dir):
    """The stored feature table and its training part; what is fitted and what is transformed read it in turn."""
    features = _numbered(materialize(features_of(spark, sf_dir), "features"))
    return features, split(features, _bucket())[0]


MARKED = f"""{FEATURES},
marked AS (
  SELECT *, ((timestamp // 3600000) * 31 + CAST(substr(city, 3) AS BIGINT) * 17 + 42) % 100 < 20 AS is_test FROM features
),
train AS (SELECT * FROM marked WHERE NOT is_test)"""


@query(
    "design_matrix",
    f"WITH {FEATURES} SELECT city, timestamp, "
    + ", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in COLS)
    + ", target_aqi AS label FROM features",
)
def q_design(spark, sf_dir):
    return plain(design_columns(design_matrix(features_of(spark, sf_dir))), 6, COLS)


@query(
    "split_counts",
    f"""WITH {MARKED}
    SELECT 'features' AS source, CASE WHEN is_test THEN 'test' ELSE 'train' END AS split, count(*) AS n
    FROM marked GROUP BY is_test
    UNION ALL
    SELECT 'lineitem', CASE WHEN (l_orderkey * 31 + l_linenumber * 17 + 42) % 100 < 20 THEN 'test' ELSE 'train' END,
           count(*) FROM lineitem GROUP BY 2""",
)
def q_split_counts(spark, sf_dir):
    features = with_split(_numbered(features_of(spark, sf_dir)), _bucket())
    lines = with_split(X.load(spark, sf_dir, "lineitem"), linear_bucket(LINE_TERMS, 42, 100))

    def counted(df, source):
        return df.groupBy("split").agg(F.count(F.lit(1)).alias("n")).select(F.lit(source).alias("source"), "split", "n")

    return counted(features, "features").unionByName(counted(lines, "lineitem"))


@query(
    "fold_counts",
    """SELECT (l_orderkey * 13 + l_linenumber * 7 + 43) % 3 AS fold, count(*) AS n FROM lineitem
    WHERE NOT (l_orderkey * 31 + l_linenumber * 17 + 42) % 100 < 20 GROUP BY fold""",
)
def q_fold_counts(spark, sf_dir):
    train, _ = split(X.load(spark, sf_dir, "lineitem"), linear_bucket(LINE_TERMS, 42, 100))
    folded = with_fold(train, bucket=linear_bucket(LINE_FOLD_TERMS, 43, 3))
    return folded.groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


# Orders both engines can compute: one in which many rows are tied, one that tells all of them apart, and one with equal rows only.
TIED_ORDER, KEY_ORDER = "(l_orderkey * 31 + l_linenumber * 17 + 42) % 1000", "l_orderkey * 8 + l_linenumber"
KIND_ORDER = "l_linenumber % 3, ascii(l_returnflag), ascii(l_linestatus), l_linenumber"

RANKED = f"""ranked AS (
  SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY {TIED_ORDER}, {KEY_ORDER}) AS place, count(*) OVER () AS n FROM lineitem
)"""


def _exact_lines(spark, sf_dir, *extra):
    """Reading lineitem again is what a written table would cost."""
    return X.load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *extra)


@query(
    "split_exact",
    f"WITH {RANKED} SELECT l_orderkey, l_linenumber, CASE WHEN place <= ceil(0.2 * n) THEN 'test' ELSE 'train' END AS split FROM ranked",
)
def q_split_exact(spark, sf_dir):
    """The side of every line: a fifth, rounded up, is for testing, however many are tied where the cut lies."""
    return with_exact_split(_exact_lines(spark, sf_dir), order=[F.expr(TIED_ORDER), F.expr(KEY_ORDER)])


@query(
    "fold_exact",
    f"""WITH {RANKED}, numbered AS (
      SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY place) - 1 AS i, count(*) OVER () AS m FROM ranked WHERE place > ceil(0.2 * n))
    SELECT l_orderkey, l_linenumber, CAST(CASE WHEN i < (m // 3) + least(1, m % 3) THEN 0 WHEN i < 2 * (m // 3) + least(2, m % 3) THEN 1 ELSE 2 END AS INTEGER) AS fold
    FROM numbered""",
)
def q_fold_exact(spark, sf_dir):
    """Three folds of the lines to train on, equal but for one row."""
    order = [F.expr(TIED_ORDER), F.expr(KEY_ORDER)]
    marked = materialize(with_exact_split(_exact_lines(spark, sf_dir), order=order), "exact-split")
    return with_exact_fold(marked.where("split = 'train'").drop("split"), order=order)


@query(
    "split_ties",
    f"""WITH ranked AS (
      SELECT l_returnflag, l_linestatus, l_linenumber, row_number() OVER (ORDER BY {KIND_ORDER}) AS place, count(*) OVER () AS n FROM lineitem)
    SELECT l_returnflag, l_linestatus, l_linenumber, CASE WHEN place <= ceil(0.2 * n) THEN 'test' ELSE 'train' END AS split, count(*) AS n_rows
    FROM ranked GROUP BY ALL""",
)
def q_split_ties(spark, sf_dir):
    """The cut goes through thousands of rows that are equal in all columns; counted per kind of row."""
    kinds = X.load(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber")
    marked = with_exact_split(kinds, order=[F.expr(e) for e in KIND_ORDER.split(", ")])
    return marked.groupBy(*kinds.columns, "split").agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "scaler_stats",
    f"WITH {MARKED} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std FROM train"
        for c in COLS
    ),
)
def q_scaler(spark, sf_dir):
    train, _ = split(_numbered(features_of(spark, sf_dir)), _bucket())
    return plain(scaler_stats(train, COLS), 6)


@query(
    "standard_scale",
    f"WITH {MARKED}, stats AS (SELECT "
    + ", ".join(f"avg({c}) AS m_{c}, coalesce(nullif(stddev_pop({c}), 0), 1) AS s_{c}" for c in COLS)
    + " FROM train) SELECT city, timestamp, "
    + ", ".join(f"round(({c} - m_{c}) / s_{c}, 6) + 0e0 AS {c}" for c in COLS)
    + " FROM features, stats",
)
def q_scale(spark, sf_dir):
    features, train = _parts(spark, sf_dir)
    return plain(standard_scale(features, train, COLS).select("city", "timestamp", *COLS), 6)


def _gram_sql(cols, label, table):
    names = [*cols, label]
    return " UNION ALL ".join(
        f"SELECT '{a}' AS row, '{b}' AS col, round(sum(CAST({a} AS DOUBLE) * {b}) / count(*), 4) AS value FROM {table}"
        for i, a in enumerate(names)
        for b in names[i:]
        if (a, b) != (label, label)
    )


@query("gram_matrix", f"WITH {MARKED} {_gram_sql(COLS, 'target_aqi', 'train')}")
def q_gram(spark, sf_dir):
    """Per row: the sums themselves have few decimals, and rounding them would meet exact ties."""
    train = _parts(spark, sf_dir)[1]
    doubled = train.withColumns({c: F.col(c).cast("double") for c in COLS})
    n = train.agg(F.count(F.lit(1)).alias("n")).scalar()
    return plain(gram_matrix(doubled, COLS, "target_aqi").withColumn("value", F.col("value") / n), 4)


@query(
    "regression_metrics",
    """SELECT count(*) AS n, round(avg(abs(y - p)), 6) AS mae, round(sqrt(avg((y - p) * (y - p))), 6) AS rmse,
           round(1e0 - avg((y - p) * (y - p)) / var_pop(y), 6) AS r2
    FROM (SELECT l_extendedprice AS y, 1500e0 * l_quantity AS p FROM lineitem)""",
)
def q_metrics(spark, sf_dir):
    scored = X.load(spark, sf_dir, "lineitem").select(
        F.col("l_extendedprice").alias("label"), (F.lit(1500.0) * F.col("l_quantity")).alias("prediction")
    )
    return plain(regression_metrics(scored), 6)


# Simple predictors of the label, registered as if they were models.
RULES = {"persistence": "target_aqi - aqi_change_rate", "pm25_as_index": "pm25", "pm10_as_index": "pm10", "heat": "humidex"}


@query(
    "champion_select",
    f"WITH {FEATURES}, scored AS ("
    + " UNION ALL ".join(
        f"SELECT '{n}' AS algo, {v} AS version, target_aqi AS y, {e} AS p FROM features"
        for v, (n, e) in enumerate(RULES.items(), 1)
    )
    + """), scores AS (
      SELECT algo, version, 1e0 - avg((y - p) * (y - p)) / var_pop(y) AS r2, avg(abs(y - p)) AS mae
      FROM scored GROUP BY algo, version)
    SELECT 'aqi' AS name, CAST(version AS BIGINT) AS version, algo, round(r2, 6) AS r2, round(mae, 6) AS mae
    FROM scores ORDER BY r2 DESC, version LIMIT 1""",
)
def q_champion(spark, sf_dir):
    rules = [
        F.struct(F.lit(n).alias("algo"), F.lit(v).cast("bigint").alias("version"), F.expr(e).alias("prediction"))
        for v, (n, e) in enumerate(RULES.items(), 1)
    ]
    scored = features_of(spark, sf_dir).select(F.col("target_aqi").alias("label"), F.explode(F.array(*rules)).alias("r"))
    scores = regression_metrics(scored.select("label", "r.*"), by=["algo", "version"])
    registry = scores.select(
        F.lit("aqi").alias("name"),
        "version",
        "algo",
        F.create_map(*[x for m in ("mae", "rmse", "r2") for x in (F.lit(m), F.col(m))]).alias("metrics"),
    )
    best = champion_select(registry)
    return plain(best.select("name", "version", "algo", F.col("metrics")["r2"].alias("r2"), F.col("metrics")["mae"].alias("mae")), 6)


# A given linear model, for explanation.
WEIGHTS = {"pm25": 0.5, "pm10": 0.25, "temperature": -0.75, "humidity": 0.125, "aqi_change_rate": 0.5, "hour": -0.1}


@query(
    "linear_shap",
    f"WITH {MARKED}, means AS (SELECT "
    + ", ".join(f"avg({c}) AS m_{c}" for c in WEIGHTS)
    + " FROM train) SELECT city, timestamp, "
    + ", ".join(f"round({w}e0 * ({c} - m_{c}), 6) + 0e0 AS shap_{c}" for c, w in WEIGHTS.items())
    + " FROM features, means",
)
def q_shap(spark, sf_dir):
    features, train = _parts(spark, sf_dir)
    return plain(
        linear_shap(features, train, WEIGHTS).select("city", "timestamp", *[f"shap_{c}" for c in WEIGHTS]), 6
    )
