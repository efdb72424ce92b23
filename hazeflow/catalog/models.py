"""Model training, tuning, registry and scoring. Results of iterative fits have no SQL twin, but one round of boosting has."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import functions as F

from ..ml.explain import permutation_importance
from ..ml.metrics import METRICS, regression_metrics
from ..ml.models import BINS as MLLIB_BINS
from ..ml.models import DEEPEST, FOREST, evaluate, train_and_evaluate, usable
from ..ml.neural import NeuralUnit, fit_neural
from ..ml.registry import NEURAL, load_champion, read_registry, register_model
from ..ml.scaling import fit_scaler, model_columns, standard_scale
from ..ml.split import split
from ..ml.search import grid_search
from ..ml.trees import BINS, PENALTY, Spec, fit_trees
from ..ml.tuning import BOOSTED_GRID, FOREST_GRID
from ..operators.joins import horizon_labels
from ..plans.inference import forecast, score_with
from ..session import materialize, work_dir
from .base import FEATURES, plain, query
from .features import features_of
from .mldata import RULES
from .store import HORIZONS


def _stored(spark, sf_dir):
    """The feature table, written once: trainers read it many times."""
    return materialize(features_of(spark, sf_dir), "features")


def _report(spark, algo, metrics):
    return spark.createDataFrame([(algo, metrics["mae"], metrics["rmse"], metrics["r2"])], "algo string, mae double, rmse double, r2 double")


def _train_eval(kind):
    def run(spark, sf_dir):
        train, test = split(_stored(spark, sf_dir))
        return _report(spark, kind, train_and_evaluate(train, test, kind)[1])

    return run


q_ridge = query("ridge_train_eval")(_train_eval("ridge"))
q_boosted = query("gbt_train_eval")(_train_eval("boosted"))


@query("mlp_train_eval")
def q_neural(spark, sf_dir):
    cols = model_columns()
    train, test = split(usable(_stored(spark, sf_dir), cols))
    model = fit_neural(standard_scale(train, train, cols), cols)
    unit, root = NeuralUnit(fit_scaler(train, cols)[0], model, cols), work_dir(spark, "registry")
    register_model(spark, root, "aqi", NEURAL, unit, {"r2": 0.0}, "registered before it is measured")
    scored = load_champion(spark, root, "aqi").transform(test)
    return regression_metrics(scored, "target_aqi").select(F.lit(NEURAL).alias("algo"), "mae", "rmse", "r2")


def _tune(kind, grid):
    def run(spark, sf_dir):
        train, test = split(_stored(spark, sf_dir))
        _, metrics, results = grid_search(train, test, kind, grid)
        rows = [(kind, str(sorted(s.items())), float(r2), metrics["r2"]) for s, r2 in results]
        return spark.createDataFrame(rows, "algo string, setting string, mean_r2 double, test_r2 double")

    return run


q_tune_forest = query("rf_tune")(_tune("forest", FOREST_GRID))
q_tune_boosted = query("gbt_tune")(_tune("boosted", BOOSTED_GRID))


def _tree_eval(algo, spec, bins=BINS):
    def run(spark, sf_dir):
        train, test = split(_stored(spark, sf_dir))
        scored = fit_trees(train, model_columns(), spec, bins=bins).transform(test)
        return regression_metrics(scored, "target_aqi").select(F.lit(algo).alias("algo"), "mae", "rmse", "r2")

    return run


# MLlib's settings of a forest (``models.random_forest``), grown by tasks to the end: MLlib sends all bins of all inputs for every node, which a depth of 30 makes too much.
q_forest = query("rf_train_eval")(_tree_eval("forest", Spec(FOREST["numTrees"], DEEPEST, forest=True, seed=FOREST["seed"]), MLLIB_BINS))

# The settings of the two tree models outside the searches.
q_tree_forest = query("tree_forest_eval")(_tree_eval("forest", Spec(200, forest=True)))
q_tree_boosted = query("tree_boosted_eval")(_tree_eval("boosted", Spec(100, 5, 0.1)))

# A first boosting round of depth 1 on the calendar inputs: each of their values is a bin of its own.
STUMP_INPUTS = ["hour", "day", "month", "day_of_week"]
STUMP_RATE = 0.1
STUMP_SQL = f"""WITH {FEATURES},
usable AS (SELECT {", ".join(STUMP_INPUTS)}, target_aqi FROM features WHERE target_aqi IS NOT NULL),
base AS (SELECT avg(target_aqi) AS base, count(*) AS n, sum(target_aqi) AS total FROM usable),
bins AS (""" + " UNION ALL ".join(
    f"SELECT {i} AS place, '{c}' AS input, CAST({c} AS DOUBLE) AS threshold, count(*) AS h, sum(base - target_aqi) AS g FROM usable, base GROUP BY {c}"
    for i, c in enumerate(STUMP_INPUTS)
) + f"""),
lefts AS (
  SELECT place, input, threshold, sum(h) OVER w AS hl, sum(g) OVER w AS gl, sum(h) OVER (PARTITION BY place) AS h, sum(g) OVER (PARTITION BY place) AS g
  FROM bins WINDOW w AS (PARTITION BY place ORDER BY threshold)
),
gains AS (
  SELECT *, gl * gl / (hl + {PENALTY}e0) + (g - gl) * (g - gl) / (h - hl + {PENALTY}e0) - g * g / (h + {PENALTY}e0) AS gain FROM lefts WHERE h > hl
),
best AS (SELECT * FROM gains ORDER BY gain DESC, place, threshold LIMIT 1)
SELECT 0 AS node, input, threshold, round(gain, 3) AS gain, CAST(h AS BIGINT) AS n_rows, round(-g / (h + {PENALTY}e0) * {STUMP_RATE}e0, 6) + 0e0 AS value FROM best
UNION ALL SELECT 1, NULL, NULL, 0e0, CAST(hl AS BIGINT), round(-gl / (hl + {PENALTY}e0) * {STUMP_RATE}e0, 6) + 0e0 FROM best
UNION ALL SELECT 2, NULL, NULL, 0e0, CAST(h - hl AS BIGINT), round(-(g - gl) / (h - hl + {PENALTY}e0) * {STUMP_RATE}e0, 6) + 0e0 FROM best"""


@query("boosted_stump", STUMP_SQL)
def q_stump(spark, sf_dir):
    """The node table of one round: split, second-order gain and leaf values with the penalty."""
    rows = _stored(spark, sf_dir).dropna(subset=[*STUMP_INPUTS, "target_aqi"])
    model = fit_trees(rows, STUMP_INPUTS, Spec(1, 1, STUMP_RATE))
    inner = F.col("feature") >= 0
    nodes = model.node_table(spark).select(
        "node", F.when(inner, F.get(F.array(*map(F.lit, STUMP_INPUTS)), F.col("feature"))).alias("input"), F.when(inner, F.col("threshold")).alias("threshold"),
        "gain", F.col("rows").alias("n_rows"), "value",
    )
    return plain(plain(nodes, 3, ["gain"]), 6, ["value"])


def _registered(spark, sf_dir):
    """Two ridge models of different penalty in a fresh registry."""
    features = _stored(spark, sf_dir)
    train, test = split(features)
    root = work_dir(spark, "registry")
    for alpha in (1.0, 1000.0):
        model, metrics = train_and_evaluate(train, test, "ridge", alpha=alpha)
        register_model(spark, root, "aqi", "ridge", model, metrics, f"ridge, alpha {alpha}")
    return features, root


@query("model_registry")
def q_registry(spark, sf_dir):
    _, root = _registered(spark, sf_dir)
    return read_registry(spark, root).select(
        "name", "version", "algo", F.col("metrics")["r2"].alias("r2"), F.col("metrics")["mae"].alias("mae"), "description"
    )


@query("batch_score")
def q_batch_score(spark, sf_dir):
    features, root = _registered(spark, sf_dir)
    return score_with(load_champion(spark, root, "aqi"), features)


@query("perm_importance")
def q_importance(spark, sf_dir):
    train, test = split(_stored(spark, sf_dir))
    model, _ = train_and_evaluate(train, test, "ridge")
    return permutation_importance(model, test, model_columns())


# --- rules in place of fitted models: what surrounds a model, with exact twins ---


def _rule(expression: str) -> PipelineModel:
    """A saved unit like any model, whose prediction is a given expression."""
    return PipelineModel(stages=[SQLTransformer(statement=f"SELECT *, CAST({expression} AS DOUBLE) AS prediction FROM __THIS__")])


def _registered_rules(spark, sf_dir):
    features, root = _stored(spark, sf_dir), work_dir(spark, "rules")
    for algo, expression in RULES.items():
        model = _rule(expression)
        row = evaluate(model, features).first()
        register_model(spark, root, "aqi", algo, model, {m: row[m] for m in METRICS}, expression)
    return features, root


RULE_SCORES = f"WITH {FEATURES}, scored AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS algo, {v} AS version, city, timestamp, target_aqi AS y, {e} AS p FROM features"
    for v, (n, e) in enumerate(RULES.items(), 1)
) + """), scores AS (
      SELECT algo, version, 1e0 - avg((y - p) * (y - p)) / var_pop(y) AS r2, avg(abs(y - p)) AS mae FROM scored GROUP BY algo, version)"""


@query(
    "rule_registry",
    RULE_SCORES + """ SELECT 'aqi' AS name, CAST(version AS BIGINT) AS version, algo, round(r2, 6) AS r2, round(mae, 6) AS mae FROM scores""",
)
def q_rule_registry(spark, sf_dir):
    """Four rules saved, registered and listed."""
    _, root = _registered_rules(spark, sf_dir)
    listed = read_registry(spark, root)
    return plain(listed.select("name", "version", "algo", F.col("metrics")["r2"].alias("r2"), F.col("metrics")["mae"].alias("mae")), 6)


@query(
    "rule_score",
    RULE_SCORES + """ SELECT city, timestamp, round(p, 6) AS prediction FROM scored
    WHERE algo = (SELECT algo FROM scores ORDER BY r2 DESC, version LIMIT 1)""",
)
def q_rule_score(spark, sf_dir):
    """The best registered rule, loaded and applied to every row."""
    features, root = _registered_rules(spark, sf_dir)
    return plain(score_with(load_champion(spark, root, "aqi"), features), 6)


@query(
    "horizon_persistence",
    f"WITH {FEATURES} " + " UNION ALL ".join(
        f"""SELECT {h} AS horizon_h, count(*) AS n, round(avg(abs(l.target_aqi - f.target_aqi)), 6) AS mae,
        round(sqrt(avg((l.target_aqi - f.target_aqi) * (l.target_aqi - f.target_aqi))), 6) AS rmse,
        round(1e0 - avg((l.target_aqi - f.target_aqi) * (l.target_aqi - f.target_aqi)) / var_pop(l.target_aqi), 6) AS r2
        FROM features f JOIN features l ON l.city = f.city AND l.event_ts = f.event_ts + INTERVAL {h} HOUR
        WHERE f.target_aqi IS NOT NULL AND l.target_aqi IS NOT NULL"""
        for h in HORIZONS
    ),
)
def q_horizon_persistence(spark, sf_dir):
    """The forecast job at each horizon with the rule that nothing changes, measured against the labels of that hour."""
    features = _stored(spark, sf_dir)
    ahead = forecast(features, {h: _rule("target_aqi") for h in HORIZONS})
    labels = horizon_labels(features.withColumn("event_ts", F.timestamp_millis("timestamp")), HORIZONS)
    later = labels.select("city", "timestamp", F.explode(F.array(*[F.struct(F.lit(h).alias("horizon_h"), F.col(f"label_{h}h").alias("label")) for h in HORIZONS])).alias("l"))
    scored = ahead.join(later.select("city", "timestamp", "l.*"), ["city", "timestamp", "horizon_h"])
    return plain(regression_metrics(scored, by=["horizon_h"]), 6)


@query("horizon_forecast")
def q_horizon_forecast(spark, sf_dir):
    """A ridge per horizon, fitted on that horizon's label, applied to every row."""
    features = _stored(spark, sf_dir)
    labels = horizon_labels(features.withColumn("event_ts", F.timestamp_millis("timestamp")), HORIZONS)
    both = features.drop("target_aqi").join(labels.select("city", "timestamp", *[f"label_{h}h" for h in HORIZONS]), ["city", "timestamp"])
    models = {}
    for h in HORIZONS:
        train, test = split(materialize(both.withColumnRenamed(f"label_{h}h", "target_aqi"), f"horizon-{h}"))
        models[h] = train_and_evaluate(train, test, "ridge")[0]
    return forecast(features, models)
