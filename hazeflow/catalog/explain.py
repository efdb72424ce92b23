"""Explanations of given models, with twins that go through all subsets of the inputs."""

from __future__ import annotations

from itertools import combinations
from math import factorial

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import functions as F

from ..ml.lime import lime
from ..ml.tree_shap import counted_on, mean_shap, tree_shap
from ..ml.trees import NODE_COLUMNS, TreeModel
from .base import plain, query
from .mldata import MARKED, WEIGHTS, _parts

INPUTS = ["pm25", "humidity", "hour"]
# Two given trees over these inputs: inner nodes (input, threshold, left, right), leaves a value.
TREES = [
    ("pm25", 80.0, ("humidity", 50.0, 10.0, 25.0), ("pm25", 160.0, 60.0, ("humidity", 35.0, 90.0, 120.0))),
    ("hour", 11.0, ("pm25", 120.0, -5.0, 8.0), ("humidity", 30.0, ("pm25", 40.0, -2.0, 3.0), ("hour", 17.0, 4.0, ("pm25", 100.0, 6.0, -9.0)))),
]
BASE = 50.0


def given_trees() -> TreeModel:
    """The trees as a model; its splits have no weights yet."""
    table = []
    for number, tree in enumerate(TREES):
        order = [tree]
        for at, node in enumerate(order):
            inner = isinstance(node, tuple)
            table.append((number, at, INPUTS.index(node[0]) if inner else -1, node[1] if inner else 0.0, len(order) if inner else -1, 0.0, 0, 0, 0.0 if inner else node))
            if inner:
                order.extend(node[2:])
    return TreeModel(INPUTS, BASE, pd.DataFrame(table, columns=NODE_COLUMNS))


def _counts(tree, place: str, where: str = "true") -> list[str]:
    """One count of training rows per node."""
    own = [f"count(*) FILTER (WHERE {where}) AS {place}"]
    if isinstance(tree, tuple):
        c, t, left, right = tree
        own += _counts(left, place + "l", f"{where} AND {c} <= {t}e0") + _counts(right, place + "r", f"{where} AND {c} > {t}e0")
    return own


def _mean_given(tree, place: str, known: tuple[str, ...]) -> str:
    """What a tree predicts when only some inputs are known."""
    if not isinstance(tree, tuple):
        return f"{tree}e0"
    c, t, left, right = tree
    l, r = _mean_given(left, place + "l", known), _mean_given(right, place + "r", known)  # noqa: E741
    if c in known:
        return f"(CASE WHEN {c} <= {t}e0 THEN {l} ELSE {r} END)"
    return f"(CASE WHEN {place} = 0 THEN ({l} + {r}) / 2e0 ELSE ({place}l * {l} + {place}r * {r}) / CAST({place} AS DOUBLE) END)"


def _shapley_sql(c: str) -> str:
    others, n, terms = [x for x in INPUTS if x != c], len(INPUTS), []
    for k in range(n):
        for s in combinations(others, k):
            weight = factorial(k) * factorial(n - 1 - k)
            terms.append(f"{weight}e0 * (v_{_name((*s, c))} - v_{_name(s)})")
    return f"({' + '.join(terms)}) / {factorial(n)}e0"


def _name(known) -> str:
    return "".join("1" if c in known else "0" for c in INPUTS)


_SUBSETS = [s for k in range(len(INPUTS) + 1) for s in combinations(INPUTS, k)]
SHAP_SQL = f"""WITH {MARKED},
counts AS (SELECT {", ".join(x for i, t in enumerate(TREES) for x in _counts(t, f"t{i}"))} FROM train WHERE {" AND ".join(f"{c} IS NOT NULL" for c in INPUTS)}),
games AS (SELECT city, timestamp, {", ".join(INPUTS)}, {", ".join(f"{BASE}e0 + " + " + ".join(_mean_given(t, f"t{i}", s) for i, t in enumerate(TREES)) + f" AS v_{_name(s)}" for s in _SUBSETS)}
  FROM features, counts),
shares AS (SELECT city, timestamp, {", ".join(f"CASE WHEN {' AND '.join(f'{x} IS NOT NULL' for x in INPUTS)} THEN {_shapley_sql(c)} END AS shap_{c}" for c in INPUTS)},
  CASE WHEN {" AND ".join(f"{x} IS NOT NULL" for x in INPUTS)} THEN v_{_name(())} END AS shap_base FROM games)"""


def _explained(spark, sf_dir):
    features, train = _parts(spark, sf_dir)
    return tree_shap(counted_on(given_trees(), train), features)


@query("tree_shap", f"{SHAP_SQL} SELECT city, timestamp, " + ", ".join(f"round({c}, 6) + 0e0 AS {c}" for c in [*(f"shap_{c}" for c in INPUTS), "shap_base"]) + " FROM shares")
def q_tree_shap(spark, sf_dir):
    """Shapley values of two given trees for every row, their splits weighted by the rows to train on."""
    return plain(_explained(spark, sf_dir).select("city", "timestamp", *[f"shap_{c}" for c in INPUTS], "shap_base"), 6)


@query("tree_shap_mean", f"{SHAP_SQL} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(avg(abs(shap_{c})), 6) + 0e0 AS mean_abs_shap FROM shares" for c in INPUTS))
def q_tree_shap_mean(spark, sf_dir):
    """How much each input moves the given trees' prediction on average."""
    return plain(mean_shap(_explained(spark, sf_dir), INPUTS), 6)


@query(
    "lime_linear",
    f"WITH {MARKED}, spread AS (SELECT " + ", ".join(f"stddev_pop({c}) AS s_{c}" for c in WEIGHTS) + " FROM train), complete AS (SELECT *, "
    + " AND ".join(f"{c} IS NOT NULL" for c in WEIGHTS) + " AS known FROM features) SELECT city, timestamp, "
    + ", ".join(f"CASE WHEN known THEN round({w}e0 * s_{c}, 6) + 0e0 END AS lime_{c}" for c, w in WEIGHTS.items())
    + ", CASE WHEN known THEN round(" + " + ".join(f"{w}e0 * {c}" for c, w in WEIGHTS.items()) + ", 6) + 0e0 END AS lime_intercept"
    + ", CASE WHEN known THEN 1e0 END AS lime_r2 FROM complete, spread",
)
def q_lime(spark, sf_dir):
    """A linear rule explained around every row: without a penalty its own weights come back. The rule's values have five decimals, so none is halfway at six."""
    features, train = _parts(spark, sf_dir)
    rule = SQLTransformer(statement="SELECT *, " + " + ".join(f"CAST({w} AS DOUBLE) * {c}" for c, w in WEIGHTS.items()) + " AS prediction FROM __THIS__")
    return plain(lime(PipelineModel(stages=[rule]), features, train, list(WEIGHTS), alpha=0.0), 6)
