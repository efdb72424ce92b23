"""Explanations of trees against all subsets of inputs, local ones against a plain weighted ridge."""

from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hazeflow.ml import tree_shap as T
from hazeflow.ml.lime import WIDTH, lime, neighbourhood
from hazeflow.ml.tree_shap import contributions, counted_on, mean_shap, tree_shap
from hazeflow.ml.trees import NODE_COLUMNS, Spec, TreeModel, fit_trees

COLS = ["pm25", "hour", "humidity", "wind"]


def mean_given(table, x, known, node=0):
    r = table.loc[node]
    if r.feature < 0:
        return r.value
    left, right = int(r.left), int(r.left) + 1
    if int(r.feature) in known:
        return mean_given(table, x, known, left if x[int(r.feature)] <= r.threshold else right)
    share = table.loc[left].weight / r.weight if r.weight else 0.5
    return share * mean_given(table, x, known, left) + (1 - share) * mean_given(table, x, known, right)


def all_subsets(model, x):
    """Shapley values by their definition."""
    n = len(model.cols)
    tables = [t.set_index("node") for _, t in model.nodes.groupby("tree")]
    worth = {s: sum(mean_given(t, x, s) for t in tables) for k in range(n + 1) for s in combinations(range(n), k)}
    out = []
    for i in range(n):
        total = 0.0
        for s in (s for s in worth if i not in s):
            total += factorial(len(s)) * factorial(n - 1 - len(s)) / factorial(n) * (worth[tuple(sorted((*s, i)))] - worth[s])
        out.append(total)
    return out, worth[()]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    data = []
    for i in range(200):
        pm, hour, hum, wind = float(rng.integers(0, 30)), int(rng.integers(0, 24)), float(rng.integers(0, 9)), float(rng.integers(0, 4))
        data.append((f"c{i % 3}", i, pm, hour, hum, wind, float(2 * pm + (hour > 11) * 30 - hum * pm / 10 + wind * (hum > 4) + rng.normal(0, 3))))
    return spark.createDataFrame([*data, *data[:4]], "city string, timestamp long, pm25 double, hour long, humidity double, wind double, target_aqi double").repartition(3).cache()


@pytest.fixture(scope="module")
def fitted(rows):
    """Boosted trees, and a forest of unlimited depth, whose paths ask inputs again."""
    return {"boosted": fit_trees(rows, COLS, Spec(5, 4, 0.3)), "forest": fit_trees(rows, COLS, Spec(3, forest=True))}


@pytest.mark.parametrize("kind", ["boosted", "forest"])
def test_equals_all_subsets(fitted, rows, kind):
    model = fitted[kind]
    got = tree_shap(model, model.transform(rows)).toPandas()
    shap = got[[f"shap_{c}" for c in COLS]]
    np.testing.assert_allclose(shap.sum(axis=1) + got["shap_base"], got["prediction"], atol=1e-9)
    for at in range(0, len(got), 23):
        want, unknown = all_subsets(model, got.loc[at, COLS].to_numpy(float))
        np.testing.assert_allclose(shap.loc[at], want, atol=1e-9)
        assert got.loc[at, "shap_base"] == pytest.approx(model.base + unknown)


def test_chunks_do_not_matter(fitted, rows, monkeypatch):
    x = rows.select(*COLS).toPandas().to_numpy(float)
    want, unknown = contributions(x, fitted["forest"].arrays())
    monkeypatch.setattr(T, "CHUNK", 50)
    monkeypatch.setattr(T, "STRETCH", 7)
    got, again = contributions(x, fitted["forest"].arrays())
    np.testing.assert_allclose(got, want, atol=1e-9)
    assert again == pytest.approx(unknown)


def test_missing_inputs_no_rows_and_single_leaves(fitted, rows, spark):
    odd = rows.limit(3).withColumn("pm25", F.when(F.col("timestamp") < 0, F.col("pm25"))).withColumn("shap_base", F.lit("old"))
    got = tree_shap(fitted["boosted"], odd)
    assert [r.shap_pm25 is None and r.shap_base is None for r in got.collect()] == [True] * 3 and got.columns.count("shap_base") == 1
    assert tree_shap(fitted["boosted"], rows.limit(0)).count() == 0
    leaf = TreeModel(COLS, 1.0, pd.DataFrame([(0, 0, -1, 0.0, -1, 0.0, 3, 3, 2.0)], columns=NODE_COLUMNS))
    r = tree_shap(leaf, rows.limit(1)).first()
    assert r.shap_base == 3.0 and r.shap_pm25 == 0.0
    nothing = TreeModel(COLS, 1.5, pd.DataFrame([], columns=NODE_COLUMNS))
    assert tree_shap(nothing, rows.limit(1)).first().shap_base == 1.5


def test_counting_again(fitted, rows):
    """Boosted trees see every row: counting the same rows gives the same weights. No rows on a side: both count alike."""
    model = fitted["boosted"]
    pd.testing.assert_frame_equal(counted_on(model, rows).nodes, model.nodes)
    few = counted_on(model, rows.where("pm25 < 4"))
    x = rows.select(*COLS).toPandas().to_numpy(float)[:9]
    for own, got in zip(x, contributions(x, few.arrays())[0]):
        np.testing.assert_allclose(got, all_subsets(few, own)[0], atol=1e-9)


def test_mean(fitted, rows):
    explained = tree_shap(fitted["boosted"], rows)
    got = {r.feature: r.mean_abs_shap for r in mean_shap(explained, COLS).collect()}
    assert set(sorted(got, key=got.get)[2:]) == {"pm25", "hour"}
    assert got["wind"] == pytest.approx(explained.toPandas()["shap_wind"].abs().mean())


class Curved:
    """A model that is no line."""

    def transform(self, df):
        return df.withColumn("prediction", F.col("pm25") * F.col("pm25") / 10 + F.when(F.col("hour") > 11, 30.0).otherwise(0.0) - F.col("humidity"))


def test_lime_equals_plain_ridge(rows):
    cols, few = ["pm25", "hour", "humidity"], rows.where("timestamp < 6")
    got = lime(Curved(), few, rows, cols, samples=40).toPandas().set_index("timestamp")
    assert len(got) == 6
    near = Curved().transform(neighbourhood(few, rows, cols, samples=40)).toPandas()
    for key, own in near.groupby("timestamp"):
        z, y = own[[f"_z_{c}" for c in cols]].to_numpy(), own["prediction"].to_numpy()
        w = np.exp(-(z**2).sum(axis=1) / (2 * WIDTH**2 * 3))
        a = np.column_stack((z, np.ones(len(z))))
        want = np.linalg.solve((a * w[:, None]).T @ a + np.diag([1.0, 1, 1, 0]), (a * w[:, None]).T @ y)
        np.testing.assert_allclose(got.loc[key, ["lime_pm25", "lime_hour", "lime_humidity", "lime_intercept"]].astype(float), want, atol=1e-7)
        mean = (w * y).sum() / w.sum()
        assert got.loc[key, "lime_r2"] == pytest.approx(1 - (w * (y - a @ want) ** 2).sum() / (w * (y - mean) ** 2).sum())


def test_lime_moves(rows):
    """Normal numbers that depend on the key alone; sample 0 is the row."""
    cols = ["pm25", "hour", "humidity"]
    near = neighbourhood(rows, rows, cols, samples=60)
    assert sorted(map(str, near.collect())) == sorted(map(str, neighbourhood(rows.repartition(5), rows, cols, samples=60).collect()))
    pdf = near.toPandas()
    z = pdf.loc[pdf["_sample"] > 0, [f"_z_{c}" for c in cols]]
    assert np.abs(z.mean()).max() < 0.05 and np.abs(z.std() - 1).max() < 0.05 and np.abs(np.corrcoef(z.T) - np.eye(3)).max() < 0.05
    assert (pdf.loc[pdf["_sample"] == 0, "pm25"] == pdf.loc[pdf["_sample"] == 0, "_own_pm25"]).all() and len(pdf) == 200 * 60


def test_lime_odd_rows(rows, spark):
    cols = ["pm25", "hour", "humidity"]
    odd = rows.where("timestamp < 3").withColumn("pm25", F.when(F.col("timestamp") != 1, F.col("pm25")))
    got = {r.timestamp: r for r in lime(Curved(), odd, rows, cols, samples=20).collect()}
    assert set(got) == {0, 1, 2} and got[1].lime_pm25 is None and got[1].lime_r2 is None and got[0].lime_pm25 is not None

    class Some:
        def transform(self, df):
            return df.withColumn("prediction", F.when(F.col("_own_hour") >= 0, F.when(F.col("timestamp") > 0, F.lit(4.0))))

    got = {r.timestamp: r for r in lime(Some(), rows.where("timestamp < 2"), rows, cols, samples=20).collect()}
    assert got[0].lime_hour is None and got[1].lime_hour == pytest.approx(0) and got[1].lime_r2 == 1.0 and got[1].lime_intercept == pytest.approx(4)
    assert lime(Curved(), rows.limit(0), rows, cols, samples=20).count() == 0
    with pytest.raises(ValueError):
        lime(Curved(), rows, rows, cols, samples=4)
