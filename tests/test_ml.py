import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hazeflow.ml.explain import linear_shap, permutation_importance, scaled_coefficients, tree_importance
from hazeflow.ml.gram import ridge_from_gram
from hazeflow.ml.metrics import champion_select, regression_metrics
from hazeflow.ml import neural
from hazeflow.ml.models import fit, ridge, score, train_and_evaluate
from hazeflow.ml.neural import NeuralUnit, fit_neural, gradient, forward, initial_parameters, layer_shapes
from hazeflow.ml.registry import load_champion, read_registry, register_model
from hazeflow.ml.scaling import count_incomplete, design_columns, design_matrix, fit_scaler, model_columns, scaler_stats, standard_scale
from hazeflow.ml.split import hash_bucket, split, split_by_time, with_fold
from hazeflow.ml.tuning import BOOSTED_GRID, FOREST_GRID, grid_search
from hazeflow.plans.inference import forecast, hazard_alerts, score_with, unscored
from hazeflow.schema import FEATURE_SCHEMA, MODEL_COLS

N = 800


@pytest.fixture(scope="module")
def planted(spark):
    """A label that is linear in pm25 and humidity, plus a little noise."""
    rng = np.random.default_rng(0)
    hour = 3_600_000
    pdf = pd.DataFrame({
        "city": np.where(np.arange(N) % 2 == 0, "a", "b"),
        "timestamp": 1704067200000 + np.arange(N) * hour,
        "pm25": rng.uniform(0, 100, N), "pm10": rng.uniform(0, 200, N), "temperature": rng.normal(25, 5, N),
        "humidity": rng.uniform(20, 90, N), "humidex": rng.normal(30, 5, N), "aqi_change_rate": rng.normal(0, 1, N),
        "hour": np.arange(N) % 24, "day": 1 + np.arange(N) // 24 % 28, "month": 1, "day_of_week": np.arange(N) // 24 % 7,
    })
    pdf["target_aqi"] = 20 + 1.5 * pdf["pm25"] - 0.5 * pdf["humidity"] + rng.normal(0, 0.5, N)
    df = spark.createDataFrame(pdf[FEATURE_SCHEMA.names], FEATURE_SCHEMA).repartition(4, "timestamp").persist()
    yield df
    df.unpersist()


@pytest.fixture(scope="module")
def parts(planted):
    return split(planted)


def test_split_does_not_depend_on_layout(planted, parts):
    train, test = parts
    assert train.count() + test.count() == N and 0.14 < test.count() / N < 0.26
    again = split(planted.repartition(7).orderBy("pm25"))[1]
    assert again.select("city", "timestamp").exceptAll(test.select("city", "timestamp")).isEmpty()
    early, late = split_by_time(planted, 1704067200000 + 600 * 3_600_000)
    assert (early.count(), late.count()) == (600, 200)


def test_folds_cover_and_balance(parts):
    sizes = [r["count"] for r in with_fold(parts[0]).groupBy("fold").count().collect()]
    assert len(sizes) == 3 and sum(sizes) == parts[0].count() and min(sizes) > 0.25 * sum(sizes)


def test_scaler_uses_population_std(parts):
    train, test = parts
    pdf = train.toPandas()
    for r in scaler_stats(train, MODEL_COLS).collect():
        assert r["mean"] == pytest.approx(pdf[r["column"]].mean())
        assert r["std"] == pytest.approx(pdf[r["column"]].std(ddof=0), abs=1e-12)
    scaled = standard_scale(test, train, MODEL_COLS)
    assert "CartesianProduct" not in scaled._jdf.queryExecution().executedPlan().toString()
    got = scaled.orderBy("timestamp").toPandas()
    raw = test.orderBy("timestamp").toPandas()
    np.testing.assert_allclose(got["pm25"], (raw["pm25"] - pdf["pm25"].mean()) / pdf["pm25"].std(ddof=0))
    assert (got["month"] == 0).all()


def test_design_matrix_keeps_and_counts_incomplete_rows(spark, planted):
    broken = planted.withColumn("pm25", F.when(F.col("hour") > 0, F.col("pm25")))
    missing = planted.where("hour = 0").count()
    laid_out = design_columns(design_matrix(broken))
    assert laid_out.count() == N and laid_out.where("pm25 IS NULL").count() == missing
    assert count_incomplete(broken, MODEL_COLS).first()[0] == missing
    assert model_columns() == MODEL_COLS and "aqi_change_rate" not in model_columns(exclude_leaky=True)


def test_ridge_equals_closed_form(parts):
    train, test = parts
    alpha = 25.0
    model = fit(train, ridge(train, alpha), True)
    pdf = train.toPandas()
    x = pdf[MODEL_COLS].to_numpy(float)
    std = x.std(axis=0)
    z = (x - x.mean(axis=0)) / np.where(std == 0, 1, std)
    y = pdf["target_aqi"].to_numpy()
    want = np.linalg.solve(z.T @ z + alpha * np.eye(z.shape[1]), z.T @ (y - y.mean()))
    np.testing.assert_allclose(list(scaled_coefficients(model, MODEL_COLS).values()), want, atol=1e-8)
    assert model.stages[-1].intercept == pytest.approx(y.mean(), abs=1e-8)
    coefficients, intercept = ridge_from_gram(standard_scale(train, train, MODEL_COLS), MODEL_COLS, "target_aqi", alpha)
    np.testing.assert_allclose(list(coefficients.values()), want, atol=1e-8)
    assert intercept == pytest.approx(y.mean())


@pytest.mark.parametrize(
    "kind,overrides,floor",
    [("ridge", {}, 0.99), ("forest", {"numTrees": 10, "maxDepth": 8}, 0.85), ("boosted", {"maxIter": 15}, 0.85)],
)
def test_models_find_the_signal(parts, kind, overrides, floor):
    model, metrics = train_and_evaluate(*parts, kind, **overrides)
    assert metrics["r2"] > floor and metrics["mae"] <= metrics["rmse"]
    again = train_and_evaluate(*parts, kind, **overrides)[1]
    assert again == pytest.approx(metrics)
    if kind == "forest":
        importance = tree_importance(model, MODEL_COLS)
        assert max(importance, key=importance.get) == "pm25"


def test_leaky_input_can_be_left_out(parts):
    model, _ = train_and_evaluate(*parts, "ridge", exclude_leaky=True)
    used = model.stages[-2].getInputCols()
    # The month does not vary here, so it is left out as well.
    assert used == [f"z_{c}" for c in MODEL_COLS if c not in ("aqi_change_rate", "month")]


def test_permutation_importance(parts):
    model, _ = train_and_evaluate(*parts, "ridge")
    drop = {r.feature: r.r2_drop for r in permutation_importance(model, parts[1], MODEL_COLS).collect()}
    # The permutation is that of the rows, whatever the buckets and partitions.
    again = permutation_importance(model, parts[1].repartition(7), MODEL_COLS, buckets=1).collect()
    assert {r.feature: pytest.approx(r.r2_drop, abs=1e-9) for r in again} == drop
    assert set(drop) == set(MODEL_COLS)
    assert drop["pm25"] > 1.0 > drop["humidity"] > 0.05 > abs(drop["pm10"])


def test_linear_shap_adds_up(parts):
    train, test = parts
    weights = {"pm25": 1.5, "humidity": -0.5}
    pdf = linear_shap(test, train, weights).toPandas()
    means = train.agg(F.avg("pm25"), F.avg("humidity")).first()
    linear = lambda a, b: 1.5 * a - 0.5 * b
    np.testing.assert_allclose(
        pdf["shap_pm25"] + pdf["shap_humidity"], linear(pdf["pm25"], pdf["humidity"]) - linear(*means), atol=1e-9
    )


def test_metrics_edge_cases(spark):
    def metrics(rows):
        return regression_metrics(spark.createDataFrame(rows, "label double, prediction double")).first()

    m = metrics([(1.0, 2.0), (3.0, 3.0), (5.0, 3.0)])
    assert (m.n, m.mae, m.rmse) == (3, 1.0, pytest.approx((5 / 3) ** 0.5)) and m.r2 == pytest.approx(1 - 5 / 8)
    assert metrics([(2.0, 2.0), (2.0, 2.0)]).r2 == 1.0
    assert metrics([(2.0, 2.0), (2.0, 3.0)]).r2 == 0.0
    assert metrics([(None, 2.0), (2.0, None)]).n == 0


def test_champion(spark):
    rows = [("m", 1, {"r2": 0.5}), ("m", 2, {"r2": 0.7}), ("m", 3, {"r2": 0.7}), ("m", 4, {"mae": 0.1}), ("k", 1, {})]
    df = spark.createDataFrame(rows, "name string, version bigint, metrics map<string,double>")
    assert {r.name: r.version for r in [champion_select(df.where("name = 'm'")).first()]} == {"m": 2}
    assert champion_select(df.where("name = 'm'"), "mae", higher_is_better=False).first().version == 4


def test_registry_round_trip(spark, parts, tmp_path):
    root = str(tmp_path)
    train, test = parts
    with pytest.raises(LookupError):
        load_champion(spark, root, "aqi")
    for alpha in (1e6, 1.0):
        model, metrics = train_and_evaluate(train, test, "ridge", alpha=alpha)
        version = register_model(spark, root, "aqi", "ridge", model, metrics, "test")
    assert version == 2 and read_registry(spark, root).count() == 2
    champion = load_champion(spark, root, "aqi")
    # The saved unit scores raw rows: the scaler is part of it.
    a, b = score_with(champion, test).toPandas(), score(model, test).toPandas()
    np.testing.assert_allclose(a.sort_values("timestamp")["prediction"], b.sort_values("timestamp")["prediction"])
    ahead = forecast(test, {24: champion, 48: champion})
    assert ahead.count() == 2 * test.count()
    # Rows with a missing input keep their place, without a prediction, and are named with the reason.
    holes = test.withColumn("pm25", F.when(F.col("timestamp") % 2 == 0, F.col("pm25")))
    scored = score_with(champion, holes)
    n_missing = holes.where("pm25 IS NULL").count()
    assert scored.count() == test.count() and scored.where("prediction IS NULL").count() == n_missing
    assert {r.reject_reason for r in unscored(holes).collect()} <= {"missing: pm25"} and unscored(holes).count() == n_missing
    alerts = hazard_alerts(score_with(champion, test), threshold=120.0).collect()
    assert alerts and all(r.prediction >= 120 and r.category for r in alerts)


def test_full_grids_and_a_small_search(parts):
    sizes = [np.prod([len(v) for v in g.values()]) for g in (FOREST_GRID, BOOSTED_GRID)]
    assert sizes == [12, 36]
    grid = {"maxIter": [1, 10], "maxDepth": [3]}
    model, metrics, results = grid_search(*parts, "boosted", grid)
    assert len(results) == 2 and max(results, key=lambda r: r[1])[0]["maxIter"] == 10
    assert metrics["r2"] > 0.5 and score_with(model, parts[1]).count() == parts[1].count()
    _, metrics, _ = grid_search(*parts, "forest", {"numTrees": [3], "maxDepth": [2, 6], "minInstancesPerNode": [1]})
    assert metrics["r2"] > 0.5


def test_registered_searches_run_the_full_grids(spark, parts, monkeypatch):
    from hazeflow.catalog import models

    ran = []
    monkeypatch.setattr(models, "_stored", lambda *_: parts[0].unionByName(parts[1]))
    monkeypatch.setattr(models, "grid_search", lambda train, test, kind, grid: ran.append((kind, grid)) or (None, {"r2": 0.0}, [({"a": 1}, 0.0)]))
    for run in (models.q_tune_forest, models.q_tune_boosted):
        assert run(spark, "").count() == 1
    assert ran == [("forest", FOREST_GRID), ("boosted", BOOSTED_GRID)]


def test_shared_fits_score_as_fits_of_their_own(parts, monkeypatch):
    from hazeflow.ml import tuning

    fits, own = [], tuning._fit
    monkeypatch.setattr(tuning, "_fit", lambda *a, **k: fits.append(k) or own(*a, **k))
    few, many = {"maxDepth": [3], "subsamplingRate": [0.8], "maxIter": [2]}, {"maxDepth": [3], "subsamplingRate": [0.8], "maxIter": [2, 5]}
    together = grid_search(*parts, "boosted", many)[2]
    assert len(fits) == 4 and [s["maxIter"] for s, _ in together] == [2, 5]
    alone = grid_search(*parts, "boosted", few)[2] + grid_search(*parts, "boosted", {**few, "maxIter": [5]})[2]
    assert [s for s, _ in together] == [s for s, _ in alone]
    assert [r for _, r in together] == pytest.approx([r for _, r in alone], abs=1e-9)
    small, large = grid_search(*parts, "forest", {"numTrees": [2, 8], "maxDepth": [6]})[2]
    assert [small[1]] == pytest.approx([r for _, r in grid_search(*parts, "forest", {"numTrees": [2], "maxDepth": [6]})[2]], abs=1e-9)
    assert large[0]["numTrees"] == 8 and large[1] > small[1]


def test_neural_gradient_matches_differences():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(7, 10)), rng.normal(size=7)
    flat = initial_parameters(10, 3)
    assert len(flat) == sum(a * b + b for a, b in layer_shapes(10)) == 2817

    class NoDropout:
        def random(self, shape):
            return np.ones(shape)

    from hazeflow.ml import neural

    keep, neural.DROPOUT = neural.DROPOUT, 0.0
    try:
        g = gradient(flat, x, y, NoDropout())
        for i in rng.integers(0, len(flat), 25):
            step = np.zeros_like(flat)
            step[i] = 1e-6
            slope = (((forward(flat + step, x) - y) ** 2).mean() - ((forward(flat - step, x) - y) ** 2).mean()) / 2e-6
            assert g[i] == pytest.approx(slope, abs=1e-4)
    finally:
        neural.DROPOUT = keep


@pytest.mark.parametrize("replicas", [1, 2])
def test_neural_finds_the_signal(spark, parts, replicas, tmp_path):
    """One replica, and several whose parameters are averaged."""
    train, test = parts
    model = fit_neural(standard_scale(train, train, MODEL_COLS), MODEL_COLS, replicas, max_epochs=40)
    scored = standard_scale(test, train, MODEL_COLS).withColumn("prediction", model.predict(F.array(*MODEL_COLS)))
    assert regression_metrics(scored, "target_aqi").first().r2 > 0.5
    assert min(model.history) < model.history[0] / 2
    # Saved and registered with its scaler, it gives the same predictions on raw rows, and NULL where an input is missing.
    unit, root = NeuralUnit(fit_scaler(train, MODEL_COLS)[0], model, MODEL_COLS), str(tmp_path)
    register_model(spark, root, "aqi", "neural", unit, {"r2": 0.9}, "test")
    again = score_with(load_champion(spark, root, "aqi"), test.withColumn("pm10", F.when(F.col("timestamp") % 7200000 == 0, F.col("pm10"))))
    a = {(r.city, r.timestamp): r.prediction for r in scored.collect()}
    b = {(r.city, r.timestamp): r.prediction for r in again.collect()}
    assert a.keys() == b.keys() and {k for k, p in b.items() if p is None} == {k for k in a if k[1] % 7200000}
    assert all(p is None or p == pytest.approx(a[k]) for k, p in b.items())


def test_bucket_is_the_documented_hash(spark):
    df = spark.createDataFrame([("a", 1)], "city string, timestamp bigint")
    got = df.select(hash_bucket(["city", "timestamp"], 42, 100).alias("b"), F.expr("pmod(xxhash64(city, timestamp, 42), 100)").alias("w")).first()
    assert got.b == got.w
    assert fit_scaler(df.withColumn("x", F.lit(2.0)), ["x"])[0].getStatement().endswith("FROM __THIS__")


def test_steps_in_place_equal_plain_steps():
    """Minibatches in place are Adam on ``gradient``, bit by bit."""
    rng = np.random.default_rng(3)
    x, y, flat = rng.normal(size=(70, 5)), rng.normal(size=70), initial_parameters(5, 1)
    steps, draws = neural._Steps(np.concatenate([flat, np.zeros(2 * len(flat))]), 5, 2, np.random.default_rng(9)), np.random.default_rng(9)
    m, v, adam = np.zeros_like(flat), np.zeros_like(flat), neural.ADAM
    for t, lo in enumerate(range(0, 70, neural.BATCH), 3):
        g = gradient(flat, x[lo : lo + neural.BATCH], y[lo : lo + neural.BATCH], draws)
        m, v = adam["beta1"] * m + (1 - adam["beta1"]) * g, adam["beta2"] * v + (1 - adam["beta2"]) * g * g
        flat = flat - adam["lr"] * (m / (1 - adam["beta1"] ** t)) / (np.sqrt(v / (1 - adam["beta2"] ** t)) + adam["eps"])
        steps.take(x[lo : lo + neural.BATCH], y[lo : lo + neural.BATCH])
    assert steps.t == 5 and np.array_equal(steps.flat, flat) and np.array_equal(steps.m, m) and np.array_equal(steps.v, v)
