"""Histogram trees against plain trees, and searches against single fits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazeflow.ml import trees as T
from hazeflow.ml.metrics import regression_metrics
from hazeflow.ml.scaling import model_columns
from hazeflow.ml.search import grid_search, r2_of
from hazeflow.ml.split import with_fold
from hazeflow.ml.trees import Growth, Spec, TreeModel, bin_edges, blocks, fit_trees

COLS = ["pm25", "hour", "humidity"]
N = 240


@pytest.fixture(scope="module")
def rows(spark):
    """Few distinct values, so that every value is a bin; equal inputs with different labels, and repeated rows."""
    rng = np.random.default_rng(3)
    data = []
    for i in range(N):
        pm, hour, hum = float(rng.integers(0, 40)), int(rng.integers(0, 24)), float(rng.integers(0, 9))
        data.append((f"c{i % 3}", i, pm, hour, hum, float(round(2 * pm + (hour > 11) * 30 - hum * pm / 10 + rng.normal(0, 4), 3))))
    data += data[:5]
    return spark.createDataFrame(data, "city string, timestamp long, pm25 double, hour long, humidity double, target_aqi double").repartition(3).cache()


def plain_tree(x, g, depth, penalty, least_gain, least_rows=2, weight=None):
    """{path: (feature, threshold, G, H)} and leaf values, node by node."""
    weight = np.ones(len(g)) if weight is None else weight
    out = {}

    def grow(own, path):
        w, gs = weight[own], (g * weight)[own]
        total_g, total_h = gs.sum(), w.sum()
        best = None
        if len(path) < depth and len(own) >= least_rows:
            for f in range(x.shape[1]):
                for v in np.unique(x[own, f])[:-1]:
                    left = x[own, f] <= v
                    gl, hl = gs[left].sum(), w[left].sum()
                    gain = gl**2 / (hl + penalty) + (total_g - gl) ** 2 / (total_h - hl + penalty) - total_g**2 / (total_h + penalty)
                    if gain > max(least_gain, 1e-7) and (best is None or gain > best[0] + 1e-7):
                        best = (gain, f, v)
        out[path] = (best and best[1:], total_g, total_h, len(own))
        if best:
            left = x[own, best[1]] <= best[2]
            grow(own[left], path + "l")
            grow(own[~left], path + "r")

    grow(np.flatnonzero(weight), "")
    return out


def as_paths(model: TreeModel, tree: int):
    table = model.nodes[model.nodes["tree"] == tree].set_index("node")
    out = {}

    def visit(node, path):
        r = table.loc[node]
        out[path] = ((int(r.feature), float(r.threshold)) if r.feature >= 0 else None, float(r.value), int(r.weight), int(r.rows))
        if r.feature >= 0:
            visit(int(r.left), path + "l")
            visit(int(r.left) + 1, path + "r")

    visit(0, "")
    return out


def arrays(df):
    pdf = df.toPandas().sort_values(["city", "timestamp"], kind="stable")
    return pdf[COLS].to_numpy(float), pdf["target_aqi"].to_numpy(), pdf


def test_boosting_equals_plain_boosting(rows):
    spec = Spec(4, 3, 0.3)
    model = fit_trees(rows, COLS, spec)
    x, y, _ = arrays(rows)
    base = y.mean()
    assert model.base == pytest.approx(base, abs=1e-6)
    margin = np.full(len(y), base)
    for t in range(4):
        want, got = plain_tree(x, margin - y, 3, T.PENALTY, T.LEAST_GAIN), as_paths(model, t)
        assert {p: w[0] for p, w in want.items()} == {p: g[0] for p, g in got.items()}
        for p, (_, g, h, n) in want.items():
            assert got[p][1:] == (pytest.approx(-g / (h + T.PENALTY) * 0.3, abs=1e-6), h, n)
        root, feature, threshold, left, value, _ = model.arrays()
        margin = margin + value[T.descend(x, root[t], feature, threshold, left)]
    predicted = model.transform(rows).toPandas().sort_values(["city", "timestamp"], kind="stable")["prediction"]
    np.testing.assert_allclose(predicted, margin, atol=1e-6)


@pytest.mark.parametrize("least", [2, 5])
def test_tree_without_bagging_equals_a_plain_tree(rows, least, monkeypatch):
    """Unlimited depth, smallest splits of 2 and of 5 rows. A round of boosting without penalty and rate is a tree without bagging."""
    x, y, _ = arrays(rows)
    monkeypatch.setattr(Spec, "penalty", property(lambda self: 0.0))
    edges = bin_edges(rows, COLS)
    grown = Growth(blocks(rows, COLS, edges), [Spec(1, None, 1.0, least_rows=least)], 3).grow()
    got, want = as_paths(grown.model(0, COLS, edges, least_rows=least), 0), plain_tree(x, grown.base[0] - y, 99, 0.0, T.LEAST_GAIN, least)
    assert {p: w[0] for p, w in want.items()} == {p: g[0] for p, g in got.items()} and max(map(len, want)) > 6
    assert all(got[p][1] == pytest.approx(-g / h, abs=1e-6) and got[p][3] == n for p, (_, g, h, n) in want.items())


def test_forest_uses_the_documented_weights(rows):
    """Each tree of a forest is the plain tree of its Poisson weights."""
    model = fit_trees(rows, COLS, Spec(3, forest=True))
    x, y, pdf = arrays(rows)
    keyed = rows.select("city", "timestamp", F.xxhash64("city", "timestamp").alias("k")).toPandas().sort_values(["city", "timestamp"], kind="stable")
    for t in range(3):
        w = T.row_weights(keyed["k"].to_numpy().astype(np.int64).view(np.uint64), Spec(3, forest=True), t)
        assert 0.8 < w.mean() < 1.25 and w.max() >= 3
        want, got = plain_tree(x, model.base - y, 99, 0.0, 0.0, 2, w.astype(float)), as_paths(model, t)
        assert {p: v[0] for p, v in want.items()} == {p: g[0] for p, g in got.items()}
        assert all(got[p][1] * 3 == pytest.approx(-g / h, abs=1e-6) and got[p][2] == h for p, (_, g, h, _n) in want.items())


def test_same_trees_for_any_partitioning(rows, monkeypatch):
    specs = [Spec(3, forest=True), Spec(3, 3, 0.1, 0.7)]
    edges = bin_edges(rows, COLS)
    monkeypatch.setattr(T, "BLOCK_ROWS", 64)
    small = blocks(rows.repartition(7), COLS, edges)
    monkeypatch.undo()
    large = blocks(rows.coalesce(1), COLS, edges)
    assert small.count() > 3 * large.count()
    a, b = (Growth(s, specs, 3).grow() for s in (small, large))
    for i in range(2):
        assert a.model(i, COLS, edges).nodes.equals(b.model(i, COLS, edges).nodes)
    assert a.levels == b.levels


def test_small_nodes_end_in_one_job(rows, monkeypatch):
    """Trees that tasks grow to their end, from the root or from some levels below, are those grown level by level; a level's job is saved for each."""
    edges = bin_edges(rows, COLS)
    monkeypatch.setattr(T, "BLOCK_ROWS", 64)
    stored = blocks(with_fold(rows, 3), COLS, edges, "fold")
    specs = [Spec(3, forest=True, fold=1), Spec(2, 4, forest=True, least_rows=5), Spec(3, 4, 0.3, 0.7), Spec(2, 2, 0.5, fold=0)]
    near, chunk = T.NEAR_ROWS, T.NEAR_CHUNK
    grown = {}
    for most, together in ((0, chunk), (40, 30), (near, 300)):
        monkeypatch.setattr(T, "NEAR_ROWS", most)
        monkeypatch.setattr(T, "NEAR_CHUNK", together)
        grown[most] = Growth(stored, specs, 3).grow()
    for i, s in enumerate(specs):
        tables = [g.model(i, COLS, edges, least_rows=s.least_rows).nodes for g in grown.values()]
        assert len(tables[0]) > 9 and tables[0].equals(tables[1]) and tables[0].equals(tables[2])
    assert grown[near].levels == 3 < grown[0].levels
    monkeypatch.setattr(T, "NEAR_MODEL", 10)
    assert Growth(stored, specs[2:3], 3).grow().levels > 3


def test_boosters_of_a_search_end_in_one_job(rows, parts, monkeypatch):
    """A task per booster grows the trees that are grown level by level, samples without rows included; a search of few rows takes one job, one of many rows a job per level."""
    edges = bin_edges(rows, COLS)
    monkeypatch.setattr(T, "BLOCK_ROWS", 64)
    stored = blocks(with_fold(rows, 3), COLS, edges, "fold")
    specs = [Spec(3, 4, 0.3, 0.7), Spec(2, 2, 0.5, fold=0), Spec(4, 7, 0.1, 0.8, fold=2), Spec(2, 3, 0.1, 0.001, fold=1)]
    monkeypatch.setattr(T, "NEAR_ROWS", 0)
    apart, level = Growth(stored, specs, 3).grow_apart(), Growth(stored, specs, 3).grow()
    assert apart.levels == 1 < level.levels
    for i, s in enumerate(specs):
        table = apart.model(i, COLS, edges).nodes
        assert table["tree"].nunique() == s.trees and table.equals(level.model(i, COLS, edges).nodes)
    variants = [(1, 2, None, 2), (1, 1, 1, 2), (2, 4, None, 2)]
    np.testing.assert_allclose(apart.squared_errors(stored, variants), level.squared_errors(stored, variants))
    monkeypatch.undo()
    jobs, own = [], Growth._level
    monkeypatch.setattr(Growth, "_level", lambda self, *a: jobs.append(1) or own(self, *a))
    grid = {"maxIter": [2], "maxDepth": [2], "subsamplingRate": [0.8, 1.0]}
    few = grid_search(*parts, "boosted", grid)
    assert not jobs
    monkeypatch.setattr(T, "ALONE_ROWS", 200)
    many = grid_search(*parts, "boosted", grid)
    assert len(jobs) > 1 and [s for s, _ in many[2]] == [s for s, _ in few[2]] and many[0].nodes.equals(few[0].nodes)
    assert [r for _, r in many[2]] == pytest.approx([r for _, r in few[2]])


@pytest.mark.parametrize("n,most", [(900, 3), (900, 1), (5_000_000, 1)])
def test_counted_sums_are_exact(n, most):
    """Large nodes' sums are those of integers, for large gradients too; rows of a node beyond what one count holds are dealt."""
    rng = np.random.default_rng(5)
    slot, bins = rng.integers(0, 3, n) if n < 1000 else np.zeros(n, np.int64), rng.integers(0, 3, (n, 2)).astype(np.uint8)
    w, size = rng.integers(1, most + 1, n), 2 ** (60 - n.bit_length())
    g = rng.integers(-size, size, n) // most * w
    key, (sum_g, sum_h, rows) = T.histogram(slot, 1 + int(slot.max()), bins, g, w)
    stretch = (slot[:, None] * 2 + np.arange(2)) * T.BINS + bins
    for k, *found in zip(key, sum_g, sum_h, rows):
        own = (stretch == k).any(axis=1)
        assert found == [int(g[own].sum()), int(w[own].sum()), int(own.sum())]
    assert len(key) == len(np.unique(stretch))


def test_boosters_count_the_smaller_child(monkeypatch):
    """A table of any rows is that of integers, however they are counted; a tree reads at most half of its rows for a level below its root."""
    rng = np.random.default_rng(8)
    n, size = 900, (40, 256, 7, 24, 1)
    bins = np.stack([rng.integers(0, k, n) for k in size], axis=1).astype(np.uint8)
    for most in (2**35, 2**50):
        g = rng.integers(-most, most, n)
        for few, alone, joint in ((1 << 10, 0, 0), (0, 1 << 10, 0), (0, 0, 1000), (0, 0, 1 << 13)):
            for name, value in (("FEW_ROWS", few), ("JOINT_ROWS", alone), ("JOINT_BINS", joint), ("COUNT_ROWS", 256)):
                monkeypatch.setattr(T, name, value)
            counts = T.Counts(bins)
            counts.weigh(g)
            for rows in (None, np.flatnonzero(g > 0), np.zeros(0, np.int64)):
                want = np.zeros((2, len(size), T.BINS), np.int64)
                for f in range(len(size)):
                    np.add.at(want[0, f], bins[slice(None) if rows is None else rows, f], g if rows is None else g[rows])
                    np.add.at(want[1, f], bins[slice(None) if rows is None else rows, f], 1)
                assert (counts.of(rows) == want.reshape(2, -1)).all()
    monkeypatch.undo()
    read, of = [], T.Counts.of
    monkeypatch.setattr(T.Counts, "of", lambda self, rows: read.append(n if rows is None else len(rows)) or of(self, rows))
    trees = list(T.boosted(np.arange(n, dtype=np.uint64), bins, bins[:, 1] * 2.0 + bins[:, 3], Spec(2, 5, 0.3), 100.0, 2.0**30))
    assert len(trees) == 2 and trees[0].num_rows > 20 and sum(read) <= 2 * n * (1 + 4 / 2)


def test_forest_with_few_bins_and_limited_depth(rows):
    """The settings of MLlib's forest: fewer bins, a largest depth."""
    nodes = fit_trees(rows, COLS, Spec(3, 4, forest=True), bins=8).nodes
    inner = nodes[nodes["feature"] >= 0]
    assert inner.groupby("feature")["threshold"].nunique().max() <= 7 and len(nodes) <= 3 * 31 and nodes["rows"].iloc[0] > 100


def test_margins_written_on_the_way_change_nothing(rows, monkeypatch):
    few = fit_trees(rows, COLS, Spec(5, 2, 0.3, 0.8))
    monkeypatch.setattr(T, "MARGIN_TREES", 1)
    assert fit_trees(rows, COLS, Spec(5, 2, 0.3, 0.8)).nodes.equals(few.nodes)


def test_many_models_equal_single_ones(rows):
    """Settings and folds grown together are those grown alone."""
    edges = bin_edges(rows, COLS)
    stored = blocks(with_fold(rows, 3), COLS, edges, "fold")
    specs = [Spec(2, 2, 0.2, 0.6, fold=0), Spec(3, 3, 0.1, fold=T.NO_FOLD), Spec(2, 2, 0.2, fold=1)]
    together = Growth(stored, specs, 3).grow()
    for i, s in enumerate(specs):
        assert Growth(stored, [s], 3).grow().model(0, COLS, edges).nodes.equals(together.model(i, COLS, edges).nodes)


def test_pruned_forest_is_the_forest_with_these_limits(rows):
    edges = bin_edges(rows, COLS)
    stored = blocks(rows, COLS, edges)
    loose = Growth(stored, [Spec(4, forest=True)], 3).grow()
    for trees, depth, least in ((4, None, 5), (3, 4, 2)):
        tight = Growth(stored, [Spec(trees, depth, least_rows=least, forest=True)], 3).grow().model(0, COLS, edges, least_rows=least)
        assert tight.nodes.equals(loose.model(0, COLS, edges, trees, depth, least).nodes)


@pytest.fixture(scope="module")
def parts(spark):
    """A signal in all inputs of the feature table."""
    h = lambda k, m: F.pmod(F.xxhash64("timestamp", F.lit(k)), F.lit(m))
    df = spark.range(500).select(
        F.lit("a").alias("city"), F.col("id").alias("timestamp"), *[(h(c, 50) / 5.0).alias(c) for c in ("pm25", "pm10", "temperature", "humidity", "humidex", "aqi_change_rate")],
        *[h(c, m).alias(c) for c, m in (("hour", 24), ("day", 28), ("month", 3), ("day_of_week", 7))],
    )
    df = df.withColumn("target_aqi", F.col("pm25") * 10 + F.when(F.col("hour") > 12, F.col("humidity") * 4).otherwise(0.0) + h("noise", 7))
    return df.where("timestamp % 5 > 0").cache(), df.where("timestamp % 5 = 0").cache()


@pytest.mark.parametrize(
    "kind,grid",
    [("forest", {"numTrees": [2, 4], "maxDepth": [3, 6], "minSamplesSplit": [2, 5]}), ("boosted", {"maxIter": [2, 5], "stepSize": [0.1, 0.5], "maxDepth": [2, 3], "subsamplingRate": [0.7]})],
)
def test_search_equals_single_fits(parts, kind, grid):
    train, test = parts
    model, metrics, results = grid_search(train, test, kind, grid)
    assert len(results) == 8
    folded = with_fold(train, 3).cache()
    edges = bin_edges(train, model_columns())
    for s, mean in results[::5]:
        if kind == "forest":
            spec = Spec(s["numTrees"], s["maxDepth"], least_rows=s["minSamplesSplit"], forest=True)
        else:
            spec = Spec(s["maxIter"], s["maxDepth"], s["stepSize"], s["subsamplingRate"])
        scores = []
        for f in range(3):
            own, held = folded.where(F.col("fold") != f), folded.where(F.col("fold") == f)
            grown = Growth(blocks(own, model_columns(), edges), [spec], 10).grow()
            scores.append(regression_metrics(grown.model(0, model_columns(), edges, least_rows=spec.least_rows).transform(held), "target_aqi").first().r2)
        assert mean == pytest.approx(np.mean(scores), abs=1e-6)
    assert metrics["r2"] > 0.5
    assert regression_metrics(model.transform(test), "target_aqi").first().r2 == pytest.approx(metrics["r2"])
    with pytest.raises(ValueError):
        grid_search(train, test, kind, {"unknown": [1]})


def test_odd_rows(spark, rows, tmp_path):
    """Missing values, no rows, one row, a constant label; saved models and missing inputs when scoring."""
    broken = rows.withColumn("pm25", F.when(F.col("hour") > 3, F.col("pm25"))).withColumn("extra", F.lit(1)).withColumn("key", F.lit("clash"))
    model = fit_trees(broken, COLS, Spec(2, 2, 0.5))
    assert model.nodes.iloc[0]["rows"] == rows.where("hour > 3").count()
    scored = model.transform(broken)
    assert scored.where("(prediction IS NULL) <> (pm25 IS NULL)").count() == 0
    model.save(spark, f"{tmp_path}/m")
    again = TreeModel.load(spark, f"{tmp_path}/m")
    assert again.nodes.equals(model.nodes) and again.base == model.base
    assert sum(model.importance().values()) == pytest.approx(1.0)
    empty = fit_trees(rows.where("false"), COLS, Spec(2, 2))
    assert (empty.nodes["value"] == 0).all() and len(empty.nodes) == 2 and empty.transform(rows).where("prediction = 0").count() == rows.count()
    constant = fit_trees(rows.withColumn("target_aqi", F.lit(7.0)), COLS, Spec(3, forest=True))
    assert len(constant.nodes) == 3 and constant.transform(rows).where("abs(prediction - 7) < 1e-9").count() == rows.count()
    assert r2_of(0.0, 2.0, 2.0, 2) == 1.0 and r2_of(1.0, 2.0, 2.0, 2) == 0.0 and np.isnan(r2_of(0.0, 0.0, 0.0, 0))


def test_large_forests_are_written_not_held(spark, rows, tmp_path, monkeypatch):
    """A forest that tasks write is the one the driver would hold, in few and in many stretches and chunks, and so are its predictions; no level reaches the driver."""
    x, _, _ = arrays(rows)
    odd = rows.withColumn("pm25", F.when(F.col("hour") > 3, F.col("pm25"))).withColumn("_row", F.lit(1)).withColumn("prediction", F.lit(0.0)).withColumn("last", F.lit(1))
    held = []
    for spec in (Spec(5, forest=True), Spec(3, 4, forest=True, least_rows=5)):
        model = fit_trees(rows, COLS, spec)
        root, feature, threshold, left, value, _ = model.arrays()
        held.append((spec, model, model.base + sum(value[T.descend(x, r, feature, threshold, left)] for r in root)))
    monkeypatch.setattr(T, "HELD", 0)
    for gone, name in ((Growth, "_level"), (TreeModel, "arrays")):
        monkeypatch.setattr(gone, name, lambda *a: pytest.fail("nodes reach the driver"))
    for (spec, model, want), near, stretch, most in zip(held, (30, T.NEAR_ROWS), (7, T.STRETCH), (100, N)):
        monkeypatch.setattr(T, "NEAR_ROWS", near)
        monkeypatch.setattr(T, "STRETCH", stretch)
        with monkeypatch.context() as m:
            m.setattr(T, "BLOCK_ROWS", 64)
            written = fit_trees(rows, COLS, spec)
            m.setattr(T, "ALONE_ROWS", most)
            found = written.transform(odd).toPandas().sort_values(["city", "timestamp"], kind="stable")
        assert list(found) == odd.columns
        np.testing.assert_allclose(found["prediction"], np.where(x[:, 1] > 3, want, np.nan), rtol=1e-12)
        assert written.nodes.equals(model.nodes)
    assert written.importance() == pytest.approx(model.importance())
    written.save(spark, f"{tmp_path}/m")
    assert TreeModel.load(spark, f"{tmp_path}/m").nodes.equals(model.nodes)
    assert written.transform(rows.where("false")).count() == 0


def test_search_of_large_forests_holds_no_nodes(parts, monkeypatch):
    """Folds measured where their trees are grown, and the best model written, are those of nodes held by the driver."""
    grid = {"numTrees": [2, 3], "maxDepth": [4, None], "minSamplesSplit": [2, 5]}
    few = grid_search(*parts, "forest", grid)
    monkeypatch.setattr(T, "HELD", 0)
    monkeypatch.setattr(Growth, "_level", lambda *a: pytest.fail("nodes reach the driver"))
    monkeypatch.setattr(T, "BLOCK_ROWS", 64)
    many = grid_search(*parts, "forest", grid)
    assert [s for s, _ in many[2]] == [s for s, _ in few[2]] and [r for _, r in many[2]] == pytest.approx([r for _, r in few[2]], rel=1e-12)
    assert many[1] == pytest.approx(few[1], rel=1e-12) and many[0].nodes.equals(few[0].nodes)
