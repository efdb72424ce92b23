import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hazeflow.operators.profile import (
    correlation_matrix, dataset_profile, iqr_bounds, iqr_outliers, null_counts, numeric_columns, quality_gate,
)
from hazeflow.operators.quantiles import approx_quantiles, exact_quantiles

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]


def frame(seed, n):
    rng = np.random.default_rng(seed)
    skewed = np.where(rng.random(n) < 0.4, 7.0, rng.normal(size=n).round(2))
    return pd.DataFrame({
        "skewed": skewed,
        "gaps": np.where(rng.random(n) < 0.3, np.nan, rng.integers(0, 1000, n).astype(float)),
        "constant": 3.0,
        "wide": rng.normal(size=n) * 10.0 ** rng.integers(-5, 6, n),
        "whole": rng.integers(-3, 3, n),
    })


@pytest.mark.parametrize("seed,n", [(0, 1), (1, 2), (2, 101), (3, 5000)])
def test_quantiles_equal_pandas(spark, seed, n):
    pdf = frame(seed, n)
    got = exact_quantiles(spark.createDataFrame(pdf), list(pdf), PROBS).toPandas()
    for col in pdf:
        want = pdf[col].quantile(PROBS)
        mine = got[got.column == col].set_index("p")["value"]
        if pdf[col].notna().any():
            np.testing.assert_allclose(mine.loc[PROBS], want, rtol=1e-12, err_msg=col)
        else:
            assert mine.empty


@pytest.mark.parametrize("rounds", [None, 1, 3])
def test_infinities_and_few_values(spark, rounds):
    inf = float("inf")
    cols = {
        "low": [-inf] * 3 + [0.0, 1.0, 2.0, 3.0, 4.0], "high": [0.0, 1.0, 2.0, 3.0] + [inf] * 4, "both": [-inf] * 4 + [inf] * 4,
        "same": [7.0] * 8, "two": [1.0] * 5 + [2.0] * 3,
    }
    df = spark.createDataFrame(list(zip(*cols.values())), ", ".join(f"{c} double" for c in cols))
    got = {(r.column, r.p): r.value for r in exact_quantiles(df, list(cols), [0.0, 0.25, 0.75, 1.0], 1, rounds).collect()}
    for c, values in cols.items():
        for p in (0.0, 0.25, 0.75, 1.0):
            at = p * 7
            a, b = values[int(at)], values[min(7, int(at) + (at % 1 > 0))]
            want = a if a == b else a + (b - a) * (at % 1)
            assert got[c, p] == want or (np.isnan(want) and np.isnan(got[c, p]))


@pytest.mark.parametrize("levels,rounds", [(1, 1), (1, 3), (2, 2)])
def test_cuts_and_rounds_do_not_change_the_result(spark, levels, rounds):
    pdf = frame(4, 500)
    found = exact_quantiles(spark.createDataFrame(pdf), list(pdf), [0.25, 0.75], levels, rounds)
    got = found.toPandas().set_index(["column", "p"])["value"]
    for col in pdf:
        for p in (0.25, 0.75):
            assert got[(col, p)] == pytest.approx(pdf[col].quantile(p), rel=1e-12)


def test_outliers_equal_definition(spark):
    pdf = frame(5, 2000)
    pdf["empty"] = np.nan
    df = spark.createDataFrame(pdf)
    got = {r.column: (r.outlier_count, r.percentage) for r in iqr_outliers(df).collect()}
    for col in pdf:
        q1, q3 = pdf[col].quantile(0.25), pdf[col].quantile(0.75)
        n = int(((pdf[col] < q1 - 1.5 * (q3 - q1)) | (pdf[col] > q3 + 1.5 * (q3 - q1))).sum())
        assert got[col] == (n, pytest.approx(round(100 * n / len(pdf), 2), abs=0.0051))
    bounds = {r.column: r for r in iqr_bounds(df).collect()}
    assert bounds["empty"].q1 is None and bounds["constant"].lower_bound == 3.0


def test_outliers_of_an_empty_frame(spark):
    df = spark.createDataFrame([], "x double, timestamp bigint")
    assert [tuple(r) for r in iqr_outliers(df).collect()] == [("x", 0, None)]


def test_approx_quantiles(spark):
    pdf = pd.DataFrame({"x": np.arange(1001.0)})
    got = {r.p: r.value for r in approx_quantiles(spark.createDataFrame(pdf), ["x"], [0.25, 0.5]).collect()}
    assert abs(got[0.25] - 250) <= 1 and abs(got[0.5] - 500) <= 1


def test_null_counts_and_shape(spark):
    df = spark.createDataFrame([("a", 1.0, 1), (None, float("nan"), None), ("b", None, 2)], "s string, x double, n int")
    assert {r.column: r.null_count for r in null_counts(df).collect()} == {"s": 1, "x": 2, "n": 1}
    assert tuple(dataset_profile(df).first()) == (3, 3)


def test_numeric_columns(spark):
    df = spark.createDataFrame([], "city string, timestamp bigint, x double, hour bigint, t timestamp, n int")
    assert numeric_columns(df) == ["x", "hour", "n"]


def test_correlation_equals_pandas(spark):
    pdf = frame(6, 800)
    got = correlation_matrix(spark.createDataFrame(pdf)).toPandas()
    assert len(got) == 20
    want = pdf.drop(columns="constant").corr()
    for r in got.itertuples():
        if "constant" in (r.column_a, r.column_b):
            assert pd.isna(r.corr)
        else:
            assert r.corr == pytest.approx(want.loc[r.column_a, r.column_b], abs=1e-9)


def test_quality_gate(spark):
    good = spark.createDataFrame([(1.0,), (2.0,)], "target_aqi double")
    assert tuple(quality_gate(good).first()) == (True, 2, True)
    assert quality_gate(good.union(good.select(F.lit(None).cast("double")))).first().all_present is False
    assert quality_gate(spark.createDataFrame([("x",)], "target_aqi string")).first().is_numeric is False
