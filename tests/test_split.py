"""Splits and folds of exact size, against numbering all rows in one list."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazeflow.ml import split as S
from hazeflow.ml.split import exact_split, in_parts, with_exact_fold, with_exact_split


def table(spark, n, seed=0, equal=0):
    """Rows with an order in which many are tied, the last ``equal`` of them equal throughout; one null."""
    rng = np.random.default_rng(seed)
    rows = [("c", i, int(rng.integers(-5, 5)) * 2**40, int(rng.integers(-(2**62), 2**62))) for i in range(n - equal)]
    rows += [("same", 7, 2**41, 5)] * equal
    if rows:
        rows[0] = ("c", 0, None, 1)
    return spark.createDataFrame(rows, "city string, timestamp long, a long, b long").repartition(3)


def ranked(df):
    """The rows in order, as one list."""
    rows = df.withColumn("h", F.xxhash64(*df.columns)).collect()
    return [tuple(r)[:4] for r in sorted(rows, key=lambda r: (-(2**63) if r.a is None else r.a, r.b, r.h))]


def order():
    return [F.col("a"), F.col("b")]


@pytest.mark.parametrize("n,equal", [(1, 0), (2, 0), (5, 0), (233, 0), (300, 100), (300, 299)])
def test_parts_equal_numbering(spark, n, equal):
    df = table(spark, n, equal=equal)
    want, ks = ranked(df), [0, n // 7, n // 2, n // 2, (9 * n) // 10, n]
    got = in_parts(df, lambda m: [k for k in ks if m == n], order(), "part").collect()
    parts = sorted((sum(i >= k for k in ks), str(r)) for i, r in enumerate(want))
    assert sorted((r.part, str(tuple(r)[:4])) for r in got) == parts


def test_order_with_one_value_only(spark):
    """All rows tied: the hash of their columns orders them."""
    df = table(spark, 90, equal=30)
    got = with_exact_split(df, order=[F.lit(1)])
    assert got.where("split = 'test'").count() == 18 and got.count() == 90
    again = with_exact_split(df.repartition(7), order=[F.lit(1)])
    assert sorted(map(str, got.collect())) == sorted(map(str, again.collect()))


@pytest.mark.parametrize("n", [0, 1, 2, 3, 15, 101])
def test_sizes(spark, n):
    df = table(spark, n)
    train, test = exact_split(df)
    assert test.count() == min(math.ceil(n / 5), max(n - 1, 0)) and train.count() + test.count() == n
    folds = {r.fold: r["count"] for r in with_exact_fold(df, 4).groupBy("fold").count().collect()}
    assert [folds.get(i, 0) for i in range(4)] == [n // 4 + (i < n % 4) for i in range(4)]


def test_equal_rows_are_written_in_runs(spark, monkeypatch):
    monkeypatch.setattr(S, "RUN", 7)
    df = table(spark, 120, equal=100).withColumn("fold", F.lit(9))
    got = {r.fold: r["count"] for r in with_exact_fold(df).groupBy("fold").count().collect()}
    assert got == {0: 40, 1: 40, 2: 40}


def test_no_row_is_shuffled(spark):
    """Rows without ties are only marked."""
    plan = with_exact_fold(spark.range(1000).select(F.lit("c").alias("city"), F.col("id").alias("timestamp")))
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        with_exact_fold(plan, 1)
