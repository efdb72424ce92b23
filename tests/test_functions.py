import math

import pytest
from pyspark.sql import functions as F

from hazeflow.functions import (
    aqi_category, aqi_overall, aqi_subindex, calendar_columns, dominant_pollutant, epoch_millis, humidex,
    humidex_rounded,
)
from hazeflow.functions.missing import normalize_missing
from hazeflow.functions.sql import register_sql_functions
from hazeflow.operators.enrich import cast_features, impute_pm10, impute_weather, with_live_humidex
from hazeflow.operators.joins import range_join_subindex

HUMIDEX = [
    (32.0, 75.0, 46.200835336663935),
    (25.0, 50.0, 28.22416352770595),
    (0.0, 0.0, -5.555555555555555),
    (-10.0, 80.0, -14.2835824522611),
    (None, 50.0, None),
    (20.0, None, None),
    (-237.7, 50.0, None),
]
SUBINDEX = [
    ("pm25", 9.0, 37.5), ("pm25", 12.0, 50.0), ("pm25", 12.1, 51.0), ("pm25", 35.4, 100.0), ("pm25", 500.4, 500.0),
    ("pm25", 12.05, None), ("pm25", 35.45, None), ("pm25", 500.5, None), ("pm25", -1.0, None),
    ("pm25", 100.0, 173.9768177028451), ("pm25", None, None), ("pm25", float("nan"), None), ("pm25", 0.0, 0.0),
    ("pm10", 100.0, 73.27272727272728), ("pm10", 54.5, None), ("pm10", 605.0, None), ("pm10", 604.0, 500.0),
]


def same(got, want, tol=1e-9):
    return got is None if want is None else got is not None and math.isclose(got, want, abs_tol=tol)


def test_humidex(spark):
    rows = [(i, *r[:2]) for i, r in enumerate(HUMIDEX)]
    df = spark.createDataFrame(rows, "i int, t double, h double")
    out = df.select("i", humidex(F.col("t"), F.col("h")).alias("a"), humidex_rounded(F.col("t"), F.col("h")).alias("b"))
    for r in out.collect():
        want = HUMIDEX[r.i][2]
        assert same(r.a, want)
        assert same(r.b, None if want is None else round(want, 2))


def test_live_humidex_overflow_and_default(spark):
    df = spark.createDataFrame([(-237.71, 50.0), (None, 50.0), (32.0, 75.0)], "temperature double, humidity double")
    assert [r.humidex for r in with_live_humidex(df).collect()] == [35.0, 35.0, 46.2]


def test_subindex_expression_and_range_join(spark):
    rows = [(i, p, v) for i, (p, v, _) in enumerate(SUBINDEX)]
    df = spark.createDataFrame(rows, "i int, p string, v double")
    chain = F.when(F.col("p") == "pm25", aqi_subindex(F.col("v"), "pm25")).otherwise(aqi_subindex(F.col("v"), "pm10"))
    for r in df.select("i", chain.alias("x")).collect():
        assert same(r.x, SUBINDEX[r.i][2]), SUBINDEX[r.i]
    clean = normalize_missing(df)
    for r in range_join_subindex(clean, F.col("p"), F.col("v")).collect():
        assert same(r.aqi_subindex, SUBINDEX[r.i][2]), SUBINDEX[r.i]


def test_truncating_gap_policy(spark):
    df = spark.createDataFrame([(12.05, 54.5), (35.45, 154.9), (-1.0, 604.9)], "a double, b double")
    got = df.select(aqi_subindex(F.col("a"), "pm25", "truncate"), aqi_subindex(F.col("b"), "pm10", "truncate")).collect()
    assert [tuple(r) for r in got] == [(50.0, 50.0), (100.0, 100.0), (None, 500.0)]
    with pytest.raises(ValueError):
        aqi_subindex(F.col("a"), "pm25", "other")


def test_overall(spark):
    df = spark.createDataFrame(
        [(9.0, 100.0), (9.0, None), (None, None), (float("nan"), 100.0), (12.05, 54.5)], "a double, b double"
    )
    a, b = F.col("a"), F.col("b")
    dom = dominant_pollutant(aqi_subindex(a, "pm25"), aqi_subindex(b, "pm10"))
    got = df.select(aqi_overall(a, b).alias("x"), dom.alias("d"), aqi_category(aqi_overall(a, b)).alias("c")).collect()
    assert [(r.x and round(r.x, 3), r.d, r.c) for r in got] == [
        (73.273, "pm10", "moderate"), (37.5, "pm25", "good"), (None, None, None), (73.273, "pm10", "moderate"),
        (None, None, None),
    ]
    assert df.select(aqi_overall().alias("x")).first().x is None
    assert df.select(aqi_overall(pm10=b).alias("x")).first().x == pytest.approx(73.27272727272728)


def test_calendar(spark):
    df = spark.sql("SELECT TIMESTAMP '2024-08-01 23:59:59.9999' AS t UNION ALL SELECT TIMESTAMP '1969-12-31 23:59:59.9999'")
    cols = {"ms": epoch_millis(F.col("t")), **calendar_columns(F.col("t"))}
    rows = {tuple(r) for r in df.select(*[c.alias(n) for n, c in cols.items()]).collect()}
    assert rows == {(1722556799999, 23, 1, 8, 3), (-1, 23, 31, 12, 2)}
    assert {t for n, t in df.select(*[c.alias(n) for n, c in cols.items()]).dtypes} == {"bigint"}


def test_imputation(spark):
    df = spark.createDataFrame([(10.0, None), (None, None), (10.0, 7.0)], "pm25 double, pm10 double")
    assert [r.pm10 for r in impute_pm10(df).collect()] == [18.0, 40.0, 7.0]
    w = spark.createDataFrame([(None, None), (1.0, 2.0)], "temperature double, humidity double")
    assert [tuple(r) for r in impute_weather(w).collect()] == [(30.0, 60.0), (1.0, 2.0)]
    text = spark.createDataFrame([("7.5",), ("n/a",)], "pm25 string")
    assert [r.pm25 for r in cast_features(text, trusted=False).collect()] == [7.5, None]


def test_sql_functions_match_and_stay_out_of_python(spark):
    register_sql_functions(spark)
    for t, h, want in HUMIDEX:
        lit = lambda x: "CAST(NULL AS DOUBLE)" if x is None else f"{x}D"
        assert same(spark.sql(f"SELECT humidex({lit(t)}, {lit(h)})").first()[0], want)
    df = spark.createDataFrame([(v,) for p, v, _ in SUBINDEX if p == "pm25" and v == v], "v double")
    out = df.selectExpr("v", "aqi_pm25(v) AS x", "aqi_overall(v, NULL) AS y")
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    want = {v: x for p, v, x in SUBINDEX if p == "pm25"}
    for r in out.collect():
        assert same(r.x, want[r.v]) and same(r.y, want[r.v])
