import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hazeflow.operators.chunks import difference, difference_filled, fill_series
from hazeflow.operators.joins import horizon_labels, point_in_time_join, source_fallback
from hazeflow.operators.profile import gap_report
from hazeflow.plans.history import feature_table

COLS = ["a", "b"]


def random_series(seed, cities=4, hours=24 * 80):
    """Sparse hourly rows over three months, long gaps, one city without any b."""
    rng = np.random.default_rng(seed)
    frames = []
    for c in range(cities):
        hour = np.sort(rng.choice(hours, size=rng.integers(5, 160), replace=False))
        df = pd.DataFrame({"city": f"c{c}", "event_ts": pd.Timestamp("2024-01-20") + pd.to_timedelta(hour, unit="h")})
        for col in COLS:
            df[col] = np.where(rng.random(len(df)) < 0.7, np.nan, rng.integers(0, 50, len(df)).astype(float))
        if c == 0:
            df["b"] = np.nan
        frames.append(df)
    return pd.concat(frames, ignore_index=True)


def to_spark(spark, pdf):
    df = spark.createDataFrame(pdf)
    return df.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in COLS if c in pdf})


def ordered(df):
    return df.toPandas().sort_values(["city", "event_ts"]).reset_index(drop=True)


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("grain", ["month", "day"])
def test_fill_equals_pandas(spark, seed, grain):
    pdf = random_series(seed)
    got = ordered(fill_series(to_spark(spark, pdf), COLS, grain=grain))
    want = pdf.sort_values(["city", "event_ts"]).reset_index(drop=True)
    want[COLS] = want.groupby("city")[COLS].transform(lambda s: s.ffill().bfill())
    pd.testing.assert_frame_equal(got[COLS], want[COLS])
    forward = ordered(fill_series(to_spark(spark, pdf), COLS, grain=grain, backward=False))
    want = pdf.sort_values(["city", "event_ts"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(forward[COLS], want.groupby("city")[COLS].ffill())


def test_fill_equals_plain_window_and_is_idempotent(spark):
    df = to_spark(spark, random_series(7))
    once = fill_series(df, COLS)
    w = W.partitionBy("city").orderBy("event_ts")
    plain = df.withColumns({
        c: F.coalesce(
            F.last(c, True).over(w.rowsBetween(W.unboundedPreceding, 0)),
            F.first(c, True).over(w.rowsBetween(0, W.unboundedFollowing)),
        ) for c in COLS
    })
    assert once.exceptAll(plain).isEmpty() and plain.exceptAll(once).isEmpty()
    assert fill_series(once, COLS).exceptAll(once).isEmpty()


@pytest.mark.parametrize("seed", range(3))
def test_difference_equals_pandas(spark, seed):
    pdf = random_series(seed)
    got = ordered(difference(to_spark(spark, pdf), "a", "d"))
    want = pdf.sort_values(["city", "event_ts"]).reset_index(drop=True)
    pd.testing.assert_series_equal(got["d"], want.groupby("city")["a"].diff().fillna(0.0), check_names=False)
    filled = ordered(difference_filled(fill_series(to_spark(spark, pdf), COLS, previous="a"), "a", "d"))
    want["a"] = want.groupby("city")["a"].transform(lambda s: s.ffill().bfill())
    pd.testing.assert_series_equal(filled["d"], want.groupby("city")["a"].diff().fillna(0.0), check_names=False)


def test_no_window_over_a_whole_city(spark):
    plan = fill_series(to_spark(spark, random_series(1)), COLS)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange SinglePartition" not in plan
    assert "hashpartitioning(city" in plan and "_chunk" in plan


def test_feature_table_without_label_fill(spark):
    t = [dt.datetime(2024, 1, 31, 22) + dt.timedelta(hours=i) for i in range(4)]
    rows = [("c", t[i], 1.0, 2.0, y, 20.0, 50.0) for i, y in enumerate([10.0, None, 30.0, 35.0])]
    df = spark.createDataFrame(rows, "city string, event_ts timestamp, pm25 double, pm10 double, target_aqi double, temperature double, humidity double")
    keep = feature_table(df, fill_label=False).orderBy("timestamp").collect()
    assert [(r.target_aqi, r.aqi_change_rate) for r in keep] == [(10.0, 0.0), (None, 0.0), (30.0, 0.0), (35.0, 5.0)]
    fill = feature_table(df).orderBy("timestamp").collect()
    assert [(r.target_aqi, r.aqi_change_rate) for r in fill] == [(10.0, 0.0), (10.0, 0.0), (30.0, 20.0), (35.0, 5.0)]


def test_point_in_time_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    base = pd.Timestamp("2024-01-30")
    feats = random_series(11).rename(columns={"a": "x"})[["city", "event_ts", "x"]].fillna(-1.0)
    asks = pd.DataFrame({
        "city": rng.choice(["c0", "c1", "c2", "c3", "c9"], 300),
        "label_ts": base + pd.to_timedelta(rng.integers(-20 * 86400, 60 * 86400, 300), unit="s"),
        "id": range(300),
    })
    # Labels exactly at a feature's time, and one that occurs very often.
    asks.loc[:50, "city"], asks.loc[:50, "label_ts"] = feats["city"].iloc[10], feats["event_ts"].iloc[10]
    got = point_in_time_join(spark.createDataFrame(asks), spark.createDataFrame(feats), ["x"]).toPandas().set_index("id")
    assert len(got) == 300
    for r in asks.itertuples():
        before = feats[(feats.city == r.city) & (feats.event_ts <= r.label_ts)]
        if before.empty:
            assert pd.isna(got.loc[r.id, "feature_ts"])
        else:
            best = before.loc[before.event_ts.idxmax()]
            assert got.loc[r.id, "feature_ts"] == best.event_ts and got.loc[r.id, "x"] == best.x


def test_horizons_follow_time_not_rows(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("c", t + dt.timedelta(hours=h), float(h)) for h in (0, 24, 30, 48)]
    df = spark.createDataFrame(rows, "city string, event_ts timestamp, target_aqi double")
    got = horizon_labels(df, [24, 48]).orderBy("event_ts").collect()
    assert [(r.label_24h, r.label_48h) for r in got] == [(24.0, 48.0), (48.0, None), (None, None), (None, None)]


def test_fallback_takes_records_whole(spark):
    t = dt.datetime(2024, 1, 1)
    schema = "city string, event_ts timestamp, x double, y double"
    primary = spark.createDataFrame([("a", t, None, None)], schema)
    secondary = spark.createDataFrame([("a", t, 1.0, 2.0), ("b", t, 3.0, None)], schema)
    got = {r.city: (r.source, r.x, r.y) for r in source_fallback(primary, secondary, ["x", "y"]).collect()}
    assert got == {"a": ("primary", None, None), "b": ("secondary", 3.0, None)}


def test_gap_report(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("a", t), ("a", t + dt.timedelta(hours=3)), ("b", t)], "city string, event_ts timestamp")
    assert sorted(r.event_ts.hour for r in gap_report(df).collect()) == [1, 2]
