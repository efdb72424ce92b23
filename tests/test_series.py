import datetime as dt
import json

from pyspark.sql import functions as F

from hazeflow import fixtures as X
from hazeflow.sources.series import explode_axis, explode_series, pack_daily, read_series
from hazeflow.sources.tables import date_range
from hazeflow.schema import AIR_COLS, series_schema

DAY = 1722470400  # 2024-08-01


def test_axis_is_half_open(spark):
    df = spark.createDataFrame([("a", DAY, DAY + 86400, 3600), ("b", DAY, DAY, 3600), ("c", DAY, DAY + 5000, 3600)],
                               "city string, start bigint, end bigint, interval bigint")
    rows = explode_axis(df, ["city"]).collect()
    by = {c: sorted(r.event_ts for r in rows if r.city == c) for c in "abc"}
    assert len(by["a"]) == 24 and by["a"][-1] == dt.datetime(2024, 8, 1, 23)
    assert by["b"] == [] and len(by["c"]) == 2


def test_series_are_read_by_name(spark, tmp_path):
    doc = {"city": "a", "start": DAY, "end": DAY + 3 * 3600, "interval": 3600,
           "pm10": [1, 2, 3], "target_aqi": [None, 8, 9], "pm25": [4, 5]}
    (tmp_path / "s.json").write_text(json.dumps(doc))
    rows = read_series(spark, str(tmp_path), AIR_COLS).orderBy("event_ts").collect()
    assert [(r.pm25, r.pm10, r.target_aqi) for r in rows] == [(4, 1, None), (5, 2, 8), (None, 3, 9)]


def test_pack_and_explode_are_inverse(spark):
    df = spark.createDataFrame([("a", dt.datetime(2024, 8, 1, 3), 1.0, None, 2.0)],
                               "city string, event_ts timestamp, pm25 double, pm10 double, target_aqi double")
    back = explode_series(pack_daily(df, AIR_COLS), AIR_COLS)
    assert back.count() == 24
    assert [tuple(r) for r in back.where("pm25 IS NOT NULL").collect()] == [("a", dt.datetime(2024, 8, 1, 3), 1.0, None, 2.0)]
    assert pack_daily(df, AIR_COLS).schema.names == series_schema(AIR_COLS).names


def test_date_range_reaches_the_scan(spark):
    events = X.load(spark, "/root/testdata/sf0.001", "events")
    plan = date_range(events, "2024-01-05", "2024-01-05", ts="ts")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan


def test_fixture_sizes(spark):
    city = F.concat(F.lit("st"), (F.col("user_id") % 4).cast("string"))
    for sf, sizes in {"0.001": (542, 377, 74), "0.01": (2530, 2171, 1913)}.items():
        d = f"/root/testdata/sf{sf}"
        got = X.air(spark, d, city).count(), X.weather(spark, d, city).count(), X.joined(spark, d, city).count()
        assert got == sizes
