import json

import pytest

from hazeflow.plans.live import live_vectors
from hazeflow.schema import LANDED_SCHEMA
from hazeflow.sources.payloads import check_envelope, decode_pollution, decode_station, split_rejects


def pollution(components='"pm2_5": 10.5, "pm10": 20', main='"aqi": 2'):
    return '{"list":[{"components":{%s},"main":{%s}}]}' % (components, main)


GOOD_WEATHER = '{"main":{"temp": 21.5, "humidity": 60}}'
FULL = (10.5, 20.0, 21.5, 60.0, 2.0)
POLLUTION_CASES = [
    (pollution(), GOOD_WEATHER, FULL),
    (pollution('"pm10": 20'), GOOD_WEATHER, (25.0, 20.0, 21.5, 60.0, 2.0)),
    (pollution("", ""), GOOD_WEATHER, (25.0, 45.0, 21.5, 60.0, 3.0)),
    (pollution('"pm2_5": "7.5", "pm10": 20'), GOOD_WEATHER, (7.5, 20.0, 21.5, 60.0, 2.0)),
    (pollution('"pm2_5": null, "pm10": 20'), GOOD_WEATHER, None),
    (pollution('"pm2_5": "n/a", "pm10": 20'), GOOD_WEATHER, None),
    (pollution('"pm2_5": {"v": 1}, "pm10": 20'), GOOD_WEATHER, None),
    (pollution(main='"aqi": null'), GOOD_WEATHER, None),
    (pollution('"pm2_5": "NaN", "pm10": 20'), GOOD_WEATHER, None),
    (pollution('"pm2_5": 1, "pm10": "Infinity"'), GOOD_WEATHER, None),
    (pollution(main='"aqi": "NaN"'), GOOD_WEATHER, None),
    ('{"list":[]}', GOOD_WEATHER, None),
    ('{"list":[{"main":{"aqi":1}}]}', GOOD_WEATHER, None),
    ('{"list":[{"components":{"pm10":1}}]}', GOOD_WEATHER, None),
    ("{}", GOOD_WEATHER, None),
    ("<html>", GOOD_WEATHER, None),
    (None, GOOD_WEATHER, None),
    (pollution(), '{"main":{"temp": 21.5}}', None),
    (pollution(), '{"main":{"temp": null, "humidity": 60}}', None),
    (pollution(), '{"main":{"temp": "21.5", "humidity": "60"}}', FULL),
    (pollution(), None, None),
]


def test_pollution_decode(spark):
    df = spark.createDataFrame([(i, p, w) for i, (p, w, _) in enumerate(POLLUTION_CASES)], "i int, pollution string, weather string")
    for r in decode_pollution(df).collect():
        want = POLLUTION_CASES[r.i][2]
        got = r.pollution_record
        assert (got is None) == (want is None), POLLUTION_CASES[r.i]
        assert got is None or tuple(got) == want, POLLUTION_CASES[r.i]


def station(**data):
    return json.dumps({"status": "ok", "data": data})


IAQI = {"pm25": {"v": 55}, "t": {"v": 30.5}, "h": {"v": 70}, "p": {"v": 1000}, "w": {"v": 2.5}, "dew": {"v": 24}}
STATION_CASES = [
    (station(aqi=150, dominentpol="pm25", city={"name": "A"}, iaqi=IAQI), ("A", 150.0, 150.0, "pm25", 55.0, 30.5, 70.0, 1000.0, 2.5, 24.0)),
    (station(aqi=150), ("Unknown", 150.0, 150.0, "N/A", None, None, None, None, None, None)),
    (station(aqi=None, dominentpol=None, city={"name": None}, iaqi={"pm25": {}}), (None, None, None, None) + (None,) * 6),
    (station(aqi="-", city={}), ("Unknown", None, None, "N/A", None, None, None, None, None, None)),
    (station(idx=7), ("Unknown", None, None, "N/A") + (None,) * 6),
    (station(aqi="NaN", iaqi={"pm25": {"v": "NaN"}}), ("Unknown", None, None, "N/A") + (None,) * 6),
    ('{"status":"error","data":"Invalid key"}', None),
    ('{"status":"ok","data":{}}', None),
    ('{"status":"ok"}', None),
    ('{"data":{"aqi":1}}', None),
    ("oops", None),
    (None, None),
]


def test_station_decode_and_envelope(spark):
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(STATION_CASES)], "i int, station string")
    for r in decode_station(df).collect():
        want = STATION_CASES[r.i][1]
        assert (r.station_record is None) == (want is None), STATION_CASES[r.i]
        assert want is None or tuple(r.station_record) == want
    good, bad = split_rejects(check_envelope(df), "envelope_error")
    assert {r.i for r in good.collect()} == {i for i, (_, w) in enumerate(STATION_CASES) if w}
    assert {r.i: r.envelope_error for r in bad.collect()} == {
        6: "status_not_ok", 7: "no_data", 8: "no_data", 9: "status_not_ok", 10: "unreadable", 11: "unreadable",
    }


def test_live_vectors_fall_back_whole_records(spark):
    import datetime as dt

    t = dt.datetime(2024, 8, 1, 5, 30)
    s = station(aqi=150, iaqi=IAQI)
    rows = [
        ("a", t, pollution(), GOOD_WEATHER, s),
        ("b", t, None, GOOD_WEATHER, s),
        ("c", t, "x", GOOD_WEATHER, "x"),
        ("d", t, None, None, station(aqi=None, iaqi=IAQI)),
    ]
    vectors, rejects = live_vectors(spark.createDataFrame(rows, LANDED_SCHEMA))
    got = {r.city: r for r in vectors.collect()}
    assert set(got) == {"a", "b"}
    a, b = got["a"], got["b"]
    assert (a.pm25, a.pm10, a.target_aqi, a.source, a.label_scale) == (10.5, 20.0, 2.0, "pollution", "aqi_5")
    assert (b.pm25, b.pm10, b.target_aqi, b.source, b.label_scale) == (55.0, 99.0, 150.0, "station", "aqi_500")
    assert (a.hour, a.day, a.month, a.day_of_week, a.timestamp, a.aqi_change_rate) == (5, 1, 8, 3, 1722490200000, 0.0)
    assert {r.city: r.reject_reason for r in rejects.collect()} == {"c": "no_source", "d": "no_label"}


def test_payloads_are_parsed_once(spark):
    df = spark.createDataFrame([("a", None, "x", "x", "x")], LANDED_SCHEMA)
    plan = live_vectors(df)[0]._jdf.queryExecution().optimizedPlan().toString()
    # Once per payload, and the keys of a station reply without any known key, inside a CASE.
    assert plan.count("from_json") == 4
