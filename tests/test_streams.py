import datetime as dt
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from hazeflow.catalog import streams
from hazeflow.schema import LANDED_SCHEMA
from hazeflow.sources.tables import feature_scan, read_landed, read_landed_stream
from hazeflow.streaming import (
    alert_episodes, change_rates, change_rates_in_time, dedup_stream, fallback_streams, hourly_stream, join_streams, read_updates, run_features, run_to_table, run_updates,
    run_upsert,
)
from hazeflow.plans.live import live_vectors
from test_payloads import GOOD_WEATHER, pollution, station
from test_store import stored, vectors

T0 = dt.datetime(2024, 8, 1)


def ts(hours):
    return (T0 + dt.timedelta(hours=hours)).isoformat()


def land(folder, batches):
    """One JSON-lines file per micro-batch, in order."""
    os.makedirs(folder, exist_ok=True)
    for i, rows in enumerate(batches):
        path = os.path.join(folder, f"{i:03d}.json")
        with open(path, "w") as f:
            f.writelines(json.dumps(r) + "\n" for r in rows)
        at = time.time() - 1000 + i
        os.utime(path, (at, at))


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(folder)


def test_change_rate_across_batches(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    land(src, [
        [{"city": "a", "timestamp": 2, "target_aqi": 12.0}, {"city": "a", "timestamp": 1, "target_aqi": 10.0}],
        [{"city": "a", "timestamp": 4, "target_aqi": 9.0}, {"city": "b", "timestamp": 4, "target_aqi": 1.0}],
        [{"city": "a", "timestamp": 3, "target_aqi": 50.0}, {"city": "a", "timestamp": 5, "target_aqi": 10.0}],
        [{"city": "b", "timestamp": 5}, {"city": "b", "timestamp": 6, "target_aqi": 3.0}],
    ])
    run_to_table(change_rates(stream(spark, src, "city string, timestamp bigint, target_aqi double")), out)
    got = {(r.city, r.timestamp): r.aqi_change_rate for r in spark.read.parquet(f"{out}/data").collect()}
    assert got == {
        ("a", 1): 0.0, ("a", 2): 2.0, ("a", 4): -3.0, ("b", 4): 0.0, ("a", 3): None, ("a", 5): 1.0,
        ("b", 5): 0.0, ("b", 6): 0.0,
    }


@pytest.mark.parametrize("spread", [False, True])
def test_dedup_within_watermark(spark, tmp_path, spread):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    row = lambda h, i: {"city": "a", "event_ts": ts(h), "id": i}
    land(src, [[row(0, 1), row(0, 2), row(1, 3)], [row(1, 4), row(2, 5)], [row(20, 6)], [row(21, 7)], [row(3, 8), row(22, 9)]])
    s = stream(spark, src, "city string, event_ts timestamp, id bigint")
    part = F.col("id") if spread else None
    run_to_table(dedup_stream(s, ["city", "event_ts"], "event_ts", "2 hours", part), out)
    hours = sorted((r.event_ts - T0).seconds // 3600 for r in spark.read.parquet(f"{out}/data").collect())
    # The row of hour 3 comes far behind the watermark and is dropped.
    assert hours == [0, 1, 2, 20, 21, 22]


def test_hourly_updates(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    row = lambda h, v: {"city": "a", "ts": ts(h), "value": v}
    land(src, [[row(0.1, 1.0), row(0.9, 2.0)], [row(1.5, 5.0), row(0.5, 7.0)], [row(30, 1.0)], [row(31, 1.0)], [row(0.2, 99.0), row(32, 2.0)]])
    s = stream(spark, src, "city string, ts timestamp, value double")
    run_updates(hourly_stream(s, "ts", "2 hours", {"n": F.count("value"), "peak": F.max("value")}), out)
    got = {r.event_ts: (r.n, r.peak) for r in read_updates(spark, out, ["city", "event_ts"]).collect()}
    at = lambda h: T0 + dt.timedelta(hours=h)
    # The late reading within the watermark counts, the one far behind it does not.
    assert got == {at(0): (3, 7.0), at(1): (1, 5.0), at(30): (1, 1.0), at(31): (1, 1.0), at(32): (1, 2.0)}


def test_stream_join_equals_batch_join(spark, tmp_path):
    air = [{"city": c, "event_ts": ts(h), "pm25": float(h)} for c in "ab" for h in range(6)]
    weather = [{"city": c, "event_ts": ts(h), "temperature": float(h)} for c in "bc" for h in range(3, 9)]
    land(str(tmp_path / "a"), [air[0:4], air[4:8], air[8:]])
    land(str(tmp_path / "w"), [weather[0:4], weather[4:8], weather[8:]])
    a = stream(spark, str(tmp_path / "a"), "city string, event_ts timestamp, pm25 double")
    w = stream(spark, str(tmp_path / "w"), "city string, event_ts timestamp, temperature double")
    run_to_table(join_streams(a, w, "12 hours"), str(tmp_path / "out"))
    got = {(r.city, r.pm25, r.temperature) for r in spark.read.parquet(str(tmp_path / "out" / "data")).collect()}
    assert got == {("b", float(h), float(h)) for h in (3, 4, 5)}


def test_upsert_stream_last_batch_wins(spark, tmp_path):
    src = str(tmp_path / "in")
    for i, rows in enumerate([[("a", 1000, 1.0)], [("a", 1000, 2.0), ("b", 1000, 5.0)], [("b", 1000, 6.0)]]):
        vectors(spark, rows).coalesce(1).write.mode("append").json(src)
        time.sleep(1.1)
    s = stream(spark, src, vectors(spark, []).schema)
    table = str(tmp_path / "t")
    run_upsert(s, table, str(tmp_path / "cp"))
    want = {("a", 1000): 2.0, ("b", 1000): 6.0}
    assert stored(spark, table) == want
    # Started again with a lost checkpoint, the same input gives the same table.
    run_upsert(s, table, str(tmp_path / "cp2"), first_seq=10)
    assert stored(spark, table) == want


def test_live_stream_equals_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    row = lambda c, h, p, s: {"city": c, "fetched_at": ts(h), "pollution": p, "weather": GOOD_WEATHER, "station": s}
    land(src, [
        [row("a", 0, pollution(), None), row("b", 0, None, station(aqi=99, iaqi={"pm25": {"v": 5}}))],
        [row("a", 1, "broken", "broken"), row("b", 1, pollution(main=""), None)],
        [row("a", 2, None, station(aqi=None, iaqi={"t": {"v": 1}})), row(None, 2, pollution(), None)],
    ])
    table, dead = str(tmp_path / "t"), str(tmp_path / "dead")
    run_features(read_landed_stream(spark, src, max_files=1), table, dead, str(tmp_path / "cp"))
    batch = live_vectors(read_landed(spark, src).where("city IS NOT NULL"))[0].drop("source", "label_scale")
    got = feature_scan(spark, table)
    assert got.exceptAll(batch).isEmpty() and batch.exceptAll(got).isEmpty() and got.count() == 3
    assert {(r.city, r.reject_reason) for r in spark.read.parquet(dead).collect()} == {("a", "no_source"), ("a", "no_label"), (None, "no_key")}
    assert LANDED_SCHEMA.names == ["city", "fetched_at", "pollution", "weather", "station"]


def test_fallback_between_streams(spark, tmp_path):
    """Partners in either order and in different micro-batches; a partner that never comes; one that comes too late."""
    row = lambda city, h, v: {"city": city, "event_ts": ts(h), "v": v}
    land(str(tmp_path / "first"), [
        [row("a", 0, 1.0), row("b", 0, None), row(None, 0, 5.0)], [row("a", 1, 2.0), row("a", 6, 3.0)], [row("b", 9, 4.0)], [row("a", 30, 0.0), row("a", 2, 8.0)],
    ])
    land(str(tmp_path / "second"), [
        [row("a", 1, 20.0), row("b", 0, 11.0)], [row("a", 0, 10.0), row("c", 5, 30.0)], [row("a", 9, 40.0), {"city": "a", "v": 1.0}], [row("a", 31, 0.0)],
    ])
    first, second = (stream(spark, str(tmp_path / side), "city string, event_ts timestamp, v double") for side in ("first", "second"))
    out = str(tmp_path / "out")
    dropped = run_to_table(fallback_streams(first, second, ["v"], "2 hours"), out)
    got = sorted((r.city, (r.event_ts - T0).total_seconds() / 3600, r.source, r.v) for r in spark.read.parquet(f"{out}/data").collect())
    assert got == [
        ("a", 0, "primary", 1.0), ("a", 1, "primary", 2.0), ("a", 6, "primary", 3.0), ("a", 9, "secondary", 40.0),
        ("b", 0, "primary", None), ("b", 9, "primary", 4.0), ("c", 5, "secondary", 30.0),
    ]
    assert dropped == 1


def test_alert_episodes(spark, tmp_path):
    """A late hour joins two stretches; a quiet city's episode ends by the others' time; an open one is not given."""
    row = lambda city, h, v: {"city": city, "event_ts": ts(h), "aqi": v}
    land(str(tmp_path / "in"), [
        [row("a", 0, 160.0), row("a", 2, 310.0), row("b", 1, 151.0), row("b", 2, 150.9)],
        [row("a", 1, 200.0), row("a", 3, 100.0), row("a", 5, 155.0), row("b", 5, None)],
        [row("c", 12, 20.0)],
        [row("c", 20, 170.0), row("b", 21, 10.0)],
    ])
    out = str(tmp_path / "out")
    run_to_table(alert_episodes(stream(spark, str(tmp_path / "in"), "city string, event_ts timestamp, aqi double"), "event_ts", "2 hours", "aqi"), out)
    hour = lambda t: (t - T0).total_seconds() / 3600
    got = sorted((r.city, hour(r.started_at), hour(r.ended_at), r.hours, r.peak) for r in spark.read.parquet(f"{out}/data").collect())
    assert got == [("a", 0, 2, 3, 310.0), ("a", 5, 5, 1, 155.0), ("b", 1, 1, 1, 151.0)]


def test_change_rate_in_event_time(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    hour = lambda h: 1722470400000 + 3_600_000 * h
    row = lambda c, h, y: {"city": c, "timestamp": None if h is None else hour(h), "target_aqi": y}
    land(src, [
        [row("a", 3, 13.0), row("a", 1, 11.0), row("b", 2, 5.0), row("a", None, 1.0), row(None, 1, 1.0)],
        [row("a", 2, 20.0), row("b", 4, None), row("a", 4, 14.0), row("a", -1, 7.0)],
        [row("b", 3, 4.0), row("b", 5, 1.0), row("a", 5, 10.0), row("c", 5, 9.0)],
        [row("a", 12, 99.0)],
        [row("a", 13, 1.0)],
        [row("a", 4, 1000.0)],
    ])
    history = spark.createDataFrame([("a", hour(0), 10.0), ("b", hour(1), None)], "city string, timestamp long, target_aqi double")
    s = stream(spark, src, "city string, timestamp bigint, target_aqi double")
    dropped = run_to_table(change_rates_in_time(s, "6 hours", history), out)
    got = sorted((r.city, (r.timestamp - hour(0)) // 3_600_000, r.target_aqi, r.aqi_change_rate) for r in spark.read.parquet(f"{out}/data").collect())
    assert got == [
        ("a", -1, 7.0, None), ("a", 1, 11.0, 1.0), ("a", 2, 20.0, 9.0), ("a", 3, 13.0, -7.0), ("a", 4, 14.0, 1.0), ("a", 5, 10.0, -4.0),
        ("b", 2, 5.0, 0.0), ("b", 3, 4.0, -1.0), ("b", 4, None, 0.0), ("b", 5, 1.0, 0.0), ("c", 5, 9.0, 0.0),
    ]
    assert dropped == 1  # the second row of hour 4: its hour was given before


def test_change_rate_in_event_time_without_history_or_rows(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    land(src, [[{"city": "a", "timestamp": 3_600_000 * h, "target_aqi": float(y)} for h, y in ((3, 4), (1, 1), (31, 9), (1, 1), (-5, 3))]])
    run_to_table(change_rates_in_time(stream(spark, src, "city string, timestamp bigint, target_aqi double"), "1 hour"), out)
    rows = sorted((r.timestamp // 3_600_000, r.aqi_change_rate) for r in spark.read.parquet(f"{out}/data").collect())
    assert rows == [(1, 0.0), (1, 0.0), (3, 3.0)]


def test_stretches_in_several_files_are_micro_batches(spark, tmp_path, monkeypatch):
    """A stretch in several files is one micro-batch of several tasks; one with fewer rows than files does not shift those behind it."""
    monkeypatch.setattr(streams, "FILE_ROWS", 40)
    at = [*range(100), 100, 150, *range(300, 400), None, None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(at)], "id long, ts long")
    seen = []

    def note(batch, batch_id):
        seen.append((sorted(r.id for r in batch.collect()), batch.select(F.spark_partition_id()).distinct().count()))

    stream = streams._in_time_order(df, "ts", "several", [100, 200, 300])
    stream.writeStream.foreachBatch(note).option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start().awaitTermination()
    assert [s[0] for s in seen] == [[*range(100), 202, 203], [100, 101], [], [*range(102, 202)]] and seen[0][1] > 1
