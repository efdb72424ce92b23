import os

import numpy as np
from pyspark.sql import functions as F

import pytest

from hazeflow.operators.parity import parity_report
from hazeflow.operators.sketches import merged_quantiles, refresh_sketches, sketches, table_quantiles
from hazeflow.operators.store import (
    STORE_SCHEMA, compact, keyless, latest_per_city, latest_wins, merge_into_table, read_online, read_store, retain, save_online, save_vectors,
    upsert, vacuum, versions,
)
from hazeflow.schema import FEATURE_COLS, FEATURE_SCHEMA
from hazeflow.sources.tables import feature_scan

JAN, FEB = 1704067200000, 1706745600000


def vectors(spark, rows):
    """(city, timestamp, target) to full feature rows."""
    full = [(c, t, 1.0, 2.0, 20.0, 50.0, 24.0, 0.0, 0, 1, 1, 0, y) for c, t, y in rows]
    return spark.createDataFrame(full, FEATURE_SCHEMA)


def stored(spark, path):
    return {(r.city, r.timestamp): r.target_aqi for r in feature_scan(spark, path).collect()}


def data_files(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(f"{path}/data") for f in fs}


def test_merge_appends_and_repeats(spark, tmp_path):
    path = str(tmp_path / "t")
    merge_into_table(vectors(spark, [("a", JAN, 1.0), ("a", FEB, 2.0)]), path, 0)
    change = vectors(spark, [("a", FEB, 3.0), ("b", FEB, 4.0)])
    want = {("a", JAN): 1.0, ("a", FEB): 3.0, ("b", FEB): 4.0}
    for _ in range(2):
        before = data_files(path)
        merge_into_table(change, path, 1)
        after = data_files(path)
        # Only the load's own rows are written, nothing is touched.
        assert before.items() <= after.items() and all("2024-02" in f for f in after.keys() - before.keys() if "year_month" in f)
        assert stored(spark, path) == want
    # An older load that arrives late does not win.
    merge_into_table(vectors(spark, [("a", FEB, 9.0)]), path, 0)
    assert stored(spark, path) == want
    assert feature_scan(spark, path).columns == FEATURE_COLS


def test_compaction_and_loads_around_it(spark, tmp_path):
    path = str(tmp_path / "t")
    merge_into_table(vectors(spark, [("a", JAN, 1.0), ("a", FEB, 2.0)]), path, 0)
    merge_into_table(vectors(spark, [("a", FEB, 3.0)]), path, 1)
    compact(spark, path, ["2024-02"])
    assert stored(spark, path) == {("a", JAN): 1.0, ("a", FEB): 3.0}
    assert read_store(spark, path, ["2024-02"]).select("target_aqi").collect()[0][0] == 3.0
    merge_into_table(vectors(spark, [("a", FEB, 4.0), ("a", JAN, 5.0)]), path, 2)
    compact(spark, path, ["2024-01", "2024-02"])
    assert stored(spark, path) == {("a", JAN): 5.0, ("a", FEB): 4.0}
    merge_into_table(vectors(spark, [("a", FEB, 8.0)]), path, 1)
    assert stored(spark, path) == {("a", JAN): 5.0, ("a", FEB): 4.0}


def test_failed_write_leaves_the_table_as_it_was(spark, tmp_path):
    path = str(tmp_path / "t")
    merge_into_table(vectors(spark, [("a", JAN, 1.0)]), path, 0)
    broken = vectors(spark, [("a", JAN, 2.0)]).withColumn("pm25", F.expr("CASE WHEN rand() < 2 THEN raise_error('lost') END").cast("double"))
    for _ in range(2):
        try:
            merge_into_table(broken, path, 1)
        except Exception as e:
            assert "lost" in str(e)
        else:
            raise AssertionError("the write should have failed")
        assert stored(spark, path) == {("a", JAN): 1.0}
    merge_into_table(vectors(spark, [("a", JAN, 3.0)]), path, 1)
    assert stored(spark, path) == {("a", JAN): 3.0}


def test_label_scale_is_kept(spark, tmp_path):
    path = str(tmp_path / "t")
    merge_into_table(vectors(spark, [("a", JAN, 180.0)]), path, 0)
    live = vectors(spark, [("a", FEB, 2.0)]).withColumns({"label_scale": F.lit("aqi_5"), "source": F.lit("pollution")})
    merge_into_table(live, path, 1)
    rows = {r.timestamp: (r.label_scale, r.source) for r in read_store(spark, path).collect()}
    assert rows == {JAN: ("aqi_500", "history"), FEB: ("aqi_5", "pollution")}
    assert [r.target_aqi for r in feature_scan(spark, path, label_scale="aqi_500").collect()] == [180.0]


def test_rows_without_a_key(spark, tmp_path):
    path, rows = str(tmp_path / "t"), vectors(spark, [(None, JAN, 1.0), ("a", None, 2.0), ("a", JAN, 3.0)])
    merge_into_table(rows, path, 0)
    assert stored(spark, path) == {("a", JAN): 3.0}
    assert {r.reject_reason for r in keyless(rows).collect()} == {"no_key"} and keyless(rows).count() == 2


def test_online_copy(spark, tmp_path):
    path = str(tmp_path / "o")
    save_online(vectors(spark, [("a", JAN, 1.0), ("b", FEB, 2.0)]), path)
    save_online(vectors(spark, [("a", FEB, 3.0), ("b", JAN, 4.0)]), path)
    assert {r.city: r.target_aqi for r in read_online(spark, path).collect()} == {"a": 3.0, "b": 2.0}
    assert [r.city for r in read_online(spark, path, ["b"]).collect()] == ["b"]


def test_nothing_to_save(spark, tmp_path):
    path = str(tmp_path / "t")
    assert save_vectors(None, path, 0) is False
    assert save_vectors(vectors(spark, []), path, 0) is False
    assert save_vectors(vectors(spark, [("a", JAN, 1.0)]), path, 0) is True


def test_scan_reads_only_the_named_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    merge_into_table(vectors(spark, [("a", JAN, 1.0)]), path, 0)
    plan = feature_scan(spark, path, ["city", "pm25"])._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<city:string,timestamp:bigint,pm25:double,load_seq:bigint>" in plan


def test_column_order_does_not_matter(spark):
    a = vectors(spark, [("a", JAN, 1.0)]).withColumns({"label_scale": F.lit("aqi_500"), "source": F.lit("history"), "load_seq": F.lit(0).cast("bigint"), "year_month": F.lit("2024-01")})
    b = a.select(*reversed(a.columns)).withColumns({"load_seq": F.lit(1).cast("bigint"), "target_aqi": F.lit(5.0)})
    out = upsert(a, b).collect()
    assert len(out) == 1 and out[0].target_aqi == 5.0 and set(a.columns) == set(STORE_SCHEMA.names)


def test_latest_wins_combines_before_the_shuffle(spark):
    df = spark.range(1000).select(F.lit("a").alias("city"), F.lit(1).alias("timestamp"), F.col("id").alias("load_seq"), "id")
    out = latest_wins(df)
    assert [r.id for r in out.collect()] == [999]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "partial_max" in plan and "Window" not in plan


def test_latest_per_city(spark):
    df = vectors(spark, [("a", JAN, 1.0), ("a", FEB, 2.0), ("b", JAN, 3.0)])
    assert {r.city: (r.timestamp, r.target_aqi) for r in latest_per_city(df).collect()} == {"a": (FEB, 2.0), "b": (JAN, 3.0)}


def test_compaction_retires_commits(spark, tmp_path):
    path = str(tmp_path / "t")
    for seq, value in enumerate((1.0, 2.0, 3.0)):
        merge_into_table(vectors(spark, [("a", JAN, value), ("a", FEB, value)]), path, seq)
    folders = lambda: {f.split("commit=")[1].split("/")[0] for f in read_store(spark, path).inputFiles()}
    assert len(folders()) == 3
    compact(spark, path, ["2024-01"])
    assert len(folders()) == 4  # February still lies in the loads
    compact(spark, path, ["2024-01", "2024-02"])
    assert len(folders()) == 1
    merge_into_table(vectors(spark, [("a", FEB, 4.0)]), path, 3)
    assert len(folders()) == 2 and {r.target_aqi for r in read_store(spark, path).collect()} == {3.0, 4.0}
    merge_into_table(vectors(spark, []), path, 4)
    assert len(folders()) == 2


def test_online_copy_takes_the_later_load(spark, tmp_path):
    path = str(tmp_path / "o")
    save_online(vectors(spark, [("a", FEB, 90.0)]), path, 0)
    save_online(vectors(spark, [("a", FEB, 20.0)]), path, 1)
    save_online(vectors(spark, [("a", FEB, 90.0)]), path, 0)
    assert read_online(spark, path).first().target_aqi == 20.0


def values_at(spark, path, commit=None):
    return {(r.city, r.timestamp): r.target_aqi for r in feature_scan(spark, path, as_of=commit).collect()}


def test_versions_retention_and_vacuum(spark, tmp_path):
    path = str(tmp_path / "t")
    first = merge_into_table(vectors(spark, [("a", JAN, 1.0), ("a", FEB, 2.0)]), path, 0)
    second = merge_into_table(vectors(spark, [("a", FEB, 3.0)]), path, 1)
    third = compact(spark, path, ["2024-01", "2024-02"])
    fourth = merge_into_table(vectors(spark, [("b", FEB, 4.0)]), path, 2)
    want = {first: {("a", JAN): 1.0, ("a", FEB): 2.0}, second: {("a", JAN): 1.0, ("a", FEB): 3.0}}
    want[third] = want[second]
    want[fourth] = want[None] = want[second] | {("b", FEB): 4.0}
    assert [v for v, _ in versions(spark, path)] == [first, second, third, fourth]
    assert all(values_at(spark, path, v) == w for v, w in want.items())

    folders = lambda: {d.split("commit=")[1] for d in map(str, (tmp_path / "t" / "data").iterdir())}
    assert retain(spark, path, second) == []  # the second version needs the first load
    assert retain(spark, path, third) == [first, second] and folders() == {first, second, third, fourth}
    for _ in range(2):  # vacuum can be repeated
        vacuum(spark, path)
        assert folders() == {third, fourth} and len(list((tmp_path / "t" / "log").glob("*.parquet"))) == 1
        assert [v for v, _ in versions(spark, path)] == [third, fourth]
        assert all(values_at(spark, path, v) == want[v] for v in (third, fourth, None))
        for gone in (first, second, "unknown"):
            with pytest.raises(ValueError, match="not kept"):
                values_at(spark, path, gone)
    fifth = merge_into_table(vectors(spark, [("a", JAN, 9.0)]), path, 3)
    assert values_at(spark, path)["a", JAN] == 9.0 and values_at(spark, path, fourth) == want[None]
    assert [v for v, _ in versions(spark, path)] == [third, fourth, fifth]


def test_a_version_still_in_use_is_not_given_up(spark, tmp_path):
    path = str(tmp_path / "t")
    first = merge_into_table(vectors(spark, [("a", JAN, 1.0), ("a", FEB, 2.0)]), path, 0)
    second = merge_into_table(vectors(spark, [("a", FEB, 3.0)]), path, 1)
    third = compact(spark, path, ["2024-02"])
    assert retain(spark, path, third) == [second]  # January lies in the first load only
    vacuum(spark, path)
    assert values_at(spark, path) == {("a", JAN): 1.0, ("a", FEB): 3.0}
    with pytest.raises(ValueError):
        values_at(spark, path, first)


def test_parity(spark):
    base = vectors(spark, [("a", JAN, 1.0), ("a", FEB, None), ("b", JAN, float("nan")), ("c", JAN, float("inf"))])
    view = vectors(spark, [("a", JAN, 3.5), ("a", FEB, 2.0), ("c", JAN, float("inf")), ("d", JAN, 1.0), (None, JAN, 1.0)])
    rows = {(r.view, r.column): r for r in parity_report(base, {"v": view, "same": base, "none": base.limit(0)}, ["target_aqi", "pm25"]).collect()}
    got = rows["v", "target_aqi"]
    assert (got.n_shared, got.n_missing, got.n_extra, got.n_differs, got.max_abs_diff) == (3, 1, 2, 2, 2.5)
    assert rows["v", "pm25"].n_differs == 0 and rows["v", "pm25"].max_abs_diff == 0.0
    assert (rows["same", "target_aqi"].n_shared, rows["same", "target_aqi"].n_differs) == (4, 0)
    assert (rows["none", "pm25"].n_missing, rows["none", "pm25"].max_abs_diff) == (4, None)
    assert {r.n_differs for r in parity_report(base, {"v": view}, ["target_aqi"], 2.5).collect()} == {1}
    assert parity_report(base, {}, ["pm25"]).count() == 0


def test_sketches_per_month(spark, tmp_path):
    path, rng = str(tmp_path / "t"), np.random.default_rng(0)
    jan, feb = rng.normal(50, 20, 700), rng.exponential(30, 600)
    merge_into_table(vectors(spark, [("a", JAN + 3_600_000 * i, float(v)) for i, v in enumerate(jan)]), path, 0)
    cols = ["target_aqi", "pm25"]
    assert table_quantiles(spark, path, cols, [0.5]).count() == 0
    assert refresh_sketches(spark, path, cols) == ["2024-01"] and refresh_sketches(spark, path, cols) == []
    merge_into_table(vectors(spark, [("a", FEB + 3_600_000 * i, float(v)) for i, v in enumerate(feb)]), path, 1)
    assert refresh_sketches(spark, path, cols) == ["2024-02"]  # January is not read again
    probs = [0.0, 0.1, 0.5, 0.9, 1.0]

    def check(everything):
        rows = [r for r in table_quantiles(spark, path, cols, probs).collect() if r.column == "target_aqi"]
        assert len(rows) == 5 and {r.n for r in rows} == {len(everything)}
        for r in rows:
            assert abs(np.mean(everything <= r.value) - r.p) <= 0.01 + 1 / len(everything)

    check(np.r_[jan, feb])
    # A correction to smaller values changes its month only; a compaction of a month changes no value.
    merge_into_table(vectors(spark, [("a", FEB, 0.0), ("b", FEB, None)]), path, 2)
    assert refresh_sketches(spark, path, cols) == ["2024-02"]
    check(np.r_[jan, 0.0, feb[1:]])
    compact(spark, path, ["2024-02"])
    assert refresh_sketches(spark, path, cols) == ["2024-02"] and refresh_sketches(spark, path, cols) == []
    check(np.r_[jan, 0.0, feb[1:]])
    assert {r.n for r in table_quantiles(spark, path, ["target_aqi"], [0.5], ["2024-01"]).collect()} == {700}


def test_merged_sketches_keep_the_bound(spark):
    rng = np.random.default_rng(1)
    values = np.r_[rng.normal(0, 1, 60_000), np.full(30_000, 0.5)]
    rng.shuffle(values)
    df = spark.createDataFrame([(i % 50, float(v), None) for i, v in enumerate(values)], "part long, v double, nothing double")
    parts = sketches(df, ["v", "nothing"], "part")
    assert parts.where("column = 'nothing' AND n = 0 AND sketch IS NULL").count() == 50
    for kept in (parts, sketches(df.withColumn("part", F.lit(0)), ["v"], "part")):
        for r in merged_quantiles(kept, [0.01, 0.25, 0.5, 0.75, 0.99]).collect():
            assert r.column == "v" and np.mean(values < r.value) - 0.005 <= r.p <= np.mean(values <= r.value) + 0.005
