"""Streaming operators and the jobs that run them over everything that has landed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import aqi_category
from ..operators.store import latest_wins, merge_into_table
from ..plans.live import decoded_vectors
from ..sources.payloads import decode_cycle
from ..sources.tables import write_dead_letters

SALTS = 16
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def dedup_stream(stream: DataFrame, keys: list[str], ts: str, delay: str, spread: Column | None = None) -> DataFrame:
    """One row per key within the watermark.

    With ``spread`` (something that differs among the copies of a key) copies are
    first removed within 16 parts of each key, so that a key with very many
    copies does not go through one task; at most 16 rows per key reach the second
    step.
    """
    marked = stream.withWatermark(ts, delay)
    if spread is None:
        return marked.dropDuplicatesWithinWatermark(keys)
    part = F.pmod(F.xxhash64(spread), F.lit(SALTS))
    return (
        marked.withColumn("_part", part)
        .dropDuplicatesWithinWatermark([*keys, "_part"])
        .drop("_part")
        .dropDuplicatesWithinWatermark(keys)
    )


def hourly_stream(stream: DataFrame, ts: str, delay: str, measures: dict[str, Column]) -> DataFrame:
    """Tumbling hours per city; late readings within the watermark update their hour."""
    return (
        stream.withWatermark(ts, delay)
        .groupBy("city", F.window(ts, "1 hour"))
        .agg(*[c.alias(n) for n, c in measures.items()])
        .select("city", F.col("window.start").alias("event_ts"), *measures)
    )


def join_streams(air: DataFrame, weather: DataFrame, delay: str) -> DataFrame:
    """Inner join of two hourly streams on city and hour.

    The hour is part of the join key and both sides have a watermark, so the
    state of an hour is dropped once both have passed it.
    """
    left = air.withWatermark("event_ts", delay)
    right = weather.withColumnRenamed("event_ts", "weather_ts").withColumnRenamed("city", "weather_city")
    right = right.withWatermark("weather_ts", delay)
    same = (F.col("city") == F.col("weather_city")) & (F.col("event_ts") == F.col("weather_ts"))
    return left.join(right, same, "inner").drop("weather_city", "weather_ts")


def fallback_streams(primary: DataFrame, secondary: DataFrame, fields: list[str], delay: str) -> DataFrame:
    """``source_fallback`` between two hourly streams: the primary record of a (city, hour), else the secondary.

    Where both records come, in whatever order, the primary is given at once. A record whose partner is missing is given when the watermark, that of the
    slower feed, has reached its hour: until then the partner may still come, and a secondary record given early could not be taken back.
    A record is taken whole, as in the batch form. Records behind the watermark are dropped and counted by the job. Rows without a city
    or hour have no partner and no time to wait for, so they are left out. State holds only the hours within the delay.
    """
    keys = ["city", "event_ts"]

    def side(stream: DataFrame, mark: str) -> DataFrame:
        keyed = stream.where(F.col("city").isNotNull() & F.col("event_ts").isNotNull())
        own = keyed.select(F.col("city").alias(f"{mark}_city"), F.col("event_ts").alias(f"{mark}_ts"), F.struct(*fields).alias(f"{mark}_record"))
        return own.withWatermark(f"{mark}_ts", delay)

    same = (F.col("first_city") == F.col("second_city")) & (F.col("first_ts") == F.col("second_ts"))
    both = side(primary, "first").join(side(secondary, "second"), same, "full_outer")
    is_first, record = F.col("first_record").isNotNull(), F.coalesce("first_record", "second_record")
    return both.select(
        *[F.coalesce(f"first_{short}", f"second_{short}").alias(k) for k, short in zip(keys, ("city", "ts"))],
        F.when(is_first, F.lit("primary")).otherwise(F.lit("secondary")).alias("source"),
        *[record.getField(f).alias(f) for f in fields],
    )


def alert_episodes(stream: DataFrame, ts: str, delay: str, column: str, threshold: float = 151.0, gap: str = "90 minutes") -> DataFrame:
    """One alert per episode of a city: (city, started_at, ended_at, hours, peak, category of the peak).

    Rows at or above the threshold belong together while less than ``gap`` lies between them; a late row within the delay extends an episode
    or joins two. An episode is given once, when the watermark has passed its last row by ``gap``: it cannot grow any more. Rows below the
    threshold advance the watermark, so an episode also ends when a city goes quiet while others report. For a notice
    at the first hour there is ``hazard_alerts``, which works row by row on the same stream.
    """
    # A filter would move below the watermark, and then only high rows would advance it. A session of no length is none.
    length = F.when(F.col(column) >= threshold, F.lit(gap)).otherwise(F.lit("0 seconds"))
    found = stream.withWatermark(ts, delay).groupBy("city", F.session_window(ts, length).alias("_session")).agg(
        F.min(ts).alias("started_at"), F.max(ts).alias("ended_at"), F.count(F.lit(1)).alias("hours"), F.max(column).alias("peak")
    )
    return found.select("city", "started_at", "ended_at", "hours", "peak", aqi_category(F.col("peak")).alias("category"))


class _ChangeRate(StatefulProcessor):
    """Keeps (timestamp, label) of the newest row per city."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._last = handle.getValueState("last", "timestamp long, target_aqi double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values("timestamp", kind="stable")
        state = self._last.get() if self._last.exists() else None
        seen = state[0] if state else None
        late = pdf["timestamp"] <= seen if state else pd.Series(False, index=pdf.index)
        rate = pd.Series(np.nan, index=pdf.index)
        fresh = pdf[~late]
        if len(fresh):
            diff = fresh["target_aqi"].diff()
            if state and state[1] is not None:
                diff.iloc[0] = fresh["target_aqi"].iloc[0] - state[1]
            rate[~late] = diff.fillna(0.0)
            newest = fresh["target_aqi"].iloc[-1]
            self._last.update((int(fresh["timestamp"].iloc[-1]), None if pd.isna(newest) else float(newest)))
        # Pandas has no NULL in a float column; the empty value of a late row becomes one on the way out.
        out = pd.DataFrame({"city": key[0], "timestamp": pdf["timestamp"], "target_aqi": pdf["target_aqi"]})
        out["aqi_change_rate"] = rate
        yield out

    def close(self) -> None:
        pass


def change_rates(stream: DataFrame) -> DataFrame:
    """(city, timestamp, target_aqi, aqi_change_rate) across micro-batches.

    The input holds one row per city and hour, so a micro-batch brings a city few
    rows however many readings are behind them. The rows of a micro-batch
    are taken in time order. A row not newer than what its city has
    already seen gets a NULL rate and leaves the state alone.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return (
        stream.select("city", "timestamp", "target_aqi")
        .groupBy("city")
        .transformWithStateInPandas(
            statefulProcessor=_ChangeRate(),
            outputStructType="city string, timestamp long, target_aqi double, aqi_change_rate double",
            outputMode="Append",
            timeMode="None",
        )
        .withColumn("aqi_change_rate", F.nanvl("aqi_change_rate", F.lit(None).cast("double")))
    )


class _RateInTime(StatefulProcessor):
    """Holds a city's rows until the watermark has passed them, then gives them in the order of their time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._held = handle.getListState("held", "timestamp long, target_aqi double")
        self._last = handle.getValueState("last", "timestamp long, target_aqi double")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        newest = initialState.loc[initialState["timestamp"].idxmax()]
        label = newest["target_aqi"]
        self._last.update((int(newest["timestamp"]), None if pd.isna(label) else float(label)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            labels = [None if pd.isna(y) else float(y) for y in part["target_aqi"]]
            times = part["timestamp"].tolist()
            self._held.appendList(list(zip(times, labels)))
            first = min(times) if first is None else min(first, *times)
        if first is not None:
            self._handle.registerTimer(first)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        held = sorted(self._held.get(), key=lambda r: (r[0], r[1] is not None, r[1] or 0.0)) if self._held.exists() else []
        rest = [tuple(r) for r in held if r[0] > mark]
        ripe = held[: len(held) - len(rest)]
        if not ripe:
            return
        if rest:
            self._held.put(rest)
            self._handle.registerTimer(rest[0][0])
        else:
            self._held.clear()
        out = pd.DataFrame([tuple(r) for r in ripe], columns=["timestamp", "target_aqi"]).astype({"timestamp": "int64", "target_aqi": "float64"})
        state = self._last.get() if self._last.exists() else None
        covered = out["timestamp"] <= state[0] if state else pd.Series(False, index=out.index)
        fresh = out[~covered]
        rate = pd.Series(np.nan, index=out.index)
        if len(fresh):
            diff = fresh["target_aqi"].diff()
            if state and state[1] is not None:
                diff.iloc[0] = fresh["target_aqi"].iloc[0] - state[1]
            rate[~covered] = diff.fillna(0.0)
            newest = fresh["target_aqi"].iloc[-1]
            self._last.update((int(fresh["timestamp"].iloc[-1]), None if pd.isna(newest) else float(newest)))
        out.insert(0, "city", key[0])
        yield out.assign(aqi_change_rate=rate)

    def close(self) -> None:
        pass


def change_rates_in_time(stream: DataFrame, delay: str, history: DataFrame | None = None) -> DataFrame:
    """(city, timestamp, target_aqi, aqi_change_rate) in the order of the rows' own time, however they arrive within ``delay``.

    A row is given when the watermark has passed it: until then an earlier one may still come. So a late row gets its difference, and so does the row
    after it. State holds a city's rows within the delay. ``history`` (city, timestamp, target_aqi; the newest row of each city,
    as ``latest_per_city`` of the stored table) starts the state, so the first live row continues the archive; a row that the archive already covers gets a NULL
    rate and leaves the state alone. Rows without city or timestamp have no place in time and are left out; rows behind the watermark (which starts at 1970) are dropped and counted by the job. Two rows of
    one hour follow each other, the smaller label first. What lies within the delay when the input ends is not given.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    keyed = stream.where(F.col("city").isNotNull() & F.col("timestamp").isNotNull())
    timed = keyed.select("city", "timestamp", F.col("target_aqi").cast("double").alias("target_aqi"), F.timestamp_millis("timestamp").alias("event_ts"))
    start = None
    if history is not None:
        known = history.where(F.col("city").isNotNull() & F.col("timestamp").isNotNull())
        start = known.select("city", "timestamp", F.col("target_aqi").cast("double").alias("target_aqi")).groupBy("city")
    rates = timed.withWatermark("event_ts", delay).groupBy("city").transformWithStateInPandas(
        statefulProcessor=_RateInTime(),
        outputStructType="city string, timestamp long, target_aqi double, aqi_change_rate double",
        outputMode="Append",
        timeMode="EventTime",
        initialState=start,
    )
    # Pandas has no NULL in a float column.
    return rates.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("target_aqi", "aqi_change_rate")})


def _dropped(query) -> int:
    """Rows that came behind the watermark, as the query's progress counts them (its last 100 micro-batches)."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def run_to_table(stream: DataFrame, path: str) -> int:
    """Append a stream's results to Parquet files until all landed input is done; returns the rows dropped as late."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", f"{path}/data")
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return _dropped(query)


def run_updates(stream: DataFrame, path: str) -> int:
    """Append each micro-batch's changed rows under its batch id; ``read_updates`` settles them. Returns the rows dropped as late."""

    def append(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("load_seq", F.lit(batch_id).cast("bigint")).write.mode("append").parquet(f"{path}/data")

    return _run_batches(stream.writeStream.outputMode("update"), append, f"{path}/checkpoint")


def read_updates(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The latest row per key. A batch that ran twice has equal rows, so it counts once."""
    return latest_wins(spark.read.parquet(f"{path}/data"), keys).drop("load_seq")


def run_upsert(stream: DataFrame, table: str, checkpoint: str, first_seq: int = 0) -> None:
    """Append a stream of feature rows to the feature table, later batches winning."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        merge_into_table(batch, table, first_seq + batch_id)

    _run_batches(stream.writeStream, merge, checkpoint)


def run_features(landed: DataFrame, table: str, dead_letters: str, checkpoint: str, first_seq: int = 0) -> None:
    """Raw payloads to the feature table, and what cannot be used to the dead letters."""

    def store(batch: DataFrame, batch_id: int) -> None:
        has_key = F.col("city").isNotNull() & F.col("fetched_at").isNotNull()
        # Parsed once, for the table and for the dead letters.
        decoded = decode_cycle(batch.where(has_key)).persist()
        try:
            vectors, rejects = decoded_vectors(decoded)
            merge_into_table(vectors, table, first_seq + batch_id)
            rejects = rejects.unionByName(batch.where(~has_key).select(*rejects.drop("reject_reason").columns, F.lit("no_key").alias("reject_reason")))
            # At least once: a repeated batch repeats its rejects, told apart by batch_id.
            write_dead_letters(rejects.withColumn("batch_id", F.lit(batch_id)), dead_letters)
        finally:
            decoded.unpersist()

    _run_batches(landed.writeStream, store, checkpoint)


def _run_batches(writer, handle, checkpoint: str) -> int:
    query = (
        writer.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return _dropped(query)
