"""The feature table: keyed, partitioned by month, append-only, the latest load wins.

A load is one commit: its rows are written to a folder of their own, and only then is the
commit named in the table's log, one row per commit. What is not named is never read, so a write
that fails half-way leaves the table as it was. Readers take the rows of all named
commits and keep the latest of each key. ``compact`` writes the latest rows of some
months as a new commit that replaces the older ones in these months; nothing is overwritten. The log says which
months a commit holds: when all are replaced, its folder is neither listed nor read any more.

Every commit is a version that can be read again: ``read_store(..., as_of=commit)``. ``retain`` gives up the versions before
a commit, and ``vacuum`` then removes the folders that only these needed and folds the log into one file.
"""

from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import FEATURE_COLS, FEATURE_SCHEMA, KEY_COLS, SCALE_INDEX_500

LOAD_SEQ = "load_seq"
PARTITION = "year_month"

#: What a stored row says of its label, besides the feature columns.
ORIGIN = {"label_scale": SCALE_INDEX_500, "source": "history"}

STORE_SCHEMA = T.StructType(
    [
        *FEATURE_SCHEMA.fields,
        *[T.StructField(c, T.StringType()) for c in ORIGIN],
        T.StructField(LOAD_SEQ, T.LongType()),
        T.StructField(PARTITION, T.StringType()),
    ]
)
COMMIT = "commit"
#: ``at`` orders the commits (microseconds, made larger than all seen); ``oldest`` is the first ``at`` still readable, ``drops`` the commits given up.
LOG_SCHEMA = "commit string, replaces array<string>, months array<string>, holds array<string>, at bigint, oldest bigint, drops array<string>"
MAX_RECORDS_PER_FILE = 5_000_000
#: Files a commit writes per month at most.
FILES_PER_MONTH = 16


def latest_wins(df: DataFrame, keys: list[str] = KEY_COLS, seq: str = LOAD_SEQ) -> DataFrame:
    """One row per key: that of the highest load; equal loads are settled by the values.

    A maximum of structs instead of a ranking window: copies combine before the
    shuffle, so a key with very many copies never piles up in one task.
    """
    rest = [c for c in df.columns if c not in {*keys, seq}]
    best = F.max(F.struct(seq, *rest)).alias("_best")
    return df.groupBy(*keys).agg(best).select(
        *[F.col(c) if c in keys else F.col(f"_best.{c}").alias(c) for c in df.columns]
    )


def upsert(base: DataFrame, *loads: DataFrame) -> DataFrame:
    """Union of all loads by column name, reduced to the latest row per key."""
    merged = base
    for load in loads:
        merged = merged.unionByName(load)
    return latest_wins(merged)


def latest_per_city(features: DataFrame) -> DataFrame:
    """The newest feature row of each city, for key lookups."""
    rest = [c for c in features.columns if c not in {"city", "timestamp"}]
    newest = F.max(F.struct("timestamp", *rest)).alias("_newest")
    return features.groupBy("city").agg(newest).select("city", "_newest.timestamp", *[f"_newest.{c}" for c in rest])


def month_of(timestamp: str) -> Column:
    return F.date_format(F.timestamp_millis(timestamp), "yyyy-MM")


def _month(df: DataFrame) -> DataFrame:
    return df.withColumn(PARTITION, month_of("timestamp"))


def _log(spark: SparkSession, path: str) -> list:
    """The table's commits, oldest first: one row per load, compaction and retention that ``vacuum`` has not folded."""
    try:
        rows = spark.read.schema(LOG_SCHEMA).parquet(f"{path}/log").collect()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return []
        raise
    # While a log is folded an entry can stand in two files.
    return sorted({r.commit: r for r in rows}.values(), key=lambda r: (r.at or 0, r.commit))


def _name(spark: SparkSession, path: str, commit: str, replaces=(), months=(), holds=(), oldest=None, drops=()) -> None:
    """Append an entry to the log, later than all that are there."""
    at = max([time.time_ns() // 1000, *[(e.at or 0) + 1 for e in _log(spark, path)]])
    entry = spark.createDataFrame([(commit, list(replaces), list(months), list(holds), at, oldest, list(drops))], LOG_SCHEMA)
    entry.coalesce(1).write.mode("append").parquet(f"{path}/log")


def _commit(df: DataFrame, path: str, replaces: list[str], months: list[str]) -> str:
    """Write rows, clustered by month and city, then name them in the log; returns the commit."""
    spark, name = df.sparkSession, uuid.uuid4().hex
    part = F.pmod(F.xxhash64("city"), F.lit(FILES_PER_MONTH))
    (
        df.select(*STORE_SCHEMA.names)
        .repartition(PARTITION, part)
        .write.option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
        .partitionBy(PARTITION)
        .parquet(f"{path}/data/{COMMIT}={name}")
    )
    written = spark.read.schema(STORE_SCHEMA).parquet(f"{path}/data/{COMMIT}={name}")
    holds = sorted(r[0] for r in written.select(PARTITION).distinct().collect())
    _name(spark, path, name, replaces, months, holds)
    return name


def live_commits(log: list) -> list:
    """The commits that readers need: those with a month that no compaction has replaced."""
    replaced: dict[str, set] = {}
    for c in log:
        for name in c.replaces:
            replaced.setdefault(name, set()).update(c.months)
    return [e for e in log if e.holds is None or set(e.holds) - replaced.get(e.commit, set())]


def _until(log: list, as_of: str | None) -> list:
    """The entries of the version ``as_of``; ValueError if there is none such, or not any more."""
    if as_of is None:
        return log
    at = next((e.at or 0 for e in log if e.commit == as_of), None)
    if at is None or at < max([e.oldest or 0 for e in log]):
        raise ValueError(f"version {as_of} is not kept")
    return [e for e in log if (e.at or 0) <= at]


def versions(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(commit, microseconds since 1970) of the versions that can be read, oldest first."""
    log = _log(spark, path)
    oldest = max([e.oldest or 0 for e in log], default=0)
    return [(e.commit, e.at or 0) for e in log if (e.at or 0) >= oldest and not e.drops and e.oldest is None]


def read_store(
    spark: SparkSession, path: str, months: list[str] | None = None, columns: list[str] | None = None, as_of: str | None = None
) -> DataFrame:
    """The latest row of each key, with label_scale, source and load_seq; of the given months, or all.

    With ``columns``, only these and the key are read. A commit holds one row per key, so a
    choice between equal loads can only be one between repeats of a load. With ``as_of``, a commit that a load or compaction
    has returned, the table is read as it was right after that commit.
    """
    log = _until(_log(spark, path), as_of)
    live = live_commits(log)
    kept = STORE_SCHEMA.names if columns is None else list(dict.fromkeys([*KEY_COLS, *columns, LOAD_SEQ, PARTITION]))
    if not live:
        return spark.createDataFrame([], STORE_SCHEMA).select(*kept)
    schema = T.StructType([*STORE_SCHEMA.fields, T.StructField(COMMIT, T.StringType())])
    reader = spark.read.schema(schema).option("basePath", f"{path}/data").option("ignoreMissingFiles", "false")
    rows = reader.parquet(*[f"{path}/data/{COMMIT}={e.commit}" for e in live])
    names = {e.commit for e in live}
    for e in log:
        if still := [c for c in e.replaces if c in names]:
            rows = rows.where(~(F.col(COMMIT).isin(still) & F.col(PARTITION).isin(e.months)))
    if months is not None:
        rows = rows.where(F.col(PARTITION).isin(months))
    return latest_wins(rows.select(*kept))


def merge_into_table(df: DataFrame, path: str, load_seq: int) -> str:
    """Append a load of feature rows to the table at ``path``; creates it if absent. Returns the commit.

    Nothing stored is read or rewritten. Running the same load again changes no
    result. Rows without a city or timestamp have no key and are left out: see ``keyless``.
    Rows that do not say their label's scale and source are history on the archive scale.
    """
    origin = [F.col(c) if c in df.columns else F.lit(v).alias(c) for c, v in ORIGIN.items()]
    load = df.where(F.col("city").isNotNull() & F.col("timestamp").isNotNull())
    rows = _month(load.select(*FEATURE_COLS, *origin).withColumn(LOAD_SEQ, F.lit(load_seq).cast("bigint")))
    return _commit(latest_wins(rows), path, [], [])


def keyless(df: DataFrame) -> DataFrame:
    """Rows that a load leaves out, for the dead letters."""
    return df.where(F.col("city").isNull() | F.col("timestamp").isNull()).withColumn("reject_reason", F.lit("no_key"))


def compact(spark: SparkSession, path: str, months: list[str]) -> str | None:
    """Bring the given months down to one row per key, as one new commit, which is returned.

    Loads that are committed meanwhile are not replaced, and stay. The old files
    are left for ``retain`` and ``vacuum``, as readers may still be using them.
    """
    log = _log(spark, path)
    if not (log and months):
        return None
    # Of the version seen: what is loaded meanwhile must not be in what replaces it.
    return _commit(read_store(spark, path, months, as_of=log[-1].commit), path, [e.commit for e in log], months)


def retain(spark: SparkSession, path: str, oldest: str) -> list[str]:
    """Give up all versions before the commit ``oldest``; returns the commits that no kept version needs.

    Nothing is removed yet: that is for ``vacuum``, once the readers of the versions given up have ended.
    """
    seen = _until(_log(spark, path), oldest)
    live = {e.commit for e in live_commits(seen)}
    drops = [e.commit for e in seen if e.commit not in live and e.holds]
    _name(spark, path, uuid.uuid4().hex, oldest=seen[-1].at or 0, drops=drops)
    return drops


def vacuum(spark: SparkSession, path: str) -> None:
    """Remove the folders of the commits given up, and fold the log into one file.

    The folded log is written before the old entries go, and entries are told apart by their commit, so a run that
    ends half-way can be repeated. Commits made meanwhile are not touched. A reader that has just listed the log may find an entry
    gone and has to read again.
    """
    log_path = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/log")
    fs = log_path.getFileSystem(spark._jsc.hadoopConfiguration())
    old = [f.getPath() for f in fs.listStatus(log_path) if f.getPath().getName().endswith(".parquet")]
    log = _log(spark, path)
    dropped = {name for e in log for name in e.drops or []}
    for name in dropped:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/data/{COMMIT}={name}"), True)
    kept = [e for e in log if e.commit not in dropped]
    names = {e.commit for e in kept}
    oldest = max([e.oldest or 0 for e in log], default=0)
    marks = {max((e for e in kept if e.oldest is not None), key=lambda e: e.oldest).commit} if oldest else set()
    rows = [
        (e.commit, [c for c in e.replaces if c in names], e.months, e.holds, e.at, e.oldest, [])
        for e in kept
        if e.oldest is None or e.commit in marks
    ]
    if rows:
        spark.createDataFrame(rows, LOG_SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/log")
        for file in old:
            fs.delete(file, False)


def save_online(features: DataFrame, path: str, load_seq: int = 0) -> None:
    """Add the newest row of each city to the online copy at ``path``: a table of its own, one key per city.

    Of two loads of the same hour the one with the larger ``load_seq`` holds, as in the table itself.
    """
    newest = latest_per_city(features)
    merge_into_table(newest, path, load_seq)


def read_online(spark: SparkSession, path: str, cities: list[str] | None = None) -> DataFrame:
    """The newest row of each city (or of the given ones) that any load has brought."""
    rows = read_store(spark, path)
    if cities is not None:
        rows = rows.where(F.col("city").isin(cities))
    return latest_per_city(rows.select(*FEATURE_COLS))


def save_vectors(df: DataFrame | None, path: str, load_seq: int) -> bool:
    """Store live vectors; False if there is nothing to store.

    A failing write raises: a stream has to see it, so that the batch runs again.
    """
    if df is None or df.isEmpty():
        return False
    merge_into_table(df, path, load_seq)
    return True
