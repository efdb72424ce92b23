"""Scans of landed payloads and of the feature table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.store import read_store
from ..schema import FEATURE_COLS, LANDED_SCHEMA


def read_landed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LANDED_SCHEMA).json(path)


def read_landed_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(LANDED_SCHEMA)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(path)


def date_range(df: DataFrame, start: str, end: str, city: str | None = None, ts: str = "event_ts") -> DataFrame:
    """Rows from the start of day ``start`` to the end of day ``end``.

    Plain comparisons with literals of the column's own type, so the scan can use
    them; where ``year_month`` partitions the table, so does the partition filter.
    """
    first = dt.date.fromisoformat(start)
    stop = dt.date.fromisoformat(end) + dt.timedelta(days=1)
    kind = df.schema[ts].dataType.simpleString()
    keep = (F.col(ts) >= F.lit(str(first)).cast(kind)) & (F.col(ts) < F.lit(str(stop)).cast(kind))
    if city is not None:
        keep = keep & (F.col("city") == city)
    if "year_month" in df.columns:
        keep = keep & F.col("year_month").between(first.strftime("%Y-%m"), end[:7])
    return df.where(keep)


def feature_scan(
    spark: SparkSession, path: str, columns: list[str] | None = None, label_scale: str | None = None, months: list[str] | None = None,
    as_of: str | None = None,
) -> DataFrame:
    """The stored feature table, as of a commit if one is given; only the named columns (and the key) are read.

    Training and alerts name the ``label_scale`` they are meant for: the table may hold both.
    """
    wanted = columns or FEATURE_COLS
    rows = read_store(spark, path, months, [*wanted, "label_scale"] if label_scale else wanted, as_of)
    if label_scale is not None:
        rows = rows.where(F.col("label_scale") == label_scale)
    return rows.select(*wanted)


def write_dead_letters(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)
