"""Ordered operators (fill, difference, as-of) that never put a whole city into one task.

A window over one city would pull all its history into one task, and one city
may hold a third of all rows. Here the unit of work is a (city, chunk) pair, a
chunk being a calendar month or day. Within a chunk an ordinary window does the
work; what must cross chunk borders is one summary row per chunk. The summaries
of a city are few (12 a year for months), so a window over them is cheap. They
return to the rows by an equi-join on (city, chunk), for which the rows are
already in place: each operator shuffles the wide rows once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CHUNK = "_chunk"


def chunk_column(ts: str, grain: str) -> Column:
    return F.date_trunc(grain, F.col(ts))


def _placed(df: DataFrame, keys: list[str], ts: str, grain: str) -> DataFrame:
    """Partition the rows by (keys, chunk) once; summary and windows both use it."""
    return df.withColumn(CHUNK, chunk_column(ts, grain)).repartition(*keys, CHUNK)


def _earlier(keys: list[str]):
    return W.partitionBy(*keys).orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)


def _from_here(keys: list[str]):
    return W.partitionBy(*keys).orderBy(CHUNK).rowsBetween(0, W.unboundedFollowing)


def fill_series(
    df: DataFrame,
    cols: list[str],
    keys: list[str] = ["city"],
    ts: str = "event_ts",
    grain: str = "month",
    backward: bool = True,
    previous: str | None = None,
) -> DataFrame:
    """Forward fill, then backward fill of what is left, over each key's whole history.

    After the forward fill only the head of a series can be missing, so the
    backward fill is the first known value of the key. With ``previous`` naming a
    column of ``cols``, the result also has ``_before_<previous>``: the last known
    value before the row's chunk.
    """
    rows = _placed(df, keys, ts, grain)
    known_at = {c: F.when(F.col(c).isNotNull(), F.col(ts)) for c in cols}
    summary = rows.groupBy(*keys, CHUNK).agg(
        *[F.max_by(c, known_at[c]).alias(f"_last_{c}") for c in cols],
        *[F.min_by(c, known_at[c]).alias(f"_first_{c}") for c in cols if backward],
    )
    carried = summary.select(
        *keys,
        CHUNK,
        *[F.last(f"_last_{c}", ignorenulls=True).over(_earlier(keys)).alias(f"_before_{c}") for c in cols],
        *[F.first(f"_first_{c}", ignorenulls=True).over(_from_here(keys)).alias(f"_next_{c}") for c in cols if backward],
    )
    so_far = W.partitionBy(*keys, CHUNK).orderBy(ts).rowsBetween(W.unboundedPreceding, 0)
    local = rows.withColumns({f"_so_far_{c}": F.last(c, ignorenulls=True).over(so_far) for c in cols})

    def filled(c: str) -> Column:
        sources = [f"_so_far_{c}", f"_before_{c}"] + ([f"_next_{c}"] if backward else [])
        return F.coalesce(*sources).alias(c)

    extra = [CHUNK, f"_before_{previous}"] if previous else []
    return local.join(carried, [*keys, CHUNK], "left").select(
        *[filled(c) if c in cols else F.col(c) for c in df.columns], *extra
    )


def difference_filled(
    filled: DataFrame, col: str, name: str, keys: list[str] = ["city"], ts: str = "event_ts"
) -> DataFrame:
    """First difference of a column that ``fill_series(..., previous=col)`` has filled.

    The rows keep the placement and order of the fill, so this adds no shuffle and
    no sort. The first row of a key has difference 0.0.
    """
    within = W.partitionBy(*keys, CHUNK).orderBy(ts)
    before = F.coalesce(F.lag(col).over(within), F.col(f"_before_{col}"))
    return filled.withColumn(name, F.coalesce(F.col(col) - before, F.lit(0.0))).drop(CHUNK, f"_before_{col}")


def difference(
    df: DataFrame, col: str, name: str, keys: list[str] = ["city"], ts: str = "event_ts", grain: str = "month"
) -> DataFrame:
    """First difference; 0.0 on the first row of a key and wherever either value is missing."""
    rows = _placed(df, keys, ts, grain)
    # A struct is never NULL itself, so "no row before" and "a missing value before" differ.
    summary = rows.groupBy(*keys, CHUNK).agg(F.max_by(F.struct(col), F.col(ts)).alias("_last"))
    carried = summary.select(
        *keys, CHUNK, F.lag("_last").over(W.partitionBy(*keys).orderBy(CHUNK)).alias("_last_before")
    )
    within = W.partitionBy(*keys, CHUNK).orderBy(ts)
    local = rows.withColumn("_prev", F.lag(F.struct(col)).over(within))
    before = F.coalesce("_prev", "_last_before").getField(col)
    return local.join(carried, [*keys, CHUNK], "left").select(
        *df.columns, F.coalesce(F.col(col) - before, F.lit(0.0)).alias(name)
    )


def carry_before(
    df: DataFrame, col: str, keys: list[str], ts: str, tie: str, grain: str = "day"
) -> DataFrame:
    """Replace ``col`` by its last non-NULL value at or before each row, ordered by (ts, tie)."""
    rows = _placed(df, keys, ts, grain)
    order = F.when(F.col(col).isNotNull(), F.struct(ts, tie))
    summary = rows.groupBy(*keys, CHUNK).agg(F.max_by(col, order).alias("_last"))
    carried = summary.select(
        *keys, CHUNK, F.last("_last", ignorenulls=True).over(_earlier(keys)).alias("_before")
    )
    so_far = W.partitionBy(*keys, CHUNK).orderBy(ts, tie).rowsBetween(W.unboundedPreceding, 0)
    local = rows.withColumn("_so_far", F.last(col, ignorenulls=True).over(so_far))
    return local.join(carried, [*keys, CHUNK], "left").select(
        *[F.coalesce("_so_far", "_before").alias(c) if c == col else F.col(c) for c in df.columns]
    )
