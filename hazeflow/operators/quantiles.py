"""Exact quantiles of many columns without gathering or shuffling whole columns.

Each round reads the columns, cuts the range still in question by approximate
quantiles and counts per cut, which combines before the shuffle. The counts are exact,
so they tell for certain between which two values a wanted rank lies. A round leaves
about one distinct value in 2**levels; only what the last round leaves is
ordered. There are as many rounds as leave about ``ORDERED_VALUES`` or fewer in an ordered
group, whatever the number of rows; the result does not depend on them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import nan_to_null

CUT_LEVELS = 7
ORDERED_VALUES = 1_000_000


def long_values(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, value) of the present values."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), nan_to_null(F.col(c)).alias("value")) for c in cols]))
    return df.select(pairs.alias("p")).select("p.column", "p.value").where(F.col("value").isNotNull())


def _bin(df: DataFrame, levels: int) -> DataFrame:
    """Add ``bin``: how many of the 2**levels - 1 sorted edges are below the value (binary search)."""
    df = df.withColumn("bin", F.lit(0))
    for level in reversed(range(levels)):
        step = 1 << level
        above = F.get("edges", F.col("bin") + F.lit(step - 1)) < F.col("value")
        df = df.withColumn("bin", F.col("bin") + F.when(above, F.lit(step)).otherwise(F.lit(0)))
    return df


def _edges(values: DataFrame, keys: list[str], levels: int) -> DataFrame:
    cuts = 1 << levels
    grid = [i / cuts for i in range(1, cuts)]
    return values.groupBy(*keys).agg(
        F.percentile_approx("value", grid, 20 * cuts).alias("edges"), F.count("value").alias("n")
    )


def _narrow(values: DataFrame, edges: DataFrame, keys: list[str], asked: DataFrame, levels: int) -> DataFrame:
    """For each asked rank: a narrower range (low, high] that holds it and the number of values up to low.

    A null ``low`` is an open end, so that a range can begin with minus infinity.

    ``values`` are those above the ``low`` asked with, and ``below`` counts the others. ``edges`` and ``asked`` have a row per column and probability at most.
    """
    per_bin = (
        _bin(values.join(F.broadcast(edges), keys), levels)
        .groupBy(*keys, "bin")
        .agg(F.count("value").alias("c"), F.max("value").alias("top"))
    )
    in_order = W.partitionBy(*keys).orderBy("bin")
    placed = per_bin.select(
        *keys, "top", "c", (F.sum("c").over(in_order) - F.col("c")).alias("before"), F.lag("top").over(in_order).alias("prev")
    )
    start = F.col("below") + F.col("before")

    def holds(rank):
        return (F.col(rank) >= start) & (F.col(rank) < start + F.col("c"))

    return (
        placed.join(F.broadcast(asked), keys)
        .groupBy("column", "p", "rank", "next_rank", "fraction")
        .agg(
            F.max(F.when(holds("rank"), F.coalesce("prev", "low"))).alias("low"),
            F.max(F.when(holds("next_rank"), F.col("top"))).alias("high"),
            F.max(F.when(holds("rank"), start)).alias("below"),
        )
    )


def exact_quantiles(
    df: DataFrame, cols: list[str], probs: list[float], levels: int = CUT_LEVELS, rounds: int | None = None
) -> DataFrame:
    """(column, p, value) with linear interpolation; no row for a column without values.

    ``df`` should be a stored table: it is read twice per round and once more.
    """
    if rounds is None:
        rounds, left = 1, df.count() >> levels
        while left > ORDERED_VALUES:
            rounds, left = rounds + 1, left >> levels
    values = long_values(df, cols)
    edges = _edges(values, ["column"], levels)
    position = F.col("p") * (F.col("n") - 1)
    asked = edges.select("column", "n", F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("p")).select(
        "column",
        "p",
        F.floor(position).alias("rank"),
        F.ceil(position).alias("next_rank"),
        (position - F.floor(position)).alias("fraction"),
        F.lit(0).cast("bigint").alias("below"),
        F.lit(None).cast("double").alias("low"),
    )
    ranges = _narrow(values, edges.drop("n"), ["column"], asked, levels)
    for _ in range(rounds - 1):
        left = _left_in(values, ranges)
        keys = ["column", "p"]
        ranges = _narrow(left, _edges(left, keys, levels).drop("n"), keys, ranges.drop("high"), levels)

    counted = _left_in(values, ranges).groupBy("column", "p", "value").agg(F.count("value").alias("c"))
    through = F.sum("c").over(W.partitionBy("column", "p").orderBy("value")) + F.col("below")
    ordered = counted.join(F.broadcast(ranges), ["column", "p"]).withColumn("through", through)

    def at(rank):
        return F.max(F.when((F.col(rank) < F.col("through")) & (F.col(rank) >= F.col("through") - F.col("c")), F.col("value")))

    return (
        ordered.groupBy("column", "p", "fraction")
        .agg(at("rank").alias("a"), at("next_rank").alias("b"))
        # Between equal values nothing is interpolated: the difference of infinities is no number.
        .select("column", "p", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * F.col("fraction")).alias("value"))
    )


def _left_in(values: DataFrame, ranges: DataFrame) -> DataFrame:
    inside = values.join(F.broadcast(ranges.select("column", "p", "low", "high")), "column")
    return inside.where((F.col("low").isNull() | (F.col("value") > F.col("low"))) & (F.col("value") <= F.col("high"))).select("column", "p", "value")


def approx_quantiles(df: DataFrame, cols: list[str], probs: list[float], accuracy: int = 10000) -> DataFrame:
    """(column, p, value) within rank error 1/accuracy, without interpolation, in one pass."""
    stats = df.agg(*[F.percentile_approx(nan_to_null(F.col(c)), probs, accuracy).alias(c) for c in cols])
    per_column = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("q")) for c in cols]))
    return (
        stats.select(per_column.alias("s"))
        .select("s.column", F.posexplode("s.q").alias("i", "value"))
        .select("column", F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("i") + 1).alias("p"), "value")
    )
