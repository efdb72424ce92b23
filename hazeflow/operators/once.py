"""Keep an expensive column from being computed again by what uses it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compute_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add the given columns so that later filters and projections cannot repeat their computation.

    A filter is pushed below a projection together with a copy of the expression
    it uses, and projections are merged. Neither happens across an explode, and
    exploding one element changes nothing else.
    """
    one = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_once")
    return df.select(*df.columns, one).select(*df.columns, "_once.*")
