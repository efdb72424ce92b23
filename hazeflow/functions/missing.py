"""One notion of "missing": NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def nan_to_null(c: Column) -> Column:
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def finite_or_null(c: Column) -> Column:
    """NULL for NaN and for both infinities."""
    return F.when(F.abs(c) < F.lit(float("inf")), c)


def normalize_missing(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in every floating-point column; run once at ingest."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: nan_to_null(F.col(c)) for c in floats}) if floats else df


def is_missing(df: DataFrame, name: str) -> Column:
    """NULL, or NaN where the type has it."""
    c = F.col(name)
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()
