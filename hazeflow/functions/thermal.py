"""Perceived heat."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .missing import finite_or_null


def vapour_pressure(temp_c: Column, humidity: Column) -> Column:
    """Water vapour pressure in hPa; NULL at the pole of the formula (-237.7 degrees)."""
    exponent = F.try_divide(temp_c * F.lit(7.5), temp_c + F.lit(237.7))
    return F.lit(6.11) * F.pow(F.lit(10.0), exponent) * (humidity / F.lit(100.0))


def humidex(temp_c: Column, humidity: Column) -> Column:
    """Canadian humidex, unrounded; NULL if either input is NULL."""
    t, h = temp_c.cast("double"), humidity.cast("double")
    return t + F.lit(5.0 / 9.0) * (vapour_pressure(t, h) - F.lit(10.0))


def humidex_rounded(temp_c: Column, humidity: Column) -> Column:
    """Live form: two decimals, and NULL where the arithmetic overflows."""
    return F.round(finite_or_null(humidex(temp_c, humidity)), 2)
