"""Air quality index from pollutant concentrations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import BREAKPOINT_SCALE, BREAKPOINTS
from .missing import nan_to_null

# Index categories by their upper index (closed).
CATEGORIES = [
    (50.0, "good"),
    (100.0, "moderate"),
    (150.0, "unhealthy_for_sensitive_groups"),
    (200.0, "unhealthy"),
    (300.0, "very_unhealthy"),
]
TOP_CATEGORY = "hazardous"


def interpolate(v: Column, c_low: Column, c_high: Column, i_low: Column, i_high: Column) -> Column:
    return i_low + (i_high - i_low) * ((v - c_low) / (c_high - c_low))


def aqi_subindex(concentration: Column, pollutant: str, gap_policy: str = "null") -> Column:
    """Linear interpolation within the breakpoint range that holds the value.

    Ranges are closed and do not touch. With ``gap_policy="null"`` a value between
    two ranges has no index; ``"truncate"`` first cuts it to the resolution the
    ranges are given in, so that it falls into the lower one.
    """
    if gap_policy not in {"null", "truncate"}:
        raise ValueError(f"unknown gap_policy: {gap_policy}")
    v = nan_to_null(concentration)
    if gap_policy == "truncate":
        step = F.lit(float(10 ** BREAKPOINT_SCALE[pollutant]))
        v = F.floor(F.round(v * step, 6)).cast("double") / step
    index = F.lit(None).cast("double")
    for c_low, c_high, i_low, i_high in reversed(BREAKPOINTS[pollutant]):
        inside = interpolate(v, F.lit(c_low), F.lit(c_high), F.lit(float(i_low)), F.lit(float(i_high)))
        index = F.when(v.between(c_low, c_high), inside).otherwise(index)
    return index


def aqi_overall(
    pm25: Column | None = None, pm10: Column | None = None, gap_policy: str = "null"
) -> Column:
    """The larger of the sub-indices that exist; NULL if there is none."""
    given = [(c, p) for c, p in ((pm25, "pm25"), (pm10, "pm10")) if c is not None]
    if not given:
        return F.lit(None).cast("double")
    parts = [aqi_subindex(c, p, gap_policy) for c, p in given]
    return parts[0] if len(parts) == 1 else F.greatest(*parts)


def dominant_pollutant(sub25: Column, sub10: Column) -> Column:
    """Which sub-index sets the overall one; pm25 on a tie, NULL if there is none."""
    return F.when(sub25.isNotNull() & (sub10.isNull() | (sub25 >= sub10)), F.lit("pm25")).when(
        sub10.isNotNull(), F.lit("pm10")
    )


def aqi_category(aqi: Column) -> Column:
    label = F.lit(TOP_CATEGORY)
    for upper, name in reversed(CATEGORIES):
        label = F.when(aqi <= upper, F.lit(name)).otherwise(label)
    return F.when(aqi.isNotNull(), label)
