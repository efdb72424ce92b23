"""The same expressions under SQL names, as SQL functions (no Python in the plan)."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..schema import BREAKPOINTS

_HUMIDEX = (
    "t + (5.0D / 9.0D) * (6.11D * pow(10.0D, try_divide(7.5D * t, 237.7D + t)) * (h / 100.0D) - 10.0D)"
)


def _subindex_sql(pollutant: str, v: str) -> str:
    arms = " ".join(
        f"WHEN {v} BETWEEN {lo}D AND {hi}D"
        f" THEN {ilo}D + ({ihi}D - {ilo}D) * (({v} - {lo}D) / ({hi}D - {lo}D))"
        for lo, hi, ilo, ihi in BREAKPOINTS[pollutant]
    )
    return f"CASE {arms} END"


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Create humidex, aqi_pm25, aqi_pm10 and aqi_overall for this session."""
    bodies = {
        "humidex(t DOUBLE, h DOUBLE)": _HUMIDEX,
        "aqi_pm25(v DOUBLE)": _subindex_sql("pm25", "v"),
        "aqi_pm10(v DOUBLE)": _subindex_sql("pm10", "v"),
        "aqi_overall(pm25 DOUBLE, pm10 DOUBLE)": (
            f"greatest({_subindex_sql('pm25', 'pm25')}, {_subindex_sql('pm10', 'pm10')})"
        ),
    }
    for signature, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS DOUBLE RETURN {body}")
    return [s.split("(")[0] for s in bodies]
