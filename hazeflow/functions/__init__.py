"""Column expressions. All of them stay inside whole-stage codegen."""

from .aqi import aqi_category, aqi_overall, aqi_subindex, dominant_pollutant
from .calendar import calendar_columns, epoch_millis, event_time
from .missing import finite_or_null, nan_to_null
from .thermal import humidex, humidex_rounded

__all__ = [
    "aqi_category",
    "aqi_overall",
    "aqi_subindex",
    "calendar_columns",
    "dominant_pollutant",
    "epoch_millis",
    "event_time",
    "finite_or_null",
    "humidex",
    "humidex_rounded",
    "nan_to_null",
]
