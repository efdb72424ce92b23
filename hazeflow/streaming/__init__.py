"""The live path as Structured Streaming jobs."""

from .jobs import (
    alert_episodes,
    change_rates,
    change_rates_in_time,
    dedup_stream,
    fallback_streams,
    hourly_stream,
    join_streams,
    read_updates,
    run_features,
    run_to_table,
    run_updates,
    run_upsert,
)

__all__ = [
    "alert_episodes",
    "change_rates",
    "change_rates_in_time",
    "dedup_stream",
    "fallback_streams",
    "hourly_stream",
    "join_streams",
    "read_updates",
    "run_features",
    "run_to_table",
    "run_updates",
    "run_upsert",
]
