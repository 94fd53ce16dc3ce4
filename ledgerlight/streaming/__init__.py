from .streams import (
    hourly_spikes, latest_updates, run_available, run_updates, stream_alert_changes, stream_alert_dedup,
    stream_change_sessions, stream_daily_final, stream_daily_spend, stream_hourly_spend, stream_spikes, stream_upsert_cost,
)
