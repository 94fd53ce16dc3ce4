from .alerts import alert_changes, alert_dedup_append
from .store import append_table, carried, carry, earlier_batches, json_export, materialise, run_dir, shared_dir, write_cost_table
from .tables import agent_runs_table, anomalies_table, forecasts_table, recommendations_table
from .upsert import changed_rows, compact_log, merge_on_read, upsert_cost_records, write_delta
from .views import update_view_cells, view_cells
