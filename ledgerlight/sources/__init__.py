from .feed import (
    cost_feed_daily, cost_feed_monthly, daily_plus_monthly, feed_lines, read_cost_feed,
    to_daily_records, usage_cells, usage_to_cost_rollup,
)
from .tables import (
    active_budgets, list_accounts, list_alerts, list_budgets, scan_cost_records, scan_inventory,
    scoped,
)
