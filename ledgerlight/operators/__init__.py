from . import (
    agents, alerts, anomaly, budgets, costs, forecast, inventory, jobs, quality, ranks,
    recommend, rootcause, rollups, tags, trends,
)
