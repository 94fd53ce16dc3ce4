"""Reads of one tenant or account, tiny charges, and the fact table that syncs leave."""

from ..functions.dates import days_before
from ..operators import anomaly as A
from ..operators import budgets as B
from ..operators import costs as C
from ..operators import inventory as I
from ..operators import quality as Q
from ..schemas import COST, DOMAINS
from ..sinks import run_dir, write_cost_table
from ..sources import feed, sample, tables
from ..sources.sample import AS_OF, EVENTS_AS_OF, PRIOR_AS_OF
from .budget_plans import ALERT, ALERTS_SQL, BUDGET, stamp, status_sql, stored_alerts
from .ingest_plans import RECORD, RECORD_SQL
from .registry import CATALOG, query
from .sync import run_ingestion, stored_sync, sync_tables
from .views import D, P

TENANT, ACCOUNT = sample.TENANTS[1], sample.ACCOUNTS[5]
OF_TENANT = f"tenant_id = '{TENANT}'"
OF_ACCOUNT = f"{OF_TENANT} AND aws_account_id = '{ACCOUNT}'"


def of_tenant(name):
    return f"SELECT * FROM ({CATALOG[name].sql}) AS everyone WHERE {OF_TENANT}"


@query("scan_cost_records_one_account", f"SELECT {RECORD_SQL} FROM cost_records WHERE {OF_ACCOUNT} AND date >= {D} - 60 AND date < {D}")
def scan_cost_records_one_account(spark, sf):
    rows = tables.scan_cost_records(sample.cost_records(spark, sf), TENANT, ACCOUNT, "DAILY", days_before(AS_OF, 60), AS_OF)
    return rows.select(*RECORD)


@query("cost_summary_one_tenant", of_tenant("cost_summary"))
def cost_summary_one_tenant(spark, sf):
    return C.cost_summary(sample.cost_records(spark, sf), AS_OF, tenant_id=TENANT)


@query("daily_costs_one_tenant", of_tenant("daily_costs"))
def daily_costs_one_tenant(spark, sf):
    return C.daily_costs(sample.cost_records(spark, sf), AS_OF, tenant_id=TENANT)


@query("budget_status_one_tenant", of_tenant("budget_status"))
def budget_status_one_tenant(spark, sf):
    costs = sample.cost_records(spark, sf)
    return B.budget_status(costs, sample.budgets(spark, sf, costs), AS_OF, "account", sample.accounts(spark, sf), tenant_id=TENANT)


@query("active_budgets_one_account", f"SELECT {', '.join(BUDGET)} FROM budgets WHERE is_active AND {OF_TENANT} AND (aws_account_id IS NULL OR aws_account_id = '{ACCOUNT}')")
def active_budgets_one_account(spark, sf):
    return tables.active_budgets(sample.budgets(spark, sf), TENANT, ACCOUNT).select(*BUDGET)


@query(
    "list_alerts_firing",
    f"SELECT {', '.join(ALERT)} FROM stored_alerts WHERE state = 'firing' AND {OF_TENANT} ORDER BY triggered_at DESC, id LIMIT 50",
)
def list_alerts_firing(spark, sf):
    return tables.list_alerts(stored_alerts(spark, sf), TENANT, "firing").select(*ALERT)


MILLIONTH = "cast(cast((cast(sum(cost_usd) * 1000000 AS HUGEINT) + 500000) // 1000000 AS DECIMAL(18,0)) * 0.000001 AS DECIMAL(18,6))"


@query(
    "usage_micro_charges",
    f"""SELECT tenant_id, aws_account_id, date, service, raw_region, {MILLIONTH} AS from_doubles, {MILLIONTH} AS from_decimals
FROM usage_lines WHERE record_type NOT IN ('Credit', 'Refund') GROUP BY ALL""",
)
def usage_micro_charges(spark, sf):
    """Lines a million times smaller, such as charges per request: no digit is lost before the sum."""
    lines = sample.usage_lines(spark, sf).selectExpr(
        *feed.FEED_KEY, "record_type", "cost_usd / 1000000 AS cost_usd",
        "cast(cost_usd AS decimal(18,6)) * cast('0.000001' AS decimal(7,6)) AS usage_quantity",
    )
    return feed.usage_cells(lines).selectExpr(
        *feed.FEED_KEY, f"cast(cost_usd AS {COST}) AS from_doubles", f"cast(usage_quantity AS {COST}) AS from_decimals"
    )


STORED = "id, date, granularity, cost_usd, usage_quantity"


@query("sync_fact_table", f"SELECT {STORED} FROM cost_records WHERE date < {D} UNION ALL SELECT {STORED} FROM monthly_records")
def sync_fact_table(spark, sf):
    """The stored table after a sync of a week ago and one of today, which ran twice."""
    folder = run_dir(spark, "sync")
    facts, found = f"{folder}/cost_records", f"{folder}/alerts"
    costs = sample.cost_records(spark, sf)
    write_cost_table(costs.where(f"date < DATE'{PRIOR_AS_OF}'"), facts)
    lines, owners, limits = sample.usage_lines(spark, sf), sample.accounts(spark, sf), sample.budgets(spark, sf, costs)
    for batch, day in enumerate((PRIOR_AS_OF, AS_OF, AS_OF)):
        now = run_ingestion(lines, owners, limits, spark.read.parquet(facts), stored_alerts(spark, sf), day, stamp(day))
        stored_sync(now, facts, found, min(batch, 1))
    return spark.read.parquet(facts).select(*STORED.split(", "))


def synced_tables(spark, sf):
    """A sync of a week ago and one of today, which ran twice, into a folder of their own."""
    folder = run_dir(spark, "sync")
    costs = sample.cost_records(spark, sf)
    write_cost_table(costs.where(f"date < DATE'{PRIOR_AS_OF}'"), f"{folder}/cost_records")
    lines, owners, limits = sample.usage_lines(spark, sf), sample.accounts(spark, sf), sample.budgets(spark, sf, costs)
    for batch, day in ((0, PRIOR_AS_OF), (1, AS_OF), (1, AS_OF)):
        sync_tables(spark, lines, owners, limits, folder, batch, day, stamp(day))
    return folder


EVENTS_NOW = f"""SELECT tenant_id, budget_id, aws_account_id, severity, current_usd AS current_value, limit_usd AS threshold_value,
  cast(percent_used AS DECIMAL(18,1)) AS percent_used, row_number() OVER (PARTITION BY tenant_id, budget_id ORDER BY evaluated_account) AS rn FROM """
SYNCED = "tenant_id, budget_id, aws_account_id, severity, current_value, threshold_value, percent_used, triggered_at"


@query(
    "sync_alerts",
    f"""WITH w AS (SELECT *, cast({P} AS TIMESTAMP) AS triggered_at FROM ({EVENTS_NOW} ({status_sql("SELECT * FROM account_status_prior")}) WHERE firing) WHERE rn = 1),
n AS (SELECT *, cast({D} AS TIMESTAMP) AS triggered_at FROM ({EVENTS_NOW} ({ALERTS_SQL})) WHERE rn = 1)
SELECT {SYNCED} FROM w UNION ALL SELECT {SYNCED} FROM n WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.tenant_id = n.tenant_id AND w.budget_id = n.budget_id)""",
)
def sync_alerts(spark, sf):
    """The stored alerts: one firing per budget over both syncs, none lost by the repetition."""
    return spark.read.parquet(f"{synced_tables(spark, sf)}/alerts").select(*SYNCED.split(", "))


def outside(source, name, column, domain):
    allowed = ", ".join(f"'{v}'" for v in DOMAINS[domain])
    return f"SELECT '{name}.{column}' AS check_name, count(*) FILTER (WHERE {column} IS NULL OR {column} NOT IN ({allowed})) AS violations FROM ({source}) AS t"


CHECKED = {
    "cost_records": ("SELECT * FROM cost_records", {"granularity": "granularity", "service_group": "service_group"}),
    "budgets": ("SELECT * FROM budgets", {"period": "budget_period"}),
    "alerts": ("SELECT * FROM stored_alerts", {"severity": "severity", "state": "alert_state"}),
    "events": (CATALOG["alert_event_types"].sql, {"alert_type": "alert_type", "severity": "severity"}),
    "anomalies": (CATALOG["anomaly_events"].sql, {"anomaly_type": "anomaly_type", "severity": "severity"}),
    "forecasts": (CATALOG["forecast_records"].sql, {"method": "forecast_method"}),
    "agent_runs": ("SELECT * FROM agent_log", {"status": "run_status"}),
    "recommendations": (CATALOG["recommendations_table"].sql, {"status": "recommendation_status"}),
    "inventory": ("SELECT * FROM inventory", {"state": "resource_state"}),
    "pulled": ("SELECT 'MONTHLY' AS granularity, service AS service_group FROM cost_records", {"granularity": "granularity", "service_group": "service_group"}),
}


@query(
    "domain_violations",
    " UNION ALL ".join(outside(source, name, c, d) for name, (source, columns) in CHECKED.items() for c, d in columns.items()),
)
def domain_violations(spark, sf):
    """Every declared domain over the tables that have it; the last table has service names where groups belong."""
    costs = sample.cost_records(spark, sf)
    frames = {
        "cost_records": costs,
        "budgets": sample.budgets(spark, sf, costs),
        "alerts": stored_alerts(spark, sf),
        "events": CATALOG["alert_event_types"].build(spark, sf),
        "anomalies": A.anomaly_events(costs, AS_OF),
        "forecasts": CATALOG["forecast_records"].build(spark, sf),
        "agent_runs": sample.agent_runs(spark, sf),
        "recommendations": CATALOG["recommendations_table"].build(spark, sf),
        "inventory": I.resource_inventory(sample.resource_utilization(spark, sf), EVENTS_AS_OF),
        "pulled": costs.selectExpr("'MONTHLY' AS granularity", "service AS service_group"),
    }
    return Q.key_violations([Q.domain_violations(frames[name], name, columns) for name, (_, columns) in CHECKED.items()])
