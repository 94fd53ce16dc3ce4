"""Budgets and alerts."""

from pyspark.sql import functions as F

from ..operators import alerts as AL
from ..operators import anomaly as A
from ..operators import budgets as B
from ..operators import forecast as FC
from ..operators import inventory as I
from ..sinks import alert_dedup_append
from ..sources import sample, tables
from ..sources.sample import AS_OF, EVENTS_AS_OF, PRIOR_AS_OF
from .registry import query
from .sync import run_ingestion
from .views import D, exact_div


def stamp(day):
    return F.lit(f"{day} 00:00:00").cast("timestamp_ntz")


def status(spark, sf, as_of=AS_OF, scope="account"):
    costs = sample.cost_records(spark, sf)
    return B.budget_status(costs, sample.budgets(spark, sf, costs), as_of, scope, sample.accounts(spark, sf))


def stored_alerts(spark, sf):
    """Alerts of a week earlier in all three states."""
    alerts = B.budget_alerts(status(spark, sf, PRIOR_AS_OF, "tenant"), stamp(PRIOR_AS_OF))
    rows = AL.with_alert_ids(AL.budget_alert_events(alerts))
    digit = F.substring("id", 1, 1)
    day = F.date_add(F.lit(PRIOR_AS_OF), F.ascii(F.substring("id", 2, 1)) % 30 - 31)
    return rows.withColumns(
        {
            "state": F.when(digit < "a", "firing").when(digit < "d", "resolved").otherwise("acknowledged"),
            "triggered_at": day.cast("timestamp_ntz"),
        }
    )


BUDGET = ["id", "tenant_id", "aws_account_id", "name", "service_group", "region", "limit_usd", "period", "alert_at_pct"]


@query("active_budgets", f"SELECT {', '.join(BUDGET)} FROM budgets WHERE is_active")
def active_budgets(spark, sf):
    return tables.active_budgets(sample.budgets(spark, sf)).select(*BUDGET)


@query("list_budgets", f"SELECT {', '.join(BUDGET)}, is_active, created_at FROM budgets")
def list_budgets(spark, sf):
    return tables.list_budgets(sample.budgets(spark, sf)).select(*BUDGET, "is_active", "created_at")


ALERT = ["id", "tenant_id", "budget_id", "aws_account_id", "severity", "state", "triggered_at"]


@query(
    "list_alerts",
    f"""SELECT {', '.join(ALERT)} FROM (
SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY triggered_at DESC, id) AS rn FROM stored_alerts) WHERE rn <= 50""",
)
def list_alerts(spark, sf):
    return tables.list_alerts(stored_alerts(spark, sf)).select(*ALERT)


@query(
    "budget_wildcard_join",
    f"""SELECT budget_id, tenant_id, evaluated_account, cast(current_usd AS DECIMAL(28,6)) AS current_usd
FROM tenant_status WHERE as_of = {D}""",
)
def budget_wildcard_join(spark, sf):
    costs = sample.cost_records(spark, sf)
    return B.budget_wildcard_join(costs, sample.budgets(spark, sf, costs), AS_OF)


STATUS_PCT = "CASE WHEN limit_usd > 0 THEN current_usd::DOUBLE / limit_usd::DOUBLE * 100 ELSE 0 END"
STATUS_COLUMNS = """budget_id, budget_name, tenant_id, aws_account_id, evaluated_account, service_group, region, period,
  cast(round(current_usd, 2) AS DECIMAL(24,2)) AS current_usd, cast(limit_usd AS DECIMAL(24,2)) AS limit_usd,
  round(pct, 1) AS percent_used, pct >= alert_at_pct AS firing,
  CASE WHEN pct < alert_at_pct THEN 'ok' WHEN pct >= 100 THEN 'critical' ELSE 'warning' END AS severity"""


def status_sql(source):
    return f"SELECT {STATUS_COLUMNS} FROM (SELECT *, {STATUS_PCT} AS pct FROM ({source}))"


@query("budget_status", status_sql("SELECT * FROM account_status"))
def budget_status(spark, sf):
    return status(spark, sf)


@query("budget_status_tenant_scope", status_sql(f"SELECT * FROM tenant_status WHERE is_active AND as_of = {D}"))
def budget_status_tenant_scope(spark, sf):
    return status(spark, sf, scope="tenant")


@query(
    "budget_status_by_period",
    status_sql(
        f"""SELECT b.id AS budget_id, b.name AS budget_name, b.tenant_id, b.aws_account_id, b.aws_account_id AS evaluated_account,
  b.service_group, b.region, b.period, b.limit_usd, b.alert_at_pct, coalesce(sum(s.cost_usd), 0) AS current_usd
FROM budgets b LEFT JOIN cost_records s ON s.tenant_id = b.tenant_id AND s.date <= {D}
  AND s.date >= date_trunc(CASE b.period WHEN 'daily' THEN 'day' WHEN 'weekly' THEN 'week' ELSE 'month' END, {D})
  AND (b.aws_account_id IS NULL OR s.aws_account_id = b.aws_account_id)
  AND (b.service_group IS NULL OR s.service_group = b.service_group)
  AND (b.region IS NULL OR s.region = b.region)
WHERE b.is_active GROUP BY ALL"""
    ),
)
def budget_status_by_period(spark, sf):
    costs = sample.cost_records(spark, sf)
    return B.budget_status_by_period(costs, sample.budgets(spark, sf, costs), AS_OF)


def alerts_now(spark, sf):
    return B.budget_alerts(status(spark, sf), stamp(AS_OF))


ALERTS_SQL = f"""SELECT budget_id, budget_name, tenant_id, aws_account_id, evaluated_account, service_group, current_usd, limit_usd,
  percent_used, severity, 'Budget alert: ''' || budget_name || ''' is at ' || cast(cast(percent_used AS DECIMAL(18,1)) AS VARCHAR) || '% — $'
    || format('{{:,.2f}}', current_usd::DOUBLE) || ' of $' || format('{{:,.2f}}', limit_usd::DOUBLE) AS message
FROM ({status_sql("SELECT * FROM account_status")}) WHERE firing"""


@query("budget_alerts", ALERTS_SQL)
def budget_alerts(spark, sf):
    return alerts_now(spark, sf).drop("triggered_at")


EVENT = ["tenant_id", "budget_id", "aws_account_id", "alert_type", "severity", "title", "current_value", "threshold_value", "percent_used"]


@query(
    "alert_dedup_append",
    f"""SELECT n.* EXCLUDE (rn) FROM (
SELECT tenant_id, budget_id, aws_account_id, 'budget_threshold' AS alert_type, severity, 'Budget threshold: ' || budget_name AS title,
  current_usd AS current_value, limit_usd AS threshold_value, cast(percent_used AS DECIMAL(18,1)) AS percent_used,
  row_number() OVER (PARTITION BY tenant_id, budget_id ORDER BY evaluated_account) AS rn
FROM ({ALERTS_SQL})) n
WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM stored_alerts f
  WHERE f.state = 'firing' AND f.tenant_id = n.tenant_id AND f.budget_id = n.budget_id)
UNION ALL SELECT tenant_id, NULL, aws_account_id, 'spend_spike', severity, 'Spend spike: ' || service,
  current_value, cast(baseline_value AS DECIMAL(24,2)),
  cast(round(cast(round(percent_change, 2) AS DECIMAL(18,2)), 1) AS DECIMAL(18,1))
FROM anomaly_list WHERE anomaly_type = 'spend_spike'""",
)
def alert_dedup(spark, sf):
    """Accounts are synced in order of their id; alerts without a budget are never held back."""
    alerts = alerts_now(spark, sf)
    order = alerts.select("*", F.col("evaluated_account").alias("seq"))
    keyed = AL.budget_alert_events(order, "seq")
    spikes = AL.spike_alert_events(A.spend_spikes(sample.cost_records(spark, sf), AS_OF), stamp(AS_OF))
    batch = keyed.unionByName(spikes.withColumn("seq", F.col("aws_account_id")))
    return alert_dedup_append(batch, stored_alerts(spark, sf)).select(*EVENT)


@query(
    "alert_lifecycle",
    f"""SELECT a.id, a.tenant_id, a.budget_id, CASE WHEN a.state = 'firing' AND s.f = false THEN 'resolved' ELSE a.state END AS state,
  CASE WHEN a.state = 'firing' AND s.f = false THEN cast({D} AS TIMESTAMP) END AS resolved_at
FROM stored_alerts a LEFT JOIN (SELECT tenant_id, budget_id, bool_or(firing) AS f
  FROM ({status_sql(f"SELECT * FROM tenant_status WHERE is_active AND as_of = {D}")}) GROUP BY ALL) s
  ON s.tenant_id = a.tenant_id AND s.budget_id = a.budget_id""",
)
def alert_lifecycle(spark, sf):
    rows = AL.alert_lifecycle(stored_alerts(spark, sf), status(spark, sf, scope="tenant"), stamp(AS_OF))
    return rows.select("id", "tenant_id", "budget_id", "state", "resolved_at")


@query(
    "alert_event_types",
    f"""SELECT tenant_id, budget_id, aws_account_id, 'budget_threshold' AS alert_type, severity, current_usd AS current_value, limit_usd AS threshold_value
FROM ({ALERTS_SQL})
UNION ALL SELECT tenant_id, NULL, aws_account_id, 'spend_spike', severity, current_value,
  cast(baseline_value AS DECIMAL(24,2)) FROM anomaly_list WHERE anomaly_type = 'spend_spike'
UNION ALL SELECT tenant_id, NULL, aws_account_id, 'idle_resource', 'info', monthly_cost_usd, NULL FROM inventory WHERE is_idle
UNION ALL SELECT tenant_id, budget_id, aws_account_id, 'forecast_breach', CASE WHEN days_to_breach <= 3 THEN 'critical' ELSE 'warning' END,
  cast(round(projected_month_end_usd, 2) AS DECIMAL(24,2)), budget_limit FROM breaches WHERE budget_breach_probability > 0.5""",
)
def alert_event_types(spark, sf):
    costs = sample.cost_records(spark, sf)
    inventory = I.resource_inventory(sample.resource_utilization(spark, sf), EVENTS_AS_OF)
    rows = AL.alert_event_types(
        AL.budget_alert_events(alerts_now(spark, sf)),
        AL.spike_alert_events(A.spend_spikes(costs, AS_OF), stamp(AS_OF)),
        AL.idle_alert_events(inventory, stamp(EVENTS_AS_OF)),
        AL.breach_alert_events(FC.budget_breach(costs, sample.budgets(spark, sf, costs), AS_OF), stamp(AS_OF)),
    )
    return rows.select(
        "tenant_id", "budget_id", "aws_account_id", "alert_type", "severity", "current_value", "threshold_value"
    )


@query(
    "run_ingestion",
    f"""SELECT a.tenant_id, a.aws_account_id, coalesce(d.n, 0) AS daily_records, coalesce(m.n, 0) AS monthly_records,
  coalesce(d.n, 0) + coalesce(m.n, 0) AS total_upserted, coalesce(f.n, 0) AS alerts, {exact_div('s.s * 30', '60', 2)} AS forecast_mean_usd
FROM accounts a
LEFT JOIN (SELECT tenant_id, aws_account_id, count(*) AS n FROM cost_records WHERE date >= {D} - 32 AND date < {D} GROUP BY ALL) d USING (tenant_id, aws_account_id)
LEFT JOIN (SELECT tenant_id, aws_account_id, count(*) AS n FROM monthly_records GROUP BY ALL) m USING (tenant_id, aws_account_id)
LEFT JOIN (SELECT tenant_id, evaluated_account AS aws_account_id, count(*) AS n FROM ({ALERTS_SQL}) GROUP BY ALL) f USING (tenant_id, aws_account_id)
LEFT JOIN fits s USING (tenant_id, aws_account_id)""",
)
def run_ingestion_query(spark, sf):
    """A sync on top of the history up to a week ago."""
    costs = sample.cost_records(spark, sf)
    history = costs.where(F.col("date") < F.lit(PRIOR_AS_OF))
    sync = run_ingestion(
        sample.usage_lines(spark, sf), sample.accounts(spark, sf), sample.budgets(spark, sf, costs), history,
        stored_alerts(spark, sf), AS_OF, stamp(AS_OF),
    )
    return sync.summary
