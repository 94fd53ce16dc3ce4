"""Forecasts and the cost report."""

from pyspark.sql import functions as F

from ..operators import forecast as FC
from ..operators import rollups as R
from ..sinks import forecasts_table
from ..sources import sample
from ..sources.sample import AS_OF
from .budget_plans import status_sql
from .registry import query
from .views import D, exact_div

for _name, _op, _method in [
    ("forecast_linear", FC.forecast_linear, "linear"),
    ("forecast_exponential", FC.forecast_exponential, "exponential"),
    ("forecast_seasonal", FC.forecast_seasonal, "seasonal"),
]:

    def _run(spark, sf, op=_op):
        return op(sample.cost_records(spark, sf), AS_OF)

    query(_name, f"SELECT * FROM forecasts WHERE method = '{_method}'")(_run)


# The recursion day by day, for each account and each of the tried weights.
ML_SQL = f"""WITH RECURSIVE d AS (SELECT tenant_id, aws_account_id, date, sum(cost_usd) AS t FROM cost_records WHERE date >= {D} - 60 AND date < {D} GROUP BY ALL),
a AS (SELECT tenant_id, aws_account_id, coalesce(sum(t) FILTER (WHERE date >= date_trunc('month', {D})), 0) AS mtd,
  coalesce(sum(t) FILTER (WHERE date < {D} - 46), 0)::DOUBLE / 14 AS start, sum(t)::DOUBLE / 60 AS mean FROM d GROUP BY ALL),
s AS (SELECT a.*, (SELECT list(coalesce(t, 0)::DOUBLE ORDER BY x) FROM range(60) r(x)
  LEFT JOIN d ON d.date = {D} - 60 + x::INTEGER AND d.tenant_id = a.tenant_id AND d.aws_account_id = a.aws_account_id) AS days FROM a),
w AS (SELECT row_number() OVER (ORDER BY wl, wt, ww) AS no, wl, wt, ww FROM (SELECT unnest([0.1, 0.3, 0.6])::DOUBLE AS wl), (SELECT unnest([0.0, 0.1])::DOUBLE AS wt),
  (SELECT unnest([0.1, 0.4])::DOUBLE AS ww)),
r AS (SELECT s.*, w.*, 14 AS x, start AS level, 0::DOUBLE AS trend, list_transform(range(1, 8), lambda i: (days[i] + days[i + 7]) / 2 - start) AS season,
    0::DOUBLE AS held, 0::DOUBLE AS spread FROM s, w
  UNION ALL
  SELECT tenant_id, aws_account_id, mtd, start, mean, days, no, wl, wt, ww, x + 1, level + trend + wl * miss, trend + wl * wt * miss,
    list_append(season[2:7], season[1] + ww * miss), held + CASE WHEN x >= 46 THEN miss * miss ELSE 0 END,
    spread + CASE WHEN x >= 46 THEN (days[x + 1] - mean) * (days[x + 1] - mean) ELSE 0 END
  FROM (SELECT *, days[x + 1] - (level + trend + season[1]) AS miss FROM r WHERE x < 60))
SELECT tenant_id, aws_account_id, 'ml' AS method, cast(mtd AS DECIMAL(28,6)) AS mtd_usd,
  round(mtd::DOUBLE + list_sum(list_transform(range(1, {FC.remaining_days(AS_OF) + 1}), lambda h: greatest(0, level + h * trend + season[1 + (h - 1) % 7]))), 4)
    AS projected_month_end_usd,
  round(greatest(0, least(1, CASE WHEN spread > 0 THEN 1 - held / spread WHEN held = 0 THEN 1 ELSE 0 END)), 4) AS confidence_level
FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, aws_account_id ORDER BY held, no) AS rn FROM r WHERE x = 60) WHERE rn = 1"""


@query("forecast_ml", ML_SQL)
def forecast_ml(spark, sf):
    return FC.forecast_ml(sample.cost_records(spark, sf), AS_OF)


@query(
    "forecast_interval",
    f"""SELECT tenant_id, aws_account_id, {D} AS period_start, {D} + 30 AS period_end,
  {exact_div('s * 30', '60', 2)} AS mean_usd,
  cast(round(mean * 30 - 1.2816 * sd * sqrt(30), 2) AS DECIMAL(24,2)) AS lower_usd,
  cast(round(mean * 30 + 1.2816 * sd * sqrt(30), 2) AS DECIMAL(24,2)) AS upper_usd FROM fits""",
)
def forecast_interval(spark, sf):
    return FC.forecast_interval(sample.cost_records(spark, sf), AS_OF)


@query("budget_breach", "SELECT * FROM breaches")
def budget_breach(spark, sf):
    costs = sample.cost_records(spark, sf)
    return FC.budget_breach(costs, sample.budgets(spark, sf, costs), AS_OF)


FORECAST_ROWS = f"""SELECT f.tenant_id, f.aws_account_id, 'monthly' AS forecast_period, {D} AS forecast_date,
  cast(round(projected_month_end_usd, 2) AS DECIMAL(24,2)) AS forecasted_cost_usd,
  cast(round(confidence_level, 2) AS DECIMAL(3,2)) AS confidence_level, f.method, b.budget_limit,
  cast(round(b.p, 2) AS DECIMAL(3,2)) AS budget_breach_probability, b.days_to_breach
FROM forecasts f LEFT JOIN (SELECT tenant_id, aws_account_id, min(budget_limit) AS budget_limit,
    max(budget_breach_probability) AS p, min(days_to_breach) AS days_to_breach FROM breaches GROUP BY 1, 2) b
  ON f.method = 'linear' AND b.tenant_id = f.tenant_id AND b.aws_account_id = f.aws_account_id"""


@query(
    "forecast_records",
    f"""SELECT substr(sha256(concat_ws('|', 'forecast', tenant_id, aws_account_id, method, '{AS_OF}')), 1, 32) AS id, *,
  '' AS notes FROM ({FORECAST_ROWS})""",
)
def forecast_records(spark, sf):
    costs = sample.cost_records(spark, sf)
    return FC.forecast_records(costs, sample.budgets(spark, sf, costs), AS_OF)


@query(
    "forecasts_table",
    f"""SELECT tenant_id, aws_account_id, 'monthly' AS forecast_period, {D} AS forecast_date,
  cast(round(projected_month_end_usd, 2) AS DECIMAL(24,2)) AS forecasted_cost_usd,
  cast(0 AS DECIMAL(3,2)) AS confidence_level, 'linear' AS method, budget_limit,
  cast(round(budget_breach_probability, 2) AS DECIMAL(3,2)) AS budget_breach_probability, days_to_breach, '' AS notes FROM breaches""",
)
def forecasts_table_query(spark, sf):
    """Breach forecasts without period, method, confidence and notes: the defaults fill in."""
    costs = sample.cost_records(spark, sf)
    none = F.lit(None).cast("string")
    docs = FC.budget_breach(costs, sample.budgets(spark, sf, costs), AS_OF).withColumns(
        {"forecast_period": none, "method": none, "notes": none, "confidence_level": none}
    )
    return forecasts_table(docs, AS_OF)


def report_sql(report_type):
    days, year = R.REPORT_DAYS[report_type]
    return f"""SELECT t.tenant_id, '{report_type}' AS report_type, {D} - {days} AS period_start, {D} AS period_end,
  cast(round(c, 2) AS DECIMAL(24,2)) AS total_usd, cast(round(p, 2) AS DECIMAL(24,2)) AS previous_usd,
  cast(round(y, 2) AS DECIMAL(24,2)) AS year_ago_usd,
  CASE WHEN p > 0 THEN round((c::DOUBLE - p::DOUBLE) / p::DOUBLE * 100, 1) END AS pct_previous,
  CASE WHEN y > 0 THEN round((c::DOUBLE - y::DOUBLE) / y::DOUBLE * 100, 1) END AS pct_year_ago,
  d.top_drivers, coalesce(b.warning, 0) AS budgets_warning, coalesce(b.critical, 0) AS budgets_critical, coalesce(a.n, 0) AS anomalies
FROM (SELECT tenant_id, coalesce(sum(cost_usd) FILTER (WHERE date >= {D} - {days} AND date < {D}), 0) AS c,
    coalesce(sum(cost_usd) FILTER (WHERE date >= {D} - {2 * days} AND date < {D} - {days}), 0) AS p,
    coalesce(sum(cost_usd) FILTER (WHERE date >= {D} - {year + days} AND date < {D} - {year}), 0) AS y
  FROM cost_records WHERE (date >= {D} - {2 * days} AND date < {D}) OR (date >= {D} - {year + days} AND date < {D} - {year}) GROUP BY 1) t
LEFT JOIN (SELECT tenant_id, string_agg(service, ', ' ORDER BY t DESC, service) AS top_drivers FROM (
    SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY t DESC, service) AS rn FROM (
      SELECT tenant_id, service, sum(cost_usd) AS t FROM cost_records WHERE date >= {D} - {days} AND date < {D} GROUP BY 1, 2)) WHERE rn <= 3 GROUP BY 1) d
  ON d.tenant_id = t.tenant_id
LEFT JOIN (SELECT tenant_id, count(*) FILTER (WHERE severity = 'warning') AS warning, count(*) FILTER (WHERE severity = 'critical') AS critical
  FROM ({status_sql(f"SELECT * FROM tenant_status WHERE is_active AND as_of = {D}")}) GROUP BY 1) b ON b.tenant_id = t.tenant_id
LEFT JOIN (SELECT tenant_id, count(*) AS n FROM anomaly_list GROUP BY 1) a ON a.tenant_id = t.tenant_id"""


for _name, _type in [("cost_report", "weekly"), ("cost_report_daily", "daily"), ("cost_report_monthly", "monthly")]:

    def _report(spark, sf, report_type=_type):
        costs = sample.cost_records(spark, sf)
        return R.cost_report(costs, sample.budgets(spark, sf, costs), AS_OF, report_type)

    query(_name, report_sql(_type))(_report)
