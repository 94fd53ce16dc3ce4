"""Reads over cost records."""

from pyspark.sql import functions as F

from ..operators import anomaly as A
from ..operators import costs as C
from ..operators import rollups as R
from ..operators import rootcause as RC
from ..operators import trends as T
from ..sources import sample
from ..sources.sample import AS_OF
from .registry import query
from .views import D, exact_div

M2 = "cast(round({0}, 2) AS DECIMAL(24,2))"
SUM6 = "cast(sum(cost_usd) AS DECIMAL(28,6))"
PCT = "CASE WHEN {1} > 0 THEN round(({0}::DOUBLE - {1}::DOUBLE) / {1}::DOUBLE * 100, 1) END"


def m2(x):
    return M2.format(x)


def pct(a, b):
    return PCT.format(a, b)


def plain(name, op, sql):
    """Register an operator that takes only cost records and the as-of date."""

    @query(name, sql)
    def run(spark, sf):
        return op(sample.cost_records(spark, sf), AS_OF)

    return run


plain(
    "cost_summary", C.cost_summary,
    f"""SELECT c.tenant_id, c.service_group, {m2('c.t')} AS total_usd, {m2('coalesce(p.t, 0)')} AS prev_total_usd,
  {pct('c.t', 'p.t')} AS pct_change, {m2('sum(c.t) OVER (PARTITION BY c.tenant_id)')} AS period_total_usd
FROM (SELECT tenant_id, service_group, sum(cost_usd) AS t FROM cost_records WHERE date >= {D} - 30 AND date < {D} GROUP BY ALL) c
LEFT JOIN (SELECT tenant_id, service_group, sum(cost_usd) AS t FROM cost_records WHERE date >= {D} - 60 AND date < {D} - 30 GROUP BY ALL) p
  ON p.tenant_id = c.tenant_id AND p.service_group = c.service_group""",
)
plain(
    "daily_costs", C.daily_costs,
    f"SELECT tenant_id, date, {m2('sum(cost_usd)')} AS total_usd FROM cost_records WHERE date >= {D} - 30 GROUP BY tenant_id, date",
)
plain(
    "top_services", C.top_services,
    f"""SELECT tenant_id, service, service_group, {m2('t')} AS total_usd, active_days FROM (
SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY t DESC, service) AS rn FROM (
  SELECT tenant_id, service, service_group, sum(cost_usd) AS t, count(DISTINCT date) AS active_days
  FROM cost_records WHERE date >= {D} - 30 GROUP BY ALL)) WHERE rn <= 20""",
)
plain(
    "costs_by_region", C.costs_by_region,
    f"SELECT tenant_id, region, {m2('sum(cost_usd)')} AS total_usd FROM cost_records WHERE date >= {D} - 30 GROUP BY tenant_id, region",
)


@query(
    "v_monthly_spend",
    f"""SELECT tenant_id, aws_account_id, account_alias, cast(date_trunc('month', date) AS DATE) AS month, service_group,
  {SUM6} AS total_usd, count(DISTINCT service) AS service_count FROM cost_records GROUP BY 1, 2, 3, 4, 5""",
)
def v_monthly_spend(spark, sf):
    return C.monthly_spend_view(sample.cost_records(spark, sf))


@query(
    "v_daily_spend",
    f"""SELECT tenant_id, aws_account_id, account_alias, date, {SUM6} AS total_usd, count(DISTINCT service) AS active_services
FROM cost_records GROUP BY 1, 2, 3, 4""",
)
def v_daily_spend(spark, sf):
    return C.daily_spend_view(sample.cost_records(spark, sf))


THIS_MONTH = f"""SELECT tenant_id, aws_account_id, service, service_group, {SUM6} AS total_usd
FROM cost_records WHERE date >= date_trunc('month', {D}) GROUP BY 1, 2, 3, 4"""
plain("v_top_services_this_month", C.top_services_this_month_view, THIS_MONTH)


@query(
    "top_n_per_account",
    f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, aws_account_id ORDER BY total_usd DESC, service)::INTEGER AS rank
FROM ({THIS_MONTH})) WHERE rank <= 5""",
)
def top_n_per_account(spark, sf):
    return C.top_n_per_account(sample.cost_records(spark, sf), AS_OF, n=5)


BY_SERVICE = f"""SELECT tenant_id, service, service_group, total FROM (
SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY total DESC, service) AS rn FROM (
  SELECT tenant_id, service, service_group, {SUM6} AS total FROM cost_records WHERE date >= {D} - 30 GROUP BY 1, 2, 3)) WHERE rn <= 20"""
BY_REGION = f"""SELECT tenant_id, region, {SUM6} AS total FROM cost_records WHERE date >= {D} - 30 GROUP BY 1, 2"""
TOTAL = f"""SELECT tenant_id, cast(coalesce(sum(cost_usd) FILTER (WHERE date >= {D} - 30), 0) AS DECIMAL(28,6)) AS total
FROM cost_records GROUP BY 1"""
plain("cost_data_by_service", C.cost_data_by_service, BY_SERVICE)
plain("cost_data_by_region", C.cost_data_by_region, BY_REGION)


@query("cost_data_total", TOTAL)
def cost_data_total(spark, sf):
    return C.cost_data_total(sample.cost_records(spark, sf), AS_OF, tenants=sample.accounts(spark, sf))


plain(
    "cost_data_daily", C.cost_data_daily,
    f"SELECT tenant_id, date, {SUM6} AS total FROM cost_records WHERE date >= {D} - 30 GROUP BY 1, 2",
)
plain(
    "monitoring_facets", C.monitoring_facets,
    f"""SELECT tenant_id, 'service' AS facet, service, service_group, NULL AS region, NULL::DATE AS date, {SUM6} AS total
FROM cost_records WHERE date >= {D} - 30 GROUP BY 1, 3, 4
UNION ALL SELECT tenant_id, 'region', NULL, NULL, region, NULL, {SUM6} FROM cost_records WHERE date >= {D} - 30 GROUP BY 1, 5
UNION ALL SELECT tenant_id, 'date', NULL, NULL, NULL, date, {SUM6} FROM cost_records WHERE date >= {D} - 30 GROUP BY 1, 6
UNION ALL SELECT tenant_id, 'total', NULL, NULL, NULL, NULL, {SUM6} FROM cost_records WHERE date >= {D} - 30 GROUP BY 1""",
)


@query(
    "multi_account_rollup",
    f"""SELECT tenant_id, aws_account_id, service_group, 3 AS level, {SUM6} AS total_usd FROM cost_records GROUP BY 1, 2, 3
UNION ALL SELECT tenant_id, aws_account_id, NULL, 2, {SUM6} FROM cost_records GROUP BY 1, 2
UNION ALL SELECT tenant_id, NULL, NULL, 1, {SUM6} FROM cost_records GROUP BY 1
UNION ALL SELECT NULL, NULL, NULL, 0, {SUM6} FROM cost_records""",
)
def multi_account_rollup(spark, sf):
    return R.multi_account_rollup(sample.cost_records(spark, sf))


@query(
    "rolling_7d_spend",
    f"""SELECT d.tenant_id, d.service, d.date, cast(any_value(d.t) AS DECIMAL(28,6)) AS day_total,
  {exact_div("sum(o.t) FILTER (WHERE o.date > d.date - 7)", '7', 4)} AS current_avg,
  {exact_div("coalesce(sum(o.t) FILTER (WHERE o.date <= d.date - 7), 0)", '90', 4)} AS baseline_avg
FROM (SELECT tenant_id, service, date, sum(cost_usd) AS t FROM cost_records GROUP BY ALL) d
JOIN (SELECT tenant_id, service, date, sum(cost_usd) AS t FROM cost_records GROUP BY ALL) o
  ON o.tenant_id = d.tenant_id AND o.service = d.service AND o.date <= d.date AND o.date > d.date - 97
GROUP BY d.tenant_id, d.service, d.date""",
)
def rolling_7d_spend(spark, sf):
    return T.rolling_spend(sample.cost_records(spark, sf))


@query(
    "mtd_running_total",
    """SELECT s.tenant_id, s.aws_account_id, date, cast(t AS DECIMAL(28,6)) AS day_total, cast(mtd AS DECIMAL(28,6)) AS mtd_total,
  coalesce(mtd >= l AND mtd - t < l, false) AS crosses_budget
FROM (SELECT *, sum(t) OVER (PARTITION BY tenant_id, aws_account_id, date_trunc('month', date) ORDER BY date) AS mtd FROM (
    SELECT tenant_id, aws_account_id, date, sum(cost_usd) AS t FROM cost_records GROUP BY ALL)) s
LEFT JOIN (SELECT tenant_id, aws_account_id, min(limit_usd) AS l FROM budgets
    WHERE is_active AND aws_account_id IS NOT NULL AND service_group IS NULL AND region IS NULL GROUP BY ALL) b
  ON b.tenant_id = s.tenant_id AND b.aws_account_id = s.aws_account_id""",
)
def mtd_running_total(spark, sf):
    return T.mtd_running_total(sample.cost_records(spark, sf), sample.budgets(spark, sf))


def period_sql(unit, year):
    return f"""SELECT c.tenant_id, c.p AS period_start, cast(c.t AS DECIMAL(28,6)) AS total_usd,
  cast(b.t AS DECIMAL(28,6)) AS previous_usd, cast(y.t AS DECIMAL(28,6)) AS year_ago_usd,
  {pct('c.t', 'b.t')} AS pct_previous, {pct('c.t', 'y.t')} AS pct_year_ago
FROM (SELECT tenant_id, cast(date_trunc('{unit}', date) AS DATE) AS p, sum(cost_usd) AS t FROM cost_records GROUP BY 1, 2) c
LEFT JOIN (SELECT tenant_id, cast(date_trunc('{unit}', date) AS DATE) AS p, sum(cost_usd) AS t FROM cost_records GROUP BY 1, 2) b
  ON b.tenant_id = c.tenant_id AND b.p = cast(c.p - INTERVAL 1 {unit} AS DATE)
LEFT JOIN (SELECT tenant_id, cast(date_trunc('{unit}', date) AS DATE) AS p, sum(cost_usd) AS t FROM cost_records GROUP BY 1, 2) y
  ON y.tenant_id = c.tenant_id AND y.p = cast(c.p - {year} AS DATE)"""


for _name, _period, _year in [
    ("period_over_period", "month", "INTERVAL 12 MONTH"),
    ("period_over_period_week", "week", "INTERVAL 364 DAY"),
    ("period_over_period_day", "day", "INTERVAL 12 MONTH"),
]:

    def _run(spark, sf, period=_period):
        return T.period_over_period(sample.cost_records(spark, sf), period)

    query(_name, period_sql(_period, _year))(_run)


@query(
    "pareto_drivers",
    f"""SELECT tenant_id, service, cast(t AS DECIMAL(28,6)) AS total_usd,
  row_number() OVER (PARTITION BY tenant_id ORDER BY t DESC, service)::INTEGER AS rank,
  round(t::DOUBLE / (sum(t) OVER (PARTITION BY tenant_id))::DOUBLE * 100, 4) AS share_pct,
  round((sum(t) OVER (PARTITION BY tenant_id ORDER BY t DESC, service ROWS UNBOUNDED PRECEDING))::DOUBLE
    / (sum(t) OVER (PARTITION BY tenant_id))::DOUBLE * 100, 4) AS cumulative_pct
FROM (SELECT tenant_id, service, sum(cost_usd) AS t FROM cost_records GROUP BY ALL)""",
)
def pareto_drivers(spark, sf):
    return T.pareto_drivers(sample.cost_records(spark, sf))


plain("service_churn", T.service_churn, "SELECT * FROM churn")


@query(
    "slice_query",
    f"""SELECT tenant_id, service, cast(coalesce(sum(cost_usd) FILTER (WHERE date >= DATE '2001-08-01'), 0) AS DECIMAL(28,6)) AS value,
  cast(coalesce(sum(cost_usd) FILTER (WHERE date < DATE '2001-08-01'), 0) AS DECIMAL(28,6)) AS compare_value,
  {pct("coalesce(sum(cost_usd) FILTER (WHERE date >= DATE '2001-08-01'), 0)", "sum(cost_usd) FILTER (WHERE date < DATE '2001-08-01')")} AS pct_change
FROM cost_records WHERE date >= DATE '2001-07-01' AND date < DATE '2001-09-01' GROUP BY tenant_id, service""",
)
def slice_query(spark, sf):
    return C.slice_query(
        sample.cost_records(spark, sf), start="2001-08-01", end="2001-09-01", compare_start="2001-07-01"
    )


plain(
    "rca_contribution", RC.rca_contribution,
    f"""SELECT s.tenant_id, s.aws_account_id, service, region, {m2('c')} AS current_usd, {m2('p')} AS previous_usd, {m2('c - p')} AS delta_usd,
  CASE WHEN a <> 0 THEN round((c - p)::DOUBLE / a::DOUBLE * 100, 4) END AS share_pct
FROM (SELECT tenant_id, aws_account_id, service, region, coalesce(sum(cost_usd) FILTER (WHERE date >= {D} - 30), 0) AS c,
    coalesce(sum(cost_usd) FILTER (WHERE date < {D} - 30), 0) AS p FROM cost_records WHERE date >= {D} - 60 AND date < {D} GROUP BY ALL) s
JOIN (SELECT tenant_id, aws_account_id, sum(CASE WHEN date >= {D} - 30 THEN cost_usd ELSE -cost_usd END) AS a
    FROM cost_records WHERE date >= {D} - 60 AND date < {D} GROUP BY ALL) w
  ON w.tenant_id = s.tenant_id AND w.aws_account_id = s.aws_account_id""",
)


def joint_split_sql(source, start, middle, end, by):
    """The sets by running sums over each grouping, written out one by one."""
    first, second = by
    cells = " UNION ALL ".join(
        f"SELECT tenant_id, aws_account_id, '{','.join(g)}' AS g, {len(g)} AS n, {k} AS o, "
        + ", ".join(c if c in g else f"NULL AS {c}" for c in by)
        + ", sum(d) AS d FROM s GROUP BY ALL"
        for k, g in enumerate([(first,), (second,), by])
    )
    return f"""SELECT tenant_id, aws_account_id, g AS grouping, rank::INTEGER AS rank, {first}, {second}, cast(round(d, 2) AS DECIMAL(24,2)) AS delta_usd,
  round(gain::DOUBLE / abs(t)::DOUBLE * 100, 4) AS share_pct, round(reached::DOUBLE / abs(t)::DOUBLE * 100, 4) AS cumulative_pct,
  round(best::DOUBLE / abs(t)::DOUBLE * 100, 4) AS explained_pct, slices::INTEGER AS slices
FROM (SELECT *, min(q) OVER (PARTITION BY tenant_id, aws_account_id) AS least FROM (
  SELECT *, row(slices, n, -best, o) AS q FROM (
    SELECT *, count(*) OVER (PARTITION BY tenant_id, aws_account_id, g) AS slices, max(reached) OVER (PARTITION BY tenant_id, aws_account_id, g) AS best
    FROM (SELECT *, row_number() OVER w AS rank, sum(gain) OVER (w ROWS UNBOUNDED PRECEDING) AS reached FROM (
      SELECT c.*, t, CASE WHEN t > 0 THEN d ELSE -d END AS gain FROM (
        WITH s AS (SELECT tenant_id, aws_account_id, {first}, {second}, sum(CASE WHEN date >= {middle} THEN cost_usd ELSE -cost_usd END) AS d
          FROM {source} WHERE date >= {start} AND date < {end} GROUP BY ALL) {cells}) c
      JOIN (SELECT tenant_id, aws_account_id, sum(CASE WHEN date >= {middle} THEN cost_usd ELSE -cost_usd END) AS t
        FROM {source} WHERE date >= {start} AND date < {end} GROUP BY ALL) a
        ON a.tenant_id = c.tenant_id AND a.aws_account_id = c.aws_account_id)
      WHERE gain > 0 WINDOW w AS (PARTITION BY tenant_id, aws_account_id, g ORDER BY gain DESC, {first} NULLS FIRST, {second} NULLS FIRST))
    WHERE (reached - gain) * 100 < abs(t) * 80 AND rank <= 20)
  WHERE best * 100 >= abs(t) * 80))
WHERE q = least"""


plain("rca_joint_split", RC.rca_joint_split, joint_split_sql("cost_records", f"{D} - 60", f"{D} - 30", D, ("service", "region")))


# ---- anomalies -------------------------------------------------------------------

ANOMALY_SQL = f"""SELECT tenant_id, aws_account_id, anomaly_type, severity, service, region,
  current_value, cast(baseline_value AS DECIMAL(24,2)) AS baseline_value,
  cast(round(percent_change, 2) AS DECIMAL(18,2)) AS percent_change, description FROM anomaly_list"""


def anomaly_sql(kind):
    return f"{ANOMALY_SQL} WHERE anomaly_type = '{kind}'"


plain("spend_spikes", A.spend_spikes, anomaly_sql("spend_spike"))
plain(
    "spend_spikes_by_region", lambda costs, as_of: A.spend_spikes(costs, as_of, by_region=True),
    f"""SELECT tenant_id, aws_account_id, 'spend_spike' AS anomaly_type,
  CASE WHEN pct < 100 THEN 'info' WHEN pct < 200 THEN 'warning' ELSE 'critical' END AS severity, service, region,
  {exact_div('c', '7', 2)} AS current_value, {exact_div('b', '90', 2)} AS baseline_value,
  cast(round(pct, 2) AS DECIMAL(18,2)) AS percent_change, service || ' daily spend is above its 90-day mean' AS description
FROM (SELECT *, (c::DOUBLE / 7 - b::DOUBLE / 90) / (b::DOUBLE / 90) * 100 AS pct FROM (
  SELECT tenant_id, aws_account_id, service, region, sum(cost_usd) FILTER (WHERE is_cur) AS c,
    sum(cost_usd) FILTER (WHERE NOT is_cur) AS b FROM recent_days GROUP BY ALL) WHERE b > 0) WHERE pct > 50""",
)
plain("new_services", A.new_services, anomaly_sql("new_service"))
plain("regional_shift", A.regional_shift, anomaly_sql("regional_shift"))
plain("seasonal_deviation", A.seasonal_deviation, anomaly_sql("unusual_pattern"))
plain(
    "anomaly_events", A.anomaly_events,
    f"""SELECT substr(sha256(concat_ws('|', 'anomaly', tenant_id, aws_account_id, anomaly_type, coalesce(service, '-'),
  coalesce(region, '-'), description, '{AS_OF}')), 1, 32) AS id, * FROM ({ANOMALY_SQL})""",
)
plain(
    "weekday_baseline",
    lambda costs, as_of: A.weekday_stats(costs, as_of).select(
        "tenant_id", "aws_account_id", (F.col("weekday") - 1).cast("bigint").alias("weekday"), "samples",
        F.round("mean", 4).cast("decimal(24,4)").alias("mean"), F.round("sd", 4).alias("sd"),
    ),
    f"""SELECT coalesce(b.tenant_id, c.tenant_id) AS tenant_id, coalesce(b.aws_account_id, c.aws_account_id) AS aws_account_id,
  coalesce(b.wd, c.wd) AS weekday, coalesce(n, 0) AS samples, {exact_div('s', 'n', 4)} AS mean, round(sd, 4) AS sd
FROM weekday_baseline b FULL JOIN (SELECT tenant_id, aws_account_id, dayofweek(date) AS wd FROM day_totals WHERE is_cur) c
  ON b.tenant_id = c.tenant_id AND b.aws_account_id = c.aws_account_id AND b.wd = c.wd""",
)
plain(
    "baseline_stats", A.baseline_stats,
    f"""SELECT tenant_id, aws_account_id, {exact_div('sum(t) FILTER (WHERE NOT cur)', '90', 4)} AS avg_daily,
  round(stddev_samp(y) FILTER (WHERE NOT cur), 4) AS std_dev, cast(round(min(t) FILTER (WHERE NOT cur), 4) AS DECIMAL(24,4)) AS min_daily,
  cast(round(max(t) FILTER (WHERE NOT cur), 4) AS DECIMAL(24,4)) AS max_daily, {m2('sum(t) FILTER (WHERE cur)')} AS current_total,
  {exact_div('sum(t) FILTER (WHERE cur)', '7', 4)} AS current_avg, cast(round(max(t) FILTER (WHERE cur), 4) AS DECIMAL(24,4)) AS current_peak,
  cast(round(min(t) FILTER (WHERE cur), 4) AS DECIMAL(24,4)) AS current_low
FROM (SELECT a.tenant_id, a.aws_account_id, c.date, c.date >= {D} - 7 AS cur, coalesce(s.t, 0) AS t, coalesce(s.t, 0)::DOUBLE AS y
  FROM (SELECT DISTINCT tenant_id, aws_account_id FROM recent_days) a
  CROSS JOIN (SELECT {D} - 97 + unnest(range(97))::INTEGER AS date) c
  LEFT JOIN (SELECT tenant_id, aws_account_id, date, sum(cost_usd) AS t FROM recent_days GROUP BY ALL) s
    ON s.tenant_id = a.tenant_id AND s.aws_account_id = a.aws_account_id AND s.date = c.date)
GROUP BY tenant_id, aws_account_id""",
)
