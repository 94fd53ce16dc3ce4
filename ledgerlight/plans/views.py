"""SQL views of the sample inputs, for the checks. Written independently of the
DataFrame code: joins and scans are spelled out where the operators avoid them."""

from ..functions.classify import NAME_FRAGMENTS, SERVICE_GROUPS
from ..sources import sample

D = f"DATE '{sample.AS_OF}'"  # as-of date of the cost tables
P = f"DATE '{sample.PRIOR_AS_OF}'"
E = f"DATE '{sample.EVENTS_AS_OF}'"
TENANT_LIST = "[" + ", ".join(f"'{t}'" for t in sample.TENANTS) + "]"
ACCOUNT_KEYS = "tenant_id, aws_account_id, account_alias"


def values(items) -> str:
    return "[" + ", ".join(f"'{i}'" for i in items) + "]"


def exact_div(total: str, days: str, digits: int) -> str:
    """A six-decimal total over a whole number, rounded half up in integer arithmetic."""
    unit = f"cast({days} AS HUGEINT) * {10 ** (6 - digits)}"
    whole = f"cast(({total}) * 1000000 AS HUGEINT)"
    quotient = f"((2 * abs({whole}) + {unit}) // (2 * {unit}) * sign({whole}))"
    return f"cast(cast({quotient} AS DECIMAL(28,0)) * cast({10 ** -digits:.{digits}f} AS DECIMAL({digits + 1},{digits})) AS DECIMAL(24,{digits}))"


def group_case(col: str) -> str:
    exact = " ".join(f"WHEN {col} IN ({', '.join(repr(n) for n in names)}) THEN '{g}'" for g, names in SERVICE_GROUPS.items())
    parts = " ".join(
        "WHEN " + " OR ".join(f"lower({col}) LIKE '%{f}%'" for f in frags) + f" THEN '{g}'" for g, frags in NAME_FRAGMENTS
    )
    return f"CASE {exact} {parts} ELSE 'other' END"


def rec_id(region: str, date: str = "date") -> str:
    return f"substr(sha256(concat(aws_account_id, ':', cast({date} AS VARCHAR), ':', service, ':', {region})), 1, 20)"


def alias(account: str) -> str:
    return f"CASE WHEN right({account}, 1) = '7' THEN {account} ELSE concat('team-', {account}) END"


def event_account(n: str = "user_id") -> str:
    return f"lpad(cast({n} % 20 AS VARCHAR), 12, '0')"


def event_tenant(n: str = "user_id") -> str:
    return f"{TENANT_LIST}[1 + cast(floor(({n} % 20) / 4) AS INTEGER)]"


BUDGET_SETS = ", ".join("(" + ", ".join(["tenant_id", *p]) + ")" for p in sample.budget_patterns())
STAR = "coalesce(aws_account_id, '*') || '/' || coalesce(service_group, '*') || '/' || coalesce(region, '*')"

VIEWS = {
    "usage_lines": f"""
SELECT *, {alias('aws_account_id')} AS account_alias FROM (
SELECT c_mktsegment AS tenant_id,
  lpad(cast((list_position({TENANT_LIST}, c_mktsegment) - 1) * 4 + l_orderkey % 4 AS VARCHAR), 12, '0') AS aws_account_id,
  cast(l_shipdate AS DATE) AS date,
  {values(sample.SERVICES)}[1 + l_partkey % 16] AS service,
  {values(sample.REGIONS)}[1 + s_nationkey % 6] AS raw_region,
  CASE WHEN l_returnflag = 'R' AND l_linenumber = 7 THEN 'Credit'
       WHEN l_returnflag = 'R' AND l_linenumber = 6 THEN 'Refund' ELSE 'Usage' END AS record_type,
  cast(CASE WHEN l_discount = 0.1 AND l_tax = 0 THEN 0 ELSE l_extendedprice * (1 - l_discount) / 100 END AS DECIMAL(18,6)) AS cost_usd,
  cast(CASE WHEN l_discount = 0.1 AND l_tax = 0 THEN 0 ELSE l_quantity END AS DECIMAL(18,4)) AS usage_quantity
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN supplier ON l_suppkey = s_suppkey)""",
    "cost_rollup": f"""
SELECT {ACCOUNT_KEYS}, date, service, raw_region,
  cast(sum(cost_usd) AS DECIMAL(18,6)) AS cost_usd, cast(sum(usage_quantity) AS DECIMAL(18,4)) AS usage_quantity,
  '' AS usage_unit
FROM usage_lines WHERE record_type NOT IN ('Credit', 'Refund')
GROUP BY {ACCOUNT_KEYS}, date, service, raw_region""",
    "cost_records": f"""
SELECT {rec_id('raw_region')} AS id, {ACCOUNT_KEYS}, date, 'DAILY' AS granularity, service,
  {group_case('service')} AS service_group,
  CASE WHEN raw_region = 'NoRegion' THEN 'global' ELSE raw_region END AS region,
  cost_usd, usage_quantity, usage_unit
FROM cost_rollup WHERE NOT (cost_usd = 0 AND usage_quantity = 0)""",
    "monthly_records": f"""
SELECT {rec_id("'global'")} || '_m' AS id, {ACCOUNT_KEYS}, date, 'MONTHLY' AS granularity, service,
  {group_case('service')} AS service_group, 'global' AS region,
  cast(round(s, 4) AS DECIMAL(18,6)) AS cost_usd, cast(0 AS DECIMAL(18,4)) AS usage_quantity, '' AS usage_unit
FROM (SELECT {ACCOUNT_KEYS}, cast(date_trunc('month', date) AS DATE) AS date, service, sum(cost_usd) AS s
  FROM usage_lines WHERE date >= DATE '2001-03-01' AND date < {D}
  GROUP BY {ACCOUNT_KEYS}, cast(date_trunc('month', date) AS DATE), service)
WHERE s <> 0""",
    "accounts": f"""
SELECT tenant_id, aws_account_id, CASE WHEN right(aws_account_id, 1) = '7' THEN '' ELSE concat('team-', aws_account_id) END AS account_alias,
  DATE '2001-01-01' + cast(n * 3 AS INTEGER) AS created_at
FROM (SELECT tenant_id, n, lpad(cast(n AS VARCHAR), 12, '0') AS aws_account_id FROM
  (SELECT tenant_id, (list_position({TENANT_LIST}, tenant_id) - 1) * 4 + unnest([0, 1, 2, 3]) AS n
   FROM (SELECT DISTINCT c_mktsegment AS tenant_id FROM customer)))""",
    "budgets": f"""
SELECT id, tenant_id, aws_account_id, 'Budget ' || id AS name, service_group, region, limit_usd,
  CASE WHEN substr(sha256(id), 2, 1) < '8' THEN 'monthly' WHEN substr(sha256(id), 2, 1) < 'c' THEN 'weekly' ELSE 'daily' END AS period,
  80 AS alert_at_pct, substr(sha256(id), 1, 1) >= '2' AS is_active,
  DATE '2001-01-01' + ascii(substr(sha256(id), 3, 1)) AS created_at
FROM (SELECT *, 'b/' || tenant_id || '/' || {STAR} || '/' || factor AS id FROM (
  SELECT tenant_id, aws_account_id, service_group, region, factor,
    cast(round(cast(spend AS DECIMAL(24,6)) * cast(factor AS DECIMAL(4,2)), 2) AS DECIMAL(24,2)) AS limit_usd
  FROM (SELECT tenant_id, aws_account_id, service_group, region, sum(cost_usd) AS spend, unnest(['0.40', '0.55', '1.00']) AS factor
    FROM cost_records WHERE date >= DATE '2001-08-01' AND date < DATE '2001-09-01'
    GROUP BY GROUPING SETS ({BUDGET_SETS}))
  UNION ALL
  SELECT tenant_id, NULL, NULL, region, '0.00', CASE WHEN region = 'nowhere-1' THEN 100 ELSE 0 END
  FROM (SELECT DISTINCT c_mktsegment AS tenant_id, unnest(['nowhere-1', 'us-east-1']) AS region FROM customer)))""",
    # Spend of every budget the way the rule is worded: a theta join. tenant scope.
    "tenant_status": f"""
SELECT b.id AS budget_id, b.name AS budget_name, b.tenant_id, b.aws_account_id, b.aws_account_id AS evaluated_account,
  b.service_group, b.region, b.period, b.is_active, b.limit_usd, as_of, alert_at_pct,
  coalesce(sum(s.cost_usd), 0) AS current_usd
FROM budgets b CROSS JOIN (SELECT unnest([{P}, {D}]) AS as_of) d
LEFT JOIN cost_records s ON s.tenant_id = b.tenant_id AND s.date >= date_trunc('month', as_of) AND s.date < as_of
  AND (b.aws_account_id IS NULL OR s.aws_account_id = b.aws_account_id)
  AND (b.service_group IS NULL OR s.service_group = b.service_group)
  AND (b.region IS NULL OR s.region = b.region)
GROUP BY ALL""",
    # A NULL account is evaluated for each account of the tenant on its own.
    "account_status": f"""
SELECT b.id AS budget_id, b.name AS budget_name, b.tenant_id, b.aws_account_id, b.evaluated_account,
  b.service_group, b.region, b.period, b.limit_usd, b.alert_at_pct, coalesce(sum(s.cost_usd), 0) AS current_usd
FROM (SELECT x.*, a.aws_account_id AS evaluated_account FROM budgets x JOIN accounts a ON a.tenant_id = x.tenant_id
        AND (x.aws_account_id IS NULL OR x.aws_account_id = a.aws_account_id) WHERE x.is_active) b
LEFT JOIN cost_records s ON s.tenant_id = b.tenant_id AND s.aws_account_id = b.evaluated_account
  AND s.date >= DATE '2001-09-01' AND s.date < {D}
  AND (b.service_group IS NULL OR s.service_group = b.service_group)
  AND (b.region IS NULL OR s.region = b.region)
GROUP BY ALL""",
    "prior_alerts": f"""
SELECT substr(sha256(concat_ws('|', 'alert', tenant_id, budget_id, coalesce(aws_account_id, '-'), 'budget_threshold',
    'Budget threshold: ' || budget_name, '{sample.PRIOR_AS_OF} 00:00:00')), 1, 32) AS id,
  tenant_id, budget_id, budget_name, aws_account_id, pct, current_usd, limit_usd,
  CASE WHEN pct >= 100 THEN 'critical' ELSE 'warning' END AS severity
FROM (SELECT *, CASE WHEN limit_usd > 0 THEN current_usd::DOUBLE / limit_usd::DOUBLE * 100 ELSE 0 END AS pct
  FROM tenant_status WHERE is_active AND as_of = {P}) WHERE pct >= alert_at_pct""",
    "stored_alerts": f"""
SELECT *, CASE WHEN substr(id, 1, 1) < 'a' THEN 'firing' WHEN substr(id, 1, 1) < 'd' THEN 'resolved' ELSE 'acknowledged' END AS state,
  cast({P} - 31 + ascii(substr(id, 2, 1)) % 30 AS TIMESTAMP) AS triggered_at
FROM prior_alerts""",
    "utilization": f"""
SELECT {event_tenant()} AS tenant_id, {event_account()} AS aws_account_id, 'i-' || user_id AS resource_id,
  {values(sample.RESOURCE_TYPES)}[1 + user_id % 4] AS resource_type,
  ['compute', 'database', 'storage', 'storage'][1 + user_id % 4] AS service_group,
  {values(sample.REGIONS[:4])}[1 + user_id % 3] AS region, 'res-' || user_id AS name, ts,
  cast(round(value / 10, 6) AS DECIMAL(12,6)) AS cpu_pct, cast(least(round(value / 5, 6), 100) AS DECIMAL(12,6)) AS memory_pct,
  CASE WHEN user_id % 17 <> 0 THEN cast(user_id * 1.25 AS DECIMAL(24,2)) END AS monthly_cost_usd
FROM events WHERE NOT (user_id % 11 = 0 AND ts < TIMESTAMP '2024-01-20 00:00:00')""",
    "inventory": f"""
SELECT *, CASE WHEN cpu IS NULL THEN 'stopped' WHEN is_idle THEN 'idle' ELSE 'running' END AS state,
  round(cpu, 2) AS cpu_avg_pct, round(mem, 2) AS memory_avg_pct FROM (
SELECT *, coalesce(cpu < 5, false) AND first_seen <= {E} - 14 AS is_idle FROM (
SELECT tenant_id, aws_account_id, resource_id, resource_type, service_group, region, name, monthly_cost_usd,
  sum(cpu_pct) FILTER (WHERE ts >= {E} - 14)::DOUBLE / nullif(count(cpu_pct) FILTER (WHERE ts >= {E} - 14), 0) AS cpu,
  sum(memory_pct) FILTER (WHERE ts >= {E} - 14)::DOUBLE / nullif(count(memory_pct) FILTER (WHERE ts >= {E} - 14), 0) AS mem,
  cast(min(ts) AS DATE) AS first_seen, max(ts) AS last_seen_at
FROM utilization WHERE ts < {E} GROUP BY ALL))""",
    "tagged_lines": f"""
SELECT event_id, {event_tenant()} AS tenant_id, {event_account()} AS aws_account_id, event_type AS service,
  cast(ts AS DATE) AS date, ts, cast(value AS DECIMAL(18,6)) AS cost_usd,
  CASE WHEN event_id % 5 = 0 THEN '{{}}' ELSE props END AS tags_json
FROM events""",
    "agent_log": f"""
SELECT *, input_tokens + output_tokens AS tokens_used, cast(round((input_tokens * cast(i AS DECIMAL(6,2))
    + output_tokens * cast(o AS DECIMAL(6,2))) * 0.000001, 6) AS DECIMAL(18,6)) AS cost_usd FROM (
SELECT *, CASE WHEN api_model LIKE '%claude%' THEN 3 WHEN api_model LIKE '%gpt-4o%' THEN 2.5 WHEN api_model LIKE '%gpt-4%' THEN 30 ELSE 0.5 END AS i,
  CASE WHEN api_model LIKE '%claude%' THEN 15 WHEN api_model LIKE '%gpt-4o%' THEN 10 WHEN api_model LIKE '%gpt-4%' THEN 60 ELSE 1.5 END AS o FROM (
SELECT event_id AS run_no, {event_tenant()} AS tenant_id,
  ['optimizer', 'anomaly', 'nlq', 'forecaster', 'reporter', 'analyzer'][1 + event_id % 6] AS agent_type,
  ['scheduled', 'manual', 'webhook', 'event'][1 + event_id % 4] AS trigger_type,
  ['success', 'success', 'error', 'pending', 'timeout'][1 + user_id % 5] AS status,
  ['claude-3-5-sonnet-20241022', 'gpt-4o-mini', 'gpt-4-turbo', 'gpt-3.5-turbo'][1 + event_id % 4] AS api_model,
  cast(floor(value * 10) AS BIGINT) AS input_tokens, cast(floor(value * 4) AS BIGINT) AS output_tokens, props, ts AS started_at
FROM events))""",
    "jobs": f"""
SELECT o_orderkey AS job_id, {event_tenant('o_custkey')} AS tenant_id, {event_account('o_custkey')} AS aws_account_id,
  CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'running' ELSE 'error' END AS status,
  cast(floor(o_totalprice / 100) AS BIGINT) AS records_pulled,
  CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'Unexpected: ' || o_orderpriority || '; retry later' END AS message,
  o_orderdate AS started_at,
  CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + to_minutes(o_custkey % 60) END AS completed_at
FROM orders""",
    # The seven current and ninety baseline days of the anomaly detectors.
    "recent_days": f"""
SELECT *, date >= {D} - 7 AS is_cur FROM cost_records WHERE date >= {D} - 97 AND date < {D}""",
    "anomaly_list": f"""
SELECT tenant_id, aws_account_id, 'spend_spike' AS anomaly_type,
  CASE WHEN pct < 100 THEN 'info' WHEN pct < 200 THEN 'warning' ELSE 'critical' END AS severity,
  service, NULL AS region, {exact_div('c', '7', 2)} AS current_value, {exact_div('b', '90', 2)} AS baseline_value,
  pct AS percent_change, service || ' daily spend is above its 90-day mean' AS description
FROM (SELECT *, (c::DOUBLE / 7 - b::DOUBLE / 90) / (b::DOUBLE / 90) * 100 AS pct FROM (
  SELECT tenant_id, aws_account_id, service, sum(cost_usd) FILTER (WHERE is_cur) AS c,
    sum(cost_usd) FILTER (WHERE NOT is_cur) AS b FROM recent_days GROUP BY ALL) WHERE b > 0)
WHERE pct > 50
UNION ALL
SELECT c.tenant_id, c.aws_account_id, 'new_service', 'info', c.service, NULL, {exact_div('sum(cost_usd)', '7', 2)}, 0, 0,
  c.service || ' was not used in the 90 days before'
FROM recent_days c WHERE is_cur AND NOT EXISTS (SELECT 1 FROM recent_days p WHERE NOT p.is_cur AND p.tenant_id = c.tenant_id
  AND p.aws_account_id = c.aws_account_id AND p.service = c.service)
GROUP BY c.tenant_id, c.aws_account_id, c.service HAVING sum(cost_usd) > 0
UNION ALL
SELECT tenant_id, aws_account_id, 'regional_shift', CASE WHEN abs(cs - bs) < 20 THEN 'info' ELSE 'warning' END, NULL, region,
  {exact_div('c', '7', 2)}, {exact_div('b', '90', 2)}, cs - bs, 'Share of ' || region || ' in account spend shifted'
FROM (SELECT r.*, c::DOUBLE / ac * 100 AS cs, b::DOUBLE / ab * 100 AS bs FROM (
    SELECT tenant_id, aws_account_id, region, coalesce(sum(cost_usd) FILTER (WHERE is_cur), 0) AS c,
      coalesce(sum(cost_usd) FILTER (WHERE NOT is_cur), 0) AS b FROM recent_days GROUP BY ALL) r
  JOIN (SELECT tenant_id, aws_account_id, sum(cost_usd) FILTER (WHERE is_cur)::DOUBLE AS ac,
      sum(cost_usd) FILTER (WHERE NOT is_cur)::DOUBLE AS ab FROM recent_days GROUP BY ALL) a USING (tenant_id, aws_account_id)
  WHERE ac > 0 AND ab > 0)
WHERE abs(cs - bs) >= 10
UNION ALL
SELECT tenant_id, aws_account_id, 'unusual_pattern', CASE WHEN abs(z) < 6 THEN 'warning' ELSE 'critical' END, NULL, NULL,
  cast(round(t, 2) AS DECIMAL(24,2)), {exact_div('s', 'n', 2)}, (t::DOUBLE - m) / m * 100,
  'Spend of ' || cast(date AS VARCHAR) || ' is unusual for its weekday'
FROM (SELECT d.*, m, w.s, w.n, (t::DOUBLE - m) / sd AS z FROM day_totals d JOIN weekday_baseline w USING (tenant_id, aws_account_id)
  WHERE d.is_cur AND w.wd = dayofweek(d.date) AND n >= 4 AND sd > 0)
WHERE abs(z) >= 3""",
    "day_totals": """
SELECT tenant_id, aws_account_id, date, is_cur, sum(cost_usd) AS t FROM recent_days GROUP BY ALL""",
    "weekday_baseline": """
SELECT tenant_id, aws_account_id, dayofweek(date) AS wd, sum(t) AS s, avg(t::DOUBLE) AS m, stddev_samp(t::DOUBLE) AS sd, count(*) AS n
FROM day_totals WHERE NOT is_cur GROUP BY ALL""",
    # Sixty days of account totals on a full calendar.
    "series": f"""
SELECT a.tenant_id, a.aws_account_id, c.date, c.x, coalesce(s.t, 0) AS total, coalesce(s.t, 0)::DOUBLE AS y
FROM (SELECT DISTINCT tenant_id, aws_account_id FROM cost_records WHERE date >= {D} - 60 AND date < {D}) a
CROSS JOIN (SELECT {D} - 60 + i AS date, i AS x FROM (SELECT unnest(range(60))::INTEGER AS i)) c
LEFT JOIN (SELECT tenant_id, aws_account_id, date, sum(cost_usd) AS t FROM cost_records GROUP BY ALL) s
  ON s.tenant_id = a.tenant_id AND s.aws_account_id = a.aws_account_id AND s.date = c.date""",
    "future": f"""
SELECT {D} + i AS date, 60 + i AS x FROM (SELECT unnest(range(16))::INTEGER AS i)""",
    "fits": """
SELECT tenant_id, aws_account_id, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_r2(y, x) AS r2,
  regr_slope(ln(yp), x) AS lb, regr_intercept(ln(yp), x) AS la,
  regr_r2(ln(yp), x) AS lr2, count(yp) AS positive_days, stddev_samp(y) AS sd, avg(y) AS mean, sum(total) AS s,
  cast(sum(total) FILTER (WHERE date >= DATE '2001-09-01') AS DECIMAL(28,6)) AS mtd
FROM (SELECT *, CASE WHEN y > 0 THEN y END AS yp FROM series) GROUP BY tenant_id, aws_account_id""",
    "forecasts": """
SELECT tenant_id, aws_account_id, 'linear' AS method, any_value(mtd) AS mtd_usd,
  round(any_value(mtd)::DOUBLE + sum(greatest(0, a + b * x)), 4) AS projected_month_end_usd,
  round(greatest(0, least(1, any_value(r2))), 4) AS confidence_level
FROM fits CROSS JOIN future GROUP BY tenant_id, aws_account_id
UNION ALL
SELECT tenant_id, aws_account_id, 'exponential', any_value(mtd), round(any_value(mtd)::DOUBLE + sum(exp(la + lb * x)), 4),
  round(greatest(0, least(1, any_value(lr2))), 4)
FROM fits CROSS JOIN future WHERE positive_days >= 2 GROUP BY tenant_id, aws_account_id
UNION ALL
SELECT f.tenant_id, f.aws_account_id, 'seasonal', any_value(f.mtd), round(any_value(f.mtd)::DOUBLE + sum(w.m), 4),
  round(greatest(0, least(1, any_value(v.r2))), 4)
FROM fits f CROSS JOIN future d
JOIN (SELECT tenant_id, aws_account_id, dayofweek(date) AS wd, avg(y) AS m FROM series GROUP BY ALL) w
  ON w.tenant_id = f.tenant_id AND w.aws_account_id = f.aws_account_id AND w.wd = dayofweek(d.date)
JOIN (SELECT s.tenant_id, s.aws_account_id, 1 - sum((y - m) * (y - m)) / (var_pop(y) * count(*)) AS r2
      FROM series s JOIN (SELECT tenant_id, aws_account_id, dayofweek(date) AS wd, avg(y) AS m FROM series GROUP BY ALL) g
        ON g.tenant_id = s.tenant_id AND g.aws_account_id = s.aws_account_id AND g.wd = dayofweek(s.date)
      GROUP BY s.tenant_id, s.aws_account_id) v
  ON v.tenant_id = f.tenant_id AND v.aws_account_id = f.aws_account_id
GROUP BY f.tenant_id, f.aws_account_id""",
    "breaches": """
SELECT p.tenant_id, p.aws_account_id, bu.id AS budget_id, any_value(p.mtd) AS mtd_usd,
  round(max(cum), 4) AS projected_month_end_usd,
  coalesce(nullif(any_value(bu.limit_usd), 0), 10000)::DECIMAL(24,2) AS budget_limit,
  round(CASE WHEN any_value(sd) > 0 THEN 1 / (1 + exp(-1.702 * (max(cum) - coalesce(nullif(any_value(bu.limit_usd), 0), 10000)::DOUBLE)
      / (any_value(sd) * sqrt(16)))) WHEN max(cum) >= coalesce(nullif(any_value(bu.limit_usd), 0), 10000) THEN 1 ELSE 0 END, 4) AS budget_breach_probability,
  CASE WHEN any_value(p.mtd) >= coalesce(nullif(any_value(bu.limit_usd), 0), 10000) THEN 0
       ELSE min(x - 59) FILTER (WHERE cum >= coalesce(nullif(bu.limit_usd, 0), 10000)::DOUBLE) END::INTEGER AS days_to_breach
FROM (SELECT f.*, x, mtd::DOUBLE + sum(greatest(0, a + b * x)) OVER (PARTITION BY tenant_id, aws_account_id ORDER BY x) AS cum
      FROM fits f CROSS JOIN future) p
LEFT JOIN (SELECT * FROM budgets WHERE is_active AND aws_account_id IS NOT NULL AND service_group IS NULL AND region IS NULL) bu
  ON bu.tenant_id = p.tenant_id AND bu.aws_account_id = p.aws_account_id
GROUP BY p.tenant_id, p.aws_account_id, bu.id""",
    "churn": f"""
SELECT coalesce(c.tenant_id, p.tenant_id) AS tenant_id, coalesce(c.aws_account_id, p.aws_account_id) AS aws_account_id,
  coalesce(c.service, p.service) AS service, CASE WHEN p.service IS NULL THEN 'started' ELSE 'stopped' END AS change,
  cast(round(coalesce(c.t, p.t), 2) AS DECIMAL(24,2)) AS spend_usd
FROM (SELECT tenant_id, aws_account_id, service, sum(cost_usd) AS t FROM cost_records WHERE date >= {D} - 30 AND date < {D} GROUP BY ALL) c
FULL JOIN (SELECT tenant_id, aws_account_id, service, sum(cost_usd) AS t FROM cost_records WHERE date >= {D} - 60 AND date < {D} - 30 GROUP BY ALL) p
  ON c.tenant_id = p.tenant_id AND c.aws_account_id = p.aws_account_id AND c.service = p.service
WHERE c.service IS NULL OR p.service IS NULL""",
    "recs": """
SELECT tenant_id, aws_account_id, 'stop_idle_resource' AS recommendation_type, 'Stop idle resource ' || resource_id AS title,
  cast(round(coalesce(monthly_cost_usd, 0), 2) AS DECIMAL(24,2)) AS savings, cast(0.9 AS DECIMAL(3,2)) AS confidence_score
FROM inventory WHERE is_idle
UNION ALL
SELECT tenant_id, aws_account_id, 'rightsizing', 'Downsize ' || resource_id, cast(round(monthly_cost_usd * 0.5, 2) AS DECIMAL(24,2)), 0.7
FROM (SELECT *, percent_rank() OVER (PARTITION BY tenant_id ORDER BY monthly_cost_usd) AS pr FROM inventory WHERE monthly_cost_usd IS NOT NULL)
WHERE pr >= 0.5 AND NOT is_idle AND cpu_avg_pct < 20 AND memory_avg_pct < 40
UNION ALL
SELECT tenant_id, aws_account_id, 'unused_service', 'Remove unused service ' || service, 0, 0.6 FROM churn WHERE change = 'stopped'""",
    "event_anomalies": """
SELECT aws_account_id || ':' || cast(date AS VARCHAR) AS anomaly_id, aws_account_id,
  cast(date AS TIMESTAMP) AS start_at, cast(date AS TIMESTAMP) + INTERVAL 24 HOUR AS end_at
FROM (SELECT aws_account_id, date, sum(cost_usd) AS t FROM tagged_lines GROUP BY ALL) d
JOIN (SELECT aws_account_id, sum(cost_usd) AS whole, count(DISTINCT date) AS days FROM tagged_lines GROUP BY ALL) a USING (aws_account_id)
WHERE t * days * 2 > whole * 3""",
    "changes": f"""
SELECT event_id AS change_id, {event_account()} AS aws_account_id, 'i-' || user_id AS resource_id,
  CASE WHEN event_type = 'signup' THEN 'created' ELSE 'terminated' END AS action, ts AS changed_at
FROM events WHERE event_type IN ('signup', 'error')""",
}
# The same a week earlier, in the same month.
VIEWS["account_status_prior"] = VIEWS["account_status"].replace(f"s.date < {D}", f"s.date < {P}")
