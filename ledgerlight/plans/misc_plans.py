"""Agent log, jobs, caches, quality checks, root causes, anomaly and run tables."""

from pyspark.sql import functions as F

from ..operators import agents as AG
from ..operators import anomaly as A
from ..operators import jobs as J
from ..operators import quality as Q
from ..operators import rootcause as RC
from ..operators import tags as TG
from ..schemas import DOMAINS
from ..sinks import agent_runs_table, anomalies_table
from ..sources import sample
from ..sources.sample import AS_OF, EVENTS_AS_OF
from .budget_plans import stamp
from .cost_plans import ANOMALY_SQL
from .registry import query
from .resource_plans import inventory
from .views import D, E


@query(
    "llm_spend",
    """SELECT tenant_id, agent_type, api_model, status, count(*) AS runs, cast(sum(tokens_used) AS BIGINT) AS tokens_used,
  cast(sum(cost_usd) AS DECIMAL(24,6)) AS cost_usd FROM agent_log GROUP BY 1, 2, 3, 4""",
)
def llm_spend(spark, sf):
    return AG.agent_spend(sample.agent_runs(spark, sf))


@query(
    "agent_runs_table",
    f"""SELECT substr(sha256(concat_ws('|', 'run', tenant_id, agent_type, cast(run_no AS VARCHAR))), 1, 32) AS id, tenant_id, agent_type,
  trigger_type, status, coalesce(props, '{{}}') AS input_data, '{{}}' AS output_data, api_model, tokens_used, cost_usd, started_at,
  CASE WHEN status <> 'pending' THEN cast({E} AS TIMESTAMP) END AS completed_at FROM agent_log""",
)
def agent_runs(spark, sf):
    return agent_runs_table(sample.agent_runs(spark, sf), stamp(EVENTS_AS_OF))


BODY = """trim(CASE WHEN contains(response_text, '```json') THEN string_split(string_split(response_text, '```json')[2], '```')[1]
  WHEN contains(response_text, '```') THEN string_split(response_text, '```')[2] ELSE response_text END, E' \\n\\t\\r')"""


@query(
    "fenced_json_extract",
    f"""SELECT event_id, json_text, CASE WHEN json_valid(json_text) THEN cast(json(json_text) AS VARCHAR) END AS parsed,
  json_valid(json_text) AS success, CASE WHEN NOT json_valid(json_text) THEN response_text END AS raw_response
FROM (SELECT *, {BODY} AS json_text FROM (
  SELECT event_id, CASE event_id % 4 WHEN 0 THEN E'Here:\\n```json\\n' || props || E'\\n```' WHEN 1 THEN E'```\\n' || props || E'\\n``` done'
    WHEN 2 THEN '  ' || props || E'\\n' ELSE E'```json\\n{{"k": \\n' END AS response_text FROM events))""",
)
def fenced_json_extract(spark, sf):
    return AG.fenced_json_extract(sample.agent_responses(spark, sf)).drop("response_text")


@query(
    "cache_key_ttl",
    f"""SELECT event_id, sha256('{{"account": "' || user_id || '", "service": "' || event_type || '"}}') AS cache_key
FROM events WHERE ts + to_hours(event_id % 48) > TIMESTAMP '2024-01-15 00:00:00'""",
)
def cache_key_ttl(spark, sf):
    live = AG.live_cache(sample.query_cache(spark, sf), stamp("2024-01-15"))
    return AG.with_cache_key(live).select("event_id", "cache_key")


@query(
    "ingestion_job_health",
    """SELECT tenant_id, aws_account_id, count(*) AS runs, count(*) FILTER (WHERE status = 'success') AS succeeded,
  count(*) FILTER (WHERE status = 'error') AS failed,
  round(count(*) FILTER (WHERE status = 'success') / nullif(count(*) FILTER (WHERE status <> 'running'), 0) * 100, 4) AS success_pct,
  cast(sum(records_pulled) AS BIGINT) AS records_pulled, cast(sum(epoch(completed_at) - epoch(started_at)) AS BIGINT) AS total_seconds,
  arg_max(message, (started_at, job_id)) FILTER (WHERE status = 'error') AS last_error,
  arg_max(job_id, (started_at, job_id)) FILTER (WHERE status = 'error') AS last_error_job
FROM jobs GROUP BY 1, 2""",
)
def ingestion_job_health(spark, sf):
    return J.ingestion_job_health(sample.ingestion_jobs(spark, sf))


@query(
    "account_sync_status",
    """SELECT a.tenant_id, a.aws_account_id, CASE WHEN j.status IS NULL THEN 'pending' WHEN j.status = 'success' THEN 'active' ELSE 'error' END AS status,
  CASE WHEN j.status = 'success' THEN j.completed_at END AS last_synced_at, CASE WHEN j.status = 'error' THEN j.message END AS last_error
FROM accounts a LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, aws_account_id ORDER BY completed_at DESC, job_id DESC) AS rn
  FROM jobs WHERE status <> 'running') WHERE rn = 1) j ON j.tenant_id = a.tenant_id AND j.aws_account_id = a.aws_account_id""",
)
def account_sync_status(spark, sf):
    return J.account_sync_status(sample.accounts(spark, sf), sample.ingestion_jobs(spark, sf))


SLOT = ["tenant_id", "aws_account_id", "date", "service", "region"]


@query(
    "key_violations",
    f"""SELECT 'cost_records.id unique' AS check_name, count(*) AS violations FROM (SELECT id FROM cost_records GROUP BY id HAVING count(*) > 1)
UNION ALL SELECT 'one row per slot', count(*) FROM (SELECT 1 FROM cost_records GROUP BY {', '.join(SLOT)} HAVING count(*) > 1)
UNION ALL SELECT 'usage line key unique', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
UNION ALL SELECT 'account once per tenant', count(*) FROM (SELECT 1 FROM accounts GROUP BY tenant_id, aws_account_id HAVING count(*) > 1)
UNION ALL SELECT 'resource once per account', count(*) FROM (SELECT 1 FROM inventory GROUP BY aws_account_id, resource_id HAVING count(*) > 1)
UNION ALL SELECT 'service group known', count(*) FROM cost_records WHERE service_group NOT IN ({', '.join(repr(g) for g in DOMAINS['service_group'])})
UNION ALL SELECT 'run status known', count(*) FROM agent_log WHERE status NOT IN ({', '.join(repr(g) for g in DOMAINS['run_status'])})
UNION ALL SELECT 'job status known', count(*) FROM jobs WHERE status NOT IN ('success', 'error')""",
)
def key_violations(spark, sf):
    costs = sample.cost_records(spark, sf)
    lines = sample.table(spark, sf, "lineitem")
    return Q.key_violations(
        [
            Q.duplicate_keys(costs, ["id"], "cost_records.id unique"),
            Q.duplicate_keys(costs, SLOT, "one row per slot"),
            Q.duplicate_keys(lines, ["l_orderkey", "l_linenumber"], "usage line key unique"),
            Q.duplicate_keys(sample.accounts(spark, sf), ["tenant_id", "aws_account_id"], "account once per tenant"),
            Q.duplicate_keys(inventory(spark, sf), ["aws_account_id", "resource_id"], "resource once per account"),
            Q.outside_domain(costs, "service_group", DOMAINS["service_group"], "service group known"),
            Q.outside_domain(sample.agent_runs(spark, sf), "status", DOMAINS["run_status"], "run status known"),
            Q.outside_domain(sample.ingestion_jobs(spark, sf), "status", ["success", "error"], "job status known"),
        ]
    )


@query(
    "anomalies_table",
    f"""SELECT tenant_id, aws_account_id, anomaly_type, severity, service, region, current_value, baseline_value, percent_change, description,
  '' AS suspected_cause, 'firing' AS state, cast({D} AS TIMESTAMP) AS triggered_at FROM ({ANOMALY_SQL})""",
)
def anomalies_table_query(spark, sf):
    events = A.anomaly_events(sample.cost_records(spark, sf), AS_OF).withColumn(
        "suspected_cause", F.lit(None).cast("string")
    )
    return anomalies_table(events, stamp(AS_OF))


TAG = "json_extract_string(tags_json, '$.k')"
BY_TAG = "tenant_id, aws_account_id, service, coalesce(" + TAG + ", '(untagged)') AS tag_value"


@query(
    "rca_contribution_by_tag",
    f"""SELECT s.tenant_id, s.aws_account_id, service, tag_value, cast(round(c, 2) AS DECIMAL(24,2)) AS current_usd,
  cast(round(p, 2) AS DECIMAL(24,2)) AS previous_usd, cast(round(c - p, 2) AS DECIMAL(24,2)) AS delta_usd,
  CASE WHEN a <> 0 THEN round((c - p)::DOUBLE / a::DOUBLE * 100, 4) END AS share_pct
FROM (SELECT {BY_TAG}, coalesce(sum(cost_usd) FILTER (WHERE date >= {E} - 15), 0) AS c,
    coalesce(sum(cost_usd) FILTER (WHERE date < {E} - 15), 0) AS p FROM tagged_lines WHERE date >= {E} - 30 AND date < {E} GROUP BY ALL) s
JOIN (SELECT tenant_id, aws_account_id, sum(CASE WHEN date >= {E} - 15 THEN cost_usd ELSE -cost_usd END) AS a
    FROM tagged_lines WHERE date >= {E} - 30 AND date < {E} GROUP BY ALL) w
  ON w.tenant_id = s.tenant_id AND w.aws_account_id = s.aws_account_id""",
)
def rca_contribution_by_tag(spark, sf):
    tagged = TG.tag_extract(sample.tagged_lines(spark, sf), "k").select(
        "tenant_id", "aws_account_id", "service", "date", "cost_usd",
        F.coalesce("tag_value", F.lit(TG.UNTAGGED)).alias("tag_value"), F.lit("DAILY").alias("granularity"),
    )
    return RC.rca_contribution(tagged, EVENTS_AS_OF, 15, by=("service", "tag_value"))


def event_anomalies(spark, sf):
    """Account days that cost more than one and a half times the account's mean day."""
    daily = (
        sample.tagged_lines(spark, sf).groupBy("aws_account_id", "date").agg(F.sum("cost_usd").cast("decimal(24,6)").alias("t"))
    )
    mean = daily.groupBy("aws_account_id").agg(
        F.sum("t").cast("decimal(24,6)").alias("whole"), F.count("*").cast("int").alias("days")
    )
    start = F.col("date").cast("timestamp_ntz")
    return (
        daily.join(mean, "aws_account_id")
        .where(F.col("t") * F.col("days") * 2 > F.col("whole") * 3)
        .select(
            F.concat("aws_account_id", F.lit(":"), F.col("date").cast("string")).alias("anomaly_id"),
            "aws_account_id", start.alias("start_at"), (start + F.expr("interval 24 hours")).alias("end_at"),
        )
    )


@query(
    "rca_change_correlation",
    """SELECT anomaly_id, aws_account_id, change_id, resource_id, action, changed_at, lag_minutes,
  rank() OVER (PARTITION BY anomaly_id ORDER BY abs(lag_minutes)) AS closeness_rank
FROM (SELECT a.anomaly_id, c.*, cast(floor((epoch_us(a.start_at) - epoch_us(c.changed_at)) / 60000000.0) AS BIGINT) AS lag_minutes
  FROM event_anomalies a JOIN changes c ON c.aws_account_id = a.aws_account_id
    AND c.changed_at >= a.start_at - INTERVAL 60 MINUTE AND c.changed_at <= a.end_at)""",
)
def rca_change_correlation(spark, sf):
    return RC.rca_change_correlation(event_anomalies(spark, sf), sample.resource_changes(spark, sf))


@query(
    "rca_top_changes",
    """SELECT * EXCLUDE (n) FROM (SELECT anomaly_id, aws_account_id, change_id, resource_id, action, changed_at, lag_minutes,
  rank() OVER (PARTITION BY anomaly_id ORDER BY abs(lag_minutes)) AS closeness_rank,
  row_number() OVER (PARTITION BY anomaly_id ORDER BY abs(lag_minutes), change_id) AS n
FROM (SELECT a.anomaly_id, c.*, cast(floor((epoch_us(a.start_at) - epoch_us(c.changed_at)) / 60000000.0) AS BIGINT) AS lag_minutes
  FROM event_anomalies a JOIN changes c ON c.aws_account_id = a.aws_account_id
    AND c.changed_at >= a.start_at - INTERVAL 60 MINUTE AND c.changed_at <= TIMESTAMP '2024-12-31 00:00:00')) WHERE n <= 5""",
)
def rca_top_changes(spark, sf):
    """The five closest changes of anomalies that are still open at the end of the year."""
    still_open = event_anomalies(spark, sf).withColumn("end_at", F.lit(None).cast("timestamp_ntz"))
    return RC.rca_change_correlation(still_open, sample.resource_changes(spark, sf), as_of="2024-12-31", top=5)


@query(
    "rca_change_sessions",
    """SELECT aws_account_id, min(changed_at) AS started_at, max(changed_at) + INTERVAL 30 MINUTE AS ended_at, count(*) AS changes FROM (
SELECT *, sum(CASE WHEN changed_at - prev < INTERVAL 30 MINUTE THEN 0 ELSE 1 END) OVER (PARTITION BY aws_account_id ORDER BY changed_at, change_id) AS s
FROM (SELECT *, lag(changed_at) OVER (PARTITION BY aws_account_id ORDER BY changed_at, change_id) AS prev FROM changes))
GROUP BY aws_account_id, s""",
)
def rca_change_sessions(spark, sf):
    return RC.change_sessions(sample.resource_changes(spark, sf))
