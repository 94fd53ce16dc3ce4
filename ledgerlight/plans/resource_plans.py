"""Inventory, overview, recommendations, tags."""

from pyspark.sql import functions as F

from ..functions.dates import days_before
from ..operators import insights as IN
from ..operators import inventory as I
from ..operators import recommend as RE
from ..operators import rollups as R
from ..operators import tags as TG
from ..sinks import carried, carry, materialise, recommendations_table, run_dir
from ..sinks.tables import recommendation_rows
from ..sources import sample, tables
from ..sources.sample import AS_OF, EVENTS_AS_OF
from .budget_plans import stamp
from .registry import query
from .views import D


def inventory(spark, sf):
    return I.resource_inventory(sample.resource_utilization(spark, sf), EVENTS_AS_OF)


def inventory_table(spark, sf):
    """The inventory as the stored snapshot it is, for plans that read it several times."""
    return materialise(inventory(spark, sf), "inventory")


INV = [
    "tenant_id", "aws_account_id", "resource_id", "resource_type", "service_group", "region", "name", "state",
    "monthly_cost_usd", "cpu_avg_pct", "memory_avg_pct", "is_idle",
]
COST = "cast(sum(coalesce(monthly_cost_usd, 0)) AS DECIMAL(28,6))"


@query("resource_idle_flags", f"SELECT {', '.join(INV)}, last_seen_at FROM inventory")
def resource_idle_flags(spark, sf):
    return inventory(spark, sf).select(*INV, "last_seen_at")


@query("resource_idle_flags_daily", f"SELECT {', '.join(INV)}, last_seen_at FROM inventory")
def resource_idle_flags_daily(spark, sf):
    """The same from rings that were made a week ago and carried on day by day."""
    samples, path = sample.resource_utilization(spark, sf), run_dir(spark, "rings")
    rings = I.resource_rings(samples, days_before(EVENTS_AS_OF, 7))
    carry(rings, path, 0)
    for run in range(1, 8):
        last = carried(spark, path, rings.schema, run)
        carry(I.advance_rings(last, samples, days_before(EVENTS_AS_OF, 8 - run)), path, run)
    now = carried(spark, path, rings.schema, 8)
    return I.inventory_from_rings(now, EVENTS_AS_OF).select(*INV, "last_seen_at")


@query("scan_inventory", f"SELECT {', '.join(INV)} FROM inventory WHERE is_idle")
def scan_inventory(spark, sf):
    return tables.scan_inventory(inventory(spark, sf), idle_only=True).select(*INV)


SUMMARY = f"""SELECT tenant_id, count(*) AS total_resources, {COST} AS total_monthly_cost_usd,
  count(*) FILTER (WHERE is_idle) AS idle_resources FROM inventory GROUP BY tenant_id"""


@query("inventory_summary", SUMMARY)
def inventory_summary(spark, sf):
    return I.inventory_summary(inventory(spark, sf))


@query("inventory_by_type", f"SELECT tenant_id, resource_type, count(*) AS count, {COST} AS monthly_cost_usd FROM inventory GROUP BY 1, 2")
def inventory_by_type(spark, sf):
    return I.inventory_by_type(inventory(spark, sf))


@query(
    "inventory_by_service_group",
    f"SELECT tenant_id, service_group, count(*) AS count, {COST} AS monthly_cost_usd FROM inventory GROUP BY 1, 2",
)
def inventory_by_service_group(spark, sf):
    return I.inventory_by_service_group(inventory(spark, sf))


@query(
    "idle_resources",
    """SELECT tenant_id, resource_id, resource_type, name, monthly_cost_usd, cpu_avg_pct, memory_avg_pct, state FROM (
SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY monthly_cost_usd DESC NULLS FIRST, resource_id) AS rn
FROM inventory WHERE is_idle) WHERE rn <= 20""",
)
def idle_resources(spark, sf):
    return I.idle_resources(inventory(spark, sf))


def stock_json(column):
    """The list of types or groups as JSON text: most expensive first."""
    item = f"""'{{"monthly_cost_usd":' || cast(c AS VARCHAR) || ',"{column}":"' || {column} || '","count":' || n || '}}'"""
    return f"'[' || string_agg({item}, ',' ORDER BY c DESC, {column} DESC) || ']'"


SCALARS = ["tenant_id", "total_usd", "period_days", "service_count", "idle_resources", "total_resource_types"]
OVERVIEW_SQL = f"""SELECT t.tenant_id, cast(round(coalesce(t.total, 0), 2) AS DECIMAL(24,2)) AS total_usd, 30 AS period_days,
  least(20, coalesce(s.n, 0)) AS service_count, least(20, coalesce(i.idle_resources, 0)) AS idle_resources,
  least(20, coalesce(y.n, 0)) AS total_resource_types, coalesce(s.top, '[]') AS top_services, coalesce(r.top, '[]') AS top_regions,
  coalesce(i.total_resources, 0) AS total_resources, coalesce(y.n, 0) AS resource_types_total, coalesce(i.idle_resources, 0) AS idle_total,
  coalesce(s.n, 0) AS services_total, coalesce(y.by_type, '[]') AS by_type, coalesce(g.by_group, '[]') AS by_group
FROM (SELECT tenant_id, sum(cost_usd) FILTER (WHERE date >= {D} - 30) AS total FROM cost_records GROUP BY 1) t
LEFT JOIN (SELECT tenant_id, count(*) AS n, '[' || string_agg('{{"service":"' || service || '","service_group":"' || service_group
      || '","total_usd":' || cast(m AS VARCHAR) || '}}', ',' ORDER BY m DESC, c DESC, service) FILTER (WHERE rn <= 10) || ']' AS top
  FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY m DESC, c DESC, service) AS rn FROM (
    SELECT tenant_id, service, service_group, sum(cost_usd) AS c, cast(round(sum(cost_usd), 2) AS DECIMAL(24,2)) AS m
    FROM cost_records WHERE date >= {D} - 30 GROUP BY 1, 2, 3)) GROUP BY 1) s USING (tenant_id)
LEFT JOIN (SELECT tenant_id, '[' || string_agg('{{"region":"' || region || '","total_usd":' || cast(m AS VARCHAR) || '}}', ',' ORDER BY m DESC, region) || ']' AS top
  FROM (SELECT tenant_id, region, cast(round(sum(cost_usd), 2) AS DECIMAL(24,2)) AS m
    FROM cost_records WHERE date >= {D} - 30 GROUP BY 1, 2) GROUP BY 1) r USING (tenant_id)
LEFT JOIN ({SUMMARY}) i USING (tenant_id)
LEFT JOIN (SELECT tenant_id, count(*) AS n, {stock_json('resource_type')} AS by_type
  FROM (SELECT tenant_id, resource_type, count(*) AS n, {COST} AS c FROM inventory GROUP BY 1, 2) GROUP BY 1) y USING (tenant_id)
LEFT JOIN (SELECT tenant_id, {stock_json('service_group')} AS by_group
  FROM (SELECT tenant_id, service_group, count(*) AS n, {COST} AS c FROM inventory GROUP BY 1, 2) GROUP BY 1) g USING (tenant_id)"""


def overview_df(spark, sf):
    return R.build_overview(
        sample.cost_records(spark, sf), inventory(spark, sf), AS_OF, tenants=sample.accounts(spark, sf)
    )


@query("overview", OVERVIEW_SQL)
def overview(spark, sf):
    """Scalars as they are, the two lists as JSON text."""
    return overview_df(spark, sf).select(
        *SCALARS, F.to_json("top_services").alias("top_services"), F.to_json("top_regions").alias("top_regions"),
        F.col("resource_summary.total_resources").alias("total_resources"), "resource_types_total", "idle_total", "services_total",
        F.to_json("resource_summary.resources_by_type").alias("by_type"),
        F.to_json("resource_summary.resources_by_service_group").alias("by_group"),
    )


@query(
    "insights_gate",
    f"""SELECT tenant_id, total_usd, total_resource_types, NOT (total_usd <= 0 AND total_resource_types = 0) AS success,
  CASE WHEN total_usd <= 0 AND total_resource_types = 0 THEN 'no_data'
       ELSE 'ready' END AS message FROM ({OVERVIEW_SQL})""",
)
def insights_gate(spark, sf):
    return R.insights_gate(overview_df(spark, sf))


REC = ["tenant_id", "aws_account_id", "recommendation_type", "title", "estimated_savings_monthly_usd", "confidence_score"]
REC_SQL = """SELECT tenant_id, aws_account_id, recommendation_type, title, cast(savings AS DECIMAL(24,2)) AS estimated_savings_monthly_usd,
  cast(confidence_score AS DECIMAL(3,2)) AS confidence_score FROM recs"""


def rec_sql(kind):
    return f"{REC_SQL} WHERE recommendation_type = '{kind}'"


@query("rec_stop_idle", rec_sql("stop_idle_resource"))
def rec_stop_idle(spark, sf):
    return RE.rec_stop_idle(inventory(spark, sf)).select(*REC)


@query("rec_rightsizing", rec_sql("rightsizing"))
def rec_rightsizing(spark, sf):
    return RE.rec_rightsizing(inventory_table(spark, sf)).select(*REC)


@query("rec_unused_service", rec_sql("unused_service"))
def rec_unused_service(spark, sf):
    return RE.rec_unused_service(sample.cost_records(spark, sf), AS_OF).select(*REC)


def recommendations(spark, sf):
    return RE.all_recommendations(sample.cost_records(spark, sf), inventory_table(spark, sf), AS_OF)


PRIORITY_SQL = f"""SELECT *, CASE WHEN pr >= 2.0 / 3 THEN 'high' WHEN pr >= 1.0 / 3 THEN 'medium' ELSE 'low' END AS priority FROM (
SELECT *, percent_rank() OVER (PARTITION BY tenant_id ORDER BY estimated_savings_monthly_usd) AS pr FROM ({REC_SQL}))"""


TOP_SQL = f"""SELECT {', '.join(REC)}, priority, rn::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id
  ORDER BY estimated_savings_monthly_usd DESC, title, aws_account_id) AS rn FROM ({PRIORITY_SQL})) WHERE rn <= 5"""


@query("top_recommendations", TOP_SQL)
def top_recommendations(spark, sf):
    recs = materialise(recommendations(spark, sf), "recommendations")
    return RE.top_recommendations(recs).select(*REC, "priority", "rank")


@query("recommendation_priority", f"SELECT tenant_id, priority, count(*) AS recommendations FROM ({PRIORITY_SQL}) GROUP BY 1, 2")
def recommendation_priority(spark, sf):
    recs = RE.with_priority(materialise(recommendations(spark, sf), "recommendations"))
    return recs.groupBy("tenant_id", "priority").agg(F.count("*").alias("recommendations"))


def created():
    return stamp(EVENTS_AS_OF)


def insights(spark, sf):
    return IN.monitoring_insights(sample.cost_records(spark, sf), inventory(spark, sf), AS_OF, tenants=sample.accounts(spark, sf))


@query(
    "monitoring_insights",
    f"""SELECT o.tenant_id, NOT (total_usd <= 0 AND total_resource_types = 0) AS success,
  CASE WHEN total_usd <= 0 AND total_resource_types = 0 THEN 'no_data' ELSE 'ready' END AS message, total_usd, services_total, idle_total,
  CASE WHEN total_usd <= 0 AND total_resource_types = 0 THEN '' ELSE coalesce(r.best, '') END AS best
FROM ({OVERVIEW_SQL}) o LEFT JOIN (SELECT tenant_id, string_agg(rank || '|' || title || '|' || cast(estimated_savings_monthly_usd AS VARCHAR) || '|' || priority,
  ';' ORDER BY rank) AS best FROM ({TOP_SQL}) GROUP BY 1) r USING (tenant_id)""",
)
def monitoring_insights(spark, sf):
    """The recommendations as text, best first."""
    item = lambda r: F.concat_ws("|", r["rank"].cast("string"), r["title"], r["estimated_savings_monthly_usd"].cast("string"), r["priority"])
    best = F.array_join(F.transform("recommendations", item), ";").alias("best")
    return insights(spark, sf).select("tenant_id", "success", "message", "total_usd", "services_total", "idle_total", best)


@query(
    "stored_recommendations",
    f"""SELECT substr(sha256(concat_ws('|', 'rec', tenant_id, aws_account_id, recommendation_type, title)), 1, 32) AS id, tenant_id, aws_account_id,
  'optimizer' AS agent_type, recommendation_type, title, priority, estimated_savings_monthly_usd AS estimated_savings_usd, confidence_score,
  'pending' AS status, 0 AS batch_id FROM ({TOP_SQL})""",
)
def stored_recommendations(spark, sf):
    """What a run of the insights stored, that was run again."""
    path, found = run_dir(spark, "stored-recommendations"), insights(spark, sf)
    for _ in range(2):
        IN.store_recommendations(found, path, 0, created())
    return spark.read.parquet(path).drop("description", "action_steps", "created_at")


@query(
    "recommendations_table",
    """SELECT substr(sha256(concat_ws('|', 'rec', tenant_id, aws_account_id, kind, title)), 1, 32) AS id, tenant_id, aws_account_id,
  'optimizer' AS agent_type, kind AS recommendation_type, title, '' AS description, 'medium' AS priority,
  cast(coalesce(cost, 0) AS DECIMAL(24,2)) AS estimated_savings_usd, cast(0 AS DECIMAL(3,2)) AS confidence_score, 'pending' AS status
FROM (SELECT tenant_id, aws_account_id, CASE WHEN is_idle THEN 'stop_idle_resource' ELSE 'other' END AS kind,
  'Review ' || resource_id AS title, monthly_cost_usd AS cost FROM inventory)""",
)
def recommendations_table_query(spark, sf):
    """Documents as an optimiser writes them, with several keys missing."""
    doc = F.to_json(
        F.struct(
            F.when(F.col("is_idle"), "stop_idle_resource").alias("recommendation_type"),
            F.concat(F.lit("Review "), F.col("resource_id")).alias("title"),
            F.col("monthly_cost_usd").alias("estimated_savings_monthly_usd"),
        )
    )
    docs = inventory(spark, sf).select("tenant_id", "aws_account_id", doc.alias("doc"))
    return recommendations_table(docs, created()).drop("created_at", "action_steps")


@query(
    "active_recommendations",
    """SELECT tenant_id, status, count(*) AS recommendations, cast(sum(savings) AS DECIMAL(24,2)) AS savings_usd FROM (
SELECT *, ['pending', 'accepted', 'rejected', 'implemented', 'archived'][1 + ascii(substr(id, 1, 1)) % 5] AS status,
  TIMESTAMP '2024-01-31 00:00:00' + to_days(ascii(substr(id, 2, 1)) % 40 - 20) AS expires_at
FROM (SELECT *, substr(sha256(concat_ws('|', 'rec', tenant_id, aws_account_id, recommendation_type, title)), 1, 32) AS id FROM recs))
WHERE status <> 'archived' AND expires_at > TIMESTAMP '2024-01-31 00:00:00' GROUP BY 1, 2""",
)
def active_recommendations(spark, sf):
    recs = recommendation_rows(
        recommendations(spark, sf).withColumn("priority", F.lit(None).cast("string")),
        created(),
    )
    shift = F.ascii(F.substring("id", 2, 1)) % 40 - 20
    stored = recs.withColumns(
        {
            "status": sample.pick(
                ["pending", "accepted", "rejected", "implemented", "archived"], "ascii(substr(id, 1, 1)) % 5"
            ),
            "expires_at": created() + F.make_dt_interval(shift),
        }
    )
    return RE.savings_by_status(RE.active_recommendations(stored, created()))


TAG = "json_extract_string(tags_json, '$.k')"


@query("tag_extract", f"SELECT event_id, {TAG} AS tag_value, {TAG} IS NOT NULL AS has_tag FROM tagged_lines")
def tag_extract(spark, sf):
    return TG.tag_extract(sample.tagged_lines(spark, sf), "k").select("event_id", "tag_value", "has_tag")


@query(
    "tag_pairs",
    f"""SELECT event_id, CASE WHEN {TAG} IS NOT NULL THEN 'k' END AS tag_key, {TAG} AS tag_value, cost_usd FROM tagged_lines""",
)
def tag_pairs(spark, sf):
    return TG.tag_pairs(sample.tagged_lines(spark, sf)).select("event_id", "tag_key", "tag_value", "cost_usd")


@query(
    "tag_chargeback",
    f"""SELECT tenant_id, coalesce({TAG}, '(untagged)') AS tag_value, cast(sum(cost_usd) AS DECIMAL(28,6)) AS total_usd,
  count(*) AS lines FROM tagged_lines GROUP BY 1, 2""",
)
def tag_chargeback(spark, sf):
    return TG.tag_chargeback(sample.tagged_lines(spark, sf), "k")


@query(
    "tag_coverage",
    f"""SELECT tenant_id, count(*) AS lines, count({TAG}) AS tagged_lines, cast(sum(cost_usd) AS DECIMAL(28,6)) AS total_usd,
  cast(coalesce(sum(cost_usd) FILTER (WHERE {TAG} IS NOT NULL), 0) AS DECIMAL(28,6)) AS tagged_usd,
  round(count({TAG}) / count(*) * 100, 4) AS line_pct,
  round(coalesce(sum(cost_usd) FILTER (WHERE {TAG} IS NOT NULL), 0)::DOUBLE / sum(cost_usd)::DOUBLE * 100, 4) AS spend_pct
FROM tagged_lines GROUP BY 1""",
)
def tag_coverage(spark, sf):
    return TG.tag_coverage(sample.tagged_lines(spark, sf), "k")
