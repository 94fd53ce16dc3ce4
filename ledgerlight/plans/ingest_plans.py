"""Feeds, scans, scalar functions and the cost upsert."""

from pyspark.sql import functions as F

from ..functions import format_money, normalise_region, record_id, service_group
from ..operators import jobs as J
from ..sinks import json_export, upsert_cost_records
from ..sources import feed, sample, tables
from ..sources.sample import AS_OF
from .registry import query
from .views import D, group_case, rec_id

RECORD = [
    "id", "tenant_id", "aws_account_id", "account_alias", "date", "granularity", "service",
    "service_group", "region", "cost_usd", "usage_quantity", "usage_unit",
]
RECORD_SQL = ", ".join(RECORD)


@query(
    "usage_to_cost_rollup",
    "SELECT tenant_id, aws_account_id, date, service, raw_region, cost_usd, usage_quantity FROM cost_rollup",
)
def usage_to_cost_rollup(spark, sf):
    return feed.usage_to_cost_rollup(sample.usage_lines(spark, sf))


def nested_pages(rollup):
    """Roll-up lines as the provider's nested pages, one per account and day."""
    if "usage_unit" not in rollup.columns:
        rollup = rollup.withColumn("usage_unit", F.lit("Units"))
    group = F.struct(
        F.array("service", "raw_region").alias("Keys"),
        F.create_map(
            F.lit("UnblendedCost"),
            F.struct(F.col("cost_usd").cast("string").alias("Amount"), F.lit("USD").alias("Unit")),
            F.lit("UsageQuantity"),
            F.struct(F.col("usage_quantity").cast("string").alias("Amount"), F.col("usage_unit").alias("Unit")),
        ).alias("Metrics"),
    )
    # A page holds one account and day: as many groups as services x regions, no more.
    pages = rollup.groupBy("tenant_id", "aws_account_id", "account_alias", "date").agg(
        F.collect_list(group).alias("Groups")
    )
    period = F.struct(
        F.struct(F.col("date").cast("string").alias("Start"), F.date_add("date", 1).cast("string").alias("End")).alias("TimePeriod"),
        "Groups",
    )
    return pages.select("tenant_id", "aws_account_id", "account_alias", F.array(period).alias("ResultsByTime"))


@query(
    "cost_feed_daily",
    f"SELECT * REPLACE ('Units' AS usage_unit) FROM (SELECT {RECORD_SQL} FROM cost_records WHERE date >= {D} - 32 AND date < {D})",
)
def cost_feed_daily(spark, sf):
    pages = nested_pages(sample.cost_rollup(spark, sf))
    return feed.cost_feed_daily(feed.feed_lines(pages), AS_OF).select(*RECORD)


def monthly_records(spark, sf):
    monthly = feed.cost_feed_monthly(sample.usage_lines(spark, sf), AS_OF)
    return monthly.withColumn("account_alias", sample.account_alias())


@query("cost_feed_monthly", f"SELECT {RECORD_SQL} FROM monthly_records")
def cost_feed_monthly(spark, sf):
    return monthly_records(spark, sf).select(*RECORD)


@query(
    "daily_plus_monthly",
    f"""SELECT {RECORD_SQL} FROM cost_records WHERE date >= {D} - 32 AND date < {D}
UNION ALL SELECT {RECORD_SQL} FROM monthly_records""",
)
def daily_plus_monthly(spark, sf):
    daily = feed.cost_feed_daily(sample.cost_rollup(spark, sf), AS_OF)
    return feed.daily_plus_monthly(daily, monthly_records(spark, sf)).select(*RECORD)


@query("scan_cost_records", f"SELECT {RECORD_SQL} FROM cost_records")
def scan_cost_records(spark, sf):
    return tables.scan_cost_records(sample.cost_records(spark, sf)).select(*RECORD)


@query("list_accounts", "SELECT tenant_id, aws_account_id, account_alias, created_at FROM accounts")
def list_accounts(spark, sf):
    return tables.list_accounts(sample.accounts(spark, sf)).select(
        "tenant_id", "aws_account_id", "account_alias", "created_at"
    )


@query(
    "account_alias_enrich",
    """SELECT c.id, c.tenant_id, c.aws_account_id, coalesce(nullif(a.account_alias, ''), c.aws_account_id) AS account_alias
FROM cost_records c LEFT JOIN accounts a ON a.tenant_id = c.tenant_id AND a.aws_account_id = c.aws_account_id""",
)
def account_alias_enrich(spark, sf):
    costs = sample.cost_records(spark, sf).withColumn("account_alias", F.lit(None).cast("string"))
    return J.account_alias_enrich(costs, sample.accounts(spark, sf)).select(
        "id", "tenant_id", "aws_account_id", "account_alias"
    )


@query("service_group_classify", f"SELECT service, {group_case('service')} AS service_group, count(*) AS lines FROM usage_lines GROUP BY 1, 2")
def service_group_classify(spark, sf):
    counted = sample.usage_lines(spark, sf).groupBy("service").agg(F.count("*").alias("lines"))
    return counted.select("service", service_group("service").alias("service_group"), "lines")


@query("record_id", f"SELECT {rec_id('raw_region')} AS id, count(*) AS lines FROM usage_lines GROUP BY 1")
def record_id_query(spark, sf):
    key = record_id(F.col("aws_account_id"), F.col("date"), F.col("service"), F.col("raw_region"))
    return sample.usage_lines(spark, sf).groupBy(key.alias("id")).agg(F.count("*").alias("lines"))


@query(
    "region_normalise",
    """SELECT raw_region, CASE WHEN raw_region = 'NoRegion' THEN 'global' ELSE raw_region END AS region, count(*) AS lines
FROM usage_lines GROUP BY 1, 2""",
)
def region_normalise(spark, sf):
    return (
        sample.usage_lines(spark, sf)
        .groupBy("raw_region")
        .agg(F.count("*").alias("lines"))
        .select("raw_region", normalise_region(F.col("raw_region")).alias("region"), "lines")
    )


@query(
    "format_money",
    """SELECT event_id, cast(round(coalesce(try_cast(t AS DECIMAL(28,6)), 0), 2) AS DECIMAL(24,2)) AS amount
FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN 'n/a' WHEN event_type = 'click' THEN '' ELSE cast(cast(value * 1.0375 AS DECIMAL(18,6)) AS VARCHAR) END AS t FROM events)""",
)
def format_money_query(spark, sf):
    ev = sample.table(spark, sf, "events")
    text = (
        F.when(F.col("event_type") == "error", "n/a")
        .when(F.col("event_type") == "click", "")
        .otherwise((F.col("value") * 1.0375).cast("decimal(18,6)").cast("string"))
    )
    return ev.select("event_id", format_money(text).alias("amount"))


def restated_batch(spark, sf):
    """A re-pull of the last 32 days in which every record appears twice: first with a
    new alias and 5 % more cost, then with 10 % more."""
    pull = feed.cost_feed_daily(sample.cost_rollup(spark, sf), AS_OF)
    raised = F.explode(
        F.array(
            F.struct(F.lit(1).cast("bigint").alias("seq"), F.lit("1.05").cast("decimal(4,2)").alias("f"), F.lit("renamed").alias("a")),
            F.struct(F.lit(2).cast("bigint").alias("seq"), F.lit("1.10").cast("decimal(4,2)").alias("f"), F.lit("again").alias("a")),
        )
    )
    rows = pull.withColumn("r", raised)
    return rows.withColumns(
        {
            "seq": F.col("r.seq"),
            "cost_usd": F.round(F.col("cost_usd") * F.col("r.f"), 6).cast("decimal(18,6)"),
            "account_alias": F.col("r.a"),
            "ingested_at": F.lit("2001-09-16 00:00:00").cast("timestamp_ntz"),
        }
    ).drop("r")


@query(
    "upsert_cost_records",
    f"""SELECT id, account_alias, date, cost_usd, usage_quantity, cast({D} AS TIMESTAMP) AS ingested_at FROM cost_records
WHERE date < {D} - 32
UNION ALL
SELECT id, CASE WHEN date < {D} - 3 THEN account_alias ELSE 'renamed' END, date,
  cast(round(cost_usd * 1.10, 6) AS DECIMAL(18,6)), usage_quantity, TIMESTAMP '2001-09-16 00:00:00'
FROM cost_records WHERE date >= {D} - 32 AND date < {D}""",
)
def upsert_cost_records_query(spark, sf):
    existing = sample.cost_records(spark, sf).where(F.col("date") < F.date_sub(F.lit(AS_OF), 3))
    merged = upsert_cost_records(existing, restated_batch(spark, sf))
    return merged.select("id", "account_alias", "date", "cost_usd", "usage_quantity", "ingested_at")


@query(
    "json_export",
    f"""SELECT '{{"service":"' || service || '","service_group":"' || service_group || '","tenant_id":"' || tenant_id
  || '","total_usd":' || cast(cast(round(sum(cost_usd), 2) AS DECIMAL(24,2)) AS VARCHAR) || '}}' AS json
FROM cost_records GROUP BY tenant_id, service, service_group""",
)
def json_export_query(spark, sf):
    totals = (
        sample.cost_records(spark, sf)
        .groupBy("tenant_id", "service", "service_group")
        .agg(F.round(F.sum("cost_usd"), 2).cast("decimal(24,2)").alias("total_usd"))
    )
    return json_export(totals)
