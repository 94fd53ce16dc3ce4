"""Subtotals, the monitoring overview and the cost report."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import as_date, money, month_start, pct_change
from ..functions.dates import days_before
from ..schemas import TOTAL
from ..sinks.store import materialise
from ..sources.tables import day_cells, scoped
from . import anomaly as A
from . import budgets as B
from . import costs as C
from . import inventory as I


def multi_account_rollup(costs, start=None, end=None, tenant_id=None) -> DataFrame:
    """Totals per tenant, account and service group with all subtotals.

    ``level`` 0 is the grand total, 3 the finest row.
    """
    rows = scoped(costs, tenant_id, None, "DAILY", start, end)
    cells = rows.groupBy("tenant_id", "aws_account_id", "service_group").agg(F.sum("cost_usd").alias("cost_usd"))
    gid = F.grouping_id("tenant_id", "aws_account_id", "service_group")
    return (
        cells.rollup("tenant_id", "aws_account_id", "service_group")
        .agg(
            F.sum("cost_usd").cast(TOTAL).alias("total_usd"),
            F.when(gid == 0, 3).when(gid == 1, 2).when(gid == 3, 1).otherwise(0).cast("int").alias("level"),
        )
        .select("tenant_id", "aws_account_id", "service_group", "level", "total_usd")
    )


def build_overview(
    costs, inventory, as_of, days: int = 30, tenant_id=None, aws_account_id=None, tenants=None,
    list_limit: int | None = 20, top: int | None = 10,
) -> DataFrame:
    """One row per tenant: totals, top services and regions, resource summary.

    ``tenants`` lists the tenants to report on even if they have no data. Costs and inventory are each read once.

    ``service_count``, ``idle_resources`` and ``total_resource_types`` count lists that are cut at ``list_limit``, so they
    stop there, as does the list of types; ``services_total``, ``idle_total`` and ``resource_types_total`` are the
    exact counts. The two lists of the costs hold ``top`` entries. None means all; lists are as long as a tenant has
    services, regions or types.
    """
    limit, first = (F.lit(2**31 - 1 if n is None else n) for n in (list_limit, top))

    def ranked(df, *order):
        return df.withColumn("_rn", F.row_number().over(Window.partitionBy("tenant_id", "facet").orderBy(*order)))

    def gathered(facet, cut, item):
        return F.array_compact(F.collect_list(F.when((F.col("facet") == facet) & (F.col("_rn") <= cut), item)))

    # Rounding keeps the order, so the order of unrounded amounts is that of the rounded ones with ties settled.
    facets = C.monitoring_facets(costs, as_of, days, tenant_id, aws_account_id).where("facet <> 'date'")
    facets = ranked(facets, F.col("total").desc(), "service", "service_group", "region").withColumn("total_usd", money(F.col("total")))
    spend = facets.groupBy("tenant_id").agg(
        F.max(F.when(F.col("facet") == "total", F.col("total"))).alias("total"),
        F.count_if(F.col("facet") == "service").alias("services_total"),
        gathered("service", first, F.struct("_rn", "service", "service_group", "total_usd")).alias("top_services"),
        gathered("region", first, F.struct("_rn", "region", "total_usd")).alias("top_regions"),
    )
    held = I.inventory_facets(inventory, tenant_id, aws_account_id)
    held = ranked(held, F.col("monthly_cost_usd").desc(), "resource_type", "service_group")
    whole = F.col("facet") == "total"
    stock = held.groupBy("tenant_id").agg(
        F.max(F.when(whole, F.col("count"))).alias("total_resources"),
        F.max(F.when(whole, F.col("monthly_cost_usd"))).alias("total_monthly_cost_usd"),
        F.max(F.when(whole, F.col("idle"))).alias("idle_total"),
        F.count_if(F.col("facet") == "type").alias("resource_types_total"),
        F.sort_array(gathered("type", limit, F.struct("monthly_cost_usd", "resource_type", "count")), asc=False).alias("by_type"),
        F.sort_array(gathered("group", F.lit(2**31 - 1), F.struct("monthly_cost_usd", "service_group", "count")), asc=False).alias("by_group"),
    )
    # Every side has at most one row per tenant.
    joined = spend.join(stock, "tenant_id", "full_outer")
    if tenants is not None:
        joined = scoped(tenants, tenant_id).select("tenant_id").distinct().join(joined, "tenant_id", "full_outer")
    zero = F.lit(0).cast("bigint")
    count = lambda c: F.coalesce(F.col(c), zero)
    empty = lambda c: F.coalesce(F.col(c), F.array())

    def listed(name, *fields):
        return F.transform(F.array_sort(empty(name)), lambda s: F.struct(*[s[f].alias(f) for f in (*fields, "total_usd")])).alias(name)

    return joined.select(
        "tenant_id",
        money(F.coalesce(F.col("total"), F.lit(0))).alias("total_usd"),
        F.lit(days).alias("period_days"),
        F.least(count("services_total"), limit).alias("service_count"),
        F.least(count("idle_total"), limit).alias("idle_resources"),
        F.least(count("resource_types_total"), limit).alias("total_resource_types"),
        count("services_total").alias("services_total"),
        count("idle_total").alias("idle_total"),
        count("resource_types_total").alias("resource_types_total"),
        listed("top_services", "service", "service_group"),
        listed("top_regions", "region"),
        F.struct(
            count("total_resources").alias("total_resources"),
            F.coalesce("total_monthly_cost_usd", F.lit(0).cast(TOTAL)).alias("total_monthly_cost_usd"),
            count("idle_total").alias("idle_resources"),
            empty("by_type").alias("resources_by_type"),
            empty("by_group").alias("resources_by_service_group"),
        ).alias("resource_summary"),
    )


def gate(total_usd, resource_types):
    """Whether there is anything to report on, and the word for it."""
    no_data = (total_usd <= 0) & (resource_types == 0)
    return ~no_data, F.when(no_data, "no_data").otherwise("ready")


def insights_gate(overview: DataFrame) -> DataFrame:
    """Whether a tenant has anything to report on.

    Spend of at most zero and no resource type means no data. A failed read raises
    instead of looking like an empty one.
    """
    success, message = gate(F.col("total_usd"), F.col("total_resource_types"))
    return overview.select("tenant_id", "total_usd", "total_resource_types", success.alias("success"), message.alias("message"))


# Length in days of a report and the distance to the same days a year earlier.
REPORT_DAYS = {"daily": (1, 364), "weekly": (7, 364), "monthly": (30, 365)}


def cost_report(costs, budgets, as_of, report_type: str = "weekly", tenant_id=None) -> DataFrame:
    """Key figures of a report per tenant: total, change against the period before and a
    year ago, three top services, budgets in trouble, number of anomalies.

    The facts are read twice, each time only the months of a window: the days that the periods, the budgets and
    the anomalies look at, summed to cells that are written once for all of them, and the same days a year ago.
    Every part is one row per tenant when joined.
    """
    days, year = REPORT_DAYS[report_type]
    end = as_date(as_of)
    start, before = days_before(end, days), days_before(end, 2 * days)
    y_start, y_end = days_before(start, year), days_before(end, year)
    date, cost = F.col("date"), F.col("cost_usd")
    first = min(before, month_start(end), days_before(end, A.CURRENT_DAYS + A.BASELINE_DAYS))
    cells = materialise(day_cells(costs, first, end, tenant_id), "day-cells")
    rows = cells.where(date >= F.lit(before)).unionByName(day_cells(costs, y_start, y_end, tenant_id))

    def window(lo, hi):
        inside = (date >= F.lit(lo)) & (date < F.lit(hi))
        return F.coalesce(F.sum(F.when(inside, cost)), F.lit(0)).cast(TOTAL)

    by_service = rows.groupBy("tenant_id", "service").agg(
        window(start, end).alias("c"), window(before, start).alias("p"), window(y_start, y_end).alias("y"),
        F.count_if(date >= F.lit(start)).alias("current_rows"),
    )
    order = Window.partitionBy("tenant_id").orderBy((F.col("current_rows") > 0).desc(), F.col("c").desc(), "service")
    ranked = by_service.withColumn("rn", F.row_number().over(order))
    driver = F.when((F.col("rn") <= 3) & (F.col("current_rows") > 0), F.struct("rn", "service"))
    totals = ranked.groupBy("tenant_id").agg(
        *[F.sum(c).cast(TOTAL).alias(c) for c in "cpy"],
        F.array_sort(F.collect_list(driver)).alias("drivers"),
    )
    states = (
        B.budget_status(cells, budgets, as_of, "tenant", tenant_id=tenant_id)
        .groupBy("tenant_id")
        .agg(
            F.count_if(F.col("severity") == "warning").alias("warning"),
            F.count_if(F.col("severity") == "critical").alias("critical"),
        )
    )
    odd = A.anomaly_events(cells, as_of, tenant_id).groupBy("tenant_id").agg(F.count("*").alias("n"))
    joined = totals.join(states, "tenant_id", "left").join(odd, "tenant_id", "left")
    zero = F.lit(0).cast("bigint")
    names = F.nullif(F.array_join(F.transform("drivers", lambda d: d["service"]), ", "), F.lit(""))
    return joined.select(
        "tenant_id",
        F.lit(report_type).alias("report_type"),
        F.lit(start).alias("period_start"),
        F.lit(end).alias("period_end"),
        money(F.col("c")).alias("total_usd"),
        money(F.col("p")).alias("previous_usd"),
        money(F.col("y")).alias("year_ago_usd"),
        pct_change(F.col("c"), F.col("p")).alias("pct_previous"),
        pct_change(F.col("c"), F.col("y")).alias("pct_year_ago"),
        names.alias("top_drivers"),
        F.coalesce("warning", zero).alias("budgets_warning"),
        F.coalesce("critical", zero).alias("budgets_critical"),
        F.coalesce("n", zero).alias("anomalies"),
    )
