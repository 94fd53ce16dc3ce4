"""Dashboard reads over cost records.

Two kinds of window exist on purpose. ``cost_summary`` compares two half-open
windows and never includes ``as_of`` itself; all other reads start ``days`` before
``as_of`` and are open towards the future.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import as_date, money, month_start, pct_change, validate_days
from ..functions.dates import days_before
from ..schemas import TOTAL
from ..sources.tables import scoped, top_n


def total(name: str = "cost_usd") -> Column:
    return F.sum(name).cast(TOTAL)


def _recent(costs, as_of, days, tenant_id, aws_account_id) -> DataFrame:
    return scoped(costs, tenant_id, aws_account_id, "DAILY", start=days_before(as_of, days))


def cost_summary(costs: DataFrame, as_of, period_days: int = 30, tenant_id=None, aws_account_id=None) -> DataFrame:
    """Spend per service group against the period before.

    One scan of both windows with conditional sums instead of two scans and a
    join. Groups without a current row are left out, whatever they cost before.
    """
    start = days_before(as_of, period_days)
    rows = scoped(costs, tenant_id, aws_account_id, "DAILY", days_before(start, period_days), as_of)
    current = F.col("date") >= F.lit(start)
    grouped = (
        rows.groupBy("tenant_id", "service_group")
        .agg(
            F.sum(F.when(current, F.col("cost_usd"))).cast(TOTAL).alias("cur"),
            F.coalesce(F.sum(F.when(~current, F.col("cost_usd"))), F.lit(0)).cast(TOTAL).alias("prev"),
        )
        .where(F.col("cur").isNotNull())
    )
    # At most one row per tenant and service group reaches this window.
    whole = Window.partitionBy("tenant_id")
    out = grouped.select(
        "tenant_id",
        "service_group",
        money(F.col("cur")).alias("total_usd"),
        money(F.col("prev")).alias("prev_total_usd"),
        pct_change(F.col("cur"), F.col("prev")).alias("pct_change"),
        money(F.sum("cur").over(whole)).alias("period_total_usd"),
    )
    return out.orderBy("tenant_id", F.col("total_usd").desc(), "service_group")


def daily_costs(costs, as_of, days: int = 30, tenant_id=None, aws_account_id=None) -> DataFrame:
    """Trend line: one row per date that has data, ascending."""
    return (
        _recent(costs, as_of, days, tenant_id, aws_account_id)
        .groupBy("tenant_id", "date")
        .agg(money(F.sum("cost_usd")).alias("total_usd"))
        .orderBy("tenant_id", "date")
    )


def top_services(costs, as_of, days: int = 30, limit: int = 20, tenant_id=None, aws_account_id=None) -> DataFrame:
    grouped = (
        _recent(costs, as_of, days, tenant_id, aws_account_id)
        .groupBy("tenant_id", "service", "service_group")
        .agg(total().alias("t"), F.countDistinct("date").alias("active_days"))
    )
    top = top_n(grouped, limit, [F.col("t").desc(), F.col("service"), F.col("service_group")], tenant_id)
    return top.select("tenant_id", "service", "service_group", money(F.col("t")).alias("total_usd"), "active_days")


def costs_by_region(costs, as_of, days: int = 30, tenant_id=None, aws_account_id=None) -> DataFrame:
    grouped = (
        _recent(costs, as_of, days, tenant_id, aws_account_id).groupBy("tenant_id", "region").agg(total().alias("t"))
    )
    return grouped.orderBy("tenant_id", F.col("t").desc(), "region").select(
        "tenant_id", "region", money(F.col("t")).alias("total_usd")
    )


def monthly_spend_view(costs) -> DataFrame:
    """Spend and exact number of services per account, month and service group."""
    return (
        scoped(costs, granularity="DAILY")
        .groupBy(
            "tenant_id", "aws_account_id", "account_alias", F.trunc("date", "MM").alias("month"), "service_group"
        )
        .agg(total().alias("total_usd"), F.countDistinct("service").alias("service_count"))
    )


def daily_spend_view(costs) -> DataFrame:
    return (
        scoped(costs, granularity="DAILY")
        .groupBy("tenant_id", "aws_account_id", "account_alias", "date")
        .agg(total().alias("total_usd"), F.countDistinct("service").alias("active_services"))
    )


def register_views(costs: DataFrame, as_of) -> None:
    """The three named views as temporary SQL views."""
    monthly_spend_view(costs).createOrReplaceTempView("v_monthly_spend")
    daily_spend_view(costs).createOrReplaceTempView("v_daily_spend")
    top_services_this_month_view(costs, as_of).createOrReplaceTempView("v_top_services_this_month")


def top_services_this_month_view(costs, as_of) -> DataFrame:
    """All services of the month per account; despite its name it has no limit."""
    return (
        scoped(costs, granularity="DAILY", start=month_start(as_of))
        .groupBy("tenant_id", "aws_account_id", "service", "service_group")
        .agg(total().alias("total_usd"))
    )


def top_n_per_account(costs, as_of, n: int = 20) -> DataFrame:
    """The ``n`` most expensive services per account this month, with their rank."""
    w = Window.partitionBy("tenant_id", "aws_account_id").orderBy(F.col("total_usd").desc(), "service")
    return (
        top_services_this_month_view(costs, as_of)
        .withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= n)
    )


def cost_data_by_service(costs, as_of, days: int = 30, tenant_id=None, aws_account_id=None, limit: int = 20) -> DataFrame:
    grouped = (
        _recent(costs, as_of, validate_days(days), tenant_id, aws_account_id)
        .groupBy("tenant_id", "service", "service_group")
        .agg(total().alias("total"))
    )
    return top_n(grouped, limit, [F.col("total").desc(), F.col("service"), F.col("service_group")], tenant_id)


def cost_data_total(costs, as_of, days: int = 30, tenant_id=None, aws_account_id=None, tenants=None) -> DataFrame:
    """Grand total, one row even without data; independent of the top-20 limit.

    Without a tenant: one row per tenant with recent rows, or one for every row of
    ``tenants`` if that list is given. The window is a scan filter either way.
    """
    rows = _recent(costs, as_of, validate_days(days), tenant_id, aws_account_id)
    if tenant_id is not None:
        return rows.agg(F.coalesce(F.sum("cost_usd"), F.lit(0)).cast(TOTAL).alias("total")).select(
            F.lit(tenant_id).alias("tenant_id"), "total"
        )
    totals = rows.groupBy("tenant_id").agg(total().alias("total"))
    if tenants is None:
        return totals
    return (
        tenants.select("tenant_id").distinct().join(totals, "tenant_id", "left")
        .select("tenant_id", F.coalesce("total", F.lit(0)).cast(TOTAL).alias("total"))
    )


def cost_data_by_region(costs, as_of, days: int = 30, tenant_id=None, aws_account_id=None, limit: int = 20) -> DataFrame:
    grouped = (
        _recent(costs, as_of, validate_days(days), tenant_id, aws_account_id)
        .groupBy("tenant_id", "region")
        .agg(total().alias("total"))
    )
    return top_n(grouped, limit, [F.col("total").desc(), F.col("region")], tenant_id)


def cost_data_daily(costs, as_of, days: int = 30, tenant_id=None, aws_account_id=None) -> DataFrame:
    return (
        _recent(costs, as_of, validate_days(days), tenant_id, aws_account_id)
        .groupBy("tenant_id", "date")
        .agg(total().alias("total"))
        .orderBy("tenant_id", F.col("date").desc())
    )


def monitoring_facets(costs, as_of, days: int = 30, tenant_id=None, aws_account_id=None) -> DataFrame:
    """By service, by region, by day and the total in one pass over the facts.

    The slices are summed first, so the four grouping sets expand pre-aggregated
    rows and not the facts.
    """
    slices = (
        _recent(costs, as_of, validate_days(days), tenant_id, aws_account_id)
        .groupBy("tenant_id", "service", "service_group", "region", "date")
        .agg(F.sum("cost_usd").alias("cost_usd"))
    )
    cols = ["tenant_id", "service", "service_group", "region", "date"]
    sets = [["tenant_id", "service", "service_group"], ["tenant_id", "region"], ["tenant_id", "date"], ["tenant_id"]]
    grouped = slices.groupingSets(sets, *cols).agg(
        F.grouping_id(*cols).alias("gid"), total().alias("total")
    )
    facet = (
        F.when(F.col("gid").bitwiseAND(0b01000) == 0, "service")
        .when(F.col("gid").bitwiseAND(0b00010) == 0, "region")
        .when(F.col("gid").bitwiseAND(0b00001) == 0, "date")
        .otherwise("total")
    )
    return grouped.select("tenant_id", facet.alias("facet"), "service", "service_group", "region", "date", "total")


# Columns a caller may slice or group by.
SLICE_COLUMNS = ("service", "service_group", "region", "aws_account_id", "date")
SLICE_METRICS = ("cost_usd", "usage_quantity")


def slice_query(
    costs: DataFrame, metric: str = "cost_usd", group_by=("service",), start=None, end=None,
    compare_start=None, tenant_id=None, aws_account_id=None, **equals,
) -> DataFrame:
    """One metric over a scope and time frame, optionally against the time before it.

    ``slice_query(costs, service="Amazon EC2", start="2001-08-01", end="2001-09-01")``
    answers "EC2 last month"; with ``compare_start`` the window
    ``[compare_start, start)`` is summed in the same scan.
    """
    unknown = (set(group_by) | set(equals)) - set(SLICE_COLUMNS)
    if metric not in SLICE_METRICS or unknown:
        raise ValueError(f"cannot slice by {sorted(unknown) or metric}")
    lower = compare_start if compare_start is not None else start
    rows = scoped(costs, tenant_id, aws_account_id, "DAILY", lower, end)
    for column, value in equals.items():
        rows = rows.where(F.col(column) == value)
    current = F.lit(True) if start is None else F.col("date") >= F.lit(as_date(start))
    grouped = rows.groupBy("tenant_id", *group_by).agg(
        F.coalesce(F.sum(F.when(current, F.col(metric))), F.lit(0)).cast(TOTAL).alias("value"),
        F.coalesce(F.sum(F.when(~current, F.col(metric))), F.lit(0)).cast(TOTAL).alias("compare_value"),
    )
    return grouped.withColumn("pct_change", pct_change(F.col("value"), F.col("compare_value")))
