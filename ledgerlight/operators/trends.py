"""Window-function reports. Every window runs over rows already summed to one per
scope and period, so a partition holds at most one row per day (or service) however
hot its key is in the facts."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import money, months_back, pct_change, per_day
from ..functions.dates import days_before
from ..schemas import TOTAL
from ..sources.tables import scoped


def rolling_spend(
    costs, tenant_id=None, aws_account_id=None, current_days: int = 7, baseline_days: int = 90, start=None, end=None
) -> DataFrame:
    """Trailing daily mean of the last 7 days against the 90 days before, per service.

    Calendar-day means: days without spend count as zero. Rows are those of ``[start, end)``; what is read begins as
    many days before ``start`` as the two windows span.
    """
    first = None if start is None else days_before(start, current_days + baseline_days - 1)
    daily = (
        scoped(costs, tenant_id, aws_account_id, "DAILY", first, end)
        .groupBy("tenant_id", "service", "date")
        .agg(F.sum("cost_usd").alias("day_total"))
        .withColumn("day_no", F.unix_date("date"))
    )
    w = Window.partitionBy("tenant_id", "service").orderBy("day_no")
    cur = F.sum("day_total").over(w.rangeBetween(-(current_days - 1), 0))
    base = F.sum("day_total").over(w.rangeBetween(-(current_days + baseline_days - 1), -current_days))
    rolled = daily.select(
        "tenant_id", "service", "date",
        F.col("day_total").cast(TOTAL).alias("day_total"),
        per_day(cur, current_days).alias("current_avg"),
        per_day(F.coalesce(base, F.lit(0)), baseline_days).alias("baseline_avg"),
    )
    return scoped(rolled, start=start)


def mtd_running_total(costs, budgets, tenant_id=None, start=None, end=None) -> DataFrame:
    """Spend of the month so far per account and day, and whether the account-wide
    budget was first crossed on that day."""
    daily = (
        scoped(costs, tenant_id, None, "DAILY", start, end)
        .groupBy("tenant_id", "aws_account_id", "date")
        .agg(F.sum("cost_usd").alias("day_total"))
        .withColumn("month", F.trunc("date", "MM"))
    )
    w = (
        Window.partitionBy("tenant_id", "aws_account_id", "month")
        .orderBy("date")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    running = daily.withColumn("mtd", F.sum("day_total").over(w).cast(TOTAL))
    limits = (
        scoped(budgets, tenant_id)
        .where(F.col("is_active") & F.col("aws_account_id").isNotNull())
        .where(F.col("service_group").isNull() & F.col("region").isNull())
        .groupBy("tenant_id", "aws_account_id")
        .agg(F.min("limit_usd").alias("limit_usd"))
    )
    return running.join(limits, ["tenant_id", "aws_account_id"], "left").select(
        "tenant_id", "aws_account_id", "date",
        F.col("day_total").cast(TOTAL).alias("day_total"),
        F.col("mtd").alias("mtd_total"),
        F.coalesce(
            (F.col("mtd") >= F.col("limit_usd")) & (F.col("mtd") - F.col("day_total") < F.col("limit_usd")),
            F.lit(False),
        ).alias("crosses_budget"),
    )


PERIODS = {"day": "DD", "week": "WEEK", "month": "MM"}


def period_over_period(costs, period: str = "month", tenant_id=None, end=None, start=None) -> DataFrame:
    """Totals per day, Monday week or month with the period before and the one a year
    ago (12 months for day and month, 52 weeks for week). A period without spend has
    no row; looking back at one gives NULL. ``start`` is the first day of a period; what is read begins a year and a
    period before it."""
    first = None if start is None else months_back(start, 13)
    start_of = F.col("date") if period == "day" else F.trunc("date", PERIODS[period])
    totals = (
        scoped(costs, tenant_id, None, "DAILY", first, end)
        .groupBy("tenant_id", start_of.alias("period_start"))
        .agg(F.sum("cost_usd").cast(TOTAL).alias("total_usd"))
    )
    step = {
        "day": F.date_add("period_start", 1),
        "week": F.date_add("period_start", 7),
        "month": F.add_months("period_start", 1),
    }[period]
    votes = [(F.col("period_start"), 0), (step, 1)]
    if period == "week":
        votes.append((F.date_add("period_start", 364), 2))
    else:
        # 28 February is looked back at by both ends of a leap February, 29 February
        # by no day: keep a vote only where going back 12 months returns here.
        ahead = F.add_months("period_start", 12)
        for day in (ahead, F.date_add(ahead, 1)):
            votes.append((F.when(F.add_months(day, -12) == F.col("period_start"), day), 2))
    # Each total is sent forward to the periods that look back at it and they meet
    # there: one aggregation of a few copies instead of two self joins.
    copies = [F.struct(p.alias("p"), F.lit(k).alias("k")) for p, k in votes]
    votes = totals.select("tenant_id", F.explode(F.array(*copies)).alias("v"), "total_usd").where(
        F.col("v.p").isNotNull()
    )

    def of(kind):
        return F.sum(F.when(F.col("v.k") == kind, F.col("total_usd"))).cast(TOTAL)

    met = (
        votes.groupBy("tenant_id", F.col("v.p").alias("period_start"))
        .agg(of(0).alias("total_usd"), of(1).alias("previous_usd"), of(2).alias("year_ago_usd"))
        .where(F.col("total_usd").isNotNull())
    )
    return scoped(met, start=start, date_col="period_start").select(
        "tenant_id", "period_start", "total_usd", "previous_usd", "year_ago_usd",
        pct_change(F.col("total_usd"), F.col("previous_usd")).alias("pct_previous"),
        pct_change(F.col("total_usd"), F.col("year_ago_usd")).alias("pct_year_ago"),
    )


def pareto_drivers(costs, start=None, end=None, tenant_id=None) -> DataFrame:
    """Services by spend with their share and cumulative share of the tenant's total."""
    grouped = (
        scoped(costs, tenant_id, None, "DAILY", start, end)
        .groupBy("tenant_id", "service")
        .agg(F.sum("cost_usd").cast(TOTAL).alias("total_usd"))
    )
    order = Window.partitionBy("tenant_id").orderBy(F.col("total_usd").desc(), "service")
    whole = F.sum("total_usd").over(Window.partitionBy("tenant_id")).cast("double")
    running = F.sum("total_usd").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("double")
    return grouped.select(
        "tenant_id", "service", "total_usd",
        F.row_number().over(order).alias("rank"),
        F.when(whole != 0, F.round(F.col("total_usd").cast("double") / whole * 100, 4)).alias("share_pct"),
        F.when(whole != 0, F.round(running / whole * 100, 4)).alias("cumulative_pct"),
    )


def service_churn(costs, as_of, window_days: int = 30, tenant_id=None) -> DataFrame:
    """Services started or stopped between the previous and the current window.

    Counts both windows in one aggregation instead of set differences of two scans.
    """
    from ..functions.dates import days_before

    start = days_before(as_of, window_days)
    rows = scoped(costs, tenant_id, None, "DAILY", days_before(start, window_days), as_of)
    current = F.col("date") >= F.lit(start)
    grouped = rows.groupBy("tenant_id", "aws_account_id", "service").agg(
        F.sum(F.when(current, F.col("cost_usd"))).cast(TOTAL).alias("cur"),
        F.sum(F.when(~current, F.col("cost_usd"))).cast(TOTAL).alias("prev"),
    )
    return grouped.where(F.col("cur").isNull() | F.col("prev").isNull()).select(
        "tenant_id", "aws_account_id", "service",
        F.when(F.col("prev").isNull(), "started").otherwise("stopped").alias("change"),
        money(F.coalesce("cur", "prev")).alias("spend_usd"),
    )
