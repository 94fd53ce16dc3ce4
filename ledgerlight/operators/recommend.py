"""Savings recommendations from inventory and spend."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import ACTION_STEPS, MONEY
from ..sources.tables import join_per_tenant, scoped, top_n
from .ranks import rank_thresholds
from .trends import service_churn

RIGHTSIZE_CPU_PCT = 20
RIGHTSIZE_MEMORY_PCT = 40
RIGHTSIZE_SHARE = 0.5
TOP_N = 5


def _rec(df, type_, title, description, savings, confidence, steps) -> DataFrame:
    items = F.array(
        *[F.struct(F.lit(i + 1).alias("step"), F.lit(s).alias("details")) for i, s in enumerate(steps)]
    ).cast(ACTION_STEPS)
    return df.select(
        "tenant_id", "aws_account_id",
        F.lit(type_).alias("recommendation_type"),
        title.alias("title"),
        description.alias("description"),
        F.round(savings, 2).cast(MONEY).alias("estimated_savings_monthly_usd"),
        F.lit(confidence).cast("decimal(3,2)").alias("confidence_score"),
        items.alias("action_steps"),
    )


def rec_stop_idle(inventory: DataFrame, tenant_id=None, aws_account_id=None) -> DataFrame:
    """Stop what is idle and save its whole cost (0 when the cost is unknown)."""
    idle = scoped(inventory, tenant_id, aws_account_id).where("is_idle")
    return _rec(
        idle, "stop_idle_resource",
        F.concat(F.lit("Stop idle resource "), F.col("resource_id")),
        F.concat(F.col("resource_type"), F.lit(" used less than 5 % CPU for 14 days")),
        F.coalesce("monthly_cost_usd", F.lit(0)), 0.90,
        ["Confirm that nobody uses the resource", "Stop it"],
    )


def rec_rightsizing(inventory: DataFrame, tenant_id=None, aws_account_id=None) -> DataFrame:
    """Halve lightly used resources in the upper half of the tenant's costs.

    The upper half starts at one exact threshold per tenant, so a tenant with a
    third of all resources is not sorted in one task.
    """
    rows = scoped(inventory, tenant_id, aws_account_id)
    half = rank_thresholds(rows, ["tenant_id"], "monthly_cost_usd", {"half_from": 0.5})
    light = rows.where(
        ~F.col("is_idle") & (F.col("cpu_avg_pct") < RIGHTSIZE_CPU_PCT) & (F.col("memory_avg_pct") < RIGHTSIZE_MEMORY_PCT)
    )
    costly = join_per_tenant(light, half, "resource_id").where(F.col("monthly_cost_usd") >= F.col("half_from"))
    return _rec(
        costly, "rightsizing",
        F.concat(F.lit("Downsize "), F.col("resource_id")),
        F.concat(F.col("resource_type"), F.lit(" runs far below its capacity")),
        F.col("monthly_cost_usd") * F.lit(RIGHTSIZE_SHARE).cast("decimal(3,2)"), 0.70,
        ["Pick the next smaller size", "Resize in a quiet hour"],
    )


def rec_unused_service(costs: DataFrame, as_of, tenant_id=None) -> DataFrame:
    """Services that cost something in the previous 30 days and nothing since: close
    them down. Nothing is being spent any more, so the saving is 0."""
    stopped = service_churn(costs, as_of, tenant_id=tenant_id).where("change = 'stopped'")
    return _rec(
        stopped, "unused_service",
        F.concat(F.lit("Remove unused service "), F.col("service")),
        F.lit("No spend in the last 30 days"),
        F.lit(0), 0.60,
        ["Check for leftovers", "Disable the service"],
    )


def all_recommendations(costs, inventory, cost_as_of, tenant_id=None, aws_account_id=None) -> DataFrame:
    unused = rec_unused_service(costs, cost_as_of, tenant_id)
    if aws_account_id is not None:
        unused = unused.where(F.col("aws_account_id") == aws_account_id)
    return (
        rec_stop_idle(inventory, tenant_id, aws_account_id)
        .unionByName(rec_rightsizing(inventory, tenant_id, aws_account_id))
        .unionByName(unused)
    )


def with_priority(recs: DataFrame) -> DataFrame:
    """Priority by savings tercile inside the tenant. Reads ``recs`` three times: hand over
    a stored table."""
    value = "estimated_savings_monthly_usd"
    cuts = rank_thresholds(recs, ["tenant_id"], value, {"medium_from": 1 / 3, "high_from": 2 / 3})
    priority = (
        F.when(F.col(value) >= F.col("high_from"), "high").when(F.col(value) >= F.col("medium_from"), "medium").otherwise("low")
    )
    return join_per_tenant(recs, cuts, "title", "left").withColumn("priority", priority).drop("medium_from", "high_from")


def top_recommendations(recs: DataFrame, n: int = TOP_N) -> DataFrame:
    """The ``n`` most valuable recommendations of every tenant, with their priority."""
    order = [F.col("estimated_savings_monthly_usd").desc(), F.col("title"), F.col("aws_account_id")]
    top = top_n(with_priority(recs), n, order)
    return top.withColumn("rank", F.row_number().over(Window.partitionBy("tenant_id").orderBy(*order)))


def active_recommendations(recs: DataFrame, as_of_ts) -> DataFrame:
    """Stored recommendations still worth showing: not archived and not expired."""
    return recs.where(
        (F.col("status") != "archived") & (F.col("expires_at").isNull() | (F.col("expires_at") > as_of_ts))
    )


def savings_by_status(recs: DataFrame) -> DataFrame:
    return recs.groupBy("tenant_id", "status").agg(
        F.count("*").alias("recommendations"),
        F.sum(F.coalesce("estimated_savings_usd", F.lit(0))).cast(MONEY).alias("savings_usd"),
    )
