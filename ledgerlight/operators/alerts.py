"""The life of alerts and the four alert types in one shape."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stable_id
from ..schemas import MONEY

ALERT_COLUMNS = [
    "tenant_id", "budget_id", "aws_account_id", "alert_type", "severity", "title", "message",
    "current_value", "threshold_value", "percent_used", "state", "triggered_at",
]


def budget_alert_events(alerts: DataFrame, *extra: str) -> DataFrame:
    """Budget alerts in the stored shape, plus further columns to carry along."""
    return alerts.select(
        "tenant_id", "budget_id", "aws_account_id",
        F.lit("budget_threshold").alias("alert_type"),
        "severity",
        F.concat(F.lit("Budget threshold: "), F.col("budget_name")).alias("title"),
        "message",
        F.col("current_usd").cast(MONEY).alias("current_value"),
        F.col("limit_usd").cast(MONEY).alias("threshold_value"),
        F.col("percent_used").cast("decimal(18,1)").alias("percent_used"),
        F.lit("firing").alias("state"),
        "triggered_at",
        *extra,
    )


def spike_alert_events(spikes: DataFrame, triggered_at: Column) -> DataFrame:
    return spikes.select(
        "tenant_id",
        F.lit(None).cast("string").alias("budget_id"),
        "aws_account_id",
        F.lit("spend_spike").alias("alert_type"),
        "severity",
        F.concat(F.lit("Spend spike: "), F.col("service")).alias("title"),
        F.col("description").alias("message"),
        F.col("current_value").cast(MONEY).alias("current_value"),
        F.col("baseline_value").cast(MONEY).alias("threshold_value"),
        F.col("percent_change").cast("decimal(18,1)").alias("percent_used"),
        F.lit("firing").alias("state"),
        triggered_at.alias("triggered_at"),
    )


def idle_alert_events(inventory: DataFrame, triggered_at: Column) -> DataFrame:
    return inventory.where("is_idle").select(
        "tenant_id",
        F.lit(None).cast("string").alias("budget_id"),
        "aws_account_id",
        F.lit("idle_resource").alias("alert_type"),
        F.lit("info").alias("severity"),
        F.concat(F.lit("Idle resource: "), F.col("resource_id")).alias("title"),
        F.concat(F.col("resource_type"), F.lit(" "), F.col("resource_id"), F.lit(" is idle")).alias("message"),
        F.col("monthly_cost_usd").cast(MONEY).alias("current_value"),
        F.lit(None).cast(MONEY).alias("threshold_value"),
        F.lit(None).cast("decimal(18,1)").alias("percent_used"),
        F.lit("firing").alias("state"),
        triggered_at.alias("triggered_at"),
    )


def breach_alert_events(breaches: DataFrame, triggered_at: Column, min_probability: float = 0.5) -> DataFrame:
    """Forecasts more likely than not to exceed their budget."""
    return breaches.where(F.col("budget_breach_probability") > min_probability).select(
        "tenant_id", "budget_id", "aws_account_id",
        F.lit("forecast_breach").alias("alert_type"),
        F.when(F.col("days_to_breach") <= 3, "critical").otherwise("warning").alias("severity"),
        F.concat(F.lit("Forecast breach: "), F.col("aws_account_id")).alias("title"),
        F.lit("Month-end forecast exceeds the budget").alias("message"),
        F.round("projected_month_end_usd", 2).cast(MONEY).alias("current_value"),
        F.col("budget_limit").cast(MONEY).alias("threshold_value"),
        F.round(F.col("projected_month_end_usd") / F.col("budget_limit") * 100, 1)
        .cast("decimal(18,1)")
        .alias("percent_used"),
        F.lit("firing").alias("state"),
        triggered_at.alias("triggered_at"),
    )


def with_alert_ids(events: DataFrame) -> DataFrame:
    """Give events a reproducible id."""
    key = [F.col(c) for c in ("tenant_id", "budget_id", "aws_account_id", "alert_type", "title", "triggered_at")]
    return events.select(stable_id("alert", *key).alias("id"), *events.columns)


def alert_event_types(*sources: DataFrame) -> DataFrame:
    """All alert types in one table."""
    out = sources[0].select(*ALERT_COLUMNS)
    for s in sources[1:]:
        out = out.unionByName(s.select(*ALERT_COLUMNS))
    return out


def alert_lifecycle(alerts: DataFrame, status: DataFrame, resolved_at: Column) -> DataFrame:
    """Firing budget alerts become resolved once no evaluation of their budget fires.

    An alert whose budget is not evaluated any more (deleted, inactive) keeps its
    state. Alerts without a budget are passed by the join, so they cannot pile up
    on one NULL key.
    """
    firing = status.groupBy("tenant_id", "budget_id").agg(F.max("firing").alias("still_firing"))
    has_budget = F.col("budget_id").isNotNull() & (F.col("state") == "firing")
    checked = alerts.where(has_budget).join(firing, ["tenant_id", "budget_id"], "left")
    back_under = F.coalesce(~F.col("still_firing"), F.lit(False))
    done = checked.select(
        *[F.col(c) for c in alerts.columns if c not in ("state", "resolved_at")],
        F.when(back_under, "resolved").otherwise("firing").alias("state"),
        F.when(back_under, resolved_at).alias("resolved_at"),
    )
    none = F.lit(None).cast(done.schema["resolved_at"].dataType)
    rest = alerts.where(~F.coalesce(has_budget, F.lit(False)))
    if "resolved_at" not in alerts.columns:
        rest = rest.withColumn("resolved_at", none)
    return done.unionByName(rest.select(*done.columns))
