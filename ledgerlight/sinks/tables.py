"""Rows for the result tables, with their defaults."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import as_date, stable_id
from ..operators.agents import agent_run_costs
from ..schemas import ACTION_STEPS, MONEY, PERCENT, RECOMMENDATION_DOC


def _or(column: str, default, type_: str) -> Column:
    return F.coalesce(F.col(column).cast(type_), F.lit(default).cast(type_))


def recommendations_table(docs: DataFrame, created_at: Column, agent_type: str = "optimizer") -> DataFrame:
    """Stored form of recommendation documents (``doc``: JSON text per row)."""
    rows = docs.withColumn("d", F.from_json("doc", RECOMMENDATION_DOC)).select("tenant_id", "aws_account_id", "d.*")
    return recommendation_rows(rows, created_at, agent_type)


def recommendation_rows(rows: DataFrame, created_at: Column, agent_type: str = "optimizer") -> DataFrame:
    title = _or("title", "", "string")
    kind = _or("recommendation_type", "other", "string")
    return rows.select(
        stable_id("rec", F.col("tenant_id"), F.col("aws_account_id"), kind, title).alias("id"),
        "tenant_id", "aws_account_id",
        F.lit(agent_type).alias("agent_type"),
        kind.alias("recommendation_type"),
        title.alias("title"),
        _or("description", "", "string").alias("description"),
        _or("priority", "medium", "string").alias("priority"),
        _or("estimated_savings_monthly_usd", 0, MONEY).alias("estimated_savings_usd"),
        _or("confidence_score", 0, "decimal(3,2)").alias("confidence_score"),
        F.coalesce("action_steps", F.array().cast(ACTION_STEPS)).alias("action_steps"),
        F.lit("pending").alias("status"),
        created_at.alias("created_at"),
    )


def anomalies_table(events: DataFrame, triggered_at: Column) -> DataFrame:
    """Stored form of anomalies. The current value is mandatory."""
    return events.select(
        "tenant_id", "aws_account_id",
        _or("anomaly_type", "unknown", "string").alias("anomaly_type"),
        _or("severity", "warning", "string").alias("severity"),
        "service", "region",
        F.col("current_value").cast(MONEY).alias("current_value"),
        F.col("baseline_value").cast(MONEY).alias("baseline_value"),
        _or("percent_change", 0, PERCENT).alias("percent_change"),
        _or("description", "", "string").alias("description"),
        _or("suspected_cause", "", "string").alias("suspected_cause"),
        F.lit("firing").alias("state"),
        triggered_at.alias("triggered_at"),
    )


def forecasts_table(forecasts: DataFrame, as_of) -> DataFrame:
    """Stored form of forecasts; the forecast date is the day they were made."""
    return forecasts.select(
        "tenant_id", "aws_account_id",
        _or("forecast_period", "monthly", "string").alias("forecast_period"),
        F.lit(as_date(as_of)).alias("forecast_date"),
        _or("projected_month_end_usd", 0, MONEY).alias("forecasted_cost_usd"),
        _or("confidence_level", 0, "decimal(3,2)").alias("confidence_level"),
        _or("method", "linear", "string").alias("method"),
        F.col("budget_limit").cast(MONEY).alias("budget_limit"),
        _or("budget_breach_probability", 0, "decimal(3,2)").alias("budget_breach_probability"),
        F.col("days_to_breach").cast("int").alias("days_to_breach"),
        _or("notes", "", "string").alias("notes"),
    )


def agent_runs_table(runs: DataFrame, now: Column) -> DataFrame:
    """Stored form of agent runs; only a pending run has no completion time."""
    done = F.col("status") != "pending"
    return agent_run_costs(runs).select(
        stable_id("run", F.col("tenant_id"), F.col("agent_type"), F.col("run_no")).alias("id"),
        "tenant_id", "agent_type", "trigger_type", "status",
        F.coalesce("props", F.lit("{}")).alias("input_data"),
        F.lit("{}").alias("output_data"),
        "api_model", "tokens_used", "cost_usd", "started_at",
        F.when(done, now).alias("completed_at"),
    )
