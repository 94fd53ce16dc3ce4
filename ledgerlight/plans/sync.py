"""One sync of all accounts, as a set of DataFrames."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import months_back
from ..operators import alerts as AL
from ..operators import anomaly as A
from ..operators import budgets as B
from ..operators import forecast as FC
from ..operators.jobs import account_alias_enrich
from ..schemas import ALERTS
from ..sinks import alert_dedup_append, anomalies_table, append_table, earlier_batches, forecasts_table, upsert_cost_records, write_cost_table
from ..sources import feed
from ..sources.tables import scoped


@dataclass
class Sync:
    daily: DataFrame  # the pulled records
    monthly: DataFrame
    costs: DataFrame  # the months a sync can touch, after the upsert
    alerts: DataFrame  # alerts to append
    forecast: DataFrame  # 30-day forecast per account
    summary: DataFrame  # one row per account


def touched_months(stored: DataFrame, as_of) -> DataFrame:
    """The months that a sync can change, which are also those its forecast reads; the others aren't listed."""
    return scoped(stored, start=months_back(as_of, 6))


def run_ingestion(
    lines: DataFrame, accounts: DataFrame, budgets: DataFrame, stored_costs: DataFrame, stored_alerts: DataFrame,
    as_of, now: Column,
) -> Sync:
    """Pull, normalise, upsert, check budgets, find new alerts, summarise.

    Every account is synced in the same job. Budgets are evaluated on the pulled
    records, account by account in the order of their ids. Nothing is written here;
    ``costs`` are the months that the sync can touch, for ``write_cost_table`` to replace,
    and ``alerts`` are for ``append_table``; :func:`stored_sync` does both.
    """
    daily = account_alias_enrich(feed.cost_feed_daily(feed.usage_cells(lines), as_of), accounts)
    monthly = account_alias_enrich(feed.cost_feed_monthly(lines, as_of), accounts)
    pulled = feed.daily_plus_monthly(daily, monthly)
    # An account under two tenants stays with the first: a total order, whatever order rows arrive in.
    order = F.struct("tenant_id", "granularity", "region", "service", "date", "cost_usd", "usage_quantity", "usage_unit")
    costs = upsert_cost_records(touched_months(stored_costs, as_of), pulled.withColumn("seq", order))
    status = B.budget_status(daily, budgets, as_of, "account", accounts)
    fired = B.budget_alerts(status, now)
    ordered = fired.withColumn("seq", F.col("evaluated_account"))
    alerts = alert_dedup_append(AL.budget_alert_events(ordered, "seq"), stored_alerts)
    key = ["tenant_id", "aws_account_id"]
    forecast = FC.forecast_interval(costs, as_of)
    counts = pulled.groupBy(*key).agg(
        F.count_if(F.col("granularity") == "DAILY").alias("daily_records"),
        F.count_if(F.col("granularity") == "MONTHLY").alias("monthly_records"),
        F.count("*").alias("total_upserted"),
    )
    firing = fired.groupBy("tenant_id", F.col("evaluated_account").alias("aws_account_id")).agg(F.count("*").alias("alerts"))
    zero = F.lit(0).cast("bigint")
    summary = (
        accounts.select(*key)
        .join(counts, key, "left")
        .join(firing, key, "left")
        .join(forecast.select(*key, "mean_usd"), key, "left")
        .select(
            *key,
            *[F.coalesce(c, zero).alias(c) for c in ("daily_records", "monthly_records", "total_upserted", "alerts")],
            F.col("mean_usd").alias("forecast_mean_usd"),
        )
    )
    return Sync(daily, monthly, costs, alerts, forecast, summary)


def stored_sync(sync: Sync, costs_path: str, alerts_path: str, batch_id: int) -> None:
    """Store what a sync changed. A sync that is run again under its batch id leaves the same tables, if its alerts were
    found against ``earlier_batches``.

    Alerts go first: they are found against the alerts stored before, and the fact table may be read by their plan.
    """
    append_table(sync.alerts, alerts_path, batch_id)
    write_cost_table(sync.costs, costs_path)


def sync_tables(
    spark: SparkSession, lines: DataFrame, accounts: DataFrame, budgets: DataFrame, folder: str, batch_id: int, as_of, now: Column
) -> Sync:
    """One sync against the tables in ``folder``, stored there: cost records, alerts, anomalies and forecasts.

    ``batch_id`` counts syncs from 0. Everything is found against the fact table and the batches before, so a sync that
    stopped anywhere is simply run again. Anomalies and forecasts are those of the fact table after the sync.
    """
    facts = f"{folder}/cost_records"
    stored = earlier_batches(spark, f"{folder}/alerts", ALERTS, batch_id)
    done = run_ingestion(lines, accounts, budgets, spark.read.parquet(facts), stored, as_of, now)
    stored_sync(done, facts, f"{folder}/alerts", batch_id)
    after = spark.read.parquet(facts)
    append_table(anomalies_table(A.anomaly_events(after, as_of).withColumn("suspected_cause", F.lit("")), now), f"{folder}/anomalies", batch_id)
    breaches = FC.budget_breach(after, budgets, as_of).withColumns(
        {"forecast_period": F.lit("monthly"), "method": F.lit("linear"), "notes": F.lit(""), "confidence_level": F.lit(0)}
    )
    append_table(forecasts_table(breaches, as_of), f"{folder}/forecasts", batch_id)
    return done
