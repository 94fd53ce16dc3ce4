"""Sync jobs: health per account, and the state they leave on the account."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import scoped


def ingestion_job_health(jobs: DataFrame, tenant_id=None) -> DataFrame:
    """Runs, success rate, records, duration and last error per account."""
    ok, failed = F.col("status") == "success", F.col("status") == "error"
    seconds = F.unix_micros(F.col("completed_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))
    message = F.array_join("errors", "; ")
    last = F.max(F.when(failed, F.struct("started_at", "job_id", message.alias("message"))))
    return (
        scoped(jobs, tenant_id)
        .groupBy("tenant_id", "aws_account_id")
        .agg(
            F.count("*").alias("runs"),
            F.count_if(ok).alias("succeeded"),
            F.count_if(failed).alias("failed"),
            F.round(F.count_if(ok) / F.nullif(F.count_if(ok | failed), F.lit(0)) * 100, 4).alias("success_pct"),
            F.sum("records_pulled").alias("records_pulled"),
            F.sum(seconds / 1_000_000).cast("bigint").alias("total_seconds"),
            last.alias("last"),
        )
        .withColumns({"last_error": F.col("last.message"), "last_error_job": F.col("last.job_id")})
        .drop("last")
    )


def account_sync_status(accounts: DataFrame, jobs: DataFrame) -> DataFrame:
    """Accounts after their newest finished job.

    Success sets ``active``, the sync time, and clears the error; anything else sets
    ``error`` and joins the messages, leaving the last sync time. An account
    without a finished job stays as it is.
    """
    finished = jobs.where(F.col("status") != "running")
    newest = finished.groupBy("tenant_id", "aws_account_id").agg(
        F.max(F.struct("completed_at", "job_id", "status", F.array_join("errors", "; ").alias("message"))).alias("j")
    )
    ok = F.col("j.status") == "success"
    return accounts.join(newest, ["tenant_id", "aws_account_id"], "left").select(
        "tenant_id", "aws_account_id",
        F.when(F.col("j").isNull(), F.col("status")).when(ok, "active").otherwise("error").alias("status"),
        F.when(ok, F.col("j.completed_at")).otherwise(F.col("last_synced_at")).alias("last_synced_at"),
        F.when(F.col("j").isNull(), F.col("last_error"))
        .when(~ok, F.coalesce("j.message", F.lit("")))
        .alias("last_error"),
    )


def account_alias_enrich(costs: DataFrame, accounts: DataFrame) -> DataFrame:
    """Put the account's alias on every row; without one the account id itself."""
    names = accounts.select(
        "tenant_id", "aws_account_id", F.nullif(F.col("account_alias"), F.lit("")).alias("_alias")
    )
    return (
        costs.join(names, ["tenant_id", "aws_account_id"], "left")
        .withColumn("account_alias", F.coalesce("_alias", "aws_account_id"))
        .drop("_alias")
    )
