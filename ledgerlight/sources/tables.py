"""Predicates and scans over the cost, inventory, budget, alert and account tables.

Every scan takes an optional tenant and account. Without a tenant the operators
answer for all tenants at once, one result per tenant.
"""

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import as_date
from ..schemas import TOTAL


def scoped(
    df: DataFrame, tenant_id=None, aws_account_id=None, granularity=None, start=None, end=None,
    date_col: str = "date",
) -> DataFrame:
    """Tenant, account and granularity equality plus ``start <= date < end``.

    Absent arguments add no predicate. All of them are literals over plain
    columns, so they reach the Parquet scan. Of a stored table, which has a ``month``
    for each ``date``, only the months of the range are listed and read.
    """
    if tenant_id is not None:
        df = df.where(F.col("tenant_id") == tenant_id)
    if aws_account_id is not None:
        df = df.where(F.col("aws_account_id") == aws_account_id)
    if granularity is not None:
        df = df.where(F.col("granularity") == granularity)
    if start is not None:
        df = df.where(F.col(date_col) >= F.lit(as_date(start)))
    if end is not None:
        df = df.where(F.col(date_col) < F.lit(as_date(end)))
    if date_col == "date" and "month" in df.columns:
        if start is not None:
            df = df.where(F.col("month") >= F.lit(as_date(start).replace(day=1)))
        if end is not None:
            df = df.where(F.col("month") <= F.lit((as_date(end) - dt.timedelta(days=1)).replace(day=1)))
    return df


def day_cells(costs: DataFrame, start, end, tenant_id=None) -> DataFrame:
    """Daily spend per account, service and region: all that period questions need of the facts, and far fewer rows."""
    keys = ["tenant_id", "aws_account_id", "date", "granularity", "service", "service_group", "region"]
    return scoped(costs, tenant_id, None, "DAILY", start, end).groupBy(*keys).agg(F.sum("cost_usd").cast(TOTAL).alias("cost_usd"))


# Spark cuts a window ranked up to this many rows before the exchange.
GROUP_LIMIT = 1000
SALTS = 64


def top_n(df: DataFrame, n: int, order: list, tenant_id=None, by=("tenant_id",)) -> DataFrame:
    """First ``n`` rows per tenant, or overall when one tenant is given.

    Both forms keep only ``n`` rows per task before the exchange (TakeOrdered for
    one tenant, a window group limit otherwise), so no group is gathered whole. A
    limit too large for that is first applied to slices of each group.
    """
    if tenant_id is not None and tuple(by) == ("tenant_id",):
        return df.orderBy(*order).limit(n)

    def cut(rows: DataFrame, *keys) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(*order)
        return rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")

    if n > GROUP_LIMIT:
        df = cut(df.withColumn("_slice", F.pmod(F.xxhash64(*df.columns), F.lit(SALTS))), *by, "_slice").drop("_slice")
    return cut(df, *by)


def join_per_tenant(rows: DataFrame, per_tenant: DataFrame, spread: str, how: str = "inner") -> DataFrame:
    """Rows met with the one row that ``per_tenant`` has for each tenant.

    The few rows of ``per_tenant`` are copied to ``SALTS`` slices, and rows go to a slice by the hash of ``spread``, so
    a tenant that holds most rows isn't one task's work, broadcast or not.
    """
    copies = per_tenant.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    sliced = rows.withColumn("_slice", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    return sliced.join(copies, ["tenant_id", "_slice"], how).drop("_slice")


def scan_cost_records(
    costs: DataFrame, tenant_id=None, aws_account_id=None, granularity="DAILY", start=None, end=None
) -> DataFrame:
    return scoped(costs, tenant_id, aws_account_id, granularity, start, end)


def scan_inventory(inventory: DataFrame, tenant_id=None, aws_account_id=None, idle_only=False) -> DataFrame:
    rows = scoped(inventory, tenant_id, aws_account_id)
    return rows.where("is_idle") if idle_only else rows


def active_budgets(budgets: DataFrame, tenant_id=None, aws_account_id=None) -> DataFrame:
    """Active budgets; for an account its own budgets plus those for all accounts."""
    rows = scoped(budgets, tenant_id).where("is_active")
    if aws_account_id is not None:
        account = F.col("aws_account_id")
        rows = rows.where(account.isNull() | (account == aws_account_id))
    return rows.select(
        "id", "tenant_id", "name", "aws_account_id", "service_group", "region", "limit_usd",
        "period", "alert_at_pct",
    )


def list_budgets(budgets: DataFrame, tenant_id=None) -> DataFrame:
    """All budgets, active or not, newest first."""
    return scoped(budgets, tenant_id).orderBy(F.col("created_at").desc(), "id")


def list_alerts(alerts: DataFrame, tenant_id=None, state=None, limit: int = 50) -> DataFrame:
    """Newest alerts of a tenant, optionally of one state."""
    rows = scoped(alerts, tenant_id)
    if state is not None:
        rows = rows.where(F.col("state") == state)
    return top_n(rows, limit, [F.col("triggered_at").desc(), F.col("id")], tenant_id)


def list_accounts(accounts: DataFrame, tenant_id=None) -> DataFrame:
    return scoped(accounts, tenant_id).orderBy(F.col("created_at").desc(), "aws_account_id")
