"""Budgets against spend.

A budget may leave account, service group and region open (NULL = any). Instead of
a theta join with three ``IS NULL OR =`` tests, the pre-aggregated spend is grouped
by all eight combinations of the three columns. Each budget then equals exactly one
cell, so the match is a plain equi join: no broadcast is needed, no nested loop can
be planned, and the number of budgets may grow with the number of tenants.
"""

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import as_date, money, month_start, pct_of_limit, severity_for_pct, usd_text
from ..functions.dates import days_before, week_start
from ..functions.money import pct_text
from ..schemas import TOTAL
from ..sources.tables import scoped

SCOPE = ["aws_account_id", "service_group", "region"]
DEFAULT_ALERT_PCT = 80


def _pattern(columns: list[Column]) -> Column:
    """Which of the scope columns are open, as a bit mask (first column highest)."""
    bits = [F.when(c.isNull(), 1 << (len(columns) - 1 - i)).otherwise(0) for i, c in enumerate(columns)]
    return sum(bits[1:], bits[0]).cast("int")


def spend_cells(slices: DataFrame, measures: list[str], per_account: bool) -> DataFrame:
    """Sum slices for every combination of open scope columns.

    With ``per_account`` the account is never open.
    """
    fixed = ["tenant_id", "aws_account_id"] if per_account else ["tenant_id"]
    free = SCOPE[1:] if per_account else SCOPE
    sets = [fixed + list(c) for r in range(len(free) + 1) for c in itertools.combinations(free, r)]
    columns = ["tenant_id", *SCOPE]
    cells = slices.groupingSets(sets, *columns).agg(
        F.grouping_id(*columns).alias("gid"), *[F.sum(m).cast(TOTAL).alias(m) for m in measures]
    )
    blank = [F.coalesce(F.col(c), F.lit("")).alias(f"k_{c}") for c in SCOPE]
    return cells.select(
        F.col("tenant_id").alias("k_tenant"), *blank, F.col("gid").cast("int").alias("k_pattern"), *measures
    )


def match_budgets(slices, budgets, measures, scope="tenant", accounts=None) -> DataFrame:
    """Every budget with the spend of its scope; a budget without spend gets 0.

    ``scope="account"`` evaluates budgets the way a per-account sync does: an open
    account means "the account being synced", so such a budget yields one row per
    account of its tenant. ``scope="tenant"`` sums an open account over the tenant.
    """
    if scope == "account":
        pulled = accounts.select("tenant_id", F.col("aws_account_id").alias("evaluated_account")).distinct()
        own = F.col("aws_account_id")
        fixed = budgets.where(own.isNotNull()).withColumn("evaluated_account", own)
        anywhere = budgets.where(own.isNull()).join(pulled, "tenant_id")
        rows = fixed.unionByName(anywhere)
        key = [F.col("evaluated_account"), F.col("service_group"), F.col("region")]
    elif scope == "tenant":
        rows = budgets.withColumn("evaluated_account", F.col("aws_account_id"))
        key = [F.col(c) for c in SCOPE]
    else:
        raise ValueError("scope must be 'account' or 'tenant'")
    cells = spend_cells(slices, measures, per_account=scope == "account")
    condition = (rows["tenant_id"] == cells["k_tenant"]) & (_pattern(key) == cells["k_pattern"])
    for k, name in zip(key, SCOPE):
        condition &= F.coalesce(k, F.lit("")) == cells[f"k_{name}"]
    zero = F.lit(0).cast(TOTAL)
    return rows.join(cells, condition, "left").select(
        *[rows[c] for c in rows.columns], *[F.coalesce(cells[m], zero).alias(m) for m in measures]
    )


def month_to_date_slices(costs, as_of, tenant_id=None, aws_account_id=None) -> DataFrame:
    """Spend of the running month per scope. Costs are pulled up to yesterday."""
    rows = scoped(costs, tenant_id, aws_account_id, "DAILY", month_start(as_of), as_of)
    return rows.groupBy("tenant_id", *SCOPE).agg(F.sum("cost_usd").alias("current_usd"))


def _status(matched: DataFrame) -> DataFrame:
    pct = pct_of_limit(F.col("current_usd"), F.col("limit_usd"))
    threshold = F.coalesce(F.col("alert_at_pct"), F.lit(DEFAULT_ALERT_PCT))
    return matched.select(
        F.col("id").alias("budget_id"),
        F.col("name").alias("budget_name"),
        "tenant_id", "aws_account_id", "evaluated_account", "service_group", "region", "period",
        money(F.col("current_usd")).alias("current_usd"),
        money(F.col("limit_usd")).alias("limit_usd"),
        F.round(pct, 1).alias("percent_used"),
        (pct >= threshold).alias("firing"),
        F.when(pct >= threshold, severity_for_pct(pct)).otherwise("ok").alias("severity"),
    )


def budget_wildcard_join(costs, budgets, as_of, scope="tenant", accounts=None) -> DataFrame:
    """Budget id and unrounded month-to-date spend of its scope."""
    matched = match_budgets(month_to_date_slices(costs, as_of), budgets, ["current_usd"], scope, accounts)
    return matched.select(F.col("id").alias("budget_id"), "tenant_id", "evaluated_account", "current_usd")


def budget_status(costs, budgets, as_of, scope="account", accounts=None, tenant_id=None) -> DataFrame:
    """Month-to-date use of every active budget, whatever its declared period."""
    active = scoped(budgets, tenant_id).where("is_active")
    if scope == "account" and accounts is None:
        raise ValueError("scope='account' needs the list of accounts")
    slices = month_to_date_slices(costs, as_of, tenant_id)
    return _status(match_budgets(slices, active, ["current_usd"], scope, accounts))


def budget_status_by_period(costs, budgets, as_of, scope="tenant", accounts=None, tenant_id=None) -> DataFrame:
    """Like ``budget_status`` but each budget is measured over its own period: the day,
    the week from Monday or the month, up to and including ``as_of`` (a daily budget
    would otherwise never see any spend)."""
    active = scoped(budgets, tenant_id).where("is_active")
    first = min(week_start(as_of), month_start(as_of))
    rows = scoped(costs, tenant_id, None, "DAILY", first, days_before(as_of, -1))

    def since(start):
        return F.sum(F.when(F.col("date") >= F.lit(start), F.col("cost_usd")))

    measures = {"daily": as_date(as_of), "weekly": week_start(as_of), "monthly": month_start(as_of)}
    slices = rows.groupBy("tenant_id", *SCOPE).agg(*[since(s).alias(p) for p, s in measures.items()])
    matched = match_budgets(slices, active, list(measures), scope, accounts)
    current = (
        F.when(F.col("period") == "daily", F.col("daily"))
        .when(F.col("period") == "weekly", F.col("weekly"))
        .otherwise(F.col("monthly"))
    )
    return _status(matched.withColumn("current_usd", current))


def budget_alerts(status: DataFrame, triggered_at: Column) -> DataFrame:
    """The firing budgets as alerts ready to be stored or sent."""
    text = F.concat(
        F.lit("Budget alert: '"), F.col("budget_name"), F.lit("' is at "), pct_text(F.col("percent_used")),
        F.lit("% — "), usd_text(F.col("current_usd")), F.lit(" of "), usd_text(F.col("limit_usd")),
    )
    return status.where("firing").select(
        "budget_id", "budget_name", "tenant_id", "aws_account_id", "evaluated_account", "service_group",
        "current_usd", "limit_usd", "percent_used", "severity",
        triggered_at.alias("triggered_at"), text.alias("message"),
    )
