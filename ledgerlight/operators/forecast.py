"""Month-end forecasts per account from the last 60 days.

The daily series counts days without spend as zero. No calendar is generated for
it: on a fixed 60-day grid the zero days only contribute constants, so trend,
weekday means and deviations follow from sums over the days that have data. Cost:
one aggregation to days, one to accounts, whatever the number of scopes.

``as_of`` is the first day to be forecast; the month's remaining days include it.
"""

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import as_date, month_end, month_start, per_day, stable_id
from ..functions.dates import days_before
from ..schemas import MONEY, TOTAL
from ..sources.tables import scoped
from .anomaly import filled_moments

HISTORY_DAYS = 60
DEFAULT_BUDGET = 10000
Z_80 = 1.2816  # two-sided 80 % of a normal distribution
LOGISTIC = 1.702  # scale that brings the logistic curve close to the normal one


def remaining_days(as_of) -> int:
    return (month_end(as_of) - as_date(as_of)).days + 1


def daily_totals(costs, as_of, tenant_id=None, aws_account_id=None) -> DataFrame:
    """Account totals per day of the history, with the day's position 0..59."""
    start = days_before(as_of, HISTORY_DAYS)
    return (
        scoped(costs, tenant_id, aws_account_id, "DAILY", start, as_of)
        .groupBy("tenant_id", "aws_account_id", "date")
        .agg(F.sum("cost_usd").cast(TOTAL).alias("total"))
        .withColumn("x", F.datediff("date", F.lit(start)))
    )


def _weekday_weights(as_of) -> dict[int, tuple[int, int]]:
    """Weekday (Sunday = 1) -> how often it occurs in the history and in the rest of the month."""
    out = {d: [0, 0] for d in range(1, 8)}
    start, n = days_before(as_of, HISTORY_DAYS), remaining_days(as_of)
    for i in range(HISTORY_DAYS + n):
        day = start + dt.timedelta(days=i)
        out[day.isoweekday() % 7 + 1][0 if i < HISTORY_DAYS else 1] += 1
    return {d: tuple(v) for d, v in out.items()}


def account_series(costs, as_of, tenant_id=None, aws_account_id=None) -> DataFrame:
    """Everything the forecasts need, one row per account."""
    n = HISTORY_DAYS
    daily = daily_totals(costs, as_of, tenant_id, aws_account_id).withColumn("y", F.col("total").cast("double"))
    moments = filled_moments("y", n)
    # 2x - 59 is an integer, so the centred cross product is an exact decimal sum.
    cross = F.sum((2 * F.col("x") - (n - 1)) * F.col("total")).cast("double") / 2
    positive = F.col("total") > 0
    ln_y, ln_x = F.when(positive, F.ln("y")), F.when(positive, F.col("x").cast("double"))
    weekday = [
        F.coalesce(F.sum(F.when(F.dayofweek("date") == d, F.col("total"))).cast("double"), F.lit(0.0)).alias(f"wd{d}")
        for d in range(1, 8)
    ]
    mtd = F.coalesce(F.sum(F.when(F.col("date") >= F.lit(month_start(as_of)), F.col("total"))), F.lit(0))
    return daily.groupBy("tenant_id", "aws_account_id").agg(
        mtd.cast(TOTAL).alias("mtd"),
        F.sum("total").cast(TOTAL).alias("sum_total"),
        cross.alias("sxy"),
        moments["avg"].alias("mean"),
        moments["m2"].alias("syy"),
        moments["stddev"].alias("sd"),
        F.regr_slope(ln_y, ln_x).alias("ln_slope"),
        F.regr_intercept(ln_y, ln_x).alias("ln_icept"),
        F.regr_r2(ln_y, ln_x).alias("ln_r2"),
        *weekday,
    )


def _trend() -> tuple[Column, Column, Column]:
    n = HISTORY_DAYS
    sxx = n * (n * n - 1) / 12
    slope = F.col("sxy") / F.lit(sxx)
    intercept = F.col("mean") - slope * ((n - 1) / 2)
    r2 = F.when(F.col("syy") > 0, F.col("sxy") * F.col("sxy") / (F.col("syy") * sxx)).otherwise(F.lit(1.0))
    return slope, intercept, r2


def _future(as_of) -> Column:
    return F.sequence(F.lit(HISTORY_DAYS), F.lit(HISTORY_DAYS + remaining_days(as_of) - 1))


def _clip01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def _shape(series: DataFrame, method: str, projected: Column, confidence: Column) -> DataFrame:
    return series.select(
        "tenant_id", "aws_account_id",
        F.lit(method).alias("method"),
        F.col("mtd").alias("mtd_usd"),
        F.round(projected, 4).alias("projected_month_end_usd"),
        F.round(_clip01(confidence), 4).alias("confidence_level"),
    )


def _linear_projection(as_of) -> Column:
    slope, icept, _ = _trend()
    rest = F.aggregate(
        _future(as_of), F.lit(0.0), lambda acc, x: acc + F.greatest(F.lit(0.0), F.col("icept") + F.col("slope") * x)
    )
    return F.col("mtd").cast("double") + rest


def _with_trend(series: DataFrame) -> DataFrame:
    slope, icept, r2 = _trend()
    return series.withColumns({"slope": slope, "icept": icept, "r2": r2})


def forecast_linear(costs, as_of, tenant_id=None, aws_account_id=None) -> DataFrame:
    """Month to date plus the trend line over the remaining days, never below zero a day."""
    series = _with_trend(account_series(costs, as_of, tenant_id, aws_account_id))
    return _shape(series, "linear", _linear_projection(as_of), F.col("r2"))


def forecast_exponential(costs, as_of, tenant_id=None, aws_account_id=None) -> DataFrame:
    """Trend of the logarithm over days with positive spend; none with fewer than two such days."""
    series = account_series(costs, as_of, tenant_id, aws_account_id).where(F.col("ln_slope").isNotNull())
    return _shape(series, "exponential", *_exponential(as_of))


def _exponential(as_of) -> tuple[Column, Column]:
    rest = F.aggregate(
        _future(as_of), F.lit(0.0), lambda acc, x: acc + F.exp(F.col("ln_icept") + F.col("ln_slope") * x)
    )
    return F.col("mtd").cast("double") + rest, F.coalesce("ln_r2", F.lit(1.0))


def forecast_seasonal(costs, as_of, tenant_id=None, aws_account_id=None) -> DataFrame:
    """Every remaining day costs the mean of its weekday. Confidence is the share of
    the variance explained by the weekday."""
    return _shape(account_series(costs, as_of, tenant_id, aws_account_id), "seasonal", *_seasonal(as_of))


def _seasonal(as_of) -> tuple[Column, Column]:
    weights = _weekday_weights(as_of)
    rest, between = F.lit(0.0), F.lit(0.0)
    for d, (past, ahead) in weights.items():
        mean = F.col(f"wd{d}") / past
        rest = rest + mean * ahead
        between = between + past * (mean - F.col("mean")) * (mean - F.col("mean"))
    confidence = F.when(F.col("syy") > 0, between / F.col("syy")).otherwise(F.lit(1.0))
    return F.col("mtd").cast("double") + rest, confidence


LEARNING_DAYS, HELD_DAYS = 14, 14
# Weights of level, trend and weekday that are tried, in this order.
SMOOTHING = [(level, trend, weekday) for level in (0.1, 0.3, 0.6) for trend in (0.0, 0.1) for weekday in (0.1, 0.4)]


def forecast_ml(costs, as_of, tenant_id=None, aws_account_id=None) -> DataFrame:
    """Exponential smoothing with a trend and weekdays, with the weights that predict held-back days best.

    Level and weekdays start from the first two weeks; each later day is predicted, then learned from. Of the weights in
    ``SMOOTHING`` those with the smallest squared error over the last two weeks are taken (the first of several), each
    day of which is predicted before it is seen. Confidence is the share of these days' squares around the mean day that
    the predictions explain. Days without spend count as zero; no projected day is below zero.

    An account is one row with an array of its 60 days; the smoothing is a fold over it.
    """
    mtd = F.coalesce(F.sum(F.when(F.col("date") >= F.lit(month_start(as_of)), F.col("total"))), F.lit(0))
    early = F.coalesce(F.sum(F.when(F.col("x") < LEARNING_DAYS, F.col("total"))), F.lit(0))
    series = daily_totals(costs, as_of, tenant_id, aws_account_id).groupBy("tenant_id", "aws_account_id").agg(
        mtd.cast(TOTAL).alias("mtd"),
        (early.cast("double") / LEARNING_DAYS).alias("start"),
        (F.sum("total").cast("double") / HISTORY_DAYS).alias("mean"),
        F.map_from_entries(F.collect_list(F.struct("x", F.col("total").cast("double").alias("y")))).alias("known"),
    )
    days = F.transform(F.sequence(F.lit(0), F.lit(HISTORY_DAYS - 1)), lambda x: F.coalesce(F.try_element_at("known", x), F.lit(0.0)))
    weekdays = F.array(*[(F.col("days")[i] + F.col("days")[i + 7]) / 2 - F.col("start") for i in range(7)])
    rows = series.withColumn("days", days).withColumn("weekdays", weekdays)
    weights = F.array(*[
        F.struct(F.lit(a).alias("level"), F.lit(b).alias("trend"), F.lit(c).alias("weekday"), F.lit(i).alias("no"))
        for i, (a, b, c) in enumerate(SMOOTHING)
    ])
    fits = F.transform(weights, lambda w: _smoothed(w))
    # Structs compare field by field: the error first, then the number of the weights.
    best = rows.withColumn("fit", F.array_min(fits))
    level, trend, season = (F.col(f"fit.{c}") for c in ("level", "trend", "season"))
    ahead = F.sequence(F.lit(1), F.lit(remaining_days(as_of)))
    rest = F.aggregate(
        ahead, F.lit(0.0), lambda acc, h: acc + F.greatest(F.lit(0.0), level + h * trend + F.get(season, (h - 1) % 7))
    )
    spread = F.aggregate(F.slice("days", -HELD_DAYS, HELD_DAYS), F.lit(0.0), lambda acc, y: acc + (y - F.col("mean")) * (y - F.col("mean")))
    # Both sums are squares: nothing varies and nothing was missed, or else a share.
    confidence = F.when(F.col("spread") > 0, 1 - F.col("fit.held") / F.col("spread")).otherwise(F.when(F.col("fit.held") == 0, 1.0).otherwise(0.0))
    return _shape(best.withColumn("spread", spread), "ml", F.col("mtd").cast("double") + rest, confidence)


def _smoothed(w: Column) -> Column:
    """The state after the history: the error over the held-back days, the number of the weights, level, trend, and the
    weekdays from the day after the history on."""

    def step(acc, x):
        y, season = F.get("days", x), acc["season"]
        miss = y - (acc["level"] + acc["trend"] + F.get(season, F.lit(0)))
        return F.struct(
            (acc["held"] + F.when(x >= HISTORY_DAYS - HELD_DAYS, miss * miss).otherwise(0.0)).alias("held"),
            acc["no"].alias("no"),
            (acc["level"] + acc["trend"] + w["level"] * miss).alias("level"),
            (acc["trend"] + w["level"] * w["trend"] * miss).alias("trend"),
            F.concat(F.slice(season, 2, 6), F.array(F.get(season, F.lit(0)) + w["weekday"] * miss)).alias("season"),
        )

    start = F.struct(
        F.lit(0.0).alias("held"), w["no"].alias("no"), F.col("start").alias("level"), F.lit(0.0).alias("trend"), F.col("weekdays").alias("season")
    )
    return F.aggregate(F.sequence(F.lit(LEARNING_DAYS), F.lit(HISTORY_DAYS - 1)), start, step)


def forecast_interval(costs, as_of, days_ahead: int = 30, tenant_id=None, aws_account_id=None) -> DataFrame:
    """Total of the next days with an 80 % interval around the daily mean."""
    series = account_series(costs, as_of, tenant_id, aws_account_id)
    mean = F.col("mean") * days_ahead
    half = Z_80 * F.col("sd") * days_ahead**0.5
    period_end = as_date(as_of) + dt.timedelta(days=days_ahead)
    return series.select(
        "tenant_id", "aws_account_id",
        F.lit(as_date(as_of)).alias("period_start"),
        F.lit(period_end).alias("period_end"),
        per_day(F.col("sum_total") * days_ahead, HISTORY_DAYS, 2).alias("mean_usd"),
        F.round(mean - half, 2).cast(MONEY).alias("lower_usd"),
        F.round(mean + half, 2).cast(MONEY).alias("upper_usd"),
    )


def account_budgets(budgets: DataFrame) -> DataFrame:
    """Active budgets on the whole spend of one account."""
    return budgets.where(
        F.col("is_active") & F.col("aws_account_id").isNotNull() & F.col("service_group").isNull() & F.col("region").isNull()
    ).select("tenant_id", "aws_account_id", F.col("id").alias("budget_id"), "limit_usd")


def budget_breach(costs, budgets, as_of, tenant_id=None, aws_account_id=None, default_budget=DEFAULT_BUDGET) -> DataFrame:
    """Chance that the linear forecast exceeds an account's budget, and the first day it does.

    The chance is the logistic approximation of the normal distribution at
    ``(projection - limit) / (sd * sqrt(remaining days))``. ``days_to_breach``
    counts from 1 for ``as_of``, is 0 when the limit is already reached and NULL
    when it is not reached this month. An account without a budget, or with a limit
    of 0, is measured against the default.
    """
    series = _with_trend(account_series(costs, as_of, tenant_id, aws_account_id))
    series = series.withColumn("projected", _linear_projection(as_of))
    rows = series.join(account_budgets(budgets), ["tenant_id", "aws_account_id"], "left").withColumn(
        "budget_limit", _limit_or_default(F.col("limit_usd"), default_budget)
    )
    probability, days = _breach(F.col("budget_limit"), as_of)
    return rows.select(
        "tenant_id", "aws_account_id", "budget_id",
        F.col("mtd").alias("mtd_usd"),
        F.round("projected", 4).alias("projected_month_end_usd"),
        "budget_limit",
        probability.alias("budget_breach_probability"),
        days.alias("days_to_breach"),
    )


def _limit_or_default(limit: Column, default_budget) -> Column:
    return F.coalesce(F.nullif(limit, F.lit(0).cast(MONEY)), F.lit(default_budget).cast(MONEY))


def _breach(budget_limit: Column, as_of) -> tuple[Column, Column]:
    """Chance and first day of the linear forecast exceeding a limit."""
    n = remaining_days(as_of)
    limit, mtd = budget_limit.cast("double"), F.col("mtd").cast("double")
    gap, spread = F.col("projected") - limit, F.col("sd") * n**0.5
    probability = F.when(spread > 0, 1 / (1 + F.exp(-LOGISTIC * gap / spread))).otherwise(
        F.when(gap >= 0, 1.0).otherwise(0.0)
    )

    def step(acc, x):
        spent = acc["spent"] + F.greatest(F.lit(0.0), F.col("icept") + F.col("slope") * x)
        hit = F.when(acc["hit"].isNull() & (spent >= limit), x - HISTORY_DAYS + 1).otherwise(acc["hit"])
        return F.struct(spent.alias("spent"), hit.cast("int").alias("hit"))

    start = F.struct(mtd.alias("spent"), F.when(mtd >= limit, 0).cast("int").alias("hit"))
    return F.round(probability, 4), F.aggregate(_future(as_of), start, step)["hit"]


def forecast_records(costs, budgets, as_of, tenant_id=None, aws_account_id=None, default_budget=DEFAULT_BUDGET) -> DataFrame:
    """All methods in the shape of the forecast table; the tightest budget is attached
    to the linear rows.

    One scan and one row per account, from which every method is a struct of an array; the budgets of an account
    are a list beside it.
    """
    key = ["tenant_id", "aws_account_id"]
    limits = account_budgets(budgets).groupBy(*key).agg(F.collect_list(F.struct("limit_usd")).alias("limits"))
    series = _with_trend(account_series(costs, as_of, tenant_id, aws_account_id)).withColumn("projected", _linear_projection(as_of))
    rows = series.join(limits, key, "left")
    none = F.array(F.struct(F.lit(None).cast(MONEY).alias("limit_usd")))
    held = F.transform(F.coalesce("limits", none), lambda b: _limit_or_default(b["limit_usd"], default_budget))
    rows = rows.withColumn("limits", held)

    def method(name, projected, confidence, limit=None, probability=None, days=None):
        return F.struct(
            F.lit(name).alias("method"),
            F.round(projected, 4).alias("projected"),
            F.round(_clip01(confidence), 4).alias("confidence"),
            (F.lit(None) if limit is None else limit).cast(MONEY).alias("budget_limit"),
            (F.lit(None) if probability is None else probability).cast("double").alias("probability"),
            (F.lit(None) if days is None else days).cast("int").alias("days_to_breach"),
        )

    linear = method(
        "linear", F.col("projected"), F.col("r2"), F.array_min("limits"),
        F.array_max(F.transform("limits", lambda b: _breach(b, as_of)[0])), F.array_min(F.transform("limits", lambda b: _breach(b, as_of)[1])),
    )
    exponential = F.when(F.col("ln_slope").isNotNull(), method("exponential", *_exponential(as_of)))
    methods = F.array_compact(F.array(linear, exponential, method("seasonal", *_seasonal(as_of))))
    day = F.lit(as_date(as_of))
    return rows.select(*key, F.inline(methods)).select(
        stable_id("forecast", F.col("tenant_id"), F.col("aws_account_id"), F.col("method"), day).alias("id"),
        *key,
        F.lit("monthly").alias("forecast_period"),
        day.alias("forecast_date"),
        F.round("projected", 2).cast(MONEY).alias("forecasted_cost_usd"),
        F.round("confidence", 2).cast("decimal(3,2)").alias("confidence_level"),
        "method", "budget_limit",
        F.round("probability", 2).cast("decimal(3,2)").alias("budget_breach_probability"),
        "days_to_breach",
        F.lit("").alias("notes"),
    )
