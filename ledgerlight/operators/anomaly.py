"""Unusual spend: the last 7 days against the 90 days before them.

Means are per calendar day (sum / 7 and sum / 90), so days without spend count as
zero and no calendar has to be generated.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import as_date, per_day, stable_id
from ..functions.dates import days_before
from ..schemas import AVERAGE, MONEY, PERCENT, TOTAL
from ..sources.tables import scoped

CURRENT_DAYS = 7
BASELINE_DAYS = 90
SPIKE_PCT = 50
SHIFT_POINTS = 10
SEASONAL_Z = 3.0
SEASONAL_MIN_SAMPLES = 4

ANOMALY_COLUMNS = [
    "tenant_id", "aws_account_id", "anomaly_type", "severity", "service", "region", "current_value",
    "baseline_value", "percent_change", "description",
]


def window_rows(costs, as_of, tenant_id=None, aws_account_id=None) -> DataFrame:
    start = days_before(as_of, CURRENT_DAYS + BASELINE_DAYS)
    return scoped(costs, tenant_id, aws_account_id, "DAILY", start, as_of)


def is_current(as_of) -> Column:
    return F.col("date") >= F.lit(days_before(as_of, CURRENT_DAYS))


def window_sums(costs, as_of, keys, tenant_id=None, aws_account_id=None) -> DataFrame:
    """Current and baseline sums per scope, from one scan. NULL = no rows in the window."""
    current = is_current(as_of)
    return (
        window_rows(costs, as_of, tenant_id, aws_account_id)
        .groupBy("tenant_id", "aws_account_id", *keys)
        .agg(
            F.sum(F.when(current, F.col("cost_usd"))).cast(TOTAL).alias("cur"),
            F.sum(F.when(~current, F.col("cost_usd"))).cast(TOTAL).alias("base"),
        )
    )


def _avg(column: str | Column, days: int) -> Column:
    return F.coalesce(_column(column), F.lit(0)).cast("double") / days


def _avg_usd(column: str | Column, days: int) -> Column:
    return per_day(F.coalesce(_column(column), F.lit(0)), days, 2)


def _column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


CURRENT, BASELINE = ("cur", CURRENT_DAYS), ("base", BASELINE_DAYS)


def _fields(type_, severity, service, region, current, baseline, pct, description) -> list[Column]:
    return [
        type_.alias("anomaly_type"),
        severity.alias("severity"),
        service.cast("string").alias("service"),
        region.cast("string").alias("region"),
        F.round(current, 2).cast(MONEY).alias("current_value"),
        F.round(baseline, 2).cast(MONEY).alias("baseline_value"),
        F.round(pct, 2).cast(PERCENT).alias("percent_change"),
        description.alias("description"),
    ]


def _shape(df, type_, *fields) -> DataFrame:
    return df.select("tenant_id", "aws_account_id", *_fields(F.lit(type_), *fields))


def spend_spikes(costs, as_of, by_region=False, threshold_pct=SPIKE_PCT, tenant_id=None, aws_account_id=None) -> DataFrame:
    """Scopes whose daily mean rose by more than 50 % over a positive baseline."""
    keys = ["service", "region"] if by_region else ["service"]
    sums = window_sums(costs, as_of, keys, tenant_id, aws_account_id)
    current, baseline = _avg(*CURRENT), _avg(*BASELINE)
    pct = (current - baseline) / baseline * 100
    fired = sums.where((baseline > 0) & F.col("cur").isNotNull()).where(pct > threshold_pct)
    severity = F.when(pct < 100, "info").when(pct < 200, "warning").otherwise("critical")
    region = F.col("region") if by_region else F.lit(None)
    text = F.concat(F.col("service"), F.lit(" daily spend is above its 90-day mean"))
    return _shape(
        fired, "spend_spike", severity, F.col("service"), region, _avg_usd(*CURRENT), _avg_usd(*BASELINE), pct, text
    )


def new_services(costs, as_of, tenant_id=None, aws_account_id=None) -> DataFrame:
    """Services with spend in the current window and no row in the baseline."""
    sums = window_sums(costs, as_of, ["service"], tenant_id, aws_account_id)
    fresh = sums.where(F.col("base").isNull() & (F.col("cur") > 0))
    text = F.concat(F.col("service"), F.lit(" was not used in the 90 days before"))
    return _shape(
        fresh, "new_service", F.lit("info"), F.col("service"), F.lit(None),
        _avg_usd(*CURRENT), F.lit(0), F.lit(0.0), text,
    )


def regional_shift(costs, as_of, points=SHIFT_POINTS, tenant_id=None, aws_account_id=None) -> DataFrame:
    """Regions whose share of the account's spend moved by at least 10 points."""
    sums = window_sums(costs, as_of, ["region"], tenant_id, aws_account_id)
    # At most one row per region and account.
    account = Window.partitionBy("tenant_id", "aws_account_id")

    def share(c):
        whole = F.sum(c).over(account).cast("double")
        return F.when(whole > 0, F.coalesce(F.col(c), F.lit(0)).cast("double") / whole * 100)

    shares = sums.withColumns({"cur_share": share("cur"), "base_share": share("base")})
    change = F.col("cur_share") - F.col("base_share")
    moved = shares.where(F.abs(change) >= points)
    severity = F.when(F.abs(change) < 2 * points, "info").otherwise("warning")
    text = F.concat(F.lit("Share of "), F.col("region"), F.lit(" in account spend shifted"))
    return _shape(
        moved, "regional_shift", severity, F.lit(None), F.col("region"),
        _avg_usd(*CURRENT), _avg_usd(*BASELINE), change, text,
    )


def weekday_stats(costs, as_of, tenant_id=None, aws_account_id=None) -> DataFrame:
    """Per account and weekday: the current week's day total beside mean and deviation
    of the same weekday in the baseline. Seven days hold each weekday once, so one
    aggregation replaces a join of days with statistics."""
    daily = (
        window_rows(costs, as_of, tenant_id, aws_account_id)
        .groupBy("tenant_id", "aws_account_id", "date")
        .agg(F.sum("cost_usd").cast(TOTAL).alias("day_total"))
    )
    current = is_current(as_of)
    past = F.when(~current, F.col("day_total"))
    return daily.groupBy("tenant_id", "aws_account_id", F.dayofweek("date").alias("weekday")).agg(
        F.max(F.when(current, F.col("date"))).alias("date"),
        F.max(F.when(current, F.col("day_total"))).alias("day_total"),
        F.avg(past).alias("mean"),
        F.stddev_samp(past.cast("double")).alias("sd"),
        F.count(past).alias("samples"),
    )


def seasonal_deviation(costs, as_of, z_min=SEASONAL_Z, tenant_id=None, aws_account_id=None) -> DataFrame:
    """Days of the current week far from what their weekday usually costs."""
    stats = weekday_stats(costs, as_of, tenant_id, aws_account_id)
    usable = stats.where(
        F.col("day_total").isNotNull() & (F.col("samples") >= SEASONAL_MIN_SAMPLES) & (F.col("sd") > 0)
    )
    total, mean = F.col("day_total").cast("double"), F.col("mean").cast("double")
    odd = usable.withColumn("z", (total - mean) / F.col("sd")).where(F.abs("z") >= z_min)
    pct = F.when(mean != 0, (total - mean) / mean * 100)
    severity = F.when(F.abs("z") < 2 * z_min, "warning").otherwise("critical")
    text = F.concat(F.lit("Spend of "), F.col("date").cast("string"), F.lit(" is unusual for its weekday"))
    return _shape(
        odd, "unusual_pattern", severity, F.lit(None), F.lit(None), F.col("day_total"), F.col("mean"), pct, text
    )


def filled_moments(total: str, n_days: int) -> dict[str, Column]:
    """Aggregates of a daily series in which missing days count as zero.

    Computed from the present days alone: ``n - k`` zeros add nothing to the sum and
    ``k (n - k) / n * mean^2`` to the squared deviations.
    """
    y = F.col(total)
    k, mean = F.count(y), F.avg(y)
    m2 = F.coalesce(F.var_pop(y) * k, F.lit(0.0)) + F.coalesce(mean * mean * k * (n_days - k) / n_days, F.lit(0.0))
    return {
        "avg": F.coalesce(F.sum(y), F.lit(0.0)) / n_days,
        "m2": m2,
        "stddev": F.sqrt(m2 / (n_days - 1)),
    }


def baseline_stats(costs, as_of, tenant_id=None, aws_account_id=None) -> DataFrame:
    """Daily statistics of the baseline and of the current week per account."""
    daily = (
        window_rows(costs, as_of, tenant_id, aws_account_id)
        .groupBy("tenant_id", "aws_account_id", "date")
        .agg(F.sum("cost_usd").alias("t"))
    )
    current = is_current(as_of)
    series = daily.select(
        "tenant_id", "aws_account_id",
        F.when(~current, F.col("t")).alias("b"),
        F.when(current, F.col("t")).alias("c"),
        F.when(~current, F.col("t")).cast("double").alias("b_double"),
    )

    def lowest(c, days):
        low = F.coalesce(F.min(c), F.lit(0))
        return F.when(F.count(c) < days, F.least(low, F.lit(0))).otherwise(low)

    def highest(c, days):
        high = F.coalesce(F.max(c), F.lit(0))
        return F.when(F.count(c) < days, F.greatest(high, F.lit(0))).otherwise(high)

    def usd(column):
        return F.round(column, 4).cast(AVERAGE)

    total_b, total_c = (F.coalesce(F.sum(c), F.lit(0)) for c in "bc")
    return series.groupBy("tenant_id", "aws_account_id").agg(
        per_day(total_b, BASELINE_DAYS).alias("avg_daily"),
        F.round(filled_moments("b_double", BASELINE_DAYS)["stddev"], 4).alias("std_dev"),
        usd(lowest("b", BASELINE_DAYS)).alias("min_daily"),
        usd(highest("b", BASELINE_DAYS)).alias("max_daily"),
        F.round(total_c, 2).cast(MONEY).alias("current_total"),
        per_day(total_c, CURRENT_DAYS).alias("current_avg"),
        usd(highest("c", CURRENT_DAYS)).alias("current_peak"),
        usd(lowest("c", CURRENT_DAYS)).alias("current_low"),
    )


def account_vectors(costs, as_of, tenant_id=None, aws_account_id=None) -> DataFrame:
    """One row per account, from one scan: its services and regions with both windows' sums, and its days.

    Facts are summed to days per service and region first, so the grouping sets expand cells and not the facts. The
    three lists are as long as an account has services, regions and days of the 97. A sum is NULL without rows.
    """
    current, keys = is_current(as_of), ["tenant_id", "aws_account_id", "service", "region", "date"]
    cells = window_rows(costs, as_of, tenant_id, aws_account_id).groupBy(*keys).agg(F.sum("cost_usd").alias("cost_usd"))
    sets = cells.groupingSets([[*keys[:2], k] for k in keys[2:]], *keys).agg(
        F.grouping_id(*keys).cast("int").alias("gid"),
        F.sum(F.when(current, F.col("cost_usd"))).cast(TOTAL).alias("cur"),
        F.sum(F.when(~current, F.col("cost_usd"))).cast(TOTAL).alias("base"),
    )

    def listed(gid, *fields):
        return F.collect_list(F.when(F.col("gid") == gid, F.struct(*fields)))

    return sets.groupBy("tenant_id", "aws_account_id").agg(
        listed(0b011, F.col("service").alias("name"), "cur", "base").alias("services"),
        listed(0b101, F.col("region").alias("name"), "cur", "base").alias("regions"),
        listed(0b110, "date", "cur", "base").alias("days"),
    )


def _service_events(threshold_pct) -> Column:
    """Spikes and new services; no service is both."""
    def event(s):
        current, baseline = _avg(s["cur"], CURRENT_DAYS), _avg(s["base"], BASELINE_DAYS)
        pct = (current - baseline) / F.when(baseline > 0, baseline) * 100
        spike = s["cur"].isNotNull() & (pct > threshold_pct)
        fresh = s["base"].isNull() & (s["cur"] > 0)
        severity = F.when(fresh | (pct < 100), "info").when(pct < 200, "warning").otherwise("critical")
        text = F.concat(s["name"], F.when(fresh, " was not used in the 90 days before").otherwise(" daily spend is above its 90-day mean"))
        kind = F.when(fresh, "new_service").otherwise("spend_spike")
        found = F.struct(*_fields(
            kind, severity, s["name"], F.lit(None), _avg_usd(s["cur"], CURRENT_DAYS), _avg_usd(s["base"], BASELINE_DAYS),
            F.when(fresh, 0.0).otherwise(pct), text,
        ))
        return F.when(spike | fresh, found)

    return F.transform("services", event)


def _region_events(points) -> Column:
    def whole(c):
        total = F.aggregate("regions", F.lit(0).cast(TOTAL), lambda acc, r: (acc + F.coalesce(r[c], F.lit(0))).cast(TOTAL))
        return total.cast("double")

    sums = F.struct(whole("cur").alias("cur"), whole("base").alias("base"))

    def event(r, t):
        def share(c):
            return F.when(t[c] > 0, F.coalesce(r[c], F.lit(0)).cast("double") / t[c] * 100)

        change = share("cur") - share("base")
        severity = F.when(F.abs(change) < 2 * points, "info").otherwise("warning")
        text = F.concat(F.lit("Share of "), r["name"], F.lit(" in account spend shifted"))
        found = F.struct(*_fields(
            F.lit("regional_shift"), severity, F.lit(None), r["name"], _avg_usd(r["cur"], CURRENT_DAYS), _avg_usd(r["base"], BASELINE_DAYS), change, text,
        ))
        return F.when(F.abs(change) >= points, found)

    # The totals are worked out once an account, as the only element of an array.
    return F.flatten(F.transform(F.array(sums), lambda t: F.transform("regions", lambda r: event(r, t))))


def _day_events(z_min) -> Column:
    past = F.filter("days", lambda d: d["base"].isNotNull())

    def stats(d):
        same = F.filter(past, lambda p: F.dayofweek(p["date"]) == F.dayofweek(d["date"]))
        total = F.aggregate(same, F.lit(0).cast(TOTAL), lambda acc, p: (acc + p["base"]).cast(TOTAL))
        mean = F.when(F.size(same) > 0, (total / F.size(same)).cast("decimal(32,10)"))
        return F.struct(d.alias("d"), same.alias("same"), mean.alias("mean"))

    def spread(s):
        values = F.transform(s["same"], lambda p: p["base"].cast("double"))
        n = F.size(values)
        mean = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v) / F.when(n > 0, n)
        squares = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + (v - mean) * (v - mean))
        return F.struct(s["d"].alias("d"), s["mean"].alias("mean"), n.alias("n"), F.sqrt(squares / F.when(n > 1, n - 1)).alias("sd"))

    def event(s):
        total, mean = s["d"]["cur"].cast("double"), s["mean"].cast("double")
        z = (total - mean) / F.when(s["sd"] > 0, s["sd"])
        severity = F.when(F.abs(z) < 2 * z_min, "warning").otherwise("critical")
        text = F.concat(F.lit("Spend of "), s["d"]["date"].cast("string"), F.lit(" is unusual for its weekday"))
        found = F.struct(*_fields(
            F.lit("unusual_pattern"), severity, F.lit(None), F.lit(None), s["d"]["cur"], s["mean"], F.when(mean != 0, (total - mean) / mean * 100), text,
        ))
        return F.when((s["n"] >= SEASONAL_MIN_SAMPLES) & (F.abs(z) >= z_min), found)

    now = F.filter("days", lambda d: d["cur"].isNotNull())
    return F.transform(F.transform(F.transform(now, stats), spread), event)


def anomaly_events(costs, as_of, tenant_id=None, aws_account_id=None) -> DataFrame:
    """All detectors in the shape of the anomaly table.

    One scan and one row per account; every detector is a fold over the account's lists.
    """
    vectors = account_vectors(costs, as_of, tenant_id, aws_account_id)
    found = F.concat(_service_events(SPIKE_PCT), _region_events(SHIFT_POINTS), _day_events(SEASONAL_Z))
    rows = vectors.select("tenant_id", "aws_account_id", F.inline(F.array_compact(found)))
    key = [F.col(c) for c in ("tenant_id", "aws_account_id", "anomaly_type", "service", "region", "description")]
    return rows.select(
        stable_id("anomaly", *key, F.lit(as_date(as_of))).alias("id"), *ANOMALY_COLUMNS,
    )
