"""Cost feeds: nested provider pages or raw usage lines -> normalised cost records."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import (
    as_date, exact_sum, monthly_record_id, months_back, normalise_region, parse_amount, record_id,
    service_group,
)
from ..functions.dates import days_before
from ..schemas import COST, COST_FEED, COST_RECORDS, USAGE, WIDE

EXCLUDED_RECORD_TYPES = ("Credit", "Refund")  # fixed values
FEED_KEY = ["tenant_id", "aws_account_id", "date", "service", "raw_region"]


def read_cost_feed(spark: SparkSession, path: str) -> DataFrame:
    """Provider pages as JSON files, one page per line. Paging is simply more files.

    A page that doesn't parse fails the read, it isn't skipped.
    """
    return spark.read.schema(COST_FEED).option("mode", "FAILFAST").json(path)


def feed_lines(pages: DataFrame) -> DataFrame:
    """Flatten pages: one row per period and group, amounts parsed from text and not rounded yet."""
    period = pages.select(
        "tenant_id", "aws_account_id", "account_alias", F.explode("ResultsByTime").alias("p")
    )
    group = period.select(
        "tenant_id", "aws_account_id", "account_alias",
        F.col("p.TimePeriod.Start").cast("date").alias("date"),
        F.explode("p.Groups").alias("g"),
    )
    keys, metrics = F.col("g.Keys"), F.col("g.Metrics")

    def amount(metric: str) -> Column:
        return parse_amount(F.element_at(metrics, F.lit(metric))["Amount"])

    return group.select(
        "tenant_id", "aws_account_id", "account_alias", "date",
        F.coalesce(F.get(keys, F.lit(0)), F.lit("Unknown")).alias("service"),
        F.coalesce(F.get(keys, F.lit(1)), F.lit("global")).alias("raw_region"),
        amount("UnblendedCost").alias("cost_usd"),
        amount("UsageQuantity").alias("usage_quantity"),
        F.coalesce(F.element_at(metrics, F.lit("UsageQuantity"))["Unit"], F.lit("")).alias("usage_unit"),
    )


def usage_cells(lines: DataFrame) -> DataFrame:
    """Raw usage lines -> one line per account, day, service and raw region, with unrounded sums.

    Credits and refunds are left out (an unknown record type stays in). This is
    the one big shuffle of the engine: sums are combined map-side first, so a hot
    account or service costs one partial row per task, and the key carries the
    day, so it spreads over all reducers. The key holds only what identifies a line;
    the alias is looked up per account afterwards.

    Amounts may be floating (a feed's numbers) or decimal; either way the sums are exact to twelve decimals.

    Lines may carry a ``usage_unit``; a cell whose lines differ gets ``N/A``. Text
    cannot be kept in a hash aggregation's buffer, so the unit joins the key first
    and the few units of a cell are merged in a second, small step.
    """
    kept = lines.where(~F.coalesce(F.col("record_type"), F.lit("")).isin(*EXCLUDED_RECORD_TYPES))
    key = FEED_KEY + [c for c in ("account_alias", "usage_unit") if c in lines.columns]
    sums = kept.groupBy(*key).agg(*(exact_sum(lines, c).alias(c) for c in ("cost_usd", "usage_quantity")))
    if "usage_unit" not in key:
        return sums
    unit = F.when(F.min("usage_unit") == F.max("usage_unit"), F.min("usage_unit")).otherwise("N/A")
    return sums.groupBy(*[c for c in key if c != "usage_unit"]).agg(
        F.sum("cost_usd").cast(WIDE).alias("cost_usd"),
        F.sum("usage_quantity").cast(WIDE).alias("usage_quantity"),
        unit.alias("usage_unit"),
    )


def usage_to_cost_rollup(lines: DataFrame) -> DataFrame:
    """The cells of :func:`usage_cells`, each sum rounded once, half up, to the scale of its column."""
    cells = usage_cells(lines)
    rounded = {"cost_usd": F.col("cost_usd").cast(COST), "usage_quantity": F.col("usage_quantity").cast(USAGE)}
    return cells.withColumns(rounded)


def _as_cost_records(df: DataFrame, as_of) -> DataFrame:
    """Complete and order the columns. Without an alias an account goes by its id."""
    stamp = f"timestamp_ntz'{as_date(as_of).isoformat()} 00:00:00'"
    added = {
        "provider": "'aws'",
        "tags": "map()",
        "ingested_at": stamp,
        "created_at": stamp,
        "raw_service_name": "service",
        "account_alias": "aws_account_id",
        "usage_unit": "''",
    }
    known = df.withColumn("service_group", service_group("service"))
    return known.selectExpr(
        *[
            f"cast({f.name if f.name in known.columns else added[f.name]} AS {f.dataType.simpleString()}) AS {f.name}"
            for f in COST_RECORDS.fields
        ]
    )


def to_daily_records(rollup: DataFrame, as_of) -> DataFrame:
    """Feed lines -> DAILY cost records.

    A line is dropped only when both cost and usage are zero before they are rounded,
    so negative corrections and tiny charges stay. The id is taken from the raw region, the stored region is
    normalised: a ``NoRegion`` and a ``global`` line stay two rows.
    """
    kept = rollup.where(~((F.col("cost_usd") == 0) & (F.col("usage_quantity") == 0)))
    daily = kept.withColumns(
        {
            "id": record_id(
                F.col("aws_account_id"), F.col("date"), F.col("service"), F.col("raw_region")
            ),
            "granularity": F.lit("DAILY"),
            "region": normalise_region(F.col("raw_region")),
        }
    )
    return _as_cost_records(daily, as_of)


def cost_feed_daily(rollup: DataFrame, as_of, days_back: int = 32) -> DataFrame:
    """The daily pull: ``[as_of - days_back, as_of)``. The overlap of 32 days picks up
    the provider's retroactive corrections; today is not included."""
    window = (F.col("date") >= F.lit(days_before(as_of, days_back))) & (F.col("date") < F.lit(as_date(as_of)))
    return to_daily_records(rollup.where(window), as_of)


def cost_feed_monthly(lines: DataFrame, as_of, months_back_: int = 6) -> DataFrame:
    """The monthly summary pull: per service, credits and refunds included, no usage,
    no region; the running month ends before ``as_of``."""
    start = months_back(as_of, months_back_)
    window = (F.col("date") >= F.lit(start)) & (F.col("date") < F.lit(as_date(as_of)))
    monthly = (
        lines.where(window)
        .groupBy(
            "tenant_id", "aws_account_id", *[c for c in ["account_alias"] if c in lines.columns],
            F.trunc("date", "MM").alias("date"), "service",
        )
        .agg(exact_sum(lines, "cost_usd").alias("cost_usd"))
        .where(F.col("cost_usd") != 0)
        .withColumns(
            {
                "id": monthly_record_id(F.col("aws_account_id"), F.col("date"), F.col("service")),
                "granularity": F.lit("MONTHLY"),
                "region": F.lit("global"),
                "cost_usd": F.round("cost_usd", 4),
                "usage_quantity": F.lit(0),
                "usage_unit": F.lit(""),
            }
        )
    )
    return _as_cost_records(monthly, as_of)


def daily_plus_monthly(daily: DataFrame, monthly: DataFrame) -> DataFrame:
    """Bag union of both pulls. The ids differ, so DAILY and MONTHLY rows never merge."""
    return daily.unionByName(monthly)
