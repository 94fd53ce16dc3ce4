"""Resource inventory: build it from utilisation samples, summarise it, find idle rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import as_date
from ..functions.dates import days_before
from ..schemas import TOTAL
from ..sources.tables import scoped, top_n

IDLE_CPU_PCT = 5
IDLE_DAYS = 14


def resource_inventory(samples: DataFrame, as_of) -> DataFrame:
    """One row per resource from its utilisation samples.

    Averages cover ``[as_of - 14, as_of)``. A resource is idle when its average CPU
    there is below 5 % and it has been observed for the whole 14 days, i.e. its first
    sample is not later than the first of those days. Attributes come from the
    newest sample. Samples may be huge for one resource: all of this is one
    aggregation with map-side partial results.
    """
    start, end = days_before(as_of, IDLE_DAYS), as_date(as_of)
    day = F.col("ts").cast("date")
    recent = day >= F.lit(start)
    cpu, mem = F.when(recent, F.col("cpu_pct")), F.when(recent, F.col("memory_pct"))
    key = ["tenant_id", "aws_account_id", "resource_id"]
    attrs = ["monthly_cost_usd", "resource_type", "service_group", "region", "name"]
    # Numeric buffers only, so the pass over the samples is a hash aggregation; the
    # newest attributes are picked afterwards among the few distinct ones.
    versions = (
        samples.where(day < F.lit(end))
        .groupBy(*key, *attrs)
        .agg(
            F.max("ts").alias("ts"),
            F.sum(cpu).alias("cpu_sum"), F.count(cpu).alias("cpu_n"),
            F.sum(mem).alias("mem_sum"), F.count(mem).alias("mem_n"),
            F.min(day).alias("first_seen"),
        )
    )
    agg = versions.groupBy(*key).agg(
        F.max(F.struct("ts", *attrs)).alias("n"),
        F.sum("cpu_sum").alias("cpu_sum"), F.sum("cpu_n").alias("cpu_n"),
        F.sum("mem_sum").alias("mem_sum"), F.sum("mem_n").alias("mem_n"),
        F.min("first_seen").alias("first_seen"),
    )
    return _flags(agg, start)


def _flags(agg: DataFrame, start) -> DataFrame:
    """The inventory's columns from a resource's sums over the days since ``start``, first day and newest sample."""

    def mean(s, n):
        return F.when(F.col(n) > 0, F.col(s).cast("double") / F.col(n))

    cpu_avg = mean("cpu_sum", "cpu_n")
    idle = F.coalesce(cpu_avg < IDLE_CPU_PCT, F.lit(False)) & (F.col("first_seen") <= F.lit(start))
    return agg.select(
        "tenant_id", "aws_account_id", "resource_id",
        F.col("n.resource_type").alias("resource_type"),
        F.col("n.service_group").alias("service_group"),
        F.col("n.region").alias("region"),
        F.col("n.name").alias("name"),
        F.when(F.col("cpu_n") == 0, "stopped").when(idle, "idle").otherwise("running").alias("state"),
        F.col("n.monthly_cost_usd").alias("monthly_cost_usd"),
        F.round(cpu_avg, 2).alias("cpu_avg_pct"),
        F.round(mean("mem_sum", "mem_n"), 2).alias("memory_avg_pct"),
        idle.alias("is_idle"),
        F.col("n.ts").alias("last_seen_at"),
    )


RESOURCE = ["tenant_id", "aws_account_id", "resource_id"]
ATTRIBUTES = ["monthly_cost_usd", "resource_type", "service_group", "region", "name"]
SUMS = ["cpu_sum", "cpu_n", "mem_sum", "mem_n"]


def _rings(samples: DataFrame, first_day) -> DataFrame:
    day = F.col("ts").cast("date")
    kept_day = F.when(day >= F.lit(first_day), day)
    versions = samples.groupBy(*RESOURCE, *ATTRIBUTES, kept_day.alias("day")).agg(
        F.max("ts").alias("ts"), F.min(day).alias("first_seen"),
        F.sum("cpu_pct").alias("cpu_sum"), F.count("cpu_pct").alias("cpu_n"),
        F.sum("memory_pct").alias("mem_sum"), F.count("memory_pct").alias("mem_n"),
    )
    days = versions.groupBy(*RESOURCE, "day").agg(
        F.max(F.struct("ts", *ATTRIBUTES)).alias("n"), F.min("first_seen").alias("first_seen"), *[F.sum(c).alias(c) for c in SUMS]
    )
    return days.groupBy(*RESOURCE).agg(
        F.max("n").alias("n"), F.min("first_seen").alias("first_seen"),
        F.collect_list(F.when(F.col("day").isNotNull(), F.struct("day", *SUMS))).alias("days"),
    )


def resource_rings(samples: DataFrame, as_of) -> DataFrame:
    """What an inventory needs to know of each resource before ``as_of``: its newest sample, the first day it was seen
    and the sums of each of the last 14 days on which it was. Made once from all samples, then carried on by
    :func:`advance_rings`."""
    return _rings(samples.where(F.col("ts").cast("date") < F.lit(as_date(as_of))), days_before(as_of, IDLE_DAYS))


def advance_rings(rings: DataFrame, samples: DataFrame, day) -> DataFrame:
    """The rings at the end of ``day``, from those before it and the samples of that day, which alone are read.

    A day that is folded in again replaces itself. A resource without samples that day keeps its ring, less the day that
    has grown too old; it stays in the inventory as one that stopped.
    """
    day = as_date(day)
    at = F.col("ts").cast("date")
    new = _rings(samples.where((at >= F.lit(day)) & (at < F.lit(days_before(day, -1)))), day)
    new = new.select(*[F.col(c).alias(f"new_{c}") for c in new.columns])
    met = rings.join(new, [F.col(c).eqNullSafe(F.col(f"new_{c}")) for c in RESOURCE], "full_outer")
    none = F.array().cast(rings.schema["days"].dataType)
    oldest = F.lit(days_before(day, IDLE_DAYS - 1))
    kept = F.filter(F.coalesce("days", none), lambda d: (d["day"] >= oldest) & (d["day"] < F.lit(day)))
    known = F.col("n").isNotNull()
    return met.select(
        *[F.when(known, F.col(c)).otherwise(F.col(f"new_{c}")).alias(c) for c in RESOURCE],
        F.greatest("n", "new_n").alias("n"),
        F.least("first_seen", "new_first_seen").alias("first_seen"),
        F.concat(kept, F.coalesce("new_days", none)).alias("days"),
    )


def inventory_from_rings(rings: DataFrame, as_of) -> DataFrame:
    """What :func:`resource_inventory` gives, from rings that were carried on to the day before ``as_of``."""
    start, end = days_before(as_of, IDLE_DAYS), as_date(as_of)
    days = F.filter("days", lambda d: (d["day"] >= F.lit(start)) & (d["day"] < F.lit(end)))

    def total(column):
        values = F.transform("days", lambda d: d[column])
        kind = rings.schema["days"].dataType.elementType[column].dataType
        zero = F.lit(0).cast(kind)
        return F.aggregate(values, zero, lambda acc, v: (acc + F.coalesce(v, zero)).cast(kind))

    sums = rings.withColumn("days", days).select(*RESOURCE, "n", "first_seen", *[total(c).alias(c) for c in SUMS])
    return _flags(sums, start)


def _cost():
    return F.sum(F.coalesce("monthly_cost_usd", F.lit(0))).cast(TOTAL)


def inventory_summary(inventory, tenant_id=None, aws_account_id=None) -> DataFrame:
    return (
        scoped(inventory, tenant_id, aws_account_id)
        .groupBy("tenant_id")
        .agg(
            F.count("*").alias("total_resources"),
            _cost().alias("total_monthly_cost_usd"),
            F.count_if("is_idle").alias("idle_resources"),
        )
    )


def inventory_facets(inventory, tenant_id=None, aws_account_id=None) -> DataFrame:
    """Counts and costs by type, by service group and in total, in one pass over the inventory."""
    cells = (
        scoped(inventory, tenant_id, aws_account_id)
        .groupBy("tenant_id", "resource_type", "service_group")
        .agg(F.count("*").alias("n"), _cost().alias("c"), F.count_if("is_idle").alias("i"))
    )
    columns = ["tenant_id", "resource_type", "service_group"]
    grouped = cells.groupingSets([["tenant_id", "resource_type"], ["tenant_id", "service_group"], ["tenant_id"]], *columns).agg(
        F.grouping_id(*columns).alias("gid"),
        F.sum("n").alias("count"), F.sum("c").cast(TOTAL).alias("monthly_cost_usd"), F.sum("i").alias("idle"),
    )
    facet = F.when(F.col("gid") == 1, "type").when(F.col("gid") == 2, "group").otherwise("total")
    return grouped.select("tenant_id", facet.alias("facet"), "resource_type", "service_group", "count", "monthly_cost_usd", "idle")


def inventory_by_type(inventory, tenant_id=None, aws_account_id=None, limit: int = 20) -> DataFrame:
    grouped = (
        scoped(inventory, tenant_id, aws_account_id)
        .groupBy("tenant_id", "resource_type")
        .agg(F.count("*").alias("count"), _cost().alias("monthly_cost_usd"))
    )
    return top_n(grouped, limit, [F.col("monthly_cost_usd").desc(), F.col("resource_type")], tenant_id)


def inventory_by_service_group(inventory, tenant_id=None, aws_account_id=None) -> DataFrame:
    return (
        scoped(inventory, tenant_id, aws_account_id)
        .groupBy("tenant_id", "service_group")
        .agg(F.count("*").alias("count"), _cost().alias("monthly_cost_usd"))
        .orderBy("tenant_id", F.col("monthly_cost_usd").desc(), "service_group")
    )


def idle_resources(inventory, tenant_id=None, aws_account_id=None, limit: int = 20) -> DataFrame:
    """Most expensive idle resources; a resource of unknown cost sorts first."""
    rows = scoped(inventory, tenant_id, aws_account_id).where("is_idle")
    order = [F.col("monthly_cost_usd").desc_nulls_first(), F.col("resource_id")]
    return top_n(rows, limit, order, tenant_id).select(
        "tenant_id", "resource_id", "resource_type", "name", "monthly_cost_usd", "cpu_avg_pct",
        "memory_avg_pct", "state",
    )
