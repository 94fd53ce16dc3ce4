"""Exact ranks inside groups that may not fit one task.

A plain ``percent_rank() OVER (PARTITION BY tenant ORDER BY cost)`` sorts a whole
tenant in one task. Here rows are first counted per distinct value, then positions
come from two bounded running sums: over coarse value buckets per group, and over
the distinct values inside one bucket.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET_CENTS = 1_000_000


def value_ranks(df: DataFrame, keys: list[str], value: str, bucket_cents: int = BUCKET_CENTS) -> DataFrame:
    """Per group and distinct non-NULL value: how many rows are smaller (``below``)
    and how many rows the group has (``n``). ``value`` is a two-decimal amount; a
    bucket spans at most ``bucket_cents`` distinct values."""
    v = F.col(value)
    counts = (
        df.where(v.isNotNull())
        .groupBy(*keys, value)
        .agg(F.count("*").alias("_c"))
        .withColumn("_b", F.floor(v * 100 / bucket_cents).cast("bigint"))
    )
    in_bucket = Window.partitionBy(*keys, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    fine = counts.withColumn("_before", F.coalesce(F.sum("_c").over(in_bucket), F.lit(0)))
    buckets = counts.groupBy(*keys, "_b").agg(F.sum("_c").alias("_bc"))
    per_group = Window.partitionBy(*keys)
    running = per_group.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.select(
        *keys, "_b",
        F.coalesce(F.sum("_bc").over(running), F.lit(0)).alias("_offset"),
        F.sum("_bc").over(per_group).alias("n"),
    )
    return fine.join(offsets, [*keys, "_b"]).select(
        *keys, value, (F.col("_before") + F.col("_offset")).alias("below"), "n"
    )


def rank_thresholds(df: DataFrame, keys: list[str], value: str, fractions: dict[str, float], **kw) -> DataFrame:
    """Per group the smallest value whose percent rank ``below / (n - 1)`` reaches each
    fraction; one row per group. ``value >= threshold`` is then exactly
    ``percent_rank >= fraction``. NULL when no value reaches it."""
    ranked = value_ranks(df, keys, value, **kw)
    pct = F.when(F.col("n") > 1, F.col("below") / (F.col("n") - 1)).otherwise(F.lit(0.0))
    return ranked.groupBy(*keys).agg(
        *[F.min(F.when(pct >= f, F.col(value))).alias(name) for name, f in fractions.items()]
    )
