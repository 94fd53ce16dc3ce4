"""Append alerts without firing twice for the same budget."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["tenant_id", "budget_id"]
SLICES = 1024  # parts of a batch by ``seq``, so that one budget's alerts are never ordered in one task


def alert_dedup_append(batch: DataFrame, stored: DataFrame, seq: str = "seq") -> DataFrame:
    """The alerts of a batch that have to be stored.

    An alert is dropped when its (tenant, budget) already has a firing alert, stored
    or earlier in the batch by ``seq``. The severity of the existing alert stays as
    it is. An alert without a budget is always stored; those rows bypass both steps,
    so they never gather on one NULL key.
    """
    loose = batch.where(F.col("budget_id").isNull())
    keyed = batch.where(F.col("budget_id").isNotNull())
    first = Window.partitionBy("tenant_id", "budget_id").orderBy(seq)
    firsts = keyed.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")
    firing = (
        stored.where((F.col("state") == "firing") & F.col("budget_id").isNotNull())
        .select("tenant_id", "budget_id")
        .distinct()
    )
    fresh = firsts.join(firing, ["tenant_id", "budget_id"], "left_anti")
    return fresh.unionByName(loose).drop(seq)


def _sliced(keyed: DataFrame, seq: str) -> DataFrame:
    lo, hi = keyed.agg(F.min(seq), F.max(seq)).first()
    width = 1 if lo is None else (hi - lo) // SLICES + 1
    return keyed.withColumn("_slice", F.coalesce(F.floor((F.col(seq) - F.lit(lo or 0)) / F.lit(width)), F.lit(-1)))


def alert_changes(batch: DataFrame, open_keys: DataFrame, seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """The alerts of a batch that change the state of their budget, and the keys that are firing after it.

    ``open_keys`` holds each (tenant, budget) that was firing before the batch, once. A ``firing`` alert counts where
    its budget isn't firing yet, any other state where it is; so a budget fires again after it was resolved, and what
    repeats a state is dropped. Rows count in the order of ``seq``, an integer; of those with the same number and state
    any one may be kept, and ``firing`` goes before the end of it. An alert without a budget or a tenant is always kept.

    A budget's alerts are put in order slice by slice; between slices only their last states meet, at most ``SLICES`` a
    budget.
    """
    known = F.col("budget_id").isNotNull() & F.col("tenant_id").isNotNull()
    loose = batch.where(~known)
    firing = F.coalesce(F.col("state") == "firing", F.lit(False)).alias("_firing")
    keyed = _sliced(batch.where(known).select("*", firing), seq)
    was_open = open_keys.select(*KEY, F.lit(True).alias("_open"))
    last = keyed.groupBy(*KEY, "_slice").agg(F.max_by("_firing", F.struct(seq, ~F.col("_firing"))).alias("_last"))
    along = Window.partitionBy(*KEY).orderBy("_slice")
    before = last.join(was_open, KEY, "left").select(
        *KEY, "_slice", "_last",
        F.coalesce(F.lag("_last").over(along), F.col("_open"), F.lit(False)).alias("_before"),
    )
    inside = Window.partitionBy(*KEY, "_slice").orderBy(seq, ~F.col("_firing"))
    met = keyed.join(before.drop("_last"), [*KEY, "_slice"]).withColumn("_prev", F.coalesce(F.lag("_firing").over(inside), "_before"))
    kept = met.where(F.col("_firing") != F.col("_prev")).select(*batch.columns)
    after = last.groupBy(*KEY).agg(F.max_by("_last", "_slice").alias("_last"))
    still = was_open.join(after, KEY, "full_outer").where(F.coalesce("_last", "_open")).select(*KEY)
    return kept.unionByName(loose).drop(seq), still
