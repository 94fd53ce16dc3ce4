"""Keyed upsert of cost records.

On a known id only cost, usage and ingestion time are replaced; every other column
keeps its first value. Inside a batch rows count in the order of ``seq``.
"""

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import COST_RECORDS

KEY = "id"
BASES = "_bases"  # names of the bases of a log; hidden from plain reads of it, like the bases themselves
REPLACED = ["cost_usd", "usage_quantity", "ingested_at"]
KEPT = [c for c in COST_RECORDS.fieldNames() if c not in REPLACED and c != KEY]
LOG = (
    T.StructType(COST_RECORDS.fields[:])
    .add("first_seq", T.LongType())
    .add("last_seq", T.LongType())
    .add("batch_id", T.LongType())
    .add("month", T.DateType())
)


def fold(rows: DataFrame, first_seq: str, last_seq: str | None = None) -> DataFrame:
    """One row per id: first value of the kept columns, last of the replaced ones, and
    the range of sequence numbers they cover.

    Values travel as whole structs, so a NULL is a value like any other. Partial
    results are combined before the shuffle; an id that occurs very often costs one
    row per task.
    """
    last_seq = last_seq or first_seq
    folded = rows.groupBy(KEY).agg(
        F.min_by(F.struct(*KEPT), first_seq).alias("k"),
        F.max_by(F.struct(*REPLACED), last_seq).alias("v"),
        F.min(first_seq).alias("first_seq"),
        F.max(last_seq).alias("last_seq"),
    )
    return folded.select(KEY, "k.*", "v.*", "first_seq", "last_seq").select(
        *COST_RECORDS.fieldNames(), "first_seq", "last_seq"
    )


def upsert_cost_records(existing: DataFrame, batch: DataFrame, seq: str = "seq") -> DataFrame:
    """The table after the batch.

    The batch is folded, then met with the table on id: each side is shuffled once
    and the table, whose ids are unique already, is not aggregated. Ids contain the
    date, so a caller may pass only the months the batch touches.
    """
    old = existing.select(F.col(KEY).alias("o_id"), *[F.col(c).alias(f"o_{c}") for c in KEPT + REPLACED])
    new = fold(batch, seq).select(F.col(KEY).alias("n_id"), *[F.col(c).alias(f"n_{c}") for c in KEPT + REPLACED])
    met = old.join(new, F.col("o_id") == F.col("n_id"), "full_outer")

    def pick(column: str):
        if column == KEY:
            return F.coalesce("o_id", "n_id").alias(KEY)
        winner, other = ("n", "o") if column in REPLACED else ("o", "n")
        present = F.col(f"{winner}_id").isNotNull()
        return F.when(present, F.col(f"{winner}_{column}")).otherwise(F.col(f"{other}_{column}")).alias(column)

    return met.select(*[pick(c) for c in COST_RECORDS.fieldNames()])


def write_delta(batch: DataFrame, path: str, batch_id: int, seq: str = "seq") -> None:
    """Add one folded batch to a log of batches. Repeating a batch id replaces it, so a
    retried batch is stored once. ``seq`` is a bigint that orders rows across batches."""
    rows = fold(batch, seq).withColumn("month", F.trunc("date", "MM")).hint("rebalance", "month")
    rows.write.mode("overwrite").partitionBy("month").parquet(f"{path}/batch_id={int(batch_id)}")


def _base(spark: SparkSession, path: str) -> tuple[int, str | None]:
    """The last batch that is folded into a base, and the folder of that base."""
    try:
        newest = spark.read.schema("upto bigint, folder string").parquet(f"{path}/{BASES}").orderBy(F.desc("upto"), "folder").first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return -1, None
    return (newest.upto, newest.folder) if newest else (-1, None)


def _log(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """The newest base, and the batches after it."""
    done, folder = _base(spark, path)
    later = F.col("batch_id") > done
    if upto is not None:
        later = later & (F.col("batch_id") <= int(upto))
    log = spark.read.schema(LOG).parquet(path).where(later).drop("batch_id")
    if folder is None:
        return log
    base = T.StructType([f for f in LOG.fields if f.name != "batch_id"])
    return spark.read.schema(base).parquet(f"{path}/{folder}").unionByName(log)


def compact_log(spark: SparkSession, path: str, upto: int) -> None:
    """Fold the batches up to ``upto``, which must be finished, into a base; reads then open it and later batches only.

    The base goes to a folder of its own and counts from the moment one row naming it is added, so a run that stops at
    any step changes nothing, and a run that is repeated adds another base of the same rows. Writers and readers go on
    meanwhile. Older bases and folded batches are no longer read by anyone who starts after that; removing them is left
    to the store's retention rules.
    """
    done, _ = _base(spark, path)
    if upto <= done:
        return
    folder = f"_base-{uuid.uuid4().hex[:12]}"
    rows = _log(spark, path, upto)
    folded = fold(rows, "first_seq", "last_seq").withColumn("month", F.trunc("date", "MM")).hint("rebalance", "month")
    folded.write.partitionBy("month").parquet(f"{path}/{folder}")
    named = spark.createDataFrame([(int(upto), folder)], "upto bigint, folder string")
    named.coalesce(1).write.mode("append").parquet(f"{path}/{BASES}")


def merge_on_read(spark: SparkSession, path: str, months: list | None = None) -> DataFrame:
    """The table a log of batches stands for: its newest base, if there is one, and what came after. Appending a batch
    never rewrites the table; with ``months`` only those partitions are read."""
    log = _log(spark, path)
    if months is not None:
        log = log.where(F.col("month").isin(months))
    return fold(log, "first_seq", "last_seq").drop("first_seq", "last_seq")


def changed_rows(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    """What a batch of the log changed: each record it touched as it was before (``sign`` -1) and is after it (1).

    Before means the batches with smaller ids, so a batch that is run again finds the same changes. Ids contain the
    date: only the months that the batch touches are read, and of them the ids in it.
    """
    batch = spark.read.schema(LOG).parquet(path).where(F.col("batch_id") == int(batch_id)).drop("batch_id")
    months = [r.month for r in batch.select("month").distinct().collect()]
    log = _log(spark, path, batch_id - 1).where(F.col("month").isin(months))
    before = log.join(batch.select(KEY).distinct(), KEY, "left_semi").select(*batch.columns)
    old, new = fold(before, "first_seq", "last_seq"), fold(before.unionByName(batch), "first_seq", "last_seq")
    signed = [rows.drop("first_seq", "last_seq").withColumn("sign", F.lit(sign)) for rows, sign in ((old, -1), (new, 1))]
    return signed[0].unionByName(signed[1])
