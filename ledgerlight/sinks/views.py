"""Sums under the spend views, kept up to date from what each batch changes instead of from the facts."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import TOTAL
from .upsert import changed_rows

CELL = ["tenant_id", "aws_account_id", "account_alias", "date", "granularity", "service", "service_group"]
STORED = T.StructType([T.StructField(c, T.DateType() if c == "date" else T.StringType()) for c in CELL])
STORED = STORED.add("cost_usd", T.DecimalType(28, 6)).add("records", T.LongType()).add("month", T.DateType())


def cell_changes(changes: DataFrame) -> DataFrame:
    """By how much each cell's sum and number of records change. Cells that stay as they are aren't listed."""
    summed = changes.groupBy(*CELL).agg(
        F.sum(F.col("cost_usd") * F.col("sign")).cast(TOTAL).alias("cost_usd"), F.sum("sign").cast("bigint").alias("records")
    )
    return summed.where("cost_usd <> 0 OR records <> 0")


def update_view_cells(spark: SparkSession, log_path: str, path: str, batch_id: int) -> None:
    """Add what a batch of the log changed. A batch that is run again replaces what it added."""
    changes = cell_changes(changed_rows(spark, log_path, batch_id)).withColumn("month", F.trunc("date", "MM")).hint("rebalance", "month")
    changes.write.mode("overwrite").partitionBy("month").parquet(f"{path}/batch_id={int(batch_id)}")


def view_cells(spark: SparkSession, path: str) -> DataFrame:
    """The sums per account, day and service, in the columns that the spend views read.

    Changes add up, in any order. A cell is there as long as records count for it, so a service whose records all moved
    elsewhere is no longer counted by ``COUNT(DISTINCT service)``. A view of one month reads that month's changes only.
    """
    summed = spark.read.schema(STORED).parquet(path).groupBy(*CELL, "month").agg(
        F.sum("cost_usd").cast(TOTAL).alias("cost_usd"), F.sum("records").alias("records")
    )
    return summed.where("records > 0")
