"""Where tables are written."""

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Only for a session on one machine that names no folder, such as a trial in a shell.
LOCAL_FOLDER = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        path = LOCAL_FOLDER
    return path.rstrip("/")


def run_dir(spark: SparkSession, name: str) -> str:
    """A new folder of its own in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a frame that several branches of a plan read, and go on from the table.

    The branches then read the columns they need instead of computing the frame
    again, and a lost executor costs a re-read, not a recomputation.
    """
    path = run_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_cost_table(costs: DataFrame, path: str, whole: bool = False) -> None:
    """Cost records partitioned by month.

    The months in ``costs`` are replaced and no other is touched, so what an upsert of some months returns can be
    written back, also into the table it was read from; a month goes live only when all of it is written. ``whole``
    replaces the table.

    The rebalance hint lets adaptive execution split a month that holds far more rows
    than others over several writers and put small months together. Inside a file
    rows are sorted by account and date, so row groups can be skipped.
    """
    rows = costs.withColumn("month", F.trunc("date", "MM")).hint("rebalance", "month")
    (
        rows.sortWithinPartitions("month", "aws_account_id", "date")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "static" if whole else "dynamic")
        .partitionBy("month")
        .parquet(path)
    )


def append_table(rows: DataFrame, path: str, batch_id: int) -> None:
    """Add the rows of a batch. A batch that is run again replaces what it wrote before, so nothing is doubled."""
    rows.write.mode("overwrite").parquet(f"{path}/batch_id={int(batch_id)}")


def earlier_batches(spark: SparkSession, path: str, schema: T.StructType, batch_id: int) -> DataFrame:
    """What batches before ``batch_id`` appended. A batch that is run again doesn't see its own first attempt."""
    if batch_id <= 0:
        return spark.createDataFrame([], schema)
    full = T.StructType(list(schema.fields)).add("batch_id", T.LongType())
    return spark.read.schema(full).parquet(path).where(F.col("batch_id") < int(batch_id)).drop("batch_id")


def carried(spark: SparkSession, path: str, schema: T.StructType, batch_id: int) -> DataFrame:
    """The state that the batch before ``batch_id`` left behind with :func:`carry`."""
    if batch_id <= 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/{(int(batch_id) - 1) % 2}")


def carry(state: DataFrame, path: str, batch_id: int) -> None:
    """Leave the state for the next batch; ids have to follow one another, as those of a stream do.

    Two folders take turns: a batch that is run again finds what its predecessor left, whatever it wrote itself, and
    nothing ever has to be deleted.
    """
    state.write.mode("overwrite").parquet(f"{path}/{int(batch_id) % 2}")


def json_export(df: DataFrame, name: str = "json") -> DataFrame:
    """Every row as JSON text with sorted keys. Decimals are written as numbers."""
    fields = sorted(df.columns)
    return df.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias(name))
