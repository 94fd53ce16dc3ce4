"""Keys and value domains, which Spark tables do not enforce themselves."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import DOMAINS


def duplicate_keys(df: DataFrame, key: list[str], check: str) -> DataFrame:
    """How many key values occur more than once. NULL key parts never collide, as in a
    unique constraint."""
    complete = F.lit(True)
    for c in key:
        complete = complete & F.col(c).isNotNull()
    groups = df.where(complete).groupBy(*key).agg(F.count("*").alias("c"))
    return groups.agg(F.count_if(F.col("c") > 1).alias("violations")).select(F.lit(check).alias("check_name"), "violations")


def outside_domain(df: DataFrame, column: str, allowed: list[str], check: str) -> DataFrame:
    """How many rows hold a value outside the allowed list, or none."""
    bad = F.col(column).isNull() | ~F.col(column).isin(allowed)
    return df.agg(F.count_if(bad).alias("violations")).select(F.lit(check).alias("check_name"), "violations")


def domain_violations(df: DataFrame, table: str, columns: dict[str, str]) -> DataFrame:
    """``check_name``, ``violations`` of each column and the domain (see ``schemas.DOMAINS``) it has to keep to.

    All columns of a table are counted in one pass over it, by check, so that each task hands on one partial count per
    check. A missing value is outside every domain; a table without rows has no violations.
    """
    names = {c: f"{table}.{c}" for c in columns}
    bad = [
        F.struct(F.lit(names[c]).alias("check_name"), (F.col(c).isNull() | ~F.col(c).isin(DOMAINS[d])).cast("bigint").alias("violations"))
        for c, d in columns.items()
    ]
    none = df.sparkSession.createDataFrame([(name, 0) for name in names.values()], "check_name string, violations bigint")
    return df.select(F.inline(F.array(*bad))).unionByName(none).groupBy("check_name").agg(F.sum("violations").alias("violations"))


def key_violations(checks: list[DataFrame]) -> DataFrame:
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out
