"""Cost by resource tag."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import TOTAL

UNTAGGED = "(untagged)"


def tags_of(lines: DataFrame, column: str) -> Column:
    """The tags of a line as a map: a map column as it is, a JSON document parsed.

    A document that doesn't parse fails the read; it isn't taken for a line without tags.
    """
    if isinstance(lines.schema[column].dataType, T.MapType):
        return F.col(column)
    blank = F.trim(F.col(column)) == ""
    return F.when(~blank, F.from_json(column, "map<string,string>", {"mode": "FAILFAST"}))


def tag_extract(lines: DataFrame, key: str, json_col: str = "tags_json") -> DataFrame:
    """The tags of a line, the value of one key and whether the key exists. ``json_col`` is JSON text or a map."""
    return lines.withColumn("tags", tags_of(lines, json_col)).withColumns(
        {
            "tag_value": F.try_element_at("tags", F.lit(key)),
            "has_tag": F.coalesce(F.map_contains_key("tags", key), F.lit(False)),
        }
    )


def tag_pairs(lines: DataFrame, json_col: str = "tags_json") -> DataFrame:
    """One row per line and tag; an untagged line keeps one row with NULLs."""
    return lines.select("*", F.explode_outer(tags_of(lines, json_col)).alias("tag_key", "tag_value"))


def tag_chargeback(lines: DataFrame, key: str, json_col: str = "tags_json") -> DataFrame:
    """Spend per tenant and tag value; lines without the tag form their own bucket."""
    return (
        tag_extract(lines, key, json_col)
        .groupBy("tenant_id", F.coalesce("tag_value", F.lit(UNTAGGED)).alias("tag_value"))
        .agg(F.sum("cost_usd").cast(TOTAL).alias("total_usd"), F.count("*").alias("lines"))
    )


def tag_coverage(lines: DataFrame, key: str, json_col: str = "tags_json") -> DataFrame:
    """Share of lines and of spend that carries a required tag."""
    tagged = F.col("has_tag")
    grouped = (
        tag_extract(lines, key, json_col)
        .groupBy("tenant_id")
        .agg(
            F.count("*").alias("lines"),
            F.count_if(tagged).alias("tagged_lines"),
            F.sum("cost_usd").cast(TOTAL).alias("total_usd"),
            F.coalesce(F.sum(F.when(tagged, F.col("cost_usd"))), F.lit(0)).cast(TOTAL).alias("tagged_usd"),
        )
    )
    return grouped.select(
        "*",
        F.round(F.col("tagged_lines") / F.col("lines") * 100, 4).alias("line_pct"),
        F.when(
            F.col("total_usd") != 0,
            F.round(F.col("tagged_usd").cast("double") / F.col("total_usd").cast("double") * 100, 4),
        ).alias("spend_pct"),
    )
