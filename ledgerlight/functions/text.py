"""String and JSON helpers."""

from pyspark.sql import Column
from pyspark.sql import functions as F

FENCE = "```"


def normalise_region(raw_region: Column) -> Column:
    """The feed's ``NoRegion`` marker (or no region at all) means a global service."""
    return F.when(raw_region.isNull() | (raw_region == "NoRegion"), F.lit("global")).otherwise(raw_region)


def fenced_json(text: Column) -> Column:
    """The JSON part of a model response.

    Text after the first fence tagged json, else after the first fence, else the
    whole text; up to the next fence or the end; trimmed.
    """
    tagged = F.split(text, FENCE + "json", -1)
    plain = F.split(text, FENCE, -1)
    body = (
        F.when(text.contains(FENCE + "json"), F.get(F.split(F.get(tagged, F.lit(1)), FENCE, -1), F.lit(0)))
        .when(text.contains(FENCE), F.get(plain, F.lit(1)))
        .otherwise(text)
    )
    return F.regexp_replace(body, r"(?U)^\s+|\s+$", "")


def sorted_json(params: Column) -> Column:
    """A string map as JSON text with sorted keys and a blank after ``:`` and ``,``."""

    def quoted(value: Column) -> Column:
        escaped = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
        return F.concat(F.lit('"'), escaped, F.lit('"'))

    pairs = F.transform(
        F.array_sort(F.map_entries(params)),
        lambda e: F.concat(quoted(e["key"]), F.lit(": "), quoted(e["value"])),
    )
    return F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))
