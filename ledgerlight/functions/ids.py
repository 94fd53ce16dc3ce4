"""Reproducible keys."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def record_id(account: Column, date: Column, service: Column, raw_region: Column) -> Column:
    """First 20 hex digits of sha256(account:date:service:region).

    Uses the raw region, before normalisation. ``concat`` keeps a NULL part
    NULL; ``concat_ws`` would skip it and let two different rows share an id.
    """
    sep = F.lit(":")
    key = F.concat(account, sep, date.cast("string"), sep, service, sep, raw_region)
    return F.substring(F.sha2(key, 256), 1, 20)


def monthly_record_id(account: Column, date: Column, service: Column) -> Column:
    return F.concat(record_id(account, date, service, F.lit("global")), F.lit("_m"))


def stable_id(prefix: str, *parts: Column) -> Column:
    """Deterministic surrogate key of a derived row (NULL parts count as ``-``)."""
    text = F.concat_ws("|", F.lit(prefix), *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts])
    return F.substring(F.sha2(text, 256), 1, 32)
