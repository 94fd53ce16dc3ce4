"""Amounts, percentages and their text forms. Amounts stay decimal, so sums are exact
whatever order the partitions arrive in; only ratios are double."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import AVERAGE, MONEY, TOTAL, WIDE


def money(amount: Column) -> Column:
    """Round to cents, half up."""
    return F.round(amount, 2).cast(MONEY)


def per_day(total: Column, days: int, digits: int = 4) -> Column:
    """Total over a number of calendar days. A decimal division, so a tie at the last
    digit is rounded half up on the exact quotient and not on a binary neighbour."""
    quotient = total.cast(TOTAL) / F.lit(days).cast("decimal(4,0)")
    return F.round(quotient, digits).cast(AVERAGE if digits == 4 else MONEY)


def exact_sum(df: DataFrame, column: str) -> Column:
    """Unrounded sum of amounts, independent of the order of rows.

    Decimal amounts are summed as they are. Floating amounts count to twelve decimals and are summed as three whole
    numbers (units, millionths, and millionths of these), so no line is too small to count, no cell overflows, and the
    aggregation stays a hash aggregation over longs; one conversion a group replaces one a row.
    """
    if dict(df.dtypes)[column] not in ("double", "float"):
        return F.sum(column).cast(WIDE)
    amount = F.col(column).cast("double")
    units = F.floor(amount)
    parts = F.rint((amount - units) * 1e12).cast("bigint")
    whole = F.sum(units).cast("decimal(19,0)")
    millionths = F.sum(F.floor(parts / 1_000_000)).cast("decimal(19,0)") * F.lit("0.000001").cast("decimal(7,6)")
    rest = F.sum(F.pmod(parts, F.lit(1_000_000))).cast("decimal(19,0)") * F.lit("0.000000000001").cast("decimal(13,12)")
    return (whole + millionths + rest).cast(WIDE)


def parse_amount(text: Column) -> Column:
    """Text amount of a feed. Text that is no number, or none at all, fails the read: a lost amount is lost spend."""
    amount = text.try_cast(WIDE)
    said = F.concat(F.lit("not an amount in a cost feed: "), F.coalesce(text, F.lit("nothing")))
    return F.when(amount.isNull(), F.raise_error(said)).otherwise(amount)


def format_money(text: Column) -> Column:
    """Missing, empty or unparseable -> 0, else two decimals."""
    return money(F.coalesce(text.try_cast("decimal(28,6)"), F.lit(0).cast("decimal(28,6)")))


def pct_change(total: Column, previous: Column) -> Column:
    """Percent change to one decimal; NULL unless the previous total is positive."""
    t, p = total.cast("double"), previous.cast("double")
    return F.when(previous > 0, F.round((t - p) / p * 100, 1))


def pct_of_limit(current: Column, limit: Column) -> Column:
    """Unrounded percent of a limit; 0 when the limit is not positive."""
    return F.when(limit > 0, current.cast("double") / limit.cast("double") * 100).otherwise(F.lit(0.0))


def severity_for_pct(pct: Column) -> Column:
    return F.when(pct >= 100, F.lit("critical")).otherwise(F.lit("warning"))


def usd_text(amount: Column) -> Column:
    """``$1,234.50``"""
    return F.concat(F.lit("$"), F.format_number(F.round(amount, 2), 2))


def pct_text(pct: Column) -> Column:
    """``80.3``: one decimal, half up."""
    return F.round(pct, 1).cast("decimal(18,1)").cast("string")
