"""Plan-time dates. Every window is a literal, so it reaches the scan as a filter."""

import datetime as dt


def as_date(value) -> dt.date:
    if isinstance(value, dt.datetime):
        return value.date()
    if isinstance(value, dt.date):
        return value
    return dt.date.fromisoformat(value)


def month_start(value) -> dt.date:
    return as_date(value).replace(day=1)


def month_end(value) -> dt.date:
    """Last day of the month."""
    return months_back(value, -1) - dt.timedelta(days=1)


def months_back(value, months: int) -> dt.date:
    """First day of the month ``months`` before the month of ``value``."""
    d = as_date(value)
    index = d.year * 12 + (d.month - 1) - months
    return dt.date(index // 12, index % 12 + 1, 1)


def days_before(value, days: int) -> dt.date:
    return as_date(value) - dt.timedelta(days=days)


def week_start(value) -> dt.date:
    """Monday of the week."""
    d = as_date(value)
    return d - dt.timedelta(days=d.weekday())


def validate_days(days: int) -> int:
    if days < 1 or days > 366:
        raise ValueError(f"a look back of {days} days is outside 1..366")
    return days
