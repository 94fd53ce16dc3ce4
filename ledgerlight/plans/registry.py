"""Name -> query over one directory of the given tables, with its check in SQL."""

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .views import VIEWS


@dataclass
class Query:
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


CATALOG: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        if name in CATALOG:
            raise ValueError(f"duplicate query {name}")
        CATALOG[name] = Query(build, sql)
        return build

    return register


def _needed(sql: str, seen: list[str]) -> list[str]:
    for name, text in VIEWS.items():
        if name not in seen and re.search(rf"\b{name}\b", sql):
            _needed(text, seen)
            if name not in seen:
                seen.append(name)
    return seen


def full_sql(sql: str) -> str:
    """Prefix a check with the views it mentions."""
    views = _needed(sql, [])
    if not views:
        return sql
    ctes = ",\n".join(f"{v} AS (\n{VIEWS[v]}\n)" for v in views)
    return f"WITH {ctes}\nSELECT * FROM (\n{sql}\n) AS q"


def _load() -> None:
    from . import budget_plans, cost_plans, forecast_plans, ingest_plans, misc_plans, resource_plans, scoped_plans, stream_plans  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: q.build for name, q in CATALOG.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {name: full_sql(q.sql) for name, q in CATALOG.items() if q.sql}
