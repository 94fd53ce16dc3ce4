from .registry import oracle_sql, queries
