"""Registry of named queries with their DuckDB twins."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mullion.lenses import LENS_SQL, Tables

_QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables)`` under ``name``; ``sql`` may name lenses freely."""

    def add(fn: Callable[[Tables], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"query {name} registered twice")
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = with_lenses(sql)
        return fn

    return add


def with_lenses(sql: str) -> str:
    """Prefix the SQL with the lens definitions it uses, dependencies first."""
    order: list[str] = []

    def need(text: str) -> None:
        for lens in LENS_SQL:
            if re.search(rf"\b{lens}\b", text) and lens not in order:
                need(LENS_SQL[lens])
                order.append(lens)

    body = sql.strip()
    need(body)
    if not order:
        return body
    ctes = ",\n".join(f"{lens} AS ({LENS_SQL[lens].strip()})" for lens in order)
    head = re.match(r"(?i)with(\s+recursive)?\s", body)
    if head:
        return f"WITH RECURSIVE {ctes},\n{body[head.end():]}"
    return f"WITH RECURSIVE {ctes}\n{body}"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import mullion.plans.load  # noqa: F401  (fills the registry)

    def bind(fn):
        return lambda spark, sf_dir: fn(Tables(spark, sf_dir))

    return {name: bind(fn) for name, fn in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    import mullion.plans.load  # noqa: F401

    return dict(_SQL)
