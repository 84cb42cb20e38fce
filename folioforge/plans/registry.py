"""All registered queries of the core with their SQL."""
from __future__ import annotations

import importlib
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}
MODULES = ("scalars", "ledger", "search", "matching", "analytics", "streams", "fixtures", "coverage")


def query(name: str, sql: str | None = None):
    """Register a query under ``name`` with the SQL that gives the same rows."""

    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"folioforge.plans.{m}")


def queries() -> dict[str, Callable]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(SQL)
