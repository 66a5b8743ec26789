"""Every query of the core library, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``f(spark, sf_dir)`` under ``name``."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


def queries() -> dict[str, Callable]:
    from quireloom import catalog  # noqa: F401  registers them

    return QUERIES


def oracle_sql() -> dict[str, str]:
    queries()
    return ORACLE
