"""Registered queries and the SQL they are compared with.

A module of plans lists its queries with :func:`query`; the name starts with the operator family.
"""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}
_MODULES = ("statistics", "maps", "sky", "filters", "segmentation", "apertures", "catalogues", "models")


def query(sql: str | None = None) -> Callable:
    """Registers a function (spark, sf_dir) -> DataFrame under its name, with its DuckDB SQL."""

    def add(f: Callable) -> Callable:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def _load() -> None:
    for name in _MODULES:
        import_module(f"{__package__}.{name}")


def queries() -> dict[str, Callable]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
