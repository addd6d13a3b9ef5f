"""Registration of queries: name to callable, and name to DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from ridgeline.plans.projection import with_views

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name; ``sql`` is what DuckDB runs on the same tables."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = with_views(sql)
        return f

    return add
