"""Where the engine's queries are registered, each with its SQL twin if SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from ..sources.views import with_views

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a (spark, sf_dir) function; names of views in ``sql`` are expanded."""

    def put(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = with_views(sql)
        return f

    return put
