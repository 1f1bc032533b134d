"""Where plan modules put their queries and SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from flowmill.plans.oracle import sql

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None, *needs: str):
    """Register a query function; ``oracle`` is its SQL over the CTEs in ``needs``."""

    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = sql(oracle, *needs)
        return fn

    return add
