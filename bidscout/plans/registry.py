"""All queries by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


from . import client_jobs, more_jobs, offer_jobs, order_jobs, page_jobs, stream_jobs, url_jobs  # noqa: E402, F401
