"""Registry of the driver-facing queries and their DuckDB oracles.

Each query is ``fn(spark, sf_dir) -> DataFrame`` reading the whole driver
tables through ``marquee.sources.views``. The oracle SQL for the same name
computes the same rows in DuckDB from the same tables.
"""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str | Callable[[], str]] = {}


def query(name: str, sql: str | Callable[[], str] | None = None):
    """Register a query; ``sql`` is its oracle, or a function that builds the oracle when it is asked for."""
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def oracles() -> dict[str, str]:
    return {k: v() if callable(v) else v for k, v in ORACLE.items()}


def load_all() -> None:
    # Importing the modules registers their queries.
    from marquee.plans import q_prepare, q_profile, q_features, q_model, q_extract, q_runs, q_more, q_pages  # noqa: F401
