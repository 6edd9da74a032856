"""Every operator as a query over the driver's tables, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name; ``sql`` may use the views of ``parley.queries.sql``."""

    def register(f):
        from .sql import VIEWS

        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = f"WITH {VIEWS}\n{sql}"
        return f

    return register


def load() -> None:
    from . import corpus, rollups, scoring  # noqa: F401  they register their queries
