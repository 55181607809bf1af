"""Registry of named queries for the driver: ``name -> (spark, sf_dir) -> DataFrame`` and,
where SQL can express it, the DuckDB statement over the same parquet tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources import fixtures

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    """Decorator; ``oracle`` is a DuckDB body that may use the fixture views."""
    def deco(fn: Query) -> Query:
        _QUERIES[name] = fn
        if oracle is not None:
            _ORACLES[name] = fixtures.oracle(oracle)
        return fn
    return deco


def _load() -> None:
    from . import queries as _  # noqa: F401  (registers on import)


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
