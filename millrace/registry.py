"""Query registry: each entry is a DataFrame builder and, where SQL can say it, its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Builder] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Builder], Builder]:
    """Registers a builder under ``name``, with the SQL that must give the same rows."""

    def add(build: Builder) -> Builder:
        _QUERIES[name] = build
        if oracle is not None:
            _ORACLES[name] = oracle
        return build

    return add


def _load() -> None:
    from millrace import plans  # noqa: F401  (registers on import)


def queries() -> dict[str, Builder]:
    _load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return _ORACLES
