"""Named queries over the base tables, each with an equivalent SQL text where one exists."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import riskloom
from riskloom.sources.tables import Tables

CATALOGS = (
    "reports", "texts", "evaluation", "scoring", "rates", "verdicts",
    "review", "storage", "vectors", "network", "noise", "live", "models",
)

_RUNNERS: dict[str, Callable[[Tables], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register `fn(tables)` under a name, with its SQL twin."""

    def register(fn):
        if name in _RUNNERS:
            raise ValueError(f"query {name} registered twice")
        _RUNNERS[name] = fn
        if sql is not None:
            _SQL[name] = sql.strip()
        return fn

    return register


def load() -> None:
    # Task-side helpers travel with the job, so executors need no copy of this package.
    cloudpickle.register_pickle_by_value(riskloom)
    for catalog in CATALOGS:
        importlib.import_module(f"riskloom.plans.catalog_{catalog}")


def runners() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load()

    def bind(fn):
        return lambda spark, folder: fn(Tables(spark, folder))

    return {name: bind(fn) for name, fn in _RUNNERS.items()}


def sql_texts() -> dict[str, str]:
    load()
    return dict(_SQL)
