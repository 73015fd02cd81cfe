"""Registered queries: a callable over (spark, sf_dir), and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans.bindings import oracle as bind
from tessera.plans.bindings import view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, *inputs: str, oracle: str | None = None):
    """Registers a function of the named views or tables."""

    def add(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: function(*[view(spark, sf_dir, i) for i in inputs])
        if oracle:
            ORACLES[name] = bind(oracle)
        return function

    return add
