"""Registered queries: name -> (Spark query, oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliary.plans.evidence import Evidence

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(evidence) -> DataFrame`` under ``name``."""

    def wrap(fn: Callable[[Evidence], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, folder: fn(Evidence(spark, folder))
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return wrap
