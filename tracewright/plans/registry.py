"""Queries by name, with the SQL that gives the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("experiment", "sessions", "signatures", "coverage", "triage", "integrity", "verdicts", "scalars", "extras", "joins", "periods", "sources")

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of a table reader ``t`` (name -> DataFrame) under a name."""

    def register(build: Callable[[Callable[[str], DataFrame]], DataFrame]):
        _queries[name] = lambda spark, sf_dir: build(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))
        if sql is not None:
            _sql[name] = sql
        return build

    return register


def _load() -> None:
    for m in MODULES:
        import_module(f"tracewright.plans.{m}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)
