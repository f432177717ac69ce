"""Registry of the queries on list programs, corpora and trials, with the SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import corpus, dsl, programs, scopes, trials
from .dsl import flagship

__all__ = ["flagship", "oracle_sql", "queries"]
MODULES = [dsl, corpus, programs, scopes, trials]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for module in MODULES for name, run in module.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.oracle_sql().items()}
