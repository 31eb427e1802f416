"""Registered queries: one per SURVEY §2 operator, each paired with its
DuckDB oracle SQL (see tipscope.catalog.*)."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from tipscope.catalog.base import REGISTRY, round_doubles
from tipscope.catalog import aggregates, basics, charts, models, text  # noqa: F401  (registers queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def wrap(q):
        return lambda spark, sf_dir: round_doubles(q.fn(spark, sf_dir))
    return {k: wrap(q) for k, q in REGISTRY.items()}


def oracle_sqls() -> dict[str, str]:
    out = {}
    for k, q in REGISTRY.items():
        s = q.oracle_sql()
        if s is not None:
            out[k] = s
    return out
