"""Registered queries over the driver tables, with their DuckDB oracle SQL.

``QUERIES[name](spark, sf_dir) -> DataFrame``; ``ORACLE[name]`` is ANSI SQL
over the same tables (views named after the tables). Every computed column
is aliased identically on both sides; doubles are rounded to 6 places on
both sides so the value hashes compare.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

R = 6  # decimal places of every double in a query result


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def rnd(col, places: int = R):
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c.cast("double"), places)


def _load_groups():
    # Importing the modules registers their queries.
    from colloquy.queries import (  # noqa: F401
        q_agreement, q_clustering, q_consistency, q_density, q_labels, q_metrics, q_reports, q_scoring, q_similar, q_sources, q_topic_fit,
        q_topics, q_turns, q_vectors,
    )


def _shipped(fn):
    from functools import wraps

    from colloquy.session import ship_package

    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return fn(spark, sf_dir)
    return run


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Registered queries; each first ships the package to the executors."""
    _load_groups()
    return {name: _shipped(fn) for name, fn in QUERIES.items()}


def all_oracles() -> dict[str, str]:
    _load_groups()
    return dict(ORACLE)
