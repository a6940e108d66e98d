"""Every registered query of the core library with its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.plans import governance, graph, memory, retrieval, streams, tabular, text

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (tabular, text, retrieval, graph, governance, memory, streams)


def queries() -> dict[str, Query]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
