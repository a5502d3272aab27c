"""Collects queries and their SQL twins from modules that define QUERIES and SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

MODULES = ("record_problems", "catalog_queries", "graph_queries", "estate_queries", "extract_queries", "merge_queries", "deepmap_queries", "report_queries")


def gather(modules: tuple[str, ...] = MODULES) -> tuple[dict[str, Query], dict[str, str]]:
    queries: dict[str, Query] = {}
    sql: dict[str, str] = {}
    for name in modules:
        module = import_module(f"graphloom.plans.{name}")
        double = queries.keys() & module.QUERIES.keys()
        if double:
            raise ValueError(f"queries registered twice: {sorted(double)}")
        queries |= module.QUERIES
        sql |= module.SQL
    return queries, sql
