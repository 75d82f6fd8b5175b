"""All queries of the library, collected from the operator modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .operators import boxes, capacity, dom, metrics, pictures, plan_text, planning, redaction, regions, rules, selectors, state, transitions
from .streaming import queries as streams

MODULES = [redaction, rules, regions, boxes, metrics, state, dom, plan_text, planning, pictures, selectors, capacity, transitions, streams]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
