"""The registry of queries: a name, a plan over the tables, and the SQL that says what it returns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Plan], Plan]:
    """Registers a plan under its own or the given name; ``sql`` is its DuckDB equivalent, if there is one."""

    def add(plan: Plan) -> Plan:
        key = name or plan.__name__
        if key in QUERIES:
            raise ValueError(f"query {key} is registered twice")
        QUERIES[key] = plan
        if sql:
            ORACLES[key] = sql
        return plan

    return add
