"""Registered queries and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from alertloom.schema import ALERTS_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

CLUSTERED = "c AS (SELECT *, user_id AS pred_cluster FROM alerts)"


def over_alerts(select: str, *ctes: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join([ALERTS_SQL, *ctes]) + "\n" + select


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with the SQL that its rows must equal."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add
