"""All queries of the document engine by name, with the SQL that checks each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with the SQL for the same rows where there is one."""

    def put(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return put


def load() -> None:
    """Register every module's queries."""
    from quire.plans import content_queries, edit_queries, extract_queries, object_queries, page_queries, report_queries, rule_queries, stream_queries, text_queries  # noqa: F401


load()
