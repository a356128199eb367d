"""All queries of the library outside the optional subpackage, with their SQL for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tablewright.plans import document_queries, figure_queries, record_queries, review_queries, stream_queries, table_queries, text_queries

Query = Callable[[SparkSession, str], DataFrame]


MODULES = (document_queries, figure_queries, text_queries, record_queries, table_queries, review_queries, stream_queries)


def queries() -> dict[str, Query]:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
