"""All queries of the engine with their SQL equivalents, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loamgraph.plans import evidence_queries, graph_queries, session_queries, source_queries, structure_queries, text_queries

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    """Queries by name; each takes (spark, directory of the tables)."""
    return evidence_queries.QUERIES | graph_queries.QUERIES | session_queries.QUERIES | source_queries.QUERIES | structure_queries.QUERIES | text_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    """SQL by query name, for the queries that SQL can express."""
    return evidence_queries.SQL | graph_queries.SQL | session_queries.SQL | source_queries.SQL | structure_queries.SQL | text_queries.SQL
