"""All queries over the driver's tables and the DuckDB SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import data_queries, html_queries, io_queries, state_queries, text_queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return text_queries.QUERIES | data_queries.QUERIES | html_queries.QUERIES | state_queries.QUERIES | io_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return text_queries.SQL | data_queries.SQL | html_queries.SQL | state_queries.SQL | io_queries.SQL
