"""The registered queries of the document-records operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import layout_queries, page_queries, process_queries, record_queries, store_queries, text_queries

_MODULES = (record_queries, page_queries, layout_queries, text_queries, process_queries, store_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """name -> f(spark, sf_dir)."""
    return {name: f for m in _MODULES for name, (f, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by query name."""
    return {name: sql for m in _MODULES for name, (_, sql) in m.QUERIES.items() if sql}
