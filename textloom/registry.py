"""Registry of named queries: a Spark builder ``(spark, sf_dir) -> DataFrame`` and, where the
semantics are SQL-expressible, the equivalent DuckDB SQL over the base tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom.functions.text import TOKEN_PATTERN

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return deco


def sql_tokens(expr: str) -> str:
    """DuckDB form of the default token count."""
    return f"CAST(len(regexp_extract_all({expr}, '{TOKEN_PATTERN}')) AS BIGINT)"


def load_all() -> None:
    """Import every module that registers queries."""
    from textloom.plans import code_jobs, message_jobs, structure_jobs, text_jobs, web_jobs  # noqa: F401
    from textloom.streaming import stream_jobs  # noqa: F401
