"""Registry of named queries and their DuckDB twins.

Each entry is ``name -> (build(spark, sf_dir) -> DataFrame, oracle_sql | None)``.
Output columns are aliased identically on both sides; doubles are rounded on
both sides to the digits given, so the order-insensitive value hash compares
results, not summation order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLE: dict[str, str] = {}
FAMILY: dict[str, str] = {}


def query(name: str, sql: str | None = None, family: str = ""):
    def deco(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        FAMILY[name] = family
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco
