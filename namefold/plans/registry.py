"""The queries by name, each with its SQL twin where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


def rounded(df: DataFrame) -> DataFrame:
    return df.select("a", "b", F.round("confidence", 6).alias("confidence"))


#: Votes (a, b, v) ranked per a, with the second's count.
TOP = """v2 AS (SELECT a, b, v, row_number() OVER w AS r, coalesce(lead(v) OVER w, 0) AS second FROM votes WINDOW w AS (PARTITION BY a ORDER BY v DESC, b))"""
