"""Query record and SQL fragments shared by several oracles."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_TAXA = ["click", "error", "purchase", "signup", "view"]


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def rounded(column: Column | str, digits: int = 6) -> Column:
    """Rounded double without a negative zero."""
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c, digits) + F.lit(0.0)


def sql_round(expression: str, digits: int = 6) -> str:
    return f"(round(CAST({expression} AS DOUBLE), {digits}) + 0.0)"


def _pivot(taxa, column, quote) -> str:
    return " || ".join(
        f"coalesce(max(CASE WHEN {column} = {quote}{t}{quote} THEN CAST(b AS VARCHAR) END), 'e')"
        for t in taxa
    )


EVENT_SITES = f"""
ev_cells AS (
  SELECT user_id, CAST(ts AS DATE) AS day, event_type,
         CAST(floor(max(value)) AS BIGINT) % 4 AS b
  FROM events GROUP BY ALL),
ev_sites AS (
  SELECT user_id, day, {_pivot(EVENT_TAXA, "event_type", "'")} AS pattern
  FROM ev_cells GROUP BY user_id, day),
ev_patterns AS (
  SELECT pattern, count(*) AS freq, row_number() OVER (ORDER BY pattern) - 1 AS pattern_id
  FROM ev_sites GROUP BY pattern)
"""

LINE_SITES = f"""
li_cells AS (
  SELECT l_orderkey, l_linenumber, CAST(floor(max(l_quantity)) AS BIGINT) % 4 AS b
  FROM lineitem GROUP BY ALL),
li_sites AS (
  SELECT l_orderkey, {_pivot(range(1, 8), "l_linenumber", "")} AS pattern
  FROM li_cells GROUP BY l_orderkey),
li_patterns AS (
  SELECT pattern, count(*) AS freq, row_number() OVER (ORDER BY pattern) - 1 AS pattern_id
  FROM li_sites GROUP BY pattern)
"""
