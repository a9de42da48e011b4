"""A registry that query modules fill: a name, a function (spark, sf_dir) -> DataFrame, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from navloom.sources.world import WORLD_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, world: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Register a query under its function's name; `world` names the synthetic tables that its SQL reads."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            sql_text = sql.strip()
            head = ", ".join(WORLD_SQL[w] for w in world)
            if "{world}" in sql_text:
                sql_text = sql_text.replace("{world}", head)
            elif sql_text.upper().startswith("WITH "):
                sql_text = f"WITH {head}, {sql_text[5:]}" if head else sql_text
            elif head:
                sql_text = f"WITH {head} {sql_text}"
            SQL[f.__name__] = sql_text
        return f

    return add


def r6(c):
    """Rounded to six decimals, and never minus zero."""
    from pyspark.sql import functions as F

    return F.round(c, 6) + F.lit(0.0)
