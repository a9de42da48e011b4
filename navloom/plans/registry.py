"""All queries of the engine's own operators, with their SQL."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession

from navloom.plans.base import QUERIES, SQL
from navloom.session import ready

for _module in ("tiles", "geometry", "mesh", "terrain", "details", "results", "routes", "files"):
    importlib.import_module(f"navloom.plans.{_module}")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Route distances over the synthetic world."""
    return QUERIES["route_distance"](ready(spark), sf_dir)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
