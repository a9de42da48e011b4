"""Origin-destination workloads: orderings of pairs as nested literals or JSON, and generated ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from navloom.functions import geometry as g

SCHEMA = "score double, ids array<int>, pairs array<struct<x1:double,y1:double,x2:double,y2:double>>"


def read_orderings(spark: SparkSession, path: str) -> DataFrame:
    """(ordering_id, pair_no, x1, y1, x2, y2) of JSON lines of orderings; coordinates are floored. ordering_id is the line's place by content order of the file."""
    rows = spark.read.schema(f"ordering_id long, {SCHEMA}").json(path)
    return flatten(rows)


def flatten(orderings: DataFrame) -> DataFrame:
    t = orderings.select("ordering_id", F.posexplode("pairs").alias("pair_no", "p"))
    return t.select("ordering_id", "pair_no", *(F.floor(f"p.{c}").cast("long").alias(c) for c in ("x1", "y1", "x2", "y2")))


def generate(tiles: DataFrame, n: int, seed: int) -> DataFrame:
    """(tx, ty, x1, y1, x2, y2): n tiles drawn by a seeded hash; from a tile's centre to ten units further, truncated."""
    drawn = tiles.orderBy(F.xxhash64("tx", "ty", F.lit(seed)), "tx", "ty").limit(n)
    x, y = g.tile_centre("tx"), g.tile_centre("ty")
    return drawn.select("tx", "ty", x.cast("long").alias("x1"), y.cast("long").alias("y1"), (x + 10).cast("long").alias("x2"), (y + 10).cast("long").alias("y2"))
