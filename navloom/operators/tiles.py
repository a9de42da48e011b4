"""Tile operators on DataFrames: covers of routes, presence, manifests, counts by shard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from navloom.functions import geometry as g


def cover(pairs: DataFrame, padding: int = 0) -> DataFrame:
    """(pair_id, tx, ty): the tiles of the rectangle over both ends of each pair, padded and clamped to the grid.

    Pairs with an end outside the grid have no cover. The rectangle is made by sequences, so a join
    on (tx, ty) afterwards is an equi-join.
    """
    ends = [g.tile_of(c) for c in ("x1", "y1", "x2", "y2")]
    t = pairs.select("pair_id", *(e.alias(n) for e, n in zip(ends, ("ta", "tb", "tc", "td"), strict=True)))
    t = t.where(g.in_grid(F.col("ta"), F.col("tb")) & g.in_grid(F.col("tc"), F.col("td")))
    t = t.select("pair_id", F.explode(g.cover("ta", "tc", padding)).alias("tx"), "tb", "td")
    return t.select("pair_id", "tx", F.explode(g.cover("tb", "td", padding)).alias("ty"))


def present(needed: DataFrame, existing: DataFrame, on: tuple[str, ...] = ("tx", "ty")) -> DataFrame:
    """`needed` and whether it exists."""
    have = existing.select(*on).distinct().withColumn("present", F.lit(True))
    return needed.join(have, list(on), "left").withColumn("present", F.col("present").isNotNull())


def pending(needed: DataFrame, loaded: DataFrame, on: tuple[str, ...] = ("tx", "ty")) -> DataFrame:
    return needed.join(loaded, list(on), "left_anti")


def inventory(lines: DataFrame) -> DataFrame:
    """(path, kind, map_id, tx, ty) of the lines (value) of a manifest or listing.

    Lines are trimmed, backslashes become slashes; blank lines, comments and other files are left out.
    """
    path = F.replace(F.trim("value"), F.lit("\\"), F.lit("/"))
    t = lines.select(path.alias("path")).where((F.col("path") != "") & ~F.startswith(F.col("path"), F.lit("#"))).distinct()
    # The file names of mesh parameters, mesh tiles (also with the last letter missing) and terrain tiles.
    kind = (
        F.when(F.col("path").rlike(r"mmaps/\d{3}\.mmap$"), "params")
        .when(F.col("path").rlike(r"mmaps/\d{7}\.mmtile?$"), "nav")
        .when(F.col("path").rlike(r"maps/\d{7}\.map$"), "terrain")
    )
    digits = lambda pattern: F.nullif(F.regexp_extract("path", pattern, 1), F.lit("")).cast("long")
    t = t.withColumn("kind", kind).where(F.col("kind").isNotNull())
    return t.select("path", "kind", digits(r"/(\d{3})\d*\.").alias("map_id"), digits(r"/\d{3}(\d{2})\d{2}\.").alias("tx"), digits(r"/\d{5}(\d{2})\.").alias("ty"))


def store_counts(tiles: DataFrame) -> DataFrame:
    """(sx, sy, nav, terrain): tiles of each kind in each shard."""
    t = tiles.select(g.shard("tx").alias("sx"), g.shard("ty").alias("sy"), "kind")
    return t.groupBy("sx", "sy").pivot("kind", ["nav", "terrain"]).count().na.fill(0)
