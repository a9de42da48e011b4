"""Terrain height at world points.

terrain(tx, ty, mode, base, scale, v9, v8, holes): a row for each terrain tile. mode is flat, f32, u8
or u16; v9 and v8 are the 129 x 129 corner and 128 x 128 centre grids, row by row; heights of the
integer modes are raw * scale + base; holes are 256 masks of 16 bits. Points join cells, not tiles: each
tile gives rows (tx, ty, cell) of the cells that points ask for, so the join is an equi-join on three
numbers, a point's row carries no grid, and a tile with few points is hardly unfolded.

Defined results: points with a null coordinate, outside the grid or on tiles that are not there have null
mode and height; repeated points have a row each; a repeated tile gives a row for each of its copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from navloom.functions import geometry as g

SIDE = 128


def cells(terrain: DataFrame, wanted: DataFrame) -> DataFrame:
    """(tx, ty, mode, base, scale, cell, h1 ... h5, hole) of the wanted (tx, ty, at); flat tiles have one cell, -1."""
    at = lambda name, i: F.element_at(F.col(name), (i + 1).cast("int")).cast("double")

    def corner(i):
        row, column = F.floor(i / SIDE).cast("int"), (i % SIDE).cast("int")
        j = row * (SIDE + 1) + column
        hole = g.is_hole(F.col("holes"), row, column)
        return F.struct(i.cast("long").alias("cell"), at("v9", j).alias("h1"), at("v9", j + SIDE + 1).alias("h2"), at("v9", j + 1).alias("h3"), at("v9", j + SIDE + 2).alias("h4"), (at("v8", i) * 2.0).alias("h5"), hole.alias("hole"))

    flat = F.array(F.struct(F.lit(-1).cast("long").alias("cell"), *(F.lit(0.0).alias(f"h{k}") for k in range(1, 6)), F.lit(False).alias("hole")))
    terrain = terrain.join(wanted.groupBy("tx", "ty").agg(F.collect_set("at").alias("asked")), ["tx", "ty"])  # at most SIDE * SIDE numbers a tile
    grid = F.transform("asked", corner)
    own = lambda t, c: t.select("tx", "ty", "mode", "base", "scale", F.inline(c))
    return own(terrain.where("mode = 'flat'"), flat).union(own(terrain.where("mode <> 'flat'"), grid))


def heights(points: DataFrame, terrain: DataFrame) -> DataFrame:
    """`points` (event_id, wx, wy), mode, hole and height: null without terrain; a hole has none either."""
    row, column, u, v = g.terrain_cell("wx", "wy")
    p = points.select("event_id", g.tile_of("wx").alias("tx"), g.tile_of("wy").alias("ty"), (row * SIDE + column).alias("at"), u.alias("u"), v.alias("v"))
    modes = terrain.select("tx", "ty", "mode")
    p = p.join(modes, ["tx", "ty"], "left").withColumn("cell", F.when(F.col("mode") == "flat", F.lit(-1).cast("long")).otherwise(F.col("at")))
    t = p.join(cells(terrain, p.where("mode is not null").select("tx", "ty", "at")).drop("mode"), ["tx", "ty", "cell"], "left")
    inside = g.terrain_height("u", "v", "h1", "h2", "h3", "h4", "h5") * F.col("scale") + F.col("base")
    height = F.when(F.col("mode") == "flat", F.col("base")).when(~F.col("hole"), inside)
    return t.select("event_id", "mode", F.coalesce("hole", F.lit(False)).alias("hole"), height.alias("height"))


def with_sentinel(height: str = "height"):
    """The height as the command line shows it: -200000 where there is none."""
    return F.coalesce(F.col(height), F.lit(g.NO_HEIGHT))
