"""Polygons as arrays of corners: distances to edges, containment, clipping; all as higher-order functions of one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from navloom.functions import geometry as g


def corners(polys: DataFrame) -> DataFrame:
    """`polys` of the synthetic lattice and quad: array of (x, z), the cell's corners moved a little, in order."""
    q, r, pid = F.col("q"), F.col("r"), F.col("pid")
    at = lambda x, z: F.struct(x.cast("double").alias("x"), z.cast("double").alias("z"))
    quad = F.array(at(q + (pid % 3) / 10.0, r + (pid % 5) / 20.0), at(q + (pid % 2) / 10.0, r + 1 - (pid % 4) / 10.0), at(q + 1 - (pid % 3) / 20.0, r + 1.0), at(q + 1.0, r + (pid % 7) / 20.0))
    return polys.withColumn("quad", quad)


def edges(polygon: str | Column) -> Column:
    """Array of (ax, az, bx, bz, e): the edges of an array of corners, the last one back to the first."""
    p = g.col(polygon)

    def edge(v, i):
        n = F.element_at(p, F.pmod(i + 1, F.size(p)) + 1)
        return F.struct(v["x"].alias("ax"), v["z"].alias("az"), n["x"].alias("bx"), n["z"].alias("bz"), i.cast("long").alias("e"))

    return F.transform(p, edge)


def edge_distances(rows: DataFrame, polygon: str, px: str = "px", pz: str = "pz") -> DataFrame:
    """`rows` and inside, edge, edge_dist_sqr, edge_x, edge_z: whether the point is in the polygon, and its nearest edge point (ties: first edge)."""

    def near(e):
        t, dd = g.nearest_on_segment((px, pz), (e["ax"], e["az"]), (e["bx"], e["bz"]))
        x, z = e["ax"] + t * (e["bx"] - e["ax"]), e["az"] + t * (e["bz"] - e["az"])
        return F.struct(dd.alias("dd"), e["e"].alias("e"), x.alias("x"), z.alias("z"), g.crosses((px, pz), (e["ax"], e["az"]), (e["bx"], e["bz"])).alias("crosses"))

    t = rows.withColumn("__near", F.transform(edges(polygon), near))
    best = F.array_min(F.transform("__near", lambda n: F.struct(n["dd"], n["e"], n["x"], n["z"])))
    t = t.withColumn("__best", best).withColumn("inside", F.size(F.filter("__near", lambda n: n["crosses"])) % 2 == 1)
    names = {"dd": "edge_dist_sqr", "e": "edge", "x": "edge_x", "z": "edge_z"}
    return t.select(*rows.columns, "inside", *(F.col("__best")[k].alias(v) for k, v in names.items()))


def clip_to_polygon(rows: DataFrame, polygon: str, start: tuple[Column, Column], end: tuple[Column, Column]) -> DataFrame:
    """`rows` and hits, t_min, t_max: the part of a segment inside a convex polygon whose corners run clockwise seen from above."""
    (sx, sz), (tx, tz) = start, end

    def part(e):
        ex, ez = e["bx"] - e["ax"], e["bz"] - e["az"]
        num = ez * (sx - e["ax"]) - ex * (sz - e["az"])
        den = (tz - sz) * ex - (tx - sx) * ez
        along = F.abs(den) >= 1e-8
        return F.struct(F.when(along & (den < 0), F.try_divide(num, den)).alias("lo"), F.when(along & (den > 0), F.try_divide(num, den)).alias("hi"), (~along & (num < 0)).alias("off"))

    t = rows.withColumn("__part", F.transform(edges(polygon), part))
    lo, hi = F.array_max(F.transform("__part", lambda x: x["lo"])), F.array_min(F.transform("__part", lambda x: x["hi"]))
    t = t.withColumn("t_min", F.greatest(F.lit(0.0), F.coalesce(lo, F.lit(0.0)))).withColumn("t_max", F.least(F.lit(1.0), F.coalesce(hi, F.lit(1.0))))
    return t.withColumn("hits", ~F.exists("__part", lambda x: x["off"]) & (F.col("t_min") <= F.col("t_max"))).drop("__part")
