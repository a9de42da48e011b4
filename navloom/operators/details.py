"""Heights and nearest points on detail triangles, and derived queries on walls and areas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from navloom.functions import geometry as g


def detail_heights(rows: DataFrame, triangles: str, px: str = "px", pz: str = "pz", boundary: bool = False) -> DataFrame:
    """`rows` and height, edge_height, edge_dist_sqr.

    triangles: an array of (a, b, c), each (x, y, z), in order. height is that of the first triangle
    above or below the point, else that of the nearest point on any triangle's edges (first edge wins).
    With `boundary` only edges on the mesh's boundary count for edge_height and edge_dist_sqr: those of triangles with
    flags whose two bits for the edge (ab, bc, ca from the lowest) are 1; a polygon without such an edge has nulls.
    """

    def inside(t):
        return g.height_in_triangle((px, pz), *((t[k]["x"], t[k]["y"], t[k]["z"]) for k in "abc"))

    def edge(t, i, p: str, q: str, n: int):
        a, b = t[p], t[q]
        s, dd = g.nearest_on_segment((px, pz), (a["x"], a["z"]), (b["x"], b["z"]))
        return F.struct(dd.alias("dd"), (i * 3 + n).alias("n"), (a["y"] + (b["y"] - a["y"]) * s).alias("h"))

    def edges_of(t, i):
        own = [(edge(t, i, "c", "a", 0), 2), (edge(t, i, "a", "b", 1), 0), (edge(t, i, "b", "c", 2), 1)]
        if not boundary:
            return F.array(*(e for e, _ in own))
        return F.array(*(F.when(F.shiftright(t["flags"].cast("long"), 2 * k).bitwiseAND(3) == 1, e) for e, k in own))

    edges = F.array_compact(F.flatten(F.transform(triangles, edges_of)))
    t = rows.withColumn("__in", F.filter(F.transform(triangles, inside), lambda h: h.isNotNull())).withColumn("__edge", F.array_min(edges))
    first = F.when(F.size("__in") > 0, F.get("__in", F.lit(0))).otherwise(F.col("__edge.h"))
    return t.select(*rows.columns, first.alias("height"), F.col("__edge.h").alias("edge_height"), F.col("__edge.dd").alias("edge_dist_sqr"))


def connection_height(px: Column, pz: Column, a, b) -> Column:
    """Height of an off-mesh connection beside a point: along its segment."""
    (ax, ay, az), (bx, by, bz) = a, b
    t, _ = g.nearest_on_segment((px, pz), (ax, az), (bx, bz))
    return ay + (by - ay) * t


def distance_to_wall(at: DataFrame, walls: DataFrame, radius: float, cell: float = 1.0) -> DataFrame:
    """(event_id, wall_dist, pid, edge): the nearest wall segment within the radius (ties: smallest pid, then edge); none: no row.

    Walls are entered into the grid cells that they and the radius around them touch, so the join is on cells.
    """
    low = lambda a, b: F.floor((F.least(F.col(a), F.col(b)) - radius) / cell).cast("long")
    high = lambda a, b: F.floor((F.greatest(F.col(a), F.col(b)) + radius) / cell).cast("long")
    w = walls.withColumn("gx", F.explode(F.sequence(low("ax", "bx"), high("ax", "bx")))).withColumn("gz", F.explode(F.sequence(low("az", "bz"), high("az", "bz"))))
    a = at.select("event_id", "px", "pz", F.floor(F.col("px") / cell).cast("long").alias("gx"), F.floor(F.col("pz") / cell).cast("long").alias("gz"))
    _, dd = g.nearest_on_segment(("px", "pz"), ("ax", "az"), ("bx", "bz"))
    near = a.join(w, ["gx", "gz"]).select("event_id", dd.alias("dd"), "pid", "edge").where(F.col("dd") <= radius * radius)
    best = near.groupBy("event_id").agg(F.min(F.struct("dd", "pid", "edge")).alias("b"))
    return best.select("event_id", F.sqrt("b.dd").alias("wall_dist"), "b.pid", "b.edge")


def weighted_draws(areas: DataFrame, draws: DataFrame, group: str) -> DataFrame:
    """`draws` (event_id, group, share in 0..1) and pid: polygons (group, pid, area) drawn in proportion to area.

    The polygons' spans of the group's whole area and the draws are merged in order of place, and a
    draw takes the last span that began: one sort, no pairs.
    """
    by = Window.partitionBy(group).orderBy("pid")
    spans = areas.where("area > 0").select(group, (F.sum("area").over(by) - F.col("area")).cast("double").alias("place"), F.lit(0).alias("kind"), "pid", F.lit(None).cast("long").alias("event_id"))
    whole = areas.groupBy(group).agg(F.sum("area").alias("__all"))
    own = draws.join(whole, group).select(group, (F.col("share") * F.col("__all")).alias("place"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("pid"), "event_id")
    order = Window.partitionBy(group).orderBy("place", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return spans.unionByName(own).withColumn("pid", F.last("pid", ignorenulls=True).over(order)).where("kind = 1").select("event_id", group, "pid")


def convex_overlap(a: str, b: str) -> Column:
    """Whether two convex polygons (arrays of (x, z)) overlap: no edge of either separates them."""

    def separated(p: str, q: str) -> Column:
        def gap(v, i):
            n = F.element_at(F.col(p), F.pmod(i + 1, F.size(p)) + 1)
            nx, nz = n["z"] - v["z"], -(n["x"] - v["x"])
            reach = lambda poly, f: f(F.transform(F.col(poly), lambda c: nx * c["x"] + nz * c["z"]))
            return (reach(p, F.array_max) < reach(q, F.array_min)) | (reach(q, F.array_max) < reach(p, F.array_min))

        return F.exists(F.transform(F.col(p), gap), lambda x: x)

    return ~(separated(a, b) | separated(b, a))


def centroid(polygon: str) -> Column:
    """The mean of a polygon's corners."""
    mean = lambda k: F.aggregate(polygon, F.lit(0.0), lambda s, v: s + v[k]) / F.size(polygon)
    return F.struct(mean("x").alias("x"), mean("z").alias("z"))
