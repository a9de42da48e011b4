"""Routes over the synthetic world: snap both ends, link the mesh, search, straighten, measure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from navloom.functions import geometry as g
from navloom.operators import mesh as m
from navloom.operators.filters import RouteFilter
from navloom.operators.routes import packed_mesh, rays, routes
from navloom.plans.base import query, r6
from navloom.session import shuffled, table
from navloom.sources.world import mesh, width

RULES = RouteFilter(include=0xFFFF, exclude=1 << 12, area_cost={1: 1.5, 2: 2.0})
TILE = (0.0, 0.0, 8.0)


def requests(spark, d) -> DataFrame:
    """(pair_id, sx, sz, gx, gz) of all orders: from the customer's cell to one at most twelve cells away, by customer and day of the month, and for every 64th order to a cell anywhere."""
    w = width(spark, d)
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("pair_id"), F.col("o_custkey").alias("c"), F.dayofmonth("o_orderdate").alias("day"))
    a, shift, far = F.col("c") * 7 % (w * w), F.col("c") * 13 + F.col("day"), F.col("c") * 31 + F.col("day") * 97
    near = lambda c, f: g.clamp(F.col(c) + (shift * f) % 25 - 12, F.lit(0).cast("long"), F.lit(w - 1).cast("long"))
    end = lambda c, f: F.when(F.col("pair_id") % 64 == 0, far * f % w).otherwise(near(c, f))
    o = o.select("pair_id", "c", "day", (a % w).alias("aq"), F.floor(a / w).cast("long").alias("ar")).select("pair_id", "aq", "ar", end("aq", 1).alias("bq"), end("ar", 7).alias("br"))
    inner = lambda c, k: (F.col(c) + 0.25 + (F.col(k) % 3) / 8.0).cast("double")
    return o.select("pair_id", inner("aq", "ar").alias("sx"), inner("ar", "aq").alias("sz"), inner("bq", "br").alias("gx"), inner("br", "bq").alias("gz"))


def od_pairs(spark, d) -> DataFrame:
    """(pair_id, sp, sx, sy, sz, gp, gx, gy, gz): the requests with both ends on the nearest polygon that passes."""
    o = requests(spark, d)
    ends = o.select(F.col("sx").alias("px"), F.col("sz").alias("pz")).union(o.select("gx", "gz")).distinct().withColumn("py", F.lit(1.0))
    near = m.nearest_polygon(ends, shuffled(mesh(spark, d).where(RULES.passes())), (0.3, 4.0, 0.3), climb=0.5, by=("px", "pz")).checkpoint()
    for p, x, z in (("s", "sx", "sz"), ("g", "gx", "gz")):
        own = near.select(F.col("px").alias(x), F.col("pz").alias(z), F.col("ref").alias(f"{p}p"), F.col("x").alias(f"__{x}"), F.col("y").alias(f"{p}y"), F.col("z").alias(f"__{z}"))
        o = o.join(own, [x, z], "left").withColumns({x: F.coalesce(f"__{x}", x), z: F.coalesce(f"__{z}", z)}).drop(f"__{x}", f"__{z}")
    return o.select("pair_id", "sp", "sx", "sy", "sz", "gp", "gx", "gy", "gz")


def _packed(spark, d) -> DataFrame:
    p = mesh(spark, d)
    return packed_mesh(p, m.all_links(p))


def _routes(pairs: DataFrame, tiles: DataFrame, waypoints: bool = False) -> DataFrame:
    return routes(pairs, tiles, None, RULES, TILE, waypoints=waypoints)


@query()
def route_distance(spark, d):
    """Route length of every pair, -1 where there is none."""
    return _routes(od_pairs(spark, d), _packed(spark, d)).select("pair_id", r6(F.col("distance")).alias("distance"), "n_polygons", "is_partial")


@query()
def route_path(spark, d):
    """Waypoints of every route, in world axes."""
    t = _routes(od_pairs(spark, d), _packed(spark, d), waypoints=True).where(F.col("distance") >= 0)
    return t.select("pair_id", F.posexplode("waypoints").alias("seq", "w")).select("pair_id", "seq", F.round("w.z", 6).alias("wx"), F.round("w.x", 6).alias("wy"), F.col("w.flags").alias("flags"))


@query()
def ray(spark, d):
    """How far one can walk straight towards the destination."""
    p = mesh(spark, d)
    t = rays(od_pairs(spark, d), p, m.all_links(p), RULES, TILE)
    return t.select("pair_id", F.round("t", 6).alias("t"), "hit", "n_polygons", F.round("cost", 6).alias("cost"))


@query()
def stream_routes(spark, d):
    """Routes of all pairs as a stream of requests, run to its end: the same as the batch."""
    from navloom.streaming.requests import run_to_end

    tiles = _packed(spark, d)  # once for all batches
    return run_to_end(spark, od_pairs(spark, d), lambda batch: _routes(batch, tiles).select("pair_id", r6(F.col("distance")).alias("distance"), "is_partial"))
