"""Detail heights, distances to walls, weighted draws, overlaps of convex polygons."""

from __future__ import annotations

from pyspark.sql import functions as F

from navloom.operators import details as dt
from navloom.operators import mesh as m
from navloom.operators.polygons import corners, edge_distances
from navloom.plans.base import query, r6
from navloom.plans.geometry import _EDGES, _QUAD, on_cells
from navloom.plans.mesh import _AT, _CON, WALL, WORLD, at_cells, connections
from navloom.session import table
from navloom.sources.world import mesh, polys

# Two detail triangles a cell, over its moved corners, with heights by corner.
_TRIS = f"""{_EDGES}, base AS (SELECT DISTINCT event_id, px, pz, pid FROM k),
    v AS (SELECT b.*, q.x1::DOUBLE AS x1, q.z1::DOUBLE AS z1, q.x2::DOUBLE AS x2, q.z2::DOUBLE AS z2, q.x3::DOUBLE AS x3, q.z3::DOUBLE AS z3, q.x4::DOUBLE AS x4, q.z4::DOUBLE AS z4,
      (b.pid % 11) / 2.0::DOUBLE AS h1, (b.pid % 7) / 2.0::DOUBLE AS h2, (b.pid % 5) / 2.0::DOUBLE AS h3, (b.pid % 3) / 2.0::DOUBLE AS h4 FROM base b JOIN quad q USING (pid)),
    tri AS (SELECT event_id, pid, px, pz, 0 AS i, x1 AS ax, h1 AS ay, z1 AS az, x2 AS bx, h2 AS by_, z2 AS bz, x3 AS cx, h3 AS cy, z3 AS cz FROM v UNION ALL SELECT event_id, pid, px, pz, 1, x1, h1, z1, x3, h3, z3, x4, h4, z4 FROM v),
    ar AS (SELECT *, (cx-ax)*(bz-az) - (cz-az)*(bx-ax) AS area FROM tri), sg AS (SELECT *, CASE WHEN area < 0 THEN -1.0 ELSE 1.0 END AS s FROM ar),
    uv AS (SELECT *, ((bz-az)*(px-ax) - (bx-ax)*(pz-az))*s AS u, ((cx-ax)*(pz-az) - (cz-az)*(px-ax))*s AS w FROM sg),
    hh AS (SELECT event_id, pid, i, CASE WHEN abs(area) >= 1e-6 AND u >= 0 AND w >= 0 AND u + w <= area*s THEN ay + ((cy-ay)*u + (by_-ay)*w) / (area*s) END AS h FROM uv),
    seg AS (SELECT event_id, pid, px, pz, i*3 AS n, cx AS ax, cy AS ay, cz AS az, ax AS bx, ay AS by_, az AS bz FROM tri UNION ALL SELECT event_id, pid, px, pz, i*3+1, ax, ay, az, bx, by_, bz FROM tri UNION ALL SELECT event_id, pid, px, pz, i*3+2, bx, by_, bz, cx, cy, cz FROM tri),
    sp AS (SELECT *, greatest(0.0, least(1.0, ((bx-ax)*(px-ax)+(bz-az)*(pz-az)) / ((bx-ax)*(bx-ax)+(bz-az)*(bz-az)))) AS t FROM seg),
    se AS (SELECT event_id, pid, n, ay + (by_-ay)*t AS h, (ax+t*(bx-ax)-px)*(ax+t*(bx-ax)-px) + (az+t*(bz-az)-pz)*(az+t*(bz-az)-pz) AS dd FROM sp),
    fi AS (SELECT event_id, pid, arg_min(h, i) FILTER (h IS NOT NULL) AS inside FROM hh GROUP BY 1, 2), ed AS (SELECT event_id, pid, arg_min(h, (dd, n)) AS eh, min(dd) AS dd FROM se GROUP BY 1, 2)"""


def _details(spark, d, boundary: bool = False):
    pid = F.col("pid")
    c = on_cells(spark, d)
    height = [(pid % k) / 2.0 for k in (11, 7, 5, 3)]
    at = lambda i: F.struct(F.col("quad")[i]["x"].alias("x"), height[i].alias("y"), F.col("quad")[i]["z"].alias("z"))
    tri = lambda i, j, k, flags: F.struct(at(i).alias("a"), at(j).alias("b"), at(k).alias("c"), F.lit(flags).alias("flags"))
    # Flags: of the first triangle ab and bc are border, of the second bc and ca.
    return dt.detail_heights(c.withColumn("tris", F.array(tri(0, 1, 2, 0b000101), tri(0, 2, 3, 0b010100))), "tris", boundary=boundary)


@query(f"WITH {_TRIS} SELECT event_id, pid, round(coalesce(inside, eh), 6) + 0.0 AS height FROM fi JOIN ed USING (event_id, pid)", ("points", "polys"))
def poly_height(spark, d):
    return _details(spark, d).select("event_id", "pid", r6(F.col("height")).alias("height"))


@query(
    f"WITH {_TRIS}, nb AS (SELECT event_id, pid, any_value(px) AS px, any_value(pz) AS pz, count(*) FILTER (crosses) % 2 = 1 AS inside_poly, arg_min({{'x': ax+p*(bx-ax), 'z': az+p*(bz-az)}}, (dd, e)) AS m FROM k GROUP BY 1, 2) "
    "SELECT event_id, pid, inside_poly AS over_it, round(CASE WHEN inside_poly THEN px ELSE m.x END, 6) AS x, round(coalesce(inside, eh), 6) + 0.0 AS y, round(CASE WHEN inside_poly THEN pz ELSE m.z END, 6) AS z FROM nb JOIN fi USING (event_id, pid) JOIN ed USING (event_id, pid)",
    ("points", "polys"),
)
def closest_point(spark, d):
    """The nearest point of the polygon: the point itself if it lies over it, else on the border; the height is the detail height."""
    t = edge_distances(_details(spark, d), "quad")
    keep = lambda own, edge: F.round(F.when(F.col("inside"), F.col(own)).otherwise(F.col(edge)), 6)
    return t.select("event_id", "pid", F.col("inside").alias("over_it"), keep("px", "edge_x").alias("x"), r6(F.col("height")).alias("y"), keep("pz", "edge_z").alias("z"))


@query(f"WITH {_TRIS} SELECT event_id, pid, round(eh, 6) + 0.0 AS edge_height, round(dd, 6) AS edge_dist_sqr FROM ed", ("points", "polys"))
def detail_edges(spark, d):
    return _details(spark, d).select("event_id", "pid", r6(F.col("edge_height")).alias("edge_height"), F.round("edge_dist_sqr", 6).alias("edge_dist_sqr"))


@query(f"WITH {_TRIS} SELECT event_id, pid, round(arg_min(h, (dd, n)), 6) + 0.0 AS edge_height, round(min(dd), 6) AS edge_dist_sqr FROM se WHERE n NOT IN (0, 4) GROUP BY 1, 2", ("points", "polys"))
def detail_boundary_edges(spark, d):
    """The nearest point on the border of the detail mesh: the edge between the two triangles does not count."""
    return _details(spark, d, True).select("event_id", "pid", r6(F.col("edge_height")).alias("edge_height"), F.round("edge_dist_sqr", 6).alias("edge_dist_sqr"))


@query(f"WITH {_CON}, m AS (SELECT con, (ax + bx) / 2 + 0.25e0 AS px, (az + bz) / 2 - 0.5e0 AS pz, ax, ay, az, bx, by_, bz, (bx-ax)*(bx-ax) + (bz-az)*(bz-az) AS len FROM con), t AS (SELECT *, CASE WHEN len > 0 THEN greatest(0.0, least(1.0, ((bx-ax)*(px-ax) + (bz-az)*(pz-az)) / len)) ELSE 0.0 END AS t FROM m) SELECT con, round(ay + (by_ - ay) * t, 6) + 0.0 AS height FROM t", ("polys",))
def connection_height(spark, d):
    """The height of every off-mesh connection beside its middle."""
    c = connections(spark, d).withColumns({"px": (F.col("ax") + F.col("bx")) / 2 + 0.25, "pz": (F.col("az") + F.col("bz")) / 2 - 0.5})
    end = lambda n: tuple(F.col(f"{n}{k}") for k in "xyz")
    return c.select("con", r6(dt.connection_height(F.col("px"), F.col("pz"), end("a"), end("b"))).alias("height"))


@query(
    f"WITH {_AT}, {WALL}, n AS (SELECT event_id, ref, edge, ax, az, bx, bz, px, pz, greatest(0.0, least(1.0, ((bx-ax)*(px-ax)+(bz-az)*(pz-az)) / ((bx-ax)*(bx-ax)+(bz-az)*(bz-az))::DOUBLE)) AS t FROM at_ JOIN wall ON px BETWEEN least(ax, bx) - 1.5 AND greatest(ax, bx) + 1.5 AND pz BETWEEN least(az, bz) - 1.5 AND greatest(az, bz) + 1.5), "
    "x AS (SELECT event_id, ref, edge, (ax+t*(bx-ax)-px)*(ax+t*(bx-ax)-px) + (az+t*(bz-az)-pz)*(az+t*(bz-az)-pz) AS dd FROM n) SELECT event_id, round(sqrt(min(dd)), 6) AS wall_dist FROM x WHERE dd <= 2.25 GROUP BY 1",
    WORLD,
)
def distance_to_wall(spark, d):
    p = mesh(spark, d)
    walls = m.wall_segments(p, m.all_links(p)).withColumnRenamed("ref", "pid")
    return dt.distance_to_wall(at_cells(spark, d), walls, 1.5).select("event_id", F.round("wall_dist", 6).alias("wall_dist"))


@query(
    "WITH a AS (SELECT c_nationkey AS g, c_custkey AS pid, (c_custkey * 31 % 17 + 1)::BIGINT AS area FROM customer), s AS (SELECT *, sum(area) OVER (PARTITION BY g ORDER BY pid) AS t, sum(area) OVER (PARTITION BY g) AS whole FROM a), "
    "e AS (SELECT event_id, user_id % 25 AS g, (event_id * 7919 % 10007) / 10007.0::DOUBLE AS share FROM events) SELECT event_id, pid FROM e JOIN s ON s.g = e.g AND share * whole >= t - area AND share * whole < t"
)
def random_polygons(spark, d):
    c = table(spark, d, "customer")
    areas = c.select(F.col("c_nationkey").cast("long").alias("g"), F.col("c_custkey").alias("pid"), (F.col("c_custkey") * 31 % 17 + 1).alias("area"))
    e = table(spark, d, "events").select("event_id", (F.col("user_id") % 25).alias("g"), ((F.col("event_id") * 7919 % 10007) / F.lit(10007.0)).alias("share"))
    return dt.weighted_draws(areas, e, "g").select("event_id", "pid")


@query(
    f"WITH {_QUAD}, b AS (SELECT pid, unnest([{{'k': 'left', 'dx': -1}}, {{'k': 'same', 'dx': 0}}]) AS o, * EXCLUDE (pid) FROM quad) SELECT pid, round((x1+x2+x3+x4)/4, 6)::DOUBLE AS centre_x, round((z1+z2+z3+z4)/4, 6)::DOUBLE AS centre_z, o.k = 'same' AS overlap, o.k AS other FROM b",
    ("polys",),
)
def convex_overlap(spark, d):
    """Every cell overlaps itself, and not its copy two cells to the left."""
    c = corners(polys(spark, d)).select("pid", "quad")
    moved = lambda dx: F.transform("quad", lambda v: F.struct((v["x"] + dx).alias("x"), v["z"].alias("z")))
    c = c.select("pid", "quad", F.explode(F.array(F.struct(F.lit("left").alias("other"), moved(-2.0).alias("q")), F.struct(F.lit("same").alias("other"), F.col("quad").alias("q")))).alias("o")).select("pid", "quad", "o.*")
    centre = dt.centroid("quad")
    return c.select("pid", F.round(centre["x"], 6).alias("centre_x"), F.round(centre["z"], 6).alias("centre_z"), dt.convex_overlap("quad", "q").alias("overlap"), "other")
