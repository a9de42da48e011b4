"""Scalar geometry: references, vectors, segments, triangles, polygons, boxes, status words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from navloom.functions import geometry as g
from navloom.functions import status as st
from navloom.operators.polygons import clip_to_polygon, corners, edge_distances
from navloom.plans.base import query, r6
from navloom.session import table
from navloom.sources.world import points, polys, width

# Three points for each order line: small pseudo-random coordinates from its numbers.
_TRI = """t AS (SELECT l_orderkey, l_linenumber, (l_partkey % 97) / 7.0 AS ax, (l_suppkey % 89) / 5.0 AS ay, l_quantity / 3.0 AS az,
    (l_orderkey % 83) / 6.0 AS bx, l_discount * 50 AS by_, (l_partkey % 41) / 4.0 AS bz, l_tax * 100 AS cx, (l_orderkey % 19) / 2.0 AS cy, (l_suppkey % 53) / 3.0 AS cz FROM lineitem)"""


def triangles(spark, d) -> DataFrame:
    x = table(spark, d, "lineitem")
    c = F.col
    return x.select(
        "l_orderkey", "l_linenumber",
        ((c("l_partkey") % 97) / 7.0).alias("ax"), ((c("l_suppkey") % 89) / 5.0).alias("ay"), (c("l_quantity") / 3.0).alias("az"),
        ((c("l_orderkey") % 83) / 6.0).alias("bx"), (c("l_discount") * 50).alias("by_"), ((c("l_partkey") % 41) / 4.0).alias("bz"),
        (c("l_tax") * 100).alias("cx"), ((c("l_orderkey") % 19) / 2.0).alias("cy"), ((c("l_suppkey") % 53) / 3.0).alias("cz"),
    )


_ID = ("l_orderkey", "l_linenumber")
_K = "l_orderkey, l_linenumber"
_P = "(l_orderkey % 31) / 3.0"
_Q = "(l_partkey % 29) / 3.0"


@query("SELECT event_id, ((user_id % 4095 + 1) << 52) | ((event_id % 2097152) << 31) | (event_id * 7919 % 1000003) AS ref FROM events WHERE user_id % 4095 + 1 < 2048")
def ref_encode(spark, d):
    e = table(spark, d, "events").where(F.col("user_id") % 4095 + 1 < 2048)
    return e.select("event_id", g.encode_ref(F.col("user_id") % 4095 + 1, F.col("event_id") % 2097152, F.col("event_id") * 7919 % 1000003).alias("ref"))


@query("SELECT event_id, user_id % 2000 + 1 AS salt, event_id % 2097152 AS tile, event_id * 7919 % 1000003 AS poly FROM events")
def ref_decode_wide_tile(spark, d):
    e = table(spark, d, "events")
    e = e.select("event_id", g.encode_ref(F.col("user_id") % 2000 + 1, F.col("event_id") % 2097152, F.col("event_id") * 7919 % 1000003).alias("ref"))
    return e.select("event_id", *(c.alias(n) for c, n in zip(g.decode_ref("ref"), ("salt", "tile", "poly"), strict=True)))


@query("SELECT event_id, user_id % 30000 + 1 AS salt, event_id * 31 % 268435456 AS tile, event_id * 7919 % 1048576 AS poly FROM events")
def ref_decode_wide_poly(spark, d):
    e = table(spark, d, "events")
    e = e.select("event_id", g.encode_ref(F.col("user_id") % 30000 + 1, F.col("event_id") * 31 % 268435456, F.col("event_id") * 7919 % 1048576, "wide_poly").alias("ref"))
    return e.select("event_id", *(c.alias(n) for c, n in zip(g.decode_ref("ref", "wide_poly"), ("salt", "tile", "poly"), strict=True)))


@query(f"""WITH {_TRI} SELECT {_K}, round(ay*bz - az*by_, 6) + 0.0 AS cross_x, round(az*bx - ax*bz, 6) + 0.0 AS cross_y, round(ax*by_ - ay*bx, 6) + 0.0 AS cross_z, round(ax*bx + ay*by_ + az*bz, 6) + 0.0 AS dot,
    round(ax + (cx-ax)*0.25, 6) + 0.0 AS lerp_x, round(ay + bx*1.5, 6) + 0.0 AS mad_y, least(ax, bx, cx) AS min_x, greatest(az, bz, cz) AS max_z FROM t""")
def vector_ops(spark, d):
    t = triangles(spark, d)
    a, b, c = ("ax", "ay", "az"), ("bx", "by_", "bz"), ("cx", "cy", "cz")
    x, y, z = g.cross(a, b)
    return t.select(*_ID, r6(x).alias("cross_x"), r6(y).alias("cross_y"), r6(z).alias("cross_z"), r6(g.dot(a, b)).alias("dot"), r6(g.lerp(a, c, 0.25)[0]).alias("lerp_x"), r6(F.col("ay") + F.col("bx") * 1.5).alias("mad_y"), F.least("ax", "bx", "cx").alias("min_x"), F.greatest("az", "bz", "cz").alias("max_z"))


@query(f"""WITH {_TRI} SELECT {_K}, round(sqrt(ax*ax+ay*ay+az*az), 6) AS length, round((bx-ax)*(bx-ax)+(by_-ay)*(by_-ay)+(bz-az)*(bz-az), 6) AS dist_sqr, round(sqrt((cx-ax)*(cx-ax)+(cz-az)*(cz-az)), 6) AS dist_2d,
    round(CASE WHEN ax*ax+ay*ay+az*az > 0 THEN ax / sqrt(ax*ax+ay*ay+az*az) END, 6) + 0.0 AS unit_x, (bx-ax)*(bx-ax)+(bz-az)*(bz-az) < (1.0/16384.0)*(1.0/16384.0) AS same FROM t""")
def vector_lengths(spark, d):
    t = triangles(spark, d)
    a, b = ("ax", "ay", "az"), ("bx", "by_", "bz")
    length = F.sqrt(g.dot(a, a))
    unit = F.when(length > 0, F.try_divide(F.col("ax"), length))
    return t.select(*_ID, F.round(length, 6).alias("length"), F.round(g.dist_sqr(a, b), 6).alias("dist_sqr"), F.round(g.dist(("ax", "az"), ("cx", "cz")), 6).alias("dist_2d"), r6(unit).alias("unit_x"), g.same_point(("ax", "az"), ("bx", "bz")).alias("same"))


@query(f"WITH {_TRI} SELECT {_K}, round((cx-ax)*(bz-az) - (bx-ax)*(cz-az), 6) + 0.0 AS area2, (cx-ax)*(bz-az) - (bx-ax)*(cz-az) > 0 AS is_left, round(az*bx - ax*bz, 6) + 0.0 AS perp FROM t")
def tri_area(spark, d):
    t = triangles(spark, d)
    area = g.area2(("ax", "az"), ("bx", "bz"), ("cx", "cz"))
    return t.select(*_ID, r6(area).alias("area2"), (area > 0).alias("is_left"), r6(g.perp(F.col("ax"), F.col("az"), F.col("bx"), F.col("bz"))).alias("perp"))


@query(f"""WITH {_TRI}, s AS (SELECT {_K}, ax, az, bx, bz, cx, cz, (bx-ax)*(bx-ax)+(bz-az)*(bz-az) AS l FROM t),
    u AS (SELECT *, CASE WHEN l > 0 THEN greatest(0.0, least(1.0, ((bx-ax)*(cx-ax)+(bz-az)*(cz-az)) / l)) ELSE 0.0 END AS p FROM s)
    SELECT {_K}, round(p, 6) + 0.0 AS t, round((ax+p*(bx-ax)-cx)*(ax+p*(bx-ax)-cx) + (az+p*(bz-az)-cz)*(az+p*(bz-az)-cz), 6) AS dist_sqr FROM u""")
def seg_dist(spark, d):
    t, dd = g.nearest_on_segment(("cx", "cz"), ("ax", "az"), ("bx", "bz"))
    return triangles(spark, d).select(*_ID, r6(t).alias("t"), F.round(dd, 6).alias("dist_sqr"))


_HEIGHT = """h AS (SELECT *, (cx-ax)*(bz-az) - (cz-az)*(bx-ax) AS area FROM t), s AS (SELECT *, CASE WHEN area < 0 THEN -1.0 ELSE 1.0 END AS sg,
    (ax+bx+cx)/3 + (l_orderkey % 7 - 3) / 2.0 AS px, (az+bz+cz)/3 AS pz FROM h),
    w AS (SELECT *, ((bz-az)*(px-ax) - (bx-ax)*(pz-az)) * sg AS u, ((cx-ax)*(pz-az) - (cz-az)*(px-ax)) * sg AS v FROM s)"""


@query(f"WITH {_TRI}, {_HEIGHT} SELECT {_K}, CASE WHEN abs(area) >= 1e-6 AND u >= 0 AND v >= 0 AND u + v <= area * sg THEN round(ay + ((cy-ay)*u + (by_-ay)*v) / (area*sg), 6) + 0.0 END AS height FROM w")
def tri_height(spark, d):
    t = triangles(spark, d)
    t = t.withColumn("px", (F.col("ax") + F.col("bx") + F.col("cx")) / 3 + (F.col("l_orderkey") % 7 - 3) / 2.0).withColumn("pz", (F.col("az") + F.col("bz") + F.col("cz")) / 3)
    h = g.height_in_triangle(("px", "pz"), ("ax", "ay", "az"), ("bx", "by_", "bz"), ("cx", "cy", "cz"))
    return t.select(*_ID, r6(h).alias("height"))


@query(f"""WITH {_TRI}, i AS (SELECT *, (bz-az)*(ay-cx) - (bx-ax)*(cy-cz) AS dd, ax-cx AS wx, az-cz AS wz FROM t)
    SELECT {_K}, CASE WHEN abs(dd) >= 1e-6 THEN round(((cy-cz)*wx - (ay-cx)*wz) / dd, 6) + 0.0 END AS s, CASE WHEN abs(dd) >= 1e-6 THEN round(((bz-az)*wx - (bx-ax)*wz) / dd, 6) + 0.0 END AS t FROM i""")
def seg_intersect(spark, d):
    s, t = g.intersection(("ax", "az"), ("bx", "bz"), ("cx", "cz"), ("ay", "cy"))
    return triangles(spark, d).select(*_ID, r6(s).alias("s"), r6(t).alias("t"))


# Quadrilaterals: the cells of the lattice, their corners moved a little, and for each the points of the events nearby.
_QUAD = """quad AS (SELECT pid, q, r, y, q + (pid % 3) / 10.0 AS x1, r + (pid % 5) / 20.0 AS z1, q + (pid % 2) / 10.0 AS x2, r + 1 - (pid % 4) / 10.0 AS z2,
    q + 1 - (pid % 3) / 20.0 AS x3, r + 1.0 AS z3, q + 1.0 AS x4, r + (pid % 7) / 20.0 AS z4 FROM polys)"""
_ON = "on_ AS (SELECT event_id, (wx + 17066.0) / 34133.0 * w AS px, (wy + 17066.0) / 34133.0 * w AS pz FROM points, size)"
_EDGES = f"""{_QUAD}, {_ON}, c AS (SELECT event_id, px, pz, pid, unnest([{{'ax': x1, 'az': z1, 'bx': x2, 'bz': z2, 'e': 0}}, {{'ax': x2, 'az': z2, 'bx': x3, 'bz': z3, 'e': 1}},
    {{'ax': x3, 'az': z3, 'bx': x4, 'bz': z4, 'e': 2}}, {{'ax': x4, 'az': z4, 'bx': x1, 'bz': z1, 'e': 3}}]) AS s FROM on_ JOIN quad ON q = cast(floor(px) AS BIGINT) AND r = cast(floor(pz) AS BIGINT)),
    e AS (SELECT event_id, px, pz, pid, s.ax::DOUBLE AS ax, s.az::DOUBLE AS az, s.bx::DOUBLE AS bx, s.bz::DOUBLE AS bz, s.e::BIGINT AS e FROM c),
    f AS (SELECT *, greatest(0.0, least(1.0, ((bx-ax)*(px-ax)+(bz-az)*(pz-az)) / ((bx-ax)*(bx-ax)+(bz-az)*(bz-az)))) AS p,
      CASE WHEN (az > pz) <> (bz > pz) THEN px < (bx-ax) * (pz-az) / (bz-az) + ax ELSE false END AS crosses FROM e),
    k AS (SELECT *, (ax+p*(bx-ax)-px)*(ax+p*(bx-ax)-px) + (az+p*(bz-az)-pz)*(az+p*(bz-az)-pz) AS dd FROM f)"""


def on_cells(spark, d) -> DataFrame:
    """(event_id, px, pz, pid, quad): each event's point and the cell below it, with four corners."""
    w = width(spark, d)
    p = points(spark, d).select("event_id", ((F.col("wx") + 17066.0) / 34133.0 * w).alias("px"), ((F.col("wy") + 17066.0) / 34133.0 * w).alias("pz"))
    p = p.withColumn("q", F.floor("px").cast("long")).withColumn("r", F.floor("pz").cast("long"))
    return p.join(corners(polys(spark, d)), ["q", "r"]).select("event_id", "px", "pz", "pid", "quad")


@query(f"WITH {_EDGES} SELECT event_id, pid, count(*) FILTER (crosses) % 2 = 1 AS inside, round(min(dd), 6) AS edge_dist_sqr, arg_min(e, (dd, e)) AS edge FROM k GROUP BY 1, 2", ("points", "polys"))
def poly_edge_dist(spark, d):
    e = edge_distances(on_cells(spark, d), "quad")
    return e.select("event_id", "pid", "inside", F.round("edge_dist_sqr", 6).alias("edge_dist_sqr"), "edge")


@query(f"WITH {_EDGES} SELECT event_id, pid, count(*) FILTER (crosses) % 2 = 1 AS inside FROM k GROUP BY 1, 2", ("points", "polys"))
def point_in_poly(spark, d):
    return edge_distances(on_cells(spark, d), "quad").select("event_id", "pid", "inside")


@query(f"""WITH {_EDGES}, b AS (SELECT event_id, pid, any_value(px) AS px, any_value(pz) AS pz, count(*) FILTER (crosses) % 2 = 1 AS inside, arg_min({{'x': ax+p*(bx-ax), 'z': az+p*(bz-az)}}, (dd, e)) AS m FROM k GROUP BY 1, 2)
    SELECT event_id, pid, round(CASE WHEN inside THEN px ELSE m.x END, 6) AS x, round(CASE WHEN inside THEN pz ELSE m.z END, 6) AS z FROM b""", ("points", "polys"))
def boundary_clamp(spark, d):
    e = edge_distances(on_cells(spark, d), "quad")
    keep = lambda own, edge: F.round(F.when(F.col("inside"), F.col(own)).otherwise(F.col(edge)), 6)
    return e.select("event_id", "pid", keep("px", "edge_x").alias("x"), keep("pz", "edge_z").alias("z"))


@query(f"WITH {_QUAD} SELECT pid, least(x1, x2, x3, x4)::DOUBLE AS min_x, least(z1, z2, z3, z4)::DOUBLE AS min_z, greatest(x1, x2, x3, x4)::DOUBLE AS max_x, greatest(z1, z2, z3, z4)::DOUBLE AS max_z, round((x1+x2+x3+x4)/4, 6)::DOUBLE AS centre_x FROM quad", ("polys",))
def poly_bbox(spark, d):
    c = corners(polys(spark, d))
    of = lambda f, k: f(F.transform("quad", lambda v: v[k]))
    centre = F.aggregate("quad", F.lit(0.0), lambda s, v: s + v["x"]) / F.size("quad")
    return c.select("pid", of(F.array_min, "x").alias("min_x"), of(F.array_min, "z").alias("min_z"), of(F.array_max, "x").alias("max_x"), of(F.array_max, "z").alias("max_z"), F.round(centre, 6).alias("centre_x"))


_CLIP = f"""{_EDGES}, v AS (SELECT event_id, pid, e, px AS sx, pz AS sz, px + 1.7 AS tx, pz - 0.6 AS tz, bx - ax AS ex, bz - az AS ez, px - ax AS dx, pz - az AS dz FROM k),
    n AS (SELECT *, ez*dx - ex*dz AS num, (tz-sz)*ex - (tx-sx)*ez AS den FROM v),
    x AS (SELECT event_id, pid, max(CASE WHEN abs(den) >= 1e-8 AND den < 0 THEN num/den END) AS lo, min(CASE WHEN abs(den) >= 1e-8 AND den > 0 THEN num/den END) AS hi, bool_or(abs(den) < 1e-8 AND num < 0) AS off FROM n GROUP BY 1, 2)"""


@query(f"WITH {_CLIP} SELECT event_id, pid, NOT off AND greatest(0.0, coalesce(lo, 0.0)) <= least(1.0, coalesce(hi, 1.0)) AS hits, round(greatest(0.0, coalesce(lo, 0.0)), 6) AS t_min, round(least(1.0, coalesce(hi, 1.0)), 6) + 0.0 AS t_max FROM x", ("points", "polys"))
def seg_poly_clip(spark, d):
    c = on_cells(spark, d)
    c = clip_to_polygon(c, "quad", (F.col("px"), F.col("pz")), (F.col("px") + 1.7, F.col("pz") - 0.6))
    return c.select("event_id", "pid", "hits", F.round("t_min", 6).alias("t_min"), r6(F.col("t_max")).alias("t_max"))


@query("""SELECT event_id, (s & 2147483648) <> 0 AS failed, (s & 1073741824) <> 0 AS succeeded, (s & 536870912) <> 0 AS running, (s & 64) <> 0 AS partial, (s & 32) <> 0 AS out_of_nodes, s & 255 AS detail
    FROM (SELECT event_id, (event_id * 2654435761) % 4294967296 AS s FROM events)""")
def status_decode(spark, d):
    e = table(spark, d, "events").select("event_id", ((F.col("event_id") * F.lit(2654435761)) % F.lit(4294967296)).alias("s"))
    return e.select("event_id", st.failed("s").alias("failed"), st.succeeded("s").alias("succeeded"), st.in_progress("s").alias("running"), st.has("s", st.PARTIAL).alias("partial"), st.has("s", st.OUT_OF_NODES).alias("out_of_nodes"), st.detail("s").alias("detail"))


@query("SELECT p_partkey, b & 63 AS area, b >> 6 AS kind, (b & 192) | (p_size % 64) AS area_set, (f >> 2) & 3 AS edge1 FROM (SELECT p_partkey, p_size::BIGINT AS p_size, (p_partkey * 37) % 256 AS b, (p_partkey * 11) % 64 AS f FROM part)")
def bit_fields(spark, d):
    b, f = F.col("b"), F.col("f")
    t = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("long").alias("p_size"), ((F.col("p_partkey") * 37) % 256).alias("b"), ((F.col("p_partkey") * 11) % 64).alias("f"))
    return t.select("p_partkey", b.bitwiseAND(63).alias("area"), F.shiftright(b, 6).alias("kind"), b.bitwiseAND(192).bitwiseOR(F.col("p_size") % 64).alias("area_set"), F.shiftright(f, 2).bitwiseAND(3).alias("edge1"))


@query("""SELECT event_id, greatest(-10.0, least(10.0, value - 50)) AS clamped, abs(value - 50) AS magnitude, round((value - 50) * (value - 50), 6) AS squared, cast(pow(2, ceil(log2(event_id + 1))) AS BIGINT) AS next_pow2,
    cast(floor(log2(event_id + 1)) AS BIGINT) AS ilog2, ((event_id + 3) // 4) * 4 AS aligned, round(sin(value) + cos(value), 6) + 0.0 AS waves, round(atan2(value, 7.0), 6) AS angle FROM events""")
def scalar_ops(spark, d):
    v, i = F.col("value"), F.col("event_id")
    return table(spark, d, "events").select(
        "event_id", g.clamp(v - 50, -10.0, 10.0).alias("clamped"), F.abs(v - 50).alias("magnitude"), F.round(g.sqr(v - 50), 6).alias("squared"),
        F.pow(F.lit(2.0), F.ceil(F.log2(i + 1))).cast("long").alias("next_pow2"), F.floor(F.log2(i + 1)).cast("long").alias("ilog2"), (F.floor((i + 3) / 4) * 4).cast("long").alias("aligned"),
        r6(F.sin(v) + F.cos(v)).alias("waves"), F.round(F.atan2(v, F.lit(7.0)), 6).alias("angle"),
    )


@query("SELECT p_partkey, p_size BETWEEN 1 AND 50 AND (p_size & 7) <> 0 AND (p_size & 8) = 0 AS passes, (p_size & 65535) <> 0 AS passes_default FROM part")
def flag_filter(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", (F.col("p_size").between(1, 50) & g.passes("p_size", 7, 8)).alias("passes"), g.passes("p_size").alias("passes_default"))


@query("""WITH c AS (SELECT pid, area, y, [1.0, 2.5, 0.75, 10.0][area + 1] AS cost FROM polys) SELECT pid, cost::DOUBLE AS cost, round(sqrt(1 + (y - 10) * (y - 10)) * cost, 6) AS step FROM c""", ("polys",))
def area_cost(spark, d):
    from navloom.operators.filters import RouteFilter

    rf = RouteFilter(area_cost={0: 1.0, 1: 2.5, 2: 0.75, 3: 10.0})
    p = polys(spark, d)
    return p.select("pid", rf.cost("area").alias("cost"), F.round(F.sqrt(1 + g.sqr(F.col("y") - 10)) * rf.cost("area"), 6).alias("step"))


@query(f"""WITH {_TRI}, b AS (SELECT *, least(ax, bx) AS lx, greatest(ax, bx) AS hx, least(az, bz) AS lz, greatest(az, bz) AS hz FROM t)
    SELECT {_K}, lx <= cx + 2 AND hx >= cx - 2 AND lz <= cz + 2 AND hz >= cz - 2 AS meets,
    cast(floor(8.0 * (greatest(0.0, least(12.0, lx)))) AS BIGINT) & 65534 AS q_low, least((cast(floor(8.0 * greatest(0.0, least(12.0, hx))) + 1 AS BIGINT)) | 1, 65535) AS q_high FROM b""")
def quant_bounds(spark, d):
    t = triangles(spark, d)
    low, high = F.least("ax", "bx"), F.greatest("ax", "bx")
    meets = g.overlap((low, high, F.col("cx") - 2, F.col("cx") + 2), (F.least("az", "bz"), F.greatest("az", "bz"), F.col("cz") - 2, F.col("cz") + 2))
    a, b = g.quantised(low, high, F.lit(0.0), F.lit(12.0), 8.0)
    return t.select(*_ID, meets.alias("meets"), a.alias("q_low"), b.alias("q_high"))


@query("SELECT tx, ty, cast((((tx * 2376512323 + ty * 3625334849) % 4294967296) & 1023) AS BIGINT) AS bucket FROM (SELECT DISTINCT (p_partkey * 7) % 64 AS tx, (p_partkey * 13 + p_size) % 64 AS ty FROM part)")
def tile_hash(spark, d):
    from navloom.plans.tiles import nav_tiles

    # The multipliers of the tile hash, modulo 2**32.
    h = (F.col("tx") * F.lit(2376512323) + F.col("ty") * F.lit(3625334849)) % F.lit(4294967296)
    return nav_tiles(spark, d).select("tx", "ty", h.bitwiseAND(1023).alias("bucket"))
