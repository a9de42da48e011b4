"""Mesh operators over the irregular mesh: box queries, nearest polygons, links inside tiles and across borders, off-mesh connections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from navloom.functions import geometry as g
from navloom.operators import mesh as m
from navloom.plans.base import query, r6
from navloom.session import table
from navloom.sources.binary import MESH_MAGIC, MESH_VERSION
from navloom.sources.world import mesh, points, width

WORLD = ("points", "polys", "mesh")
#: query points over the lattice
_AT = "at_ AS (SELECT event_id, (wx + 17066.0) / 34133.0 * w AS px, (wy + 17066.0) / 34133.0 * w AS pz, (event_id % 9) / 2.0 AS py FROM points, size)"
_BOX = f"""{_AT}, cand AS (SELECT event_id, px, py, pz, 1.5 AS climb, b.* FROM at_ JOIN boxes b ON lx <= px + 2 AND hx >= px - 2 AND lz <= pz + 2 AND hz >= pz - 2 AND ly <= py + 4 AND hy >= py - 4)"""


def near_sql(by: str, source: str, name: str = "near") -> str:
    """SQL of the nearest polygon for each `by` of a table (by, px, py, pz, climb, ref, corners), as tables ending in `name`."""
    return f"""{name}_e AS (SELECT {by}, px, py, pz, climb, ref, e, corners[1] AS o, corners[e + 1] AS a, corners[(e + 1) % len(corners) + 1] AS b FROM (SELECT *, unnest(range(len(corners))) AS e FROM {source})),
    {name}_t AS (SELECT *, b.x - a.x AS dx, b.z - a.z AS dz, (a.z > pz) <> (b.z > pz) AND px < (b.x - a.x) * ((pz - a.z) / (b.z - a.z)) + a.x AS crosses, (b.x - o.x) * (a.z - o.z) - (b.z - o.z) * (a.x - o.x) AS area FROM {name}_e),
    {name}_u AS (SELECT *, CASE WHEN dx * dx + dz * dz > 0 THEN greatest(0.0, least(1.0, (dx * (px - a.x) + dz * (pz - a.z)) / (dx * dx + dz * dz))) ELSE 0.0 END AS t, CASE WHEN area < 0 THEN -1.0 ELSE 1.0 END AS s FROM {name}_t),
    {name}_v AS (SELECT *, ((a.z - o.z) * (px - o.x) - (a.x - o.x) * (pz - o.z)) * s AS u, ((b.x - o.x) * (pz - o.z) - (b.z - o.z) * (px - o.x)) * s AS v, (a.x + t * dx - px) * (a.x + t * dx - px) + (a.z + t * dz - pz) * (a.z + t * dz - pz) AS dd FROM {name}_u),
    {name}_h AS (SELECT *, CASE WHEN abs(area) >= 1e-6 AND u >= 0 AND v >= 0 AND u + v <= area * s THEN o.y + ((b.y - o.y) * u + (a.y - o.y) * v) / (area * s) END AS h FROM {name}_v),
    {name}_g AS (SELECT {by}, px, py, pz, climb, ref, count(*) FILTER (crosses) % 2 = 1 AS over_it, arg_min(h, e) FILTER (h IS NOT NULL) AS h, arg_min({{'x': a.x + t * (b.x - a.x), 'y': a.y + t * (b.y - a.y), 'z': a.z + t * (b.z - a.z)}}, (dd, e)) AS n FROM {name}_h GROUP BY ALL),
    {name}_p AS (SELECT {by}, px, py, pz, climb, ref, over_it, CASE WHEN over_it THEN px ELSE n.x END AS nx, CASE WHEN over_it THEN coalesce(h, n.y) ELSE n.y END AS ny, CASE WHEN over_it THEN pz ELSE n.z END AS nz FROM {name}_g),
    {name}_d AS (SELECT *, CASE WHEN over_it THEN greatest(0.0, abs(ny - py) - climb) * greatest(0.0, abs(ny - py) - climb) ELSE (nx - px) * (nx - px) + (ny - py) * (ny - py) + (nz - pz) * (nz - pz) END AS dist FROM {name}_p),
    {name} AS (SELECT * FROM {name}_d QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY dist, ref) = 1)"""


def at_cells(spark, d) -> DataFrame:
    w = width(spark, d)
    scale = lambda c: (F.col(c) + 17066.0) / 34133.0 * w
    return points(spark, d).select("event_id", scale("wx").alias("px"), ((F.col("event_id") % 9) / F.lit(2.0)).alias("py"), scale("wy").alias("pz"))


@query(f"WITH {_BOX} SELECT event_id, ref FROM cand WHERE (flags & 7) <> 0", WORLD)
def box_query(spark, d):
    return m.box_query(at_cells(spark, d), mesh(spark, d).where(g.passes("flags", 7)), g.SNAP).select("event_id", "ref")


@query(f"WITH {_BOX}, n AS (SELECT event_id, ref, row_number() OVER (PARTITION BY event_id ORDER BY ref) AS n, count(*) OVER (PARTITION BY event_id) AS found FROM cand) SELECT event_id, ref, found > 8 AS overflow FROM n WHERE n <= 8", WORLD)
def box_query_capped(spark, d):
    found = m.box_query(at_cells(spark, d), mesh(spark, d).where("ptype = 0"), g.SNAP)
    return m.first_polygons(found, 8).select("event_id", "ref", "overflow")


@query(
    f"""WITH {_AT}, low AS (SELECT x, y, layer, min(lx) AS tx, min(ly) AS ty, min(lz) AS tz FROM boxes GROUP BY 1, 2, 3),
    leaf AS (SELECT b.x, b.y, ref, tx, ty, tz, floor((lx - tx) * 4) AS ax, floor((ly - ty) * 4) AS ay, floor((lz - tz) * 4) AS az, ceil((hx - tx) * 4) AS bx, ceil((hy - ty) * 4) AS by_, ceil((hz - tz) * 4) AS bz FROM boxes b JOIN low l USING (x, y, layer)),
    q AS (SELECT event_id, ref, ax, ay, az, bx, by_, bz, floor(greatest(px - 2.0 - tx, 0) * 4)::BIGINT & 65534 AS qx, floor(greatest(py - 4.0 - ty, 0) * 4)::BIGINT & 65534 AS qy, floor(greatest(pz - 2.0 - tz, 0) * 4)::BIGINT & 65534 AS qz,
      least((floor(greatest(px + 2.0 - tx, 0) * 4)::BIGINT + 1) | 1, 65535) AS ux, least((floor(greatest(py + 4.0 - ty, 0) * 4)::BIGINT + 1) | 1, 65535) AS uy, least((floor(greatest(pz + 2.0 - tz, 0) * 4)::BIGINT + 1) | 1, 65535) AS uz
      FROM at_ JOIN leaf ON x BETWEEN floor((px - 2.0) / 8) AND floor((px + 2.0) / 8) AND y BETWEEN floor((pz - 2.0) / 8) AND floor((pz + 2.0) / 8))
    SELECT event_id, ref FROM q WHERE qx <= bx AND ux >= ax AND qy <= by_ AND uy >= ay AND qz <= bz AND uz >= az""",
    WORLD,
)
def tree_query(spark, d):
    """What the tiles' box trees return: boxes are rounded out to quarter units."""
    return m.tree_query(at_cells(spark, d), m.tree_leaves(mesh(spark, d), 4.0), g.SNAP, 4.0, 8.0)


_SHOWN = "over_it, round(nx, 6) + 0.0 AS x, round(ny, 6) + 0.0 AS y, round(nz, 6) + 0.0 AS z, round(dist, 6) + 0.0 AS dist_sqr"


@query(f"WITH {_BOX}, passing AS (SELECT * FROM cand WHERE (flags & 7) <> 0), {near_sql('event_id', 'passing')} SELECT event_id, ref, {_SHOWN} FROM near", WORLD)
def nearest_poly(spark, d):
    near = m.nearest_polygon(at_cells(spark, d), mesh(spark, d).where(g.passes("flags", 7)), g.SNAP, climb=1.5)
    return near.select("event_id", "ref", "over_it", *(r6(F.col(c)).alias(c) for c in ("x", "y", "z", "dist_sqr")))


@query(f"WITH {_BOX}, own AS (SELECT * FROM cand WHERE x = floor(px / 8) AND y = floor(pz / 8)), {near_sql('event_id', 'own')} SELECT event_id, ref, {_SHOWN} FROM near", WORLD)
def nearest_in_tile(spark, d):
    own = (F.col("x") == F.floor(F.col("px") / 8)) & (F.col("y") == F.floor(F.col("pz") / 8))
    near = m.nearest_polygon(at_cells(spark, d), mesh(spark, d), g.SNAP, climb=1.5, condition=own)
    return near.select("event_id", "ref", "over_it", *(r6(F.col(c)).alias(c) for c in ("x", "y", "z", "dist_sqr")))


_INNER = "inner_ AS (SELECT e.ref AS src, t.ref AS dst, e.e AS edge, 255::BIGINT AS side, 0::BIGINT AS bmin, 255::BIGINT AS bmax FROM edges e JOIN mesh t ON t.x = e.x AND t.y = e.y AND t.layer = e.layer AND t.idx = e.nei - 1 WHERE nei BETWEEN 1 AND 32767)"
_BYTE = "cast(floor(greatest(0.0, least(1.0, {})) * 255 + 0.5) AS BIGINT)"
_PORTAL = f"""pe AS (SELECT ref, x, y, layer, idx, e, (nei & 255)::BIGINT AS side, (nei & 255) IN (0, 4) AS up, a, b FROM edges WHERE nei >= 32768),
    pf AS (SELECT *, CASE WHEN up THEN a.x ELSE a.z END AS at, CASE WHEN up THEN a.z < b.z ELSE a.x < b.x END AS fwd, CASE side WHEN 0 THEN 1 WHEN 4 THEN -1 ELSE 0 END AS dx, CASE side WHEN 2 THEN 1 WHEN 6 THEN -1 ELSE 0 END AS dy FROM pe),
    po AS (SELECT *, CASE WHEN up THEN least(a.z, b.z) ELSE least(a.x, b.x) END AS u0, CASE WHEN up THEN greatest(a.z, b.z) ELSE greatest(a.x, b.x) END AS u1, CASE WHEN fwd THEN a.y ELSE b.y END AS y0, CASE WHEN fwd THEN b.y ELSE a.y END AS y1 FROM pf),
    pj AS (SELECT o.ref AS src, t.ref AS dst, o.e AS edge, o.side, o.fwd, o.u0, o.u1, o.y0, o.y1, t.u0 AS v0, t.u1 AS v1, t.y0 AS z0, t.y1 AS z1, t.x AS tx, t.y AS ty, t.layer AS tl, t.idx AS ti, t.e AS te, greatest(o.u0 + 0.01, t.u0 + 0.01) AS lo, least(o.u1 - 0.01, t.u1 - 0.01) AS hi
      FROM po o JOIN po t ON t.side = (o.side + 4) % 8 AND ((t.x = o.x + o.dx AND t.y = o.y + o.dy) OR (t.x = o.x AND t.y = o.y AND t.layer <> o.layer)) WHERE abs(o.at - t.at) <= 0.01),
    pd AS (SELECT *, (z0 + (z1 - z0) / (v1 - v0) * (lo - v0)) - (y0 + (y1 - y0) / (u1 - u0) * (lo - u0)) AS d0, (z0 + (z1 - z0) / (v1 - v0) * (hi - v0)) - (y0 + (y1 - y0) / (u1 - u0) * (hi - u0)) AS d1 FROM pj WHERE lo <= hi),
    pk AS (SELECT *, (greatest(u0, v0) - u0) / (u1 - u0) AS t0, (least(u1, v1) - u0) / (u1 - u0) AS t1 FROM pd WHERE d0 * d1 < 0 OR d0 * d0 <= 1.0 OR d1 * d1 <= 1.0 QUALIFY row_number() OVER (PARTITION BY src, edge, dst ORDER BY te) = 1),
    portal AS (SELECT src, dst, edge, side, {_BYTE.format('CASE WHEN fwd THEN t0 ELSE 1 - t1 END')} AS bmin, {_BYTE.format('CASE WHEN fwd THEN t1 ELSE 1 - t0 END')} AS bmax FROM pk QUALIFY row_number() OVER (PARTITION BY src, edge, tx, ty, tl ORDER BY ti) <= 4)"""
LINKS = f"{_INNER}, {_PORTAL}, links AS (SELECT * FROM inner_ UNION ALL SELECT * FROM portal)"


@query(f"WITH {_INNER} SELECT src, dst, edge, side FROM inner_", WORLD)
def link_internal(spark, d):
    return m.internal_links(mesh(spark, d))


@query(f"WITH {_PORTAL} SELECT src, dst, edge, side, bmin, bmax FROM portal", WORLD)
def link_portal(spark, d):
    return m.portal_links(mesh(spark, d))


@query(f"WITH {_PORTAL} SELECT a.src, a.dst, a.edge, a.side, b.side AS back, b.src IS NOT NULL AS paired FROM portal a LEFT JOIN portal b ON a.src = b.dst AND a.dst = b.src", WORLD)
def link_symmetry(spark, d):
    p = m.portal_links(mesh(spark, d))
    back = p.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("side").alias("back"))
    return p.join(back, ["src", "dst"], "left").select("src", "dst", "edge", "side", "back", F.col("back").isNotNull().alias("paired"))


@query(f"WITH {LINKS} SELECT src, dst, edge, side, bmin, bmax FROM links", WORLD)
def mesh_links(spark, d):
    return m.all_links(mesh(spark, d))


@query(f"WITH {LINKS} SELECT src, dst, arg_min(edge, (edge, side, bmin, bmax)) AS edge, arg_min(side, (edge, side, bmin, bmax)) AS side FROM links GROUP BY 1, 2", WORLD)
def link_between(spark, d):
    return m.first_link(m.all_links(mesh(spark, d))).select("src", "dst", "edge", "side")


@query(f"WITH {LINKS}, gone AS (SELECT ref FROM mesh WHERE x = 1 AND y = 1) SELECT src, dst, edge, side FROM links WHERE src NOT IN (FROM gone) AND dst NOT IN (FROM gone)", WORLD)
def unlink_tile(spark, d):
    p = mesh(spark, d)
    return m.without_polygons(m.all_links(p), p.where("x = 1 AND y = 1").select("ref")).select("src", "dst", "edge", "side")


@query(f"WITH {LINKS}, fresh AS (SELECT ref FROM mesh WHERE (x * 5 + y * 3) % 4 = 0) SELECT src, dst, edge, side, bmin, bmax FROM links WHERE src IN (FROM fresh) OR dst IN (FROM fresh)", WORLD)
def links_of_arrivals(spark, d):
    """What the tiles of one arrival link when they join all others."""
    p = mesh(spark, d)
    return m.links_of_new_tiles(p, p.where("(x * 5 + y * 3) % 4 = 0").select("x", "y"))


_ARRIVE = f"""t AS (SELECT event_id, event_id % 9 AS x, event_id % 7 AS y, user_id % 2 AS layer, CASE WHEN event_id % 13 = 0 THEN 0 ELSE {MESH_MAGIC} END AS magic, CASE WHEN event_id % 17 = 0 THEN 6 ELSE {MESH_VERSION} END AS version FROM events),
    b AS (SELECT *, CASE WHEN magic <> {MESH_MAGIC} THEN 'wrong_magic' WHEN version <> {MESH_VERSION} THEN 'wrong_version' END AS bad FROM t)"""


@query(f"WITH {_ARRIVE} SELECT event_id, x, y, layer, coalesce(bad, CASE WHEN row_number() OVER (PARTITION BY x, y, layer, bad IS NULL ORDER BY event_id) > 1 THEN 'duplicate' ELSE 'ok' END) AS status FROM b")
def tile_arrivals(spark, d):
    """Arriving tiles are checked, and a place that has a good tile takes no other."""
    k = F.col("event_id")
    t = table(spark, d, "events").select("event_id", (k % 9).alias("x"), (k % 7).alias("y"), (F.col("user_id") % 2).alias("layer"), F.when(k % 13 == 0, 0).otherwise(MESH_MAGIC).alias("magic"), F.when(k % 17 == 0, 6).otherwise(MESH_VERSION).alias("version"))
    return m.accept_tiles(t, "event_id").select("event_id", "x", "y", "layer", "status")


@query(f"WITH {_INNER} SELECT src, dst FROM inner_ JOIN mesh s ON s.ref = src JOIN mesh t ON t.ref = dst WHERE (s.flags & 7) <> 0 AND (t.flags & 7) <> 0 AND (t.flags & 8) = 0", WORLD)
def links_filtered(spark, d):
    p = mesh(spark, d)
    ok = lambda name, inc, exc: p.where(g.passes("flags", inc, exc)).select(F.col("ref").alias(name))
    return m.internal_links(p).join(ok("src", 7, 0), "src", "left_semi").join(ok("dst", 7, 8), "dst", "left_semi").select("src", "dst")


@query("SELECT e.event_id, e.user_id % 3000 AS ref, p.x, p.y, p.layer, p.idx, p.ref IS NOT NULL AS valid FROM events e LEFT JOIN mesh p ON p.ref = e.user_id % 3000", ("polys", "mesh"))
def ref_lookup(spark, d):
    e = table(spark, d, "events").select("event_id", (F.col("user_id") % 3000).alias("ref"))
    p = mesh(spark, d).select("ref", "x", "y", "layer", "idx", F.lit(True).alias("valid"))
    return e.join(p, "ref", "left").select("event_id", "ref", "x", "y", "layer", "idx", F.coalesce("valid", F.lit(False)).alias("valid"))


@query("SELECT event_id FROM events WHERE user_id % 3000 IN (SELECT ref FROM mesh WHERE (flags & 3) <> 0)", ("polys", "mesh"))
def valid_ref(spark, d):
    e = table(spark, d, "events").select("event_id", (F.col("user_id") % 3000).alias("ref"))
    return e.join(mesh(spark, d).where(g.passes("flags", 3)), "ref", "left_semi").select("event_id")


@query("SELECT DISTINCT e.x, e.y, p.layer, p.n FROM (SELECT event_id % 9 AS x, event_id % 7 AS y FROM events) e JOIN (SELECT x, y, layer, count(*) AS n FROM mesh GROUP BY ALL) p USING (x, y)", ("polys", "mesh"))
def tiles_at(spark, d):
    t = mesh(spark, d).groupBy("x", "y", "layer").agg(F.count("*").alias("n"))
    want = table(spark, d, "events").select((F.col("event_id") % 9).alias("x"), (F.col("event_id") % 7).alias("y")).distinct()
    return t.join(want, ["x", "y"]).select("x", "y", "layer", "n")


_SLAB = """s AS (SELECT l_orderkey, l_linenumber, (l_partkey % 10) / 2.0 AS au, (l_suppkey % 7) / 2.0 AS ay, (l_partkey % 10) / 2.0 + 1 + l_quantity % 5 AS av, (l_orderkey % 11) / 2.0 AS az,
    (l_orderkey % 13) / 2.0 AS bu, (l_partkey % 6) / 2.0 AS by_, (l_orderkey % 13) / 2.0 + 0.5 + l_linenumber AS bv, (l_suppkey % 9) / 2.0 AS bz FROM lineitem),
    k AS (SELECT *, greatest(au + 0.01, bu + 0.01) AS lo, least(av - 0.01, bv - 0.01) AS hi, (az - ay) / (av - au) AS sa, (bz - by_) / (bv - bu) AS sb FROM s),
    h AS (SELECT *, (by_ + sb * (lo - bu)) - (ay + sa * (lo - au)) AS d0, (by_ + sb * (hi - bu)) - (ay + sa * (hi - au)) AS d1 FROM k)"""


@query(f"WITH {_SLAB} SELECT l_orderkey, l_linenumber, CASE WHEN lo > hi THEN false ELSE d0 * d1 < 0 OR d0 * d0 <= 2.25 OR d1 * d1 <= 2.25 END AS meets FROM h")
def slab_overlap(spark, d):
    c = F.col
    s = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", ((c("l_partkey") % 10) / 2.0).alias("au"), ((c("l_suppkey") % 7) / 2.0).alias("ay"), ((c("l_partkey") % 10) / 2.0 + 1 + c("l_quantity") % 5).alias("av"), ((c("l_orderkey") % 11) / 2.0).alias("az"),
        ((c("l_orderkey") % 13) / 2.0).alias("bu"), ((c("l_partkey") % 6) / 2.0).alias("by_"), ((c("l_orderkey") % 13) / 2.0 + 0.5 + c("l_linenumber")).alias("bv"), ((c("l_suppkey") % 9) / 2.0).alias("bz"),
    )
    return s.select("l_orderkey", "l_linenumber", g.slabs_meet(("au", "ay", "av", "az"), ("bu", "by_", "bv", "bz"), 0.75).alias("meets"))

def _portal_points(spark, d) -> DataFrame:
    p = mesh(spark, d)
    return m.portal_points(m.all_links(p), p)


_POINTS = f"""{LINKS}, pp AS (SELECT l.*, e.a, e.b, side = 255 OR (bmin = 0 AND bmax = 255) AS whole FROM links l JOIN edges e ON e.ref = l.src AND e.e = l.edge),
    pt AS (SELECT src, dst, edge, {", ".join(f"CASE WHEN whole THEN {end}.{k} ELSE a.{k} + (b.{k} - a.{k}) * ({byte} / 255.0) END AS {name}_{k}" for name, end, byte in (("left", "a", "bmin"), ("right", "b", "bmax")) for k in "xyz")} FROM pp)"""
_ENDS = tuple(f"{n}_{k}" for n in ("left", "right") for k in "xyz")


@query(f"WITH {_POINTS} SELECT src, dst, edge, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in _ENDS)} FROM pt", WORLD)
def portal_points(spark, d):
    return _portal_points(spark, d).select("src", "dst", "edge", *(r6(F.col(c)).alias(c) for c in _ENDS))


@query(f"WITH {_POINTS} SELECT src, dst, edge, {', '.join(f'round((left_{k} + right_{k}) * 0.5, 6) + 0.0 AS {k}' for k in 'xyz')} FROM pt", WORLD)
def edge_midpoint(spark, d):
    mid = lambda k: r6((F.col(f"left_{k}") + F.col(f"right_{k}")) * 0.5).alias(k)
    return _portal_points(spark, d).select("src", "dst", "edge", *(mid(k) for k in "xyz"))


_SIDE = "CASE WHEN dx = 0 AND dy = 0 THEN 255 " + " ".join(f"WHEN dx = {dx} AND dy = {dy} THEN {side}" for side, dx, dy in g.SIDES) + " ELSE 255 END"
_CON = f"""c0 AS (SELECT s_suppkey AS con, s_suppkey * 37 % w + 0.3e0 AS ax, s_suppkey * 53 % w + 0.6e0 AS az, (s_suppkey % 7) / 2.0e0 AS ay, (s_suppkey % 5) / 2.0e0 AS by_, s_nationkey % 2 = 0 AS bidir, w FROM supplier, size),
    c1 AS (SELECT *, greatest(0.5e0, least(w - 0.5e0, ax + con * 91 % 13 - 6.0e0)) AS bx, greatest(0.5e0, least(w - 0.5e0, az + con * 29 % 13 - 6.0e0)) AS bz, floor(ax / 8)::BIGINT AS x, floor(az / 8)::BIGINT AS y FROM c0),
    c2 AS (SELECT *, floor(bx / 8)::BIGINT - x AS dx, floor(bz / 8)::BIGINT - y AS dy FROM c1), con AS (SELECT *, {_SIDE}::BIGINT AS side, 0.6e0 AS rad, 2.0e0 AS climb FROM c2)"""
_HIT = "lx <= px + 0.6e0 AND hx >= px - 0.6e0 AND lz <= pz + 0.6e0 AND hz >= pz - 0.6e0 AND ly <= py + 2.0e0 AND hy >= py - 2.0e0"
_OFF = f"""{_CON}, sc AS (SELECT con, px, py, pz, climb, ref, corners FROM (SELECT con, x AS cx, y AS cy, ax AS px, ay AS py, az AS pz, climb FROM con) JOIN boxes b ON b.x = cx AND b.y = cy AND b.layer = 0 AND {_HIT}), {near_sql('con', 'sc', 'ns')},
    s AS (SELECT * FROM ns WHERE (nx - px) * (nx - px) + (nz - pz) * (nz - pz) <= 0.6e0 * 0.6e0),
    ec AS (SELECT con, b.layer AS tl, px, py, pz, climb, ref, corners FROM (SELECT con, CASE WHEN side = 255 THEN x ELSE x + dx END AS cx, CASE WHEN side = 255 THEN y ELSE y + dy END AS cy, bx AS px, by_ AS py, bz AS pz, climb FROM con) JOIN boxes b ON b.x = cx AND b.y = cy AND {_HIT}), {near_sql('con, tl', 'ec', 'ne')},
    t AS (SELECT * FROM ne WHERE (nx - px) * (nx - px) + (nz - pz) * (nz - pz) <= 0.6e0 * 0.6e0 AND con IN (SELECT con FROM s)),
    off AS (SELECT con, -con AS src, ref AS dst, 0::BIGINT AS end_, 255::BIGINT AS side, nx, ny, nz FROM s UNION ALL SELECT con, ref, -con, 0, 255, nx, ny, nz FROM s
      UNION ALL SELECT t.con, -t.con, ref, 1, c.side, nx, ny, nz FROM t JOIN con c ON c.con = t.con UNION ALL SELECT t.con, ref, -t.con, 1, c.side, nx, ny, nz FROM t JOIN con c ON c.con = t.con WHERE bidir)"""


def connections(spark, d) -> DataFrame:
    """Off-mesh connections of all suppliers, at most six cells long."""
    w = width(spark, d)
    k = F.col("con")
    t = table(spark, d, "supplier").select(F.col("s_suppkey").alias("con"), (F.col("s_nationkey") % 2 == 0).alias("bidir"))
    t = t.withColumns({"ax": k * 37 % w + F.lit(0.3), "az": k * 53 % w + F.lit(0.6), "ay": (k % 7) / F.lit(2.0), "by": (k % 5) / F.lit(2.0)})
    end = lambda c, f: g.clamp(F.col(c) + k * f % 13 - F.lit(6.0), 0.5, w - 0.5)
    tile = lambda c: F.floor(F.col(c) / 8).cast("long")
    t = t.withColumns({"bx": end("ax", 91), "bz": end("az", 29)}).withColumns({"x": tile("ax"), "y": tile("az"), "layer": F.lit(0).cast("long")})
    side = F.lit(m.INTERNAL)
    for s, dx, dy in g.SIDES:
        side = F.when((tile("bx") - F.col("x") == dx) & (tile("bz") - F.col("y") == dy), s).otherwise(side)
    return t.withColumns({"side": side.cast("long"), "rad": F.lit(0.6), "climb": F.lit(2.0)})


@query(f"WITH {_OFF} SELECT con, src, dst, end_, side, round(nx, 6) + 0.0 AS x, round(ny, 6) + 0.0 AS y, round(nz, 6) + 0.0 AS z FROM off", WORLD)
def offmesh_links(spark, d):
    t = m.offmesh_links(connections(spark, d), mesh(spark, d))
    return t.select("con", "src", "dst", F.col("end").alias("end_"), "side", *(r6(F.col(c)).alias(c) for c in "xyz"))


WALL = f"{LINKS}, wall AS (SELECT ref, e AS edge, a.x AS ax, a.z AS az, b.x AS bx, b.z AS bz FROM edges ANTI JOIN (SELECT DISTINCT src, edge FROM links) o ON o.src = ref AND o.edge = e)"


@query(f"WITH {WALL} SELECT ref, edge, ax, az, bx, bz FROM wall", WORLD)
def wall_segments(spark, d):
    p = mesh(spark, d)
    return m.wall_segments(p, m.all_links(p))


@query("SELECT ref, coalesce(f, flags) AS flags, coalesce(a, area) AS area FROM mesh LEFT JOIN (SELECT p_partkey * 2 AS k, cast(p_size * 2 AS BIGINT) AS f, cast(3 AS BIGINT) AS a FROM part WHERE p_partkey % 17 = 0) ON k = ref", ("polys", "mesh"))
def poly_overrides(spark, d):
    o = table(spark, d, "part").where("p_partkey % 17 = 0").select((F.col("p_partkey") * 2).alias("ref"), (F.col("p_size") * 2).cast("long").alias("flags"), F.lit(3).cast("long").alias("area"))
    return m.with_overrides(mesh(spark, d), o).select("ref", "flags", "area")
