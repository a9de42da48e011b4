"""Mesh operators over polygons of any shape.

polys: (ref, x, y, layer, idx, corners, neis, flags, area, ptype, climb), also with map_id. ref names a polygon (any type
that has an order), (x, y, layer) is its tile and idx its number there; corners are (x, y, z) with y the height, in
order; neis has for each edge 0 (a wall), the neighbour's idx plus one, or 0x8000 and the side that a border edge faces.

Searches near points enter polygons and query boxes into the grid cells they cover and join on the cell, so plans are
equi-joins with bounded candidates, never a nested loop. A pair that shares several cells is kept in one of them, the
cell of the lower corner of the two boxes' common part, so nothing is made distinct afterwards. Links are equi-joins on
tiles and sides with the overlap conditions as residuals; no polygon, edge or link is broadcast there.

Defined results, unless an operator says otherwise: points with a null coordinate and polygons without corners meet
nothing; repeated points and polygons give repeated rows where an operator lists pairs, and one row where it picks the
best; a neighbour number that no polygon of the tile has is no link; empty tables give empty results; other columns of
the points are left out of results that pick, and kept in results that list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from navloom.functions import geometry as g
from navloom.session import shuffled

INTERNAL = 255
PORTAL = 0x8000
MARGIN = 0.01


def _tile(polys: DataFrame, *names: str) -> list[str]:
    return [c for c in ("map_id", *(names or ("x", "y", "layer"))) if c in polys.columns or c != "map_id"]


def boxes(polys: DataFrame) -> DataFrame:
    """`polys` and lx, ly, lz, hx, hy, hz: the box around the corners."""
    end = lambda f, k: f(F.transform("corners", lambda c: c[k]))
    return polys.withColumns({f"{n}{k}": end(f, k) for n, f in (("l", F.array_min), ("h", F.array_max)) for k in "xyz"})


def _cells(low: Column, high: Column, size: float) -> Column:
    return F.sequence(F.floor(low / size).cast("long"), F.floor(high / size).cast("long"))


def box_query(at: DataFrame, polys: DataFrame, half: tuple, cell: float = 2.0) -> DataFrame:
    """`at` and the polygon, for every polygon whose box overlaps the box of half-extents around the point (px, py, pz).

    half: three numbers or columns of `at`. cell: the grid's width; about that of the boxes is best. Columns of polygons
    that `at` has too (a tile, a map) must be equal.
    """
    px, py, pz = (F.col(c) for c in ("px", "py", "pz"))
    hx, hy, hz = (h if isinstance(h, Column) else F.lit(float(h)) for h in half)
    a = at.where(px.isNotNull() & py.isNotNull() & pz.isNotNull()).withColumns({"__ax": px - hx, "__bx": px + hx, "__ay": py - hy, "__by": py + hy, "__az": pz - hz, "__bz": pz + hz})
    a = a.withColumn("__cx", F.explode(_cells(F.col("__ax"), F.col("__bx"), cell))).withColumn("__cz", F.explode(_cells(F.col("__az"), F.col("__bz"), cell)))
    p = boxes(polys).where(F.size("corners") > 0)
    p = p.withColumn("__cx", F.explode(_cells(F.col("lx"), F.col("hx"), cell))).withColumn("__cz", F.explode(_cells(F.col("lz"), F.col("hz"), cell)))
    shared = [c for c in at.columns if c in polys.columns]
    first = lambda a, b: F.floor(F.greatest(a, b) / cell).cast("long")
    met = a.join(p, [*shared, "__cx", "__cz"]).where((F.col("__cx") == first("__ax", "lx")) & (F.col("__cz") == first("__az", "lz")))
    met = met.where(g.overlap(("__ax", "__bx", "lx", "hx"), ("__ay", "__by", "ly", "hy"), ("__az", "__bz", "lz", "hz")))
    return met.drop("__ax", "__bx", "__ay", "__by", "__az", "__bz", "__cx", "__cz", "lx", "ly", "lz", "hx", "hy", "hz")


def tree_leaves(polys: DataFrame, factor: float) -> DataFrame:
    """(x, y, layer, idx, bmin, bmax): the leaves of each tile's box tree, in units of 1 / factor from the tile's own lower corner, rounded out."""
    b = boxes(polys)
    low = b.groupBy(*_tile(polys)).agg(*(F.min(f"l{k}").alias(f"t{k}") for k in "xyz"))
    unit = lambda k, up: (F.ceil if up else F.floor)((F.col(f"{'h' if up else 'l'}{k}") - F.col(f"t{k}")) * factor).cast("long")
    return b.join(low, _tile(polys)).select(*_tile(polys), "ref", "idx", *(F.col(f"t{k}") for k in "xyz"), F.array(*(unit(k, False) for k in "xyz")).alias("bmin"), F.array(*(unit(k, True) for k in "xyz")).alias("bmax"))


def tree_query(at: DataFrame, leaves: DataFrame, half: tuple[float, float, float], factor: float, size: float) -> DataFrame:
    """(event_id, ref): what a tile's box tree returns for the box around each point, with boxes rounded to its units: never less than box_query.

    An inner node contains its leaves, so only leaves decide. at: (event_id, px, py, pz); tiles are size x size from the
    origin, and those that the box touches are searched.
    """
    px, pz = F.col("px"), F.col("pz")
    a = at.withColumn("x", F.explode(_cells(px - half[0], px + half[0], size))).withColumn("y", F.explode(_cells(pz - half[2], pz + half[2], size)))
    met = a.join(leaves, ["x", "y"])
    for i, (p, h) in enumerate(zip(("px", "py", "pz"), half, strict=True)):
        k = "xyz"[i]
        # Units of a query box below the tile's corner count as none, and beyond 16 bits as the last.
        low = F.floor(F.greatest(F.col(p) - h - F.col(f"t{k}"), F.lit(0.0)) * factor).cast("long").bitwiseAND(0xFFFE)
        high = F.least((F.floor(F.greatest(F.col(p) + h - F.col(f"t{k}"), F.lit(0.0)) * factor) + 1).cast("long").bitwiseOR(1), F.lit(0xFFFF))
        met = met.where((low <= F.col("bmax")[i]) & (high >= F.col("bmin")[i]))
    return met.select("event_id", "ref")


def first_polygons(found: DataFrame, most: int) -> DataFrame:
    """At most `most` polygons for each point, by polygon, and overflow: whether there were more."""
    by = Window.partitionBy("event_id")
    n = found.withColumn("__n", F.row_number().over(by.orderBy("ref"))).withColumn("overflow", F.count("*").over(by) > most)
    return n.where(F.col("__n") <= most).drop("__n")


def with_edges(rows: DataFrame, *keep: str) -> DataFrame:
    """(keep, e, a, b, o): the edges of each row's corners, from a to b, and the first corner."""
    nxt = lambda i: F.get("corners", (i + 1) % F.size("corners"))
    edge = F.inline(F.transform("corners", lambda v, i: F.struct(i.cast("long").alias("e"), v.alias("a"), nxt(i).alias("b"), F.get("corners", F.lit(0)).alias("o"))))
    return rows.select(*keep, edge)


def nearest_polygon(at: DataFrame, polys: DataFrame, half: tuple, climb: float | Column, condition: Column | None = None, cell: float = 2.0, by: tuple[str, ...] = ("event_id",)) -> DataFrame:
    """(by, ref, over_it, x, y, z, dist_sqr): for each point the polygon with the smallest distance (ties: smallest ref) and its nearest point.

    Above or below a polygon the nearest point has the height of its triangles around the first corner and the distance
    is the height difference beyond the climb, squared; elsewhere it is the nearest point of the border, and the distance
    is the squared distance. Points without a candidate have no row. condition: on the candidates.
    """
    found = box_query(at, polys, half, cell)
    if condition is not None:
        found = found.where(condition)
    climb = climb if isinstance(climb, Column) else F.lit(float(climb))
    # One shuffle by point; both aggregations below find their rows together.
    found = found.withColumn("__climb", climb).repartition(*by)
    own = list(dict.fromkeys([*by, "px", "py", "pz", "ref", "__climb"]))
    e = with_edges(found, *own)
    a, b, o = (lambda k, n=n: F.col(f"{n}.{k}") for n in "abo")
    part, dd = g.nearest_on_segment(("px", "pz"), (a("x"), a("z")), (b("x"), b("z")))
    h = g.height_in_triangle(("px", "pz"), (o("x"), o("y"), o("z")), (a("x"), a("y"), a("z")), (b("x"), b("y"), b("z")))
    e = e.select(*own, "e", g.crosses(("px", "pz"), (a("x"), a("z")), (b("x"), b("z"))).cast("int").alias("crosses"), dd.alias("dd"), h.alias("h"), *((a(k) + part * (b(k) - a(k))).alias(f"n{k}") for k in "xyz"))
    t = e.groupBy(*own).agg((F.sum("crosses") % 2 == 1).alias("over_it"), F.min(F.when(F.col("h").isNotNull(), F.struct("e", "h")))["h"].alias("h"), F.min(F.struct("dd", "e", "nx", "ny", "nz")).alias("n"))
    at_ = lambda k, inside: F.when(F.col("over_it"), inside).otherwise(F.col(f"n.n{k}"))
    t = t.select(*own, "over_it", at_("x", F.col("px")).alias("x"), at_("y", F.coalesce("h", "n.ny")).alias("y"), at_("z", F.col("pz")).alias("z"))
    gap = F.greatest(F.lit(0.0), F.abs(F.col("y") - F.col("py")) - F.col("__climb"))
    away = g.sqr(F.col("x") - F.col("px")) + g.sqr(F.col("y") - F.col("py")) + g.sqr(F.col("z") - F.col("pz"))
    t = t.withColumn("dist_sqr", F.when(F.col("over_it"), gap * gap).otherwise(away))
    best = t.groupBy(*by).agg(F.min(F.struct("dist_sqr", "ref", "over_it", "x", "y", "z")).alias("b"))
    return best.select(*by, "b.*")


# --- links ---


def internal_links(polys: DataFrame) -> DataFrame:
    """(map_id, src, dst, edge, side): neighbouring polygons within a tile; side 255 marks them as internal."""
    e = polys.where("ptype = 0").select(*_tile(polys), F.col("ref").alias("src"), F.posexplode("neis").alias("edge", "nei")).where((F.col("nei") > 0) & (F.col("nei") < PORTAL))
    dst = polys.select(*_tile(polys), (F.col("idx") + 1).cast("int").alias("nei"), F.col("ref").alias("dst"))
    return e.join(shuffled(dst), [*_tile(polys), "nei"]).select(*_tile(polys, "src"), "dst", F.col("edge").cast("long").alias("edge"), F.lit(INTERNAL).cast("long").alias("side"))


def portal_links(polys: DataFrame, climb: float | Column | None = None, most: int = 4, margin: float = MARGIN) -> DataFrame:
    """(map_id, src, dst, edge, side, bmin, bmax): links across borders, both ways.

    A border edge looks for edges that look back: in the tiles (all layers) on its side, and in other layers of its own
    tile, at the same coordinate and with overlapping slabs. Of a target polygon the first such edge counts, and of each
    target tile the first `most` polygons by number. climb: by default the polygons' own.
    """
    m = [c for c in ("map_id",) if c in polys.columns]
    climb = F.col("climb") if climb is None else climb if isinstance(climb, Column) else F.lit(float(climb))
    e = polys.where("ptype = 0").withColumn("__climb", climb)
    e = e.select(*m, "x", "y", "layer", "idx", "ref", "__climb", "corners", F.posexplode("neis").alias("edge", "nei")).where(F.col("nei").bitwiseAND(PORTAL) != 0)
    corner = lambda i: F.get("corners", (i % F.size("corners")).cast("int"))
    e = e.select(*m, "x", "y", "layer", "idx", "ref", "__climb", F.col("edge").cast("long").alias("edge"), F.col("nei").bitwiseAND(0xFF).cast("long").alias("side"), corner(F.col("edge")).alias("a"), corner(F.col("edge") + 1).alias("b"))
    step = lambda k: F.element_at(F.array(*(F.lit(s[k]) for s in g.SIDES)), (F.col("side") + 1).cast("int"))
    along_z = F.col("side").isin(0, 4)
    forward = F.when(along_z, F.col("a.z") < F.col("b.z")).otherwise(F.col("a.x") < F.col("b.x"))
    low, high = F.when(forward, F.col("a")).otherwise(F.col("b")), F.when(forward, F.col("b")).otherwise(F.col("a"))
    u = lambda v: F.when(along_z, v["z"]).otherwise(v["x"])
    e = e.select(*m, "x", "y", "layer", "idx", "ref", "__climb", "edge", "side", F.when(along_z, F.col("a.x")).otherwise(F.col("a.z")).alias("at"), u(low).alias("u0"), low["y"].alias("y0"), u(high).alias("u1"), high["y"].alias("y1"), forward.alias("forward"), step(1).alias("dx"), step(2).alias("dy"))
    t = e.select(*(F.col(c).alias(f"t_{c}") for c in (*m, "x", "y", "layer", "idx", "ref", "edge", "side", "at", "u0", "y0", "u1", "y1")))
    target = F.inline(F.array(*(F.struct((F.col("x") + k * F.col("dx")).cast("long").alias("nx"), (F.col("y") + k * F.col("dy")).cast("long").alias("ny"), F.lit(k == 0).alias("here")) for k in (1, 0))))
    o = e.select("*", target)
    on = (F.col("nx") == F.col("t_x")) & (F.col("ny") == F.col("t_y")) & (g.opposite("side") == F.col("t_side"))
    for c in m:
        on = on & (F.col(c) == F.col(f"t_{c}"))
    met = o.join(shuffled(t), on).where(~F.col("here") | (F.col("layer") != F.col("t_layer"))).where(F.abs(F.col("at") - F.col("t_at")) <= margin)
    met = met.where(g.slabs_meet(("u0", "y0", "u1", "y1"), ("t_u0", "t_y0", "t_u1", "t_y1"), F.col("__climb"), margin)).repartition("ref")
    met = met.withColumn("n", F.row_number().over(Window.partitionBy("ref", "edge", "t_ref").orderBy("t_edge"))).where("n = 1")
    met = met.withColumn("n", F.row_number().over(Window.partitionBy("ref", "edge", "t_x", "t_y", "t_layer").orderBy("t_idx"))).where(F.col("n") <= most)
    span = F.col("u1") - F.col("u0")
    share = lambda v: F.try_divide(v - F.col("u0"), span)
    t0, t1 = share(F.greatest("u0", "t_u0")), share(F.least("u1", "t_u1"))
    first, last = F.when(F.col("forward"), t0).otherwise(1 - t1), F.when(F.col("forward"), t1).otherwise(1 - t0)
    return met.select(*m, F.col("ref").alias("src"), F.col("t_ref").alias("dst"), "edge", "side", g.portal_byte(first).alias("bmin"), g.portal_byte(last).alias("bmax"))


def all_links(polys: DataFrame, climb: float | Column | None = None) -> DataFrame:
    """(map_id, src, dst, edge, side, bmin, bmax): internal and portal links."""
    inner = internal_links(polys).withColumns({"bmin": F.lit(0).cast("long"), "bmax": F.lit(255).cast("long")})
    return inner.unionByName(portal_links(polys, climb))


def accept_tiles(tiles: DataFrame, order: str) -> DataFrame:
    """`tiles` (x, y, layer, magic, version) and status: ok, wrong_magic, wrong_version, or duplicate of an earlier good tile of that place.

    order: the column of arrival; of equal ones the result is one of them. Only good tiles take a place.
    """
    from navloom.sources.binary import MESH_MAGIC, MESH_VERSION

    bad = F.when(~F.col("magic").eqNullSafe(F.lit(MESH_MAGIC)), "wrong_magic").when(~F.col("version").eqNullSafe(F.lit(MESH_VERSION)), "wrong_version")
    t = tiles.withColumn("__bad", bad)
    n = F.row_number().over(Window.partitionBy(*_tile(tiles), F.col("__bad").isNull()).orderBy(order))
    return t.withColumn("status", F.coalesce("__bad", F.when(n > 1, "duplicate"), F.lit("ok"))).drop("__bad")


def links_of_new_tiles(polys: DataFrame, new: DataFrame, climb: float | Column | None = None) -> DataFrame:
    """The links that tiles (x, y) of `new` bring when they join the others: those with an end in a new tile.

    Only the new tiles and their neighbours are read; the union over arrivals is all_links of the whole.
    """
    new = new.select("x", "y").distinct()
    shift = F.inline(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1))))
    around = new.select("x", "y", shift).select((F.col("x") + F.col("a")).alias("x"), (F.col("y") + F.col("b")).alias("y")).distinct()
    near = polys.join(around, ["x", "y"], "left_semi")
    fresh = polys.join(new, ["x", "y"], "left_semi").select("ref").distinct()
    links = all_links(near, climb)
    ends = links.join(fresh.select(F.col("ref").alias("src"), F.lit(True).alias("__a")), "src", "left").join(fresh.select(F.col("ref").alias("dst"), F.lit(True).alias("__b")), "dst", "left")
    return ends.where(F.col("__a").isNotNull() | F.col("__b").isNotNull()).select(links.columns)


def first_link(links: DataFrame) -> DataFrame:
    """(src, dst, edge, side, bmin, bmax): the first link from src to dst, by edge."""
    best = links.groupBy("src", "dst").agg(F.min(F.struct("edge", "side", "bmin", "bmax")).alias("b"))
    return best.select("src", "dst", "b.*")


def without_polygons(links: DataFrame, gone: DataFrame) -> DataFrame:
    """`links` without those from or to polygons (ref) of removed tiles."""
    return links.join(gone.select(F.col("ref").alias("src")), "src", "left_anti").join(gone.select(F.col("ref").alias("dst")), "dst", "left_anti")


def portal_points(links: DataFrame, polys: DataFrame) -> DataFrame:
    """`links` and left_x ... right_z: the two ends of the passage between src and dst, cut to its bytes."""
    p = polys.select(F.col("ref").alias("src"), "corners")
    corner = lambda i: F.get("corners", (i % F.size("corners")).cast("int"))
    t = links.join(shuffled(p), "src").select(*links.columns, corner(F.col("edge")).alias("__a"), corner(F.col("edge") + 1).alias("__b"))
    whole = (F.col("side") == INTERNAL) | ((F.col("bmin") == 0) & (F.col("bmax") == 255))
    at = lambda k, byte, end: F.when(whole, F.col(f"{end}.{k}")).otherwise(F.col(f"__a.{k}") + (F.col(f"__b.{k}") - F.col(f"__a.{k}")) * (F.col(byte) / 255.0))
    return t.select(*links.columns, *(at(k, "bmin", "__a").alias(f"left_{k}") for k in "xyz"), *(at(k, "bmax", "__b").alias(f"right_{k}") for k in "xyz"))


def offmesh_links(connections: DataFrame, polys: DataFrame, cell: float = 2.0) -> DataFrame:
    """(con, src, dst, end, side, x, y, z): the links of off-mesh connections; the connection itself is the polygon -con.

    connections: (con, x, y, layer, ax, ay, az, bx, by, bz, rad, climb, side, bidir), as the mesh files have them; side is
    that of the neighbour tile in which the connection ends, 255 for its own tile (and the other layers there). An end
    links to the nearest polygon of its tile within the box (rad, climb, rad), if that is within rad as seen from above.
    Ground and connection link both ways at the start; at the end the connection links to the ground, and the ground back
    if the connection is bidirectional. Without a start there is no end. (x, y, z) is the end's place on the ground.
    """
    m = [c for c in ("map_id",) if c in polys.columns]
    half = (F.col("rad"), F.col("climb"), F.col("rad"))
    p = polys.where("ptype = 0").select(*m, "ref", "x", "y", "layer", "corners")
    keep = ("con", "rad", "side", "bidir")
    at = lambda n, *tile: [*m, *tile, *keep, "climb", *(F.col(f"{n}{k}").cast("double").alias(f"p{k}") for k in "xyz")]

    def snapped(points: DataFrame, by: tuple[str, ...]) -> DataFrame:
        near = nearest_polygon(points, p, half, F.col("climb"), cell=cell, by=(*m, *by, *keep, "px", "pz"))
        return near.where(g.sqr(F.col("x") - F.col("px")) + g.sqr(F.col("z") - F.col("pz")) <= g.sqr(F.col("rad")))

    starts = snapped(connections.select(*at("a", "x", "y", "layer")), ())
    step = lambda k: F.when(F.col("side") == INTERNAL, 0).otherwise(F.element_at(F.array(*(F.lit(s[k]) for s in g.SIDES)), (F.col("side") % 8 + 1).cast("int")))
    target = connections.select(*at("b"), (F.col("x") + step(1)).cast("long").alias("tx"), (F.col("y") + step(2)).cast("long").alias("ty"))
    layers = polys.select(*m, F.col("x").alias("tx"), F.col("y").alias("ty"), "layer").distinct()
    target = target.join(layers, [*m, "tx", "ty"]).withColumnsRenamed({"tx": "x", "ty": "y"})
    # The polygons' tile columns are joined under the names they have there; the result's x is the place.
    ends = snapped(target.withColumn("__layer", F.col("layer")), ("__layer",)).join(starts.select(*m, "con").distinct(), [*m, "con"], "left_semi")
    link = lambda s, d, end, back: F.struct(s.alias("src"), d.alias("dst"), F.lit(end).cast("long").alias("end"), F.lit(back).alias("back"))
    own, ref = (-F.col("con")).cast("long"), F.col("ref")
    rows = []
    for t, end in ((starts, 0), (ends, 1)):
        t = t.select(*m, "con", "bidir", F.lit(INTERNAL).cast("long").alias("side") if end == 0 else F.col("side").cast("long").alias("side"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("z").alias("pz"), F.inline(F.array(link(own, ref, end, False), link(ref, own, end, end == 1))))
        rows.append(t.where(~F.col("back") | F.col("bidir")).select(*m, "con", "src", "dst", "end", "side", F.col("px").alias("x"), F.col("py").alias("y"), F.col("pz").alias("z")))
    return rows[0].unionByName(rows[1])


def wall_segments(polys: DataFrame, links: DataFrame) -> DataFrame:
    """(ref, edge, ax, az, bx, bz): the edges that no link leads across."""
    edges = with_edges(polys.where("ptype = 0"), "ref").select("ref", F.col("e").alias("edge"), F.col("a.x").alias("ax"), F.col("a.z").alias("az"), F.col("b.x").alias("bx"), F.col("b.z").alias("bz"))
    return edges.join(links.select(F.col("src").alias("ref"), "edge").distinct(), ["ref", "edge"], "left_anti")


def with_overrides(polys: DataFrame, overrides: DataFrame) -> DataFrame:
    """`polys` with flags and area replaced where a table (ref, flags, area) has them."""
    o = overrides.select("ref", F.col("flags").alias("__f"), F.col("area").alias("__a"))
    t = polys.join(o, "ref", "left")
    return t.withColumns({"flags": F.coalesce("__f", "flags"), "area": F.coalesce("__a", "area")}).drop("__f", "__a")
