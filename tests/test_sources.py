"""Binary readers, blob stores, workloads, streams and stores on small fixtures."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from navloom import progress
from navloom.operators import kernel, search, store
from navloom.operators import mesh as m
from navloom.operators.routes import build_mesh, rays, routes
from navloom.operators.terrain import heights
from navloom.plans.routes import od_pairs
from navloom.sources import binary as b
from navloom.sources import blobs, workload
from navloom.sources.world import mesh
from navloom.streaming.requests import grow_mesh
from tests.conftest import SF


def padded(x: bytes) -> bytes:
    return x + b"\0" * (-len(x) % 4)


def tile(x, y, quads, climb=0.5, offmesh=(), details=()):
    """A mesh tile of quads ((corner x 4), neis, flags)."""
    verts = [c for q, _, _ in quads for c in q]
    h = np.zeros(1, b.HEADER)
    h["magic"], h["version"], h["x"], h["y"], h["climb"] = b.MESH_MAGIC, b.MESH_VERSION, x, y, climb
    h["poly_count"], h["vert_count"], h["max_links"], h["offmesh_count"] = len(quads), len(verts), 4, len(offmesh)
    p = np.zeros(len(quads), b.POLY)
    for i, (_, neis, flags) in enumerate(quads):
        p[i]["verts"][:4], p[i]["neis"][:4], p[i]["n"], p[i]["flags"], p[i]["area_type"] = range(4 * i, 4 * i + 4), neis, 4, flags, 5
    c = np.zeros(len(offmesh), b.OFFMESH)
    for i, (pos, bidir) in enumerate(offmesh):
        c[i]["pos"], c[i]["rad"], c[i]["flags"], c[i]["poly"] = pos, 1.0, bidir, len(quads)
    d, dv, dt = np.zeros(len(details), b.DETAIL), [], []
    for i, (own_verts, tris) in enumerate(details):
        d[i]["vert_base"], d[i]["tri_base"], d[i]["verts"], d[i]["tris"] = len(dv), len(dt), len(own_verts), len(tris)
        dv, dt = dv + own_verts, dt + tris
    h["detail_count"], h["detail_verts"], h["detail_tris"] = len(details), len(dv), len(dt)
    body = b"".join(map(padded, (h.tobytes(), np.array(verts, "<f4").tobytes(), p.tobytes(), b"\0" * 64, d.tobytes(), np.array(dv, "<f4").tobytes(), np.array(dt, "u1").tobytes(), c.tobytes())))
    outer = np.zeros(1, b.OUTER)
    outer["magic"], outer["version"], outer["size"] = b.OUTER_MAGIC, b.OUTER_VERSION, len(body)
    return outer.tobytes() + body


def quad(x, z, w=1.0, y=0.0):
    return [(x, y, z), (x, y, z + 1), (x + w, y, z + 1), (x + w, y, z)]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    f = tmp_path_factory.mktemp("mmaps")
    params = np.zeros(1, b.PARAMS)
    params["orig"], params["tile_w"], params["tile_h"], params["max_tiles"], params["max_polys"] = (1, 2, 3), 533.25, 533.25, 64, 1024
    (f / "000.mmap").write_bytes(params.tobytes())
    (f / "001.mmap").write_bytes(b"short")
    # Two quads in tile (0, 0), the second with a border to the east; tile (1, 0) has a border to the west, half of it beside.
    (f / "0000000.mmtile").write_bytes(tile(0, 0, [(quad(0, 0), [0, 0, 2, 0], 1), (quad(1, 0), [1, 0, 0x8000, 0], 3)], offmesh=[((0, 0, 0, 1, 1, 1), 1)], details=[([], [(0, 1, 2, 1), (0, 2, 3, 4)])]))
    (f / "0000100.mmtile").write_bytes(tile(1, 0, [([(2, 0.3, 0.5), (2, 0.3, 1.5), (3, 0, 1.5), (3, 0, 0.5)], [0x8004, 0, 0, 0], 1)]))
    (f / "0000200.mmtile").write_bytes(tile(2, 0, [(quad(4, 0), [0, 0, 0, 0], 0)])[:-4])
    (f / "0000300.mmtile").write_bytes(b"\1" * 40)
    return str(f)


def test_mesh_files(spark, folder):
    (p,) = b.mesh_params(spark, folder).collect()
    assert (p["map_id"], p["orig"], p["tile_w"], p["max_polys"]) == (0, [1.0, 2.0, 3.0], 533.25, 1024)
    rows = {(r["x"], r["pid"]): r for r in b.polygons(spark, folder).collect()}
    assert sorted(rows) == [(0, 0), (0, 1), (1, 0)]  # a short file and one with another magic have no rows
    assert rows[0, 1]["corners"][2]["x"] == 2.0 and rows[0, 1]["flags"] == 3 and rows[0, 1]["area"] == 5 and rows[0, 1]["ptype"] == 0
    (c,) = b.connections(spark, folder).collect()
    assert c["bidir"] and (c["bx"], c["by"], c["bz"]) == (1.0, 1.0, 1.0)
    assert [(r["tri"], r["edge_flags"], r["c"]["x"]) for r in b.details(spark, folder).orderBy("tri").collect()] == [(0, 1, 1.0), (1, 4, 1.0)]
    assert b.listing(spark, folder).count() == 6


def test_links_of_files(spark, folder):
    links = {(tuple(r["src"]), tuple(r["dst"])): (r["edge"], r["side"], r["bmin"], r["bmax"]) for r in b.tile_links(b.polygons(spark, folder)).collect()}
    assert links[(0, 0, 0, 0), (0, 0, 0, 1)] == (2, 255, 0, 255) and ((0, 0, 0, 1), (0, 0, 0, 0)) in links
    # Half of each border edge: seen along its own direction.
    assert links[(0, 0, 0, 1), (1, 0, 0, 0)] == (2, 0, 0, 128) and links[(1, 0, 0, 0), (0, 0, 0, 1)] == (0, 4, 0, 128)
    assert len(links) == 4


@pytest.mark.parametrize("mode", ["flat", "f32", "u16", "u8"])
def test_terrain_plane(spark, tmp_path, mode):
    i9, i8 = np.indices((129, 129)), np.indices((128, 128))
    plane = lambda r, c: 0.5 * r + 0.25 * c
    v9, v8 = plane(*i9), plane(i8[0] + 0.5, i8[1] + 0.5)
    top = 128.0
    kind, flags, steps = {"flat": ("<f4", 1, 1), "f32": ("<f4", 0, 1), "u16": ("<u2", 2, 65535), "u8": ("u1", 4, 255)}[mode]
    raw = [] if mode == "flat" else [(x if mode == "f32" else np.rint(x / top * steps)).astype(kind).tobytes() for x in (v9, v8)]
    holes = np.zeros(256, "<u2")
    holes[0] = 0x0001
    head = np.array([b.TERRAIN_MAGIC, b.TERRAIN_VERSION, 0, 0, 40, 0, 0, 0, 40 + 16 + sum(map(len, raw)) + len(raw and b"") , 512], "<u4")
    body = np.array([b.HEIGHT_MAGIC, flags], "<u4").tobytes() + np.array([7.0 if mode == "flat" else 0.0, top], "<f4").tobytes() + b"".join(raw)
    (tmp_path / "0003232.map").write_bytes(head.tobytes() + body + holes.tobytes())
    (tmp_path / "0003233.map").write_bytes(head.tobytes()[:20])
    t = b.terrain(spark, str(tmp_path))
    assert [(r["tx"], r["ty"], r["mode"]) for r in t.select("tx", "ty", "mode").collect()] == [(32, 32, mode)]
    # In each of the four triangles of cell (20, 30) the plane comes out; cell (0, 0) is a hole.
    cell = 533.33333 / 128
    at = [(i, -(20 + u) * cell, -(30 + v) * cell) for i, (u, v) in enumerate([(0.5, 0.2), (0.2, 0.5), (0.9, 0.5), (0.5, 0.9)])] + [(9, -0.5 * cell, -0.5 * cell), (10, 9000.0, 9000.0)]
    points = spark.createDataFrame(at, "event_id long, wx double, wy double")
    got = {r["event_id"]: r["height"] for r in heights(points, t).collect()}
    for i, wx, wy in at[:4]:
        expected = 7.0 if mode == "flat" else plane(-wx / cell, -wy / cell)
        assert got[i] == pytest.approx(expected, abs={"u8": 0.6}.get(mode, 0.01))
    assert got[10] is None and (got[9] == 7.0 if mode == "flat" else got[9] is None)


def test_blob_store_round_trip(spark):
    tiles = [(0, 0, 0, b"TILE00" * 10, "nav"), (0, 1, 2, b"TILE12" * 7 + b"\0\1\2\xff", "nav"), (0, 0, 0, b"MAP00" * 9, "terrain")]
    rows = [(m_, 0, 0, kind, tx * 64 + ty + 1, blob) for m_, tx, ty, blob, kind in tiles]
    t = spark.createDataFrame(rows, "map_id long, sx long, sy long, kind string, tile_key long, blob binary")
    back = blobs.import_shards(blobs.export_shards(t))
    assert {r["status"] for r in store.differences(t, back, ["map_id", "kind", "tile_key"]).collect()} == {"equal"}
    numbers = spark.createDataFrame([(n, blobs.put_number(n)) for n in (0, 1, 127, 128, 300, 1 << 40)], "n long, data binary")
    assert numbers.where(blobs.get_number_sql("data") != F.col("n")).count() == 0


def test_workload(spark, tmp_path):
    (tmp_path / "w.json").write_text(json.dumps({"ordering_id": 4, "score": 1.0, "ids": [1], "pairs": [{"x1": -9099.796, "y1": 413.932, "x2": -9214.001, "y2": 434.28}]}))
    (r,) = workload.read_orderings(spark, str(tmp_path)).collect()
    assert tuple(r) == (4, 0, -9100, 413, -9215, 434)
    tiles = spark.range(50).select((F.col("id") % 8).alias("tx"), F.floor(F.col("id") / 8).alias("ty"))
    a, c = (sorted(map(tuple, workload.generate(tiles, 5, s).collect())) for s in (1, 1))
    assert a == c and len(a) == 5


def test_growing_mesh_equals_whole(spark, tmp_path):
    p = mesh(spark, SF).cache()
    tiles = sorted(tuple(r) for r in p.select("x", "y").distinct().collect())
    for some in (tiles[:2], tiles[2:]):
        spark.createDataFrame(some, "x long, y long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen: list = []

    def links_of(new):
        seen.extend(tuple(r) for r in new.collect())
        return m.links_of_new_tiles(p.join(spark.createDataFrame(seen, "x long, y long"), ["x", "y"], "left_semi"), new)

    stream = spark.readStream.schema("x long, y long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    grow_mesh(stream, links_of, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("src", "dst", "edge", "side").collect()}
    assert len(tiles) > 2 and got == {tuple(r) for r in m.all_links(p).select("src", "dst", "edge", "side").collect()}


def test_routes_by_blocks_equal_one_search_each(spark):
    """Blocks, lots and maps change where a pair is searched, not the result; the rectangle keeps a route to its tiles."""
    pairs, p = od_pairs(spark, SF).limit(80).cache(), mesh(spark, SF).cache()
    links = m.all_links(p).cache()
    own = build_mesh(p.select("ref", "corners", "flags", "area", "ptype", "x", "y").toArrow(), links.toArrow())
    for tile, padding in ((None, 0), ((0.0, 0.0, 8.0), 0), ((0.0, 0.0, 8.0), 1)):
        expected = {}
        for r in pairs.collect():
            if r["sp"] is None or r["gp"] is None:
                expected[r["pair_id"]] = -1.0
                continue
            x, z = sorted((r["sx"] // 8, r["gx"] // 8)), sorted((r["sz"] // 8, r["gz"] // 8))
            within = None if tile is None else (x[0] - padding, z[0] - padding, x[1] + padding, z[1] + padding)
            a, b = own.index[r["sp"]], own.index[r["gp"]]
            expected[r["pair_id"]] = kernel.route(own, a, b, (r["sx"], r["sy"], r["sz"]), (r["gx"], r["gy"], r["gz"]), kernel.Filter(), within=within)[0]
        got = {r["pair_id"]: r["distance"] for r in routes(pairs, p, links, tile=tile, padding=padding, most_pairs=7).collect()}
        assert got == pytest.approx(expected) and len(got) == 80 and any(v > 0 for v in got.values())
    one = F.lit(7).cast("long").alias("map_id")
    two = routes(pairs.select("*", one), p.select("*", one), links.select("*", one), tile=tile, padding=padding)
    assert {r["pair_id"]: r["distance"] for r in two.collect()} == pytest.approx(expected)


def test_routes_and_rays_of_odd_rows(spark):
    p = mesh(spark, SF)
    links = m.all_links(p)
    some = od_pairs(spark, SF).where("sp is not null and gp is not null").limit(3).cache()
    rows = [tuple(r) for r in some.collect()]
    odd = [rows[0], rows[0], (None, *rows[1][1:]), (7, None, *rows[1][2:]), (8, 10**12, *rows[1][2:]), (9, *rows[1][1:5], None, *rows[1][6:])]
    pairs = spark.createDataFrame(odd, some.schema)
    got = sorted(((r["pair_id"] or 0, r["distance"], r["n_waypoints"]) for r in routes(pairs, p, links, tile=(0.0, 0.0, 8.0)).collect()), key=str)
    assert len(got) == 6 and sum(d == -1.0 for i, d, _ in got if i in (7, 8, 9)) == 3
    walks = rays(pairs, p, links, tile=(0.0, 0.0, 8.0)).collect()
    assert len(walks) == 6 and {r["t"] for r in walks if r["pair_id"] in (7, 8)} == {None}
    nothing = routes(pairs, p.where("false"), links)
    assert {r["distance"] for r in nothing.collect()} == {-1.0} and routes(pairs.where("false"), p, links).count() == 0


def test_progress_is_told(spark):
    told = []
    hook = lambda what, **numbers: told.append((what, numbers))
    progress.hooks.append(hook)
    try:
        links = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (2, 3, 1.0), (None, 3, 1.0)], "src long, dst long, cost double")
        sources = spark.createDataFrame([(1, 1), (1, 1)], "source long, node long")
        best = search.relax(links, sources, 9)
    finally:
        progress.hooks.remove(hook)
    assert [w for w, _ in told] == ["relax"] * 3 and told[0][1] == {"step": 1, "of": 9}
    assert sorted(map(tuple, best.collect())) == [(1, 1, 0.0, None), (1, 2, 1.0, 1), (1, 3, 2.0, 2)]
    assert {r["node"]: r["path"] for r in search.chains(best, 2).collect()} == {1: [1], 2: [1, 2], 3: [1, 2]}
    assert search.relax(links, sources.where("false"), 3).count() == 0


def test_mesh_operators_on_odd_rows(spark):
    p = mesh(spark, SF)
    at = spark.createDataFrame([(1, 2.5, 1.0, 2.5), (1, 2.5, 1.0, 2.5), (2, None, 1.0, 1.0), (3, 1e6, 0.0, 1e6)], "event_id long, px double, py double, pz double")
    bad = p.withColumn("corners", F.when(F.col("ref") % 2 == 0, F.col("corners")))
    for polys in (p, bad):
        near = m.nearest_polygon(at, polys, (1.0, 4.0, 1.0), 0.5).collect()
        assert [r["event_id"] for r in near] == [1]
        listed = m.box_query(at, polys, (1.0, 4.0, 1.0)).groupBy("event_id").count().collect()
        assert [(r["event_id"], r["count"] % 2) for r in listed] == [(1, 0)]
    none = p.where("false")
    assert m.all_links(none).count() == 0 and m.nearest_polygon(at, none, (1.0, 1.0, 1.0), 0.5).count() == 0 and m.wall_segments(none, m.all_links(none)).count() == 0
    assert m.all_links(p.union(p)).distinct().count() == m.all_links(p).count()
    gone = p.withColumn("neis", F.transform("neis", lambda n: F.when(n == 1, F.lit(9999)).otherwise(n)))
    assert m.internal_links(gone).where("dst is null").count() == 0


def test_whole_tables_are_numbered(spark):
    rows = spark.createDataFrame([(x,) for x in ["b", "a", None, "b", *map(str, range(500))]], "v string").repartition(5)
    got = [(r["place"], r["v"]) for r in store.numbered(rows, "v").orderBy("place").collect()]
    expected = sorted(["b", "a", "b", *map(str, range(500))])
    assert [p for p, _ in got] == list(range(1, 505)) and [v for _, v in got] == [None, *expected] and store.numbered(rows.where("false"), "v").count() == 0


def test_tiles_of_bytes(spark):
    p = mesh(spark, SF).where("x = 0")
    files = b.encode_tiles(p).cache()
    assert files.select("x", "y", "layer").distinct().count() == files.count()
    back = b.decode_polygons(files.union(spark.createDataFrame([(0, 9, 9, 0, None), (0, 8, 8, 0, bytearray(b"x"))], files.schema))).where("size(corners) > 0")
    assert back.count() == p.count()
    assert m.all_links(back.withColumn("ref", F.struct("x", "y", "layer", "pid")).withColumn("idx", F.col("pid"))).count() == m.all_links(p).count()
