"""What keeps queries within the driver's memory on large tables."""

import gc
import weakref

import pyarrow as pa
import pyarrow.compute as pc
import pytest

from navloom.operators import mesh as m
from navloom.operators import kernel, packed
from navloom.operators.routes import rays, routes
from navloom.plans import registry
from navloom.sources.world import mesh
from tests.conftest import SF

QUERIES = registry.queries()


@pytest.mark.parametrize("name", ["portal_points", "edge_midpoint"])
def test_links_are_not_broadcast(name, spark):
    """Spark takes the polygons of a small file for small; at 1.2 million parts they do not fit the driver."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def checkpointed(name, spark, monkeypatch):
    """The plans of what a query checkpoints on its way, and its own."""
    frame = type(spark.range(0))
    plans, kept = [], frame.checkpoint
    text = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(frame, "checkpoint", lambda self, *a, **b: plans.append(text(self)) or kept(self, *a, **b))
    plans.append(text(QUERIES[name](spark, SF)))
    return plans


@pytest.mark.parametrize("name", ["ray", "route_distance", "route_path", "stream_routes"])
def test_no_mesh_is_broadcast_on_the_way(name, spark, monkeypatch):
    plans = [p for p in checkpointed(name, spark, monkeypatch) if "corners" in p]
    assert plans and not any("Broadcast" in p for p in plans)


def test_an_end_on_a_border_has_its_polygon(spark):
    """It is on a polygon of the tile before, which no other point of the pair touches."""
    p = mesh(spark, SF)
    at = p.where("x = 0 and y = 0 and layer = 0 and exists(corners, c -> c.x = 8)").orderBy("ref").first()
    z, y = min((c["z"], c["y"]) for c in at["corners"] if c["x"] == 8)
    goal = p.where("x = 1 and y = 0 and layer = 0").orderBy("ref").first()
    far = goal["corners"][0]
    pairs = spark.createDataFrame([(1, at["ref"], 8.0, y, z + 0.3, goal["ref"], far["x"] + 0.3, far["y"], far["z"] + 0.3)], "pair_id long, sp long, sx double, sy double, sz double, gp long, gx double, gy double, gz double")
    (walk,) = rays(pairs, p, m.all_links(p), tile=(0.0, 0.0, 8.0)).collect()
    (way,) = routes(pairs, p, m.all_links(p), tile=(0.0, 0.0, 8.0)).collect()
    assert walk["t"] is not None and walk["n_polygons"] > 0 and way["n_polygons"] > 0


@pytest.mark.parametrize("most", [3, 50_000])
def test_packed_meshes_are_whole(most, spark, monkeypatch):
    """A mesh out of many packed tables, with few rows kept as lists, has every corner and link of the tables."""
    monkeypatch.setattr(packed, "KEPT", most)
    monkeypatch.setattr(packed, "_AT_ONCE", 2)
    p = mesh(spark, SF)
    polys, links = p.select(packed.POLYS.names).toArrow(), m.all_links(p).join(p.selectExpr("ref src", "x", "y"), "src").toArrow()
    parts = {k: [packed.pack(t.filter((pc.field("x") == x) & (pc.field("y") == y)), k) for x, y in sorted({(r["x"], r["y"]) for r in polys.select(["x", "y"]).to_pylist()})] for k, t in ((packed.POLYS, polys), (packed.LINKS, links))}
    (a, b) = (packed.unpack(pa.chunked_array([pa.array([*v, None, v[0]], pa.binary())]), k) for k, v in parts.items())
    own = packed.mesh_of(a, b)
    rows = {r["ref"]: r for r in polys.to_pylist()}
    ids = sorted(rows)
    assert list(own.ids) == ids and len(own.corners) == len(own.links) == len(ids) and [own.index[i] for i in ids] == list(range(len(ids))) and own.index.get(max(ids) + 1) is None
    assert [own.corners[i] for i in range(len(ids))] == [[(c["x"], c["y"], c["z"]) for c in rows[i]["corners"]] for i in ids]
    assert [*zip(own.flags, own.area, own.kind, own.tile, strict=True)] == [(r["flags"], r["area"], r["ptype"], (r["x"], r["y"])) for r in (rows[i] for i in ids)]
    expected = sorted({(r["src"], r["edge"], r["dst"], r["side"], r["bmin"], r["bmax"]) for r in links.to_pylist()})
    assert [(ids[i], e, ids[to], *rest) for i in range(len(ids)) for to, e, *rest in own.links[i]] == expected
    assert dict.__len__(own.links) <= most


@pytest.mark.parametrize("name", ["route_distance", "stream_routes"])
def test_no_waypoints_leave_the_search_where_only_lengths_are_asked_for(name, spark, monkeypatch):
    from navloom.plans import routes as plan

    seen = []
    own = plan.routes
    monkeypatch.setattr(plan, "routes", lambda *a, **b: seen.append(own(*a, **b)) or seen[-1])
    QUERIES[name](spark, SF)
    assert seen and not any("waypoints" in t._jdf.queryExecution().executedPlan().toString().replace("n_waypoints", "") for t in seen)


def test_the_ways_of_arrays_are_those_of_lists(spark, monkeypatch):
    """Also for partial portals, and for several links to one polygon, of which the first has the passage."""
    p = mesh(spark, SF)
    polys, links = p.select(packed.POLYS.names).toArrow(), m.all_links(p).toArrow()
    twice = links.slice(0, 50)
    twice = twice.set_column(twice.schema.get_field_index("edge"), "edge", pc.subtract(2, pc.min_element_wise(twice["edge"], 2)))
    own = packed.mesh_of([polys], [pa.concat_tables([links, twice.cast(links.schema)])])
    assert own.ways is not None and [own.ways(i) for i in range(len(own.ids))] == [kernel.ways(own, i) for i in range(len(own.ids))]
    assert any(w[5] for i in range(len(own.ids)) for w in own.ways(i))
    monkeypatch.setattr(packed, "WITH_WAYS", 10)
    assert packed.mesh_of([polys], [links]).ways is None


def test_steps_of_large_meshes_are_those_of_lists(spark, monkeypatch):
    """Made for some polygons together they are the same, linked polygons have one group, and so every route is the same."""
    p = mesh(spark, SF)
    polys, links = p.select(packed.POLYS.names).toArrow(), m.all_links(p).toArrow()
    small = packed.mesh_of([polys], [links])
    monkeypatch.setattr(packed, "WITH_WAYS", 10)
    monkeypatch.setattr(packed, "SOME", 7)
    monkeypatch.setattr(kernel, "KEPT", 40)
    # The links in tables out of order, as tiles come.
    parts = [links.filter(pc.equal(pc.bit_wise_and(links["src"], 3), k)) for k in (2, 0, 3, 1)]
    large = packed.mesh_of([polys], parts)
    assert small.rows is None and large.rows is not None and large.ways is None
    n = len(large.ids)
    for rules in (kernel.Filter(), kernel.Filter(include=0b1010, exclude=0b100)):
        for i in range(n):
            found = large.rows(i, rules)
            assert i in found and len(found) <= 7
            assert found[i] == (small.area[i], [w for w in kernel.ways(small, i) if rules.passes(small.flags[w[0]])])
    assert all(large.group[i] == large.group[to] for i in range(n) for to, *_ in large.links[i])
    middle = lambda i: tuple(sum(v) / len(v) for v in zip(*small.corners[i], strict=True))
    for a, b in [(i * 37 % n, i * 101 % n) for i in range(60)]:
        assert kernel.route(large, a, b, middle(a), middle(b), kernel.Filter()) == kernel.route(small, a, b, middle(a), middle(b), kernel.Filter())


@pytest.mark.parametrize("most", [10, 400_000])
def test_a_mesh_goes_when_its_search_is_over(most, spark, monkeypatch):
    """A task has one mesh after the other; whole maps that wait for Python's collector add up."""
    monkeypatch.setattr(packed, "WITH_WAYS", most)
    p = mesh(spark, SF)
    own = packed.mesh_of([p.select(packed.POLYS.names).toArrow()], [m.all_links(p).toArrow()])
    at = own.corners[0][0]
    kernel.route(own, 0, len(own.ids) - 1, at, own.corners[len(own.ids) - 1][0], kernel.Filter())
    seen = weakref.ref(own)
    gc.collect()
    gc.disable()
    try:
        del own
        assert seen() is None
    finally:
        gc.enable()


def test_a_way_may_leave_the_tiles_of_its_ends(spark):
    """From tile (0, 0) to (1, 0) through (0, 1) and (1, 1): the tiles around the rectangle count."""
    at = {1: (0, 0), 2: (0, 1), 3: (1, 1), 4: (1, 0)}
    corner = lambda x, z: {"x": 8.0 * x, "y": 0.0, "z": 8.0 * z}
    rows = [(ref, [corner(x, z), corner(x, z + 1), corner(x + 1, z + 1), corner(x + 1, z)], 1, 0, 0, x, z) for ref, (x, z) in at.items()]
    polys = spark.createDataFrame(rows, "ref long, corners array<struct<x:double,y:double,z:double>>, flags long, area long, ptype long, x long, y long")
    # Edges: 1 towards z + 1, 2 towards x + 1, 3 towards z - 1.
    steps = [(1, 2, 1, 2), (2, 1, 3, 6), (2, 3, 2, 0), (3, 2, 0, 4), (3, 4, 3, 6), (4, 3, 1, 2)]
    links = spark.createDataFrame([(*step, 0, 255) for step in steps], "src long, dst long, edge int, side int, bmin int, bmax int")
    pairs = spark.createDataFrame([(1, 1, 4.0, 0.0, 4.0, 4, 12.0, 0.0, 4.0)], "pair_id long, sp long, sx double, sy double, sz double, gp long, gx double, gy double, gz double")
    (way,) = routes(pairs, polys, links, tile=(0.0, 0.0, 8.0)).collect()
    assert not way["is_partial"] and way["n_polygons"] == 4
    assert routes(pairs, polys, links, tile=(0.0, 0.0, 8.0), padding=0).first()["is_partial"]
