"""The search in Spark's own processes against the kernel, and what keeps large streams of requests quick."""

import math

import pyarrow as pa
import pyarrow.compute as pc
import pytest

from navloom.operators import kernel, packed
from navloom.operators import mesh as m
from navloom.operators.filters import RouteFilter
from navloom.operators.routes import routes
from navloom.plans import registry
from navloom.sources.world import mesh
from tests.conftest import SF

PAIR = "pair_id long, sp long, sx double, sy double, sz double, gp long, gx double, gy double, gz double"


@pytest.fixture(scope="module")
def world(spark):
    """(polygons, links, the kernel's mesh); some links have a second one to the same polygon over another edge."""
    p = mesh(spark, SF)
    polys, links = p.select(packed.POLYS.names).toArrow(), m.all_links(p).select(packed.LINKS.names).toArrow()
    twice = links.slice(0, 50)
    twice = twice.set_column(2, "edge", pc.subtract(2, pc.min_element_wise(twice["edge"], 2)))
    links = pa.concat_tables([links, twice.cast(links.schema)])
    return spark.createDataFrame(polys), spark.createDataFrame(links), packed.mesh_of([polys], [links])


@pytest.mark.parametrize(
    ("rules", "options"),
    [
        (RouteFilter(area_cost={1: 1.5, 2: 2.0}), {}),
        (RouteFilter(include=0b1011, exclude=0b100), {"padding": 0}),
        (RouteFilter(area_cost={3: 0.25}), {"most_nodes": 25}),
        (RouteFilter(), {"most": 5, "most_expansions": 30}),
    ],
)
def test_routes_are_those_of_the_kernel(rules, options, spark, world):
    polys, links, own = world
    n, (padding, limits) = len(own.ids), (options.get("padding", 1), {k: v for k, v in options.items() if k != "padding"})
    middle = lambda i: tuple(sum(v) / len(v) for v in zip(*own.corners[i], strict=True))
    ends = [(i, i * 37 % n, i * 101 % n) for i in range(250)]
    pairs = spark.createDataFrame([(i, own.ids[a], *middle(a), own.ids[b], *middle(b)) for i, a, b in ends], PAIR)
    got = {r["pair_id"]: r for r in routes(pairs, polys, links, rules, (0.0, 0.0, 8.0), most_pairs=40, **options).collect()}
    assert len(got) == len(ends)
    for i, a, b in ends:
        p, q = middle(a), middle(b)
        (x0, x1), (y0, y1) = (sorted(math.floor(v[k] / 8) for v in (p, q)) for k in (0, 2))
        d, points, count, short = kernel.route(own, a, b, p, q, kernel.Filter(rules.include, rules.exclude, tuple(rules.costs())), within=(x0 - padding, y0 - padding, x1 + padding, y1 + padding), **limits)
        r = got[i]
        assert (r["n_waypoints"], r["n_polygons"], r["is_partial"]) == (len(points), count, short) and math.isclose(r["distance"], d, rel_tol=1e-12)
        assert [(w["flags"], w["ref"]) for w in r["waypoints"]] == [(f, ref) for _, f, ref in points]
        assert all(math.dist((w["x"], w["y"], w["z"]), at) < 1e-9 for w, (at, *_) in zip(r["waypoints"], points, strict=True))


def test_connections_and_ends_that_are_no_numbers(spark):
    square = lambda x: [(x, 0.0, 0.0), (x, 0.0, 1.0), (x + 1, 0.0, 1.0), (x + 1, 0.0, 0.0)]
    rows = [(1, square(0.0), 1, 0, 0, 0, 0), (2, square(2.0), 1, 0, 0, 0, 0), (3, [(0.9, 0.0, 0.5), (2.1, 0.0, 0.5)], 1, 0, 1, 0, 0)]
    polys = spark.createDataFrame(rows, "ref long, corners array<struct<x:double,y:double,z:double>>, flags long, area long, ptype long, x long, y long")
    links = spark.createDataFrame([(1, 3, 0, 255, 0, 255), (2, 3, 0, 255, 0, 255), (3, 2, 1, 255, 0, 255), (3, 1, 0, 255, 0, 255)], "src long, dst long, edge int, side int, bmin int, bmax int")
    pairs = spark.createDataFrame([(1, 1, 0.2, 0.0, 0.5, 2, 2.8, 0.0, 0.5), (2, 1, math.nan, 0.0, 0.5, 2, 2.8, 0.0, 0.5), (3, 1, 0.2, 0.0, 0.5, 9, 2.8, 0.0, 0.5)], PAIR)
    got = {r["pair_id"]: r for r in routes(pairs, polys, links).collect()}
    assert math.isclose(got[1]["distance"], 2.6) and not got[1]["is_partial"] and any(w["flags"] & kernel.CONNECTION for w in got[1]["waypoints"])
    assert [(got[i]["distance"], got[i]["n_polygons"]) for i in (2, 3)] == [(-1.0, 0)] * 2


def test_a_stream_packs_its_mesh_once_and_searches_without_python(spark, monkeypatch):
    from navloom.operators import routes as operator
    from navloom.plans import routes as plan

    packs, plans = [], []
    own, tiles = plan.routes, operator._tiles
    monkeypatch.setattr(operator, "_tiles", lambda *a: packs.append(1) or tiles(*a))
    monkeypatch.setattr(plan, "routes", lambda *a, **b: plans.append(own(*a, **b)) or plans[-1])
    assert registry.queries()["stream_routes"](spark, SF).count() > 0
    texts = [t._jdf.queryExecution().executedPlan().toString() for t in plans]
    assert len(packs) == 1 and len(texts) == 2 and all("MapPartitions" in t and "InArrow" not in t for t in texts)
