"""The routing kernel against brute force and by properties."""

import heapq
import math
import random

import pytest

from navloom.functions import status as st
from navloom.operators import kernel as k


def lattice(w, h, blocked=(), flags=1, area=None, side=k.INTERNAL):
    ids = {}
    corners, links = [], []
    for r in range(h):
        for q in range(w):
            if (q, r) not in blocked:
                ids[q, r] = len(corners)
                corners.append([(q, 0.0, r), (q, 0.0, r + 1), (q + 1, 0.0, r + 1), (q + 1, 0.0, r)])
    for q, r in ids:
        links.append([(ids[q + a, r + b], e, side, 0, 255) for e, (a, b) in enumerate(((-1, 0), (0, 1), (1, 0), (0, -1))) if (q + a, r + b) in ids])
    n = len(corners)
    return k.Mesh([[tuple(map(float, p)) for p in c] for c in corners], [flags] * n, area or [0] * n, [0] * n, links), ids


def dijkstra(mesh, start, goal, p, q):
    """The cheapest way over the same graph: a node's position is that of its discovering edge, so only lower-bound it by straight distance."""
    seen, queue = set(), [(0.0, start)]
    while queue:
        hops, x = heapq.heappop(queue)
        if x == goal:
            return hops
        if x in seen:
            continue
        seen.add(x)
        for to, *_ in mesh.links[x]:
            heapq.heappush(queue, (hops + 1, to))
    return None


def test_same_polygon_is_a_straight_line():
    mesh, ids = lattice(1, 1)
    d, points, n, short = k.route(mesh, 0, 0, (0.2, 0.0, 0.2), (0.7, 0.0, 0.6), k.Filter())
    assert math.isclose(d, math.hypot(0.5, 0.4)) and n == 1 and not short
    assert [f for _, f, _ in points] == [k.START, k.END] and points[-1][2] == 0


def test_convex_corridor_is_straight():
    mesh, ids = lattice(6, 1)
    d, points, _, _ = k.route(mesh, ids[0, 0], ids[5, 0], (0.5, 0.0, 0.2), (5.5, 0.0, 0.8), k.Filter())
    assert math.isclose(d, math.hypot(5, 0.6)) and len(points) == 2


def test_one_corner():
    mesh, ids = lattice(3, 3, blocked={(1, 1), (2, 0), (2, 1)})
    d, points, n, _ = k.route(mesh, ids[1, 0], ids[1, 2], (1.5, 0.0, 0.5), (1.5, 0.0, 2.5), k.Filter())
    assert math.isclose(d, math.hypot(0.5, 0.5) * 2 + 1)
    assert [p[:3:2] for p, _, _ in points] == [(1.5, 0.5), (1.0, 1.0), (1.0, 2.0), (1.5, 2.5)]


def test_island_is_partial_and_clamped():
    mesh, ids = lattice(5, 1, blocked={(3, 0)})
    status, corridor = k.find_corridor(mesh, ids[0, 0], ids[4, 0], (0.5, 0.0, 0.5), (4.5, 0.0, 0.5), k.Filter())
    assert status & st.PARTIAL and corridor[-1] == ids[2, 0]
    d, points, _, short = k.route(mesh, ids[0, 0], ids[4, 0], (0.5, 0.0, 0.5), (4.5, 0.0, 0.5), k.Filter())
    assert short and math.isclose(d, 2.5) and points[-1][0][0] == 3.0


def test_filter_flags_and_invalid_input():
    mesh, ids = lattice(3, 1, flags=0)
    assert k.find_corridor(mesh, 0, 2, (0.5, 0, 0.5), (2.5, 0, 0.5), k.Filter())[1] == [0]
    mesh, ids = lattice(3, 1)
    assert k.find_corridor(mesh, 0, 2, (math.nan, 0, 0.5), (2.5, 0, 0.5), k.Filter())[0] & st.FAILURE
    assert k.find_corridor(mesh, 0, 7, (0.5, 0, 0.5), (2.5, 0, 0.5), k.Filter())[0] & st.FAILURE


def test_limits():
    mesh, ids = lattice(9, 1)
    ends = (0.5, 0.0, 0.5), (8.5, 0.0, 0.5)
    status, corridor = k.find_corridor(mesh, 0, 8, *ends, k.Filter(), most=4)
    assert status & st.BUFFER_TOO_SMALL and corridor == [0, 1, 2, 3]
    status, _ = k.find_corridor(mesh, 0, 8, *ends, k.Filter(), most_nodes=3)
    assert status & st.OUT_OF_NODES and status & st.PARTIAL
    status, corridor = k.find_corridor(mesh, 0, 8, *ends, k.Filter(), most_expansions=2)
    assert status & st.PARTIAL and len(corridor) <= 4


def test_area_costs_turn_the_way():
    area = [0] * 9
    area[4] = 1
    mesh, ids = lattice(3, 3, area=area)
    ends = (0.5, 0.0, 1.5), (2.5, 0.0, 1.5)
    assert ids[1, 1] in k.find_corridor(mesh, ids[0, 1], ids[2, 1], *ends, k.Filter())[1]
    dear = k.Filter(cost=(1.0, 50.0, *([1.0] * 62)))
    assert ids[1, 1] not in k.find_corridor(mesh, ids[0, 1], ids[2, 1], *ends, dear)[1]


def test_crossings():
    mesh, ids = lattice(4, 1, area=[0, 0, 1, 1])
    corridor = [0, 1, 2, 3]
    ends = (0.5, 0.0, 0.2), (3.5, 0.0, 0.8)
    assert [p[0] for p, _, _ in k.straighten(mesh, corridor, *ends, crossings="all")[1]] == [0.5, 1.0, 2.0, 3.0, 3.5]
    assert [p[0] for p, _, _ in k.straighten(mesh, corridor, *ends, crossings="area")[1]] == [0.5, 2.0, 3.5]


@pytest.mark.parametrize("seed", range(12))
def test_random_meshes(seed):
    rng = random.Random(seed)
    blocked = {(rng.randrange(9), rng.randrange(9)) for _ in range(25)}
    mesh, ids = lattice(9, 9, blocked)
    for _ in range(20):
        (a, b) = rng.choice(sorted(ids)), rng.choice(sorted(ids))
        p, q = (a[0] + 0.5, 0.0, a[1] + 0.5), (b[0] + 0.5, 0.0, b[1] + 0.5)
        hops = dijkstra(mesh, ids[a], ids[b], p, q)
        d, points, n, short = k.route(mesh, ids[a], ids[b], p, q, k.Filter())
        assert short == (hops is None)
        if a == b:
            assert d == -1.0  # both ends are one point: fewer than two waypoints
        elif hops is not None:
            assert n >= hops + 1 and d >= math.dist(p, q) - 1e-9
            # No shorter than straight, and each leg stays inside the free cells.
            for (u, _, _), (v, _, _) in zip(points, points[1:], strict=False):
                for t in (0.25, 0.5, 0.75):
                    x, _, z = k.lerp(u, v, t)
                    near = {(math.floor(x + dx), math.floor(z + dz)) for dx in (-1e-6, 1e-6) for dz in (-1e-6, 1e-6)}
                    assert near & set(ids)


def test_ray():
    mesh, ids = lattice(5, 1, blocked={(3, 0)})
    free = k.cast_ray(mesh, 0, (0.5, 0.0, 0.5), (2.5, 0.0, 0.6), k.Filter())
    assert math.isinf(free.t) and free.path == [0, 1, 2] and math.isclose(free.cost, math.hypot(2, 0.1))
    wall = k.cast_ray(mesh, 0, (0.5, 0.0, 0.5), (4.5, 0.0, 0.5), k.Filter())
    assert math.isclose(wall.t, 2.5 / 4) and wall.edge == 2 and abs(wall.normal[0]) == 1.0 and math.isclose(wall.cost, 2.5)


def test_partial_portal_blocks_the_ray_beside_it():
    mesh, ids = lattice(2, 1, side=0)
    mesh.links[0] = [(1, 2, 0, 128, 255)]
    hit = k.cast_ray(mesh, 0, (0.5, 0.0, 0.9), (1.5, 0.0, 0.9), k.Filter())
    free = k.cast_ray(mesh, 0, (0.5, 0.0, 0.2), (1.5, 0.0, 0.2), k.Filter())
    assert (math.isinf(hit.t), math.isinf(free.t)) == (False, True) or (math.isinf(hit.t), math.isinf(free.t)) == (True, False)


def test_off_mesh_connection():
    mesh, ids = lattice(3, 1, blocked={(1, 0)})
    mesh.corners.append([(0.9, 0.0, 0.5), (2.1, 0.0, 0.5)])
    mesh.flags.append(1)
    mesh.area.append(0)
    mesh.kind.append(k.OFFMESH)
    mesh.ids.append(99)
    mesh.links.append([(1, 1, k.INTERNAL, 0, 255), (0, 0, k.INTERNAL, 0, 255)])
    mesh.links[0].append((2, 0, k.INTERNAL, 0, 255))
    mesh.links[1].append((2, 0, k.INTERNAL, 0, 255))
    d, points, n, short = k.route(mesh, 0, 1, (0.2, 0.0, 0.5), (2.8, 0.0, 0.5), k.Filter())
    assert not short and n == 3 and math.isclose(d, 2.6) and any(f & k.CONNECTION for _, f, _ in points)


def test_a_broken_corridor_ends_without_the_end_flag():
    """The string goes straight from its last corner to the border of the last polygon that can be reached."""
    mesh, ids = lattice(4, 1, blocked={(2, 0)})
    corridor = [ids[0, 0], ids[1, 0], ids[3, 0]]
    status, points = k.straighten(mesh, corridor, (0.5, 0.0, 0.5), (3.5, 0.0, 0.5))
    assert status & st.PARTIAL and [(p, f) for p, f, _ in points] == [((0.5, 0.0, 0.5), k.START), ((2.0, 0.0, 0.5), 0)] and points[-1][2] == ids[1, 0]


def test_a_search_keeps_to_its_tiles():
    mesh, ids = lattice(3, 3, blocked={(1, 0), (1, 1)})
    mesh.tile = [(int(c[0][0]), int(c[0][2])) for c in mesh.corners]
    ends = (0.5, 0.0, 0.5), (2.5, 0.0, 0.5)
    assert k.find_corridor(mesh, ids[0, 0], ids[2, 0], *ends, k.Filter(), within=(0, 0, 2, 2))[1][-1] == ids[2, 0]
    status, corridor = k.find_corridor(mesh, ids[0, 0], ids[2, 0], *ends, k.Filter(), within=(0, 0, 2, 1))
    assert status & st.PARTIAL and corridor[-1] != ids[2, 0]
