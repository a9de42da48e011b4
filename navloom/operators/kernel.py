"""The sequential part of routing, for one mesh in memory: search, corridor, funnel, ray.

Plain Python over compact lists, called from Arrow batches. All of it is deterministic: links are
visited in their order, and of equal totals the node that was queued first is taken.
"""

from __future__ import annotations

import heapq
import math
import weakref
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from navloom.functions import status as st
from navloom.functions.geometry import HEURISTIC, SAME_POINT

GROUND, OFFMESH = 0, 1
START, END, CONNECTION = 1, 2, 4
INTERNAL = 255
#: polygons whose steps are kept; all go when they are so many
KEPT = 50_000
Point = tuple[float, float, float]


@dataclass
class Mesh:
    """Polygons by index: corners, flags, area, kind; links (to, edge, side, low byte, high byte) in order; index: place of each id."""

    corners: Sequence[list[Point]]
    flags: Sequence[int]
    area: Sequence[int]
    kind: Sequence[int]
    links: Sequence[list[tuple[int, int, int, int, int]]]
    ids: Sequence[int] = field(default_factory=list)
    tile: Sequence[tuple[int, int]] = field(default_factory=list)
    index: Mapping[int, int] | None = None
    #: ways() of this mesh by another way, if there is one
    ways: Callable[[int], list[tuple]] | None = field(default=None, repr=False, compare=False)
    #: Steps of a polygon and of some around it, made together, if there is such a way
    rows: Callable[[int, Filter], dict[int, tuple[int, list]]] | None = field(default=None, repr=False, compare=False)
    #: by polygon a number that those have alike between which there may be a way; pairs in this order find steps that are kept
    group: Sequence[int] | None = field(default=None, repr=False, compare=False)
    known: dict = field(default_factory=dict, init=False, repr=False, compare=False)

    def __post_init__(self):
        if self.index is None:
            self.ids = self.ids or list(range(len(self.corners)))
            self.index = {pid: i for i, pid in enumerate(self.ids)}

    def steps(self, rules: Filter) -> Steps:
        """What a search may do from each polygon; kept, so a mesh stays as it is once it was searched."""
        own = self.known.get((rules.include, rules.exclude))
        if own is None:
            own = self.known[rules.include, rules.exclude] = Steps(self, rules)
        return own


class Steps(dict):
    """By polygon, made when asked for: its area and the ways (Mesh.ways) to polygons that pass."""

    def __init__(self, mesh: Mesh, rules: Filter):
        # Without a cycle: a mesh of a whole map goes when its search is over, not when Python next looks for cycles.
        own = weakref.proxy(mesh)
        self.mesh, self.rules = own, rules
        self.ways = mesh.ways or (lambda here: ways(own, here))

    def __missing__(self, here: int) -> tuple[int, list]:
        if len(self) >= KEPT:
            self.clear()
        if self.mesh.rows:
            self.update(self.mesh.rows(here, self.rules))
            return self[here]
        passes, flags = self.rules.passes, self.mesh.flags
        row = self[here] = (self.mesh.area[here], [w for w in self.ways(here) if passes(flags[w[0]])])
        return row


def ways(mesh: Mesh, here: int) -> list[tuple]:
    """(to, number of the node, middle of the passage (x, y, z; None if there is no passage), whether to another tile) for each link."""
    out, middles = [], {}
    for to, _edge, side, _low, _high in mesh.links[here]:
        if to not in middles:
            passage = portal(mesh, here, to)
            middles[to] = lerp(*passage, 0.5) if passage else (None, None, None)
        out.append((to, to << 7 | (0 if side == INTERNAL else side >> 1), *middles[to], bool(mesh.tile) and mesh.tile[to] != mesh.tile[here]))
    return out


@dataclass(frozen=True)
class Filter:
    include: int = 0xFFFF
    exclude: int = 0
    cost: tuple[float, ...] = (1.0,) * 64

    def passes(self, flags: int) -> bool:
        return bool(flags & self.include) and not flags & self.exclude


def dist(a: Point, b: Point) -> float:
    return math.sqrt((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2)


def same(a: Point, b: Point) -> bool:
    return (a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 < SAME_POINT


def lerp(a: Point, b: Point, t: float) -> Point:
    return (a[0] + (b[0] - a[0]) * t, a[1] + (b[1] - a[1]) * t, a[2] + (b[2] - a[2]) * t)


def area2(a: Point, b: Point, c: Point) -> float:
    return (c[0] - a[0]) * (b[2] - a[2]) - (b[0] - a[0]) * (c[2] - a[2])


def clamp_to(mesh: Mesh, poly: int, p: Point) -> Point:
    """p if it lies in the polygon seen from above, else the nearest point of its border."""
    corners = mesh.corners[poly]
    inside, best, at = False, math.inf, p
    for i, a in enumerate(corners):
        b = corners[(i + 1) % len(corners)]
        if (a[2] > p[2]) != (b[2] > p[2]) and p[0] < (b[0] - a[0]) * (p[2] - a[2]) / (b[2] - a[2]) + a[0]:
            inside = not inside
        dx, dz = b[0] - a[0], b[2] - a[2]
        length = dx * dx + dz * dz
        t = max(0.0, min(1.0, (dx * (p[0] - a[0]) + dz * (p[2] - a[2])) / length)) if length > 0 else 0.0
        d = (a[0] + t * dx - p[0]) ** 2 + (a[2] + t * dz - p[2]) ** 2
        if d < best:
            best, at = d, lerp(a, b, t)
    return p if inside else at


def portal(mesh: Mesh, a: int, b: int) -> tuple[Point, Point] | None:
    """Left and right end of the passage from polygon a to b, by the first link between them."""
    for to, edge, side, low, high in mesh.links[a]:
        if to == b:
            break
    else:
        return None
    if mesh.kind[a] == OFFMESH:
        p = mesh.corners[a][edge]
        return p, p
    if mesh.kind[b] == OFFMESH:
        for to, edge, *_ in mesh.links[b]:
            if to == a:
                p = mesh.corners[b][edge]
                return p, p
        return None
    corners = mesh.corners[a]
    left, right = corners[edge], corners[(edge + 1) % len(corners)]
    if side != INTERNAL and (low, high) != (0, 255):
        return lerp(left, right, low / 255), lerp(left, right, high / 255)
    return left, right


def find_corridor(mesh: Mesh, start: int, goal: int, p: Point, q: Point, rules: Filter, most: int = 4096, most_nodes: int = 65535, most_expansions: int | None = None, within: tuple[int, int, int, int] | None = None) -> tuple[int, list[int]]:
    """(status, polygons from start towards goal): A* over links with the straight distance as estimate.

    A node is a polygon and the border side it was entered by. Its position is the middle of the edge
    by which it was first reached, and stays so; its cost may still improve, also after it was expanded.
    Without a way the corridor leads to the node nearest to the goal by the estimate (PARTIAL). `within` keeps the
    search to the tiles of a rectangle (first x, first y, last x, last y).
    """
    n = len(mesh.corners)
    if not (0 <= start < n and 0 <= goal < n and all(map(math.isfinite, (*p, *q))) and most > 0):
        return st.FAILURE | st.INVALID_PARAM, []
    if start == goal:
        return st.SUCCESS, [start]
    steps, factors, sqrt, push, pop = mesh.steps(rules), rules.cost, math.sqrt, heapq.heappush, heapq.heappop
    inside = (lambda at: True) if within is None else lambda at: within[0] <= at[0] <= within[2] and within[1] <= at[1] <= within[3]
    begins_outside = within is not None and not inside(mesh.tile[start])
    goal_factor, rising = factors[mesh.area[goal]], min(factors) >= 0
    gx, gy, gz = q
    # A node: total, cost, node before, place (x, y, z), estimate of the rest, cost within the goal, polygon.
    left = dist(p, q) * HEURISTIC
    first = [left, 0.0, None, *p, left, 0.0, start]
    number = {} if begins_outside else {start << 7: first}
    nodes = 1
    # A node's total falls with every entry, so of its entries only one has its total.
    queue, queued = [(left, 0, first)], 1
    nearest, nearest_left, status, expanded = first, left, st.SUCCESS, 0
    found = None
    while queue:
        t, _, node = pop(queue)
        total, cost, before, x, y, z, _, _, here = node
        if t != total:
            continue  # an older entry of a node that has improved since
        if here == goal:
            found = node
            break
        if most_expansions is not None and expanded >= most_expansions:
            break
        expanded += 1
        came_from = before[8] if before is not None else -1
        area, own = steps[here]
        factor, floor = factors[area], cost if rising else -math.inf
        if begins_outside and node is first:
            own = [s for s in own if inside(mesh.tile[s[0]])]
        for to, key, ax, ay, az, crosses in own:
            if to == came_from:
                continue
            other = number.get(key)
            if other is None:
                if crosses and not inside(mesh.tile[to]):
                    continue
                if nodes >= most_nodes:
                    status |= st.OUT_OF_NODES
                    continue
                if ax is None:
                    ax, ay, az = x, y, z
                rest = sqrt((ax - gx) * (ax - gx) + (ay - gy) * (ay - gy) + (az - gz) * (az - gz))
                left, last = (0.0, rest * goal_factor) if to == goal else (rest * HEURISTIC, 0.0)
                other = number[key] = [math.inf, math.inf, None, ax, ay, az, left, last, to]
                nodes += 1
                c = cost + sqrt((x - ax) * (x - ax) + (y - ay) * (y - ay) + (z - az) * (z - az)) * factor + last
                t = c + left
                if t >= math.inf:
                    continue
                if left < nearest_left:
                    nearest_left, nearest = left, other
            else:
                if floor >= other[1]:
                    continue  # from here it cannot get cheaper
                _, _, _, ax, ay, az, left, last, _ = other
                c = cost + sqrt((x - ax) * (x - ax) + (y - ay) * (y - ay) + (z - az) * (z - az)) * factor + last
                t = c + left
                if t >= other[0]:
                    continue
            other[0], other[1], other[2] = t, c, node
            push(queue, (t, queued, other))
            queued += 1
    if found is None:
        found, status = nearest, status | st.PARTIAL
    chain = []
    while found is not None:
        chain.append(found[8])
        found = found[2]
    chain.reverse()
    if len(chain) > most:
        status |= st.BUFFER_TOO_SMALL
    return status, chain[:most]


def straighten(mesh: Mesh, corridor: list[int], p: Point, q: Point, most: int = 4096, crossings: str = "none") -> tuple[int, list[tuple[Point, int, int]]]:
    """(status, waypoints (point, flags, polygon id or 0)): the tight string through a corridor from p to q.

    `crossings` adds the points where the string crosses from polygon to polygon: none, area (where the
    area changes) or all. Ends outside their polygons are moved to the border. Where two polygons of the corridor have no
    passage, the string goes from its last corner straight to the border of the first of them, without the END flag.
    """
    if not corridor:
        return st.FAILURE | st.INVALID_PARAM, []
    start, end = clamp_to(mesh, corridor[0], p), clamp_to(mesh, corridor[-1], q)
    doors: list[tuple[Point, Point]] = []
    status, broken = st.SUCCESS, False
    for i in range(len(corridor) - 1):
        door = portal(mesh, corridor[i], corridor[i + 1])
        if door is None:  # the corridor ends here
            end, corridor, status, broken = clamp_to(mesh, corridor[i], q), corridor[: i + 1], status | st.PARTIAL, True
            break
        doors.append(door)
    out: list[tuple[Point, int, int]] = []

    def add(point: Point, flags: int, poly: int | None) -> bool:
        """False once the list is full or ended."""
        nonlocal status
        ref = mesh.ids[poly] if poly is not None else 0
        if out and same(out[-1][0], point):
            out[-1] = (out[-1][0], flags, ref)
            return True
        out.append((point, flags, ref))
        if flags == END:
            return False
        if len(out) >= most:
            status |= st.BUFFER_TOO_SMALL
            return False
        return True

    def add_crossings(first: int, last: int, to: Point) -> bool:
        if crossings == "none":
            return True
        for i in range(first, last):
            a, b = corridor[i], corridor[i + 1]
            if crossings == "area" and mesh.area[a] == mesh.area[b]:
                continue
            (lx, ly, lz), (rx, ry, rz) = doors[i]
            o = out[-1][0]
            ux, uz, vx, vz, wx, wz = to[0] - o[0], to[2] - o[2], rx - lx, rz - lz, o[0] - lx, o[2] - lz
            d = uz * vx - ux * vz
            if abs(d) >= 1e-6:
                t = (uz * wx - ux * wz) / d
                if not add((lx + (rx - lx) * t, ly + (ry - ly) * t, lz + (rz - lz) * t), 0, b):
                    return False
        return True

    add(start, START, corridor[0])
    apex, at_left, at_right = start, start, start
    apex_i, left_i, right_i = 0, 0, 0
    left_flags = right_flags = 0
    left_poly: int | None = corridor[0]
    right_poly: int | None = corridor[0]
    i = 0
    while i <= len(doors) and len(doors):
        if i < len(doors):
            left, right = doors[i]
            poly = corridor[i + 1]
            flags = CONNECTION if mesh.kind[poly] == OFFMESH else 0
            if i == 0 and _near_segment(apex, left, right):
                i += 1
                continue
        elif broken:
            break
        else:
            left = right = end
            poly, flags = None, END
        turn = None
        if area2(apex, at_right, right) <= 0:
            if same(apex, at_right) or area2(apex, at_left, right) > 0:
                at_right, right_i, right_flags, right_poly = right, i, flags, poly
            else:
                turn = (at_left, left_i, left_flags, left_poly)
        if turn is None and area2(apex, at_left, left) >= 0:
            if same(apex, at_left) or area2(apex, at_right, left) < 0:
                at_left, left_i, left_flags, left_poly = left, i, flags, poly
            else:
                turn = (at_right, right_i, right_flags, right_poly)
        if turn is not None:
            corner, index, corner_flags, corner_poly = turn
            if not add_crossings(apex_i, index, corner):
                return status, out
            if not add(corner, END if corner_poly is None else corner_flags, corner_poly):
                return status, out
            apex = at_left = at_right = corner
            apex_i = left_i = right_i = index
            left_flags = right_flags = corner_flags
            left_poly = right_poly = corner_poly
            i = index
        i += 1
    if doors and not add_crossings(apex_i, len(doors), end):
        return status, out
    if broken:
        add(end, 0, corridor[-1])
    else:
        add(end, END, None)
    return status, out


def _near_segment(p: Point, a: Point, b: Point) -> bool:
    """Whether p is within a thousandth of a passage: then it is skipped."""
    dx, dz = b[0] - a[0], b[2] - a[2]
    length = dx * dx + dz * dz
    t = max(0.0, min(1.0, (dx * (p[0] - a[0]) + dz * (p[2] - a[2])) / length)) if length > 0 else 0.0
    return (a[0] + t * dx - p[0]) ** 2 + (a[2] + t * dz - p[2]) ** 2 < 0.001**2


def length(points: list[Point]) -> float:
    return sum(map(dist, points, points[1:]))


@dataclass
class Ray:
    """t: share of the way to the target until the first wall, inf if none; normal of the wall; polygons crossed; cost so far."""

    t: float
    normal: tuple[float, float]
    edge: int
    path: list[int]
    cost: float
    status: int


def cast_ray(mesh: Mesh, start: int, p: Point, q: Point, rules: Filter, most: int = 4096) -> Ray:
    """Walk straight from p to q, from polygon to polygon, until a wall; heights play no part."""
    here, came, path, cost, at, status = start, -1, [], 0.0, p, st.SUCCESS
    dx, dz = q[0] - p[0], q[2] - p[2]
    while True:
        corners = mesh.corners[here]
        low, high, out_edge, hit = 0.0, 1.0, -1, True
        for i, a in enumerate(corners):
            b = corners[(i + 1) % len(corners)]
            ex, ez = b[0] - a[0], b[2] - a[2]
            num = ez * (p[0] - a[0]) - ex * (p[2] - a[2])
            den = dz * ex - dx * ez
            if abs(den) < 1e-8:
                if num < 0:
                    hit = False
                continue
            t = num / den
            if den < 0:
                low = max(low, t)
            elif t < high:
                high, out_edge = t, i
        if not hit or low > high:  # the ray does not touch this polygon
            return Ray(0.0, (0.0, 0.0), -1, path, cost, status)
        if len(path) < most:
            path.append(here)
        else:
            status |= st.BUFFER_TOO_SMALL
        leave = (p[0] + dx * high, p[1] + (q[1] - p[1]) * high, p[2] + dz * high)
        if out_edge < 0:
            cost += dist(at, q) * rules.cost[mesh.area[here]]
            return Ray(math.inf, (0.0, 0.0), -1, path, cost, status)
        cost += dist(at, leave) * rules.cost[mesh.area[here]]
        at = leave
        a, b = corners[out_edge], corners[(out_edge + 1) % len(corners)]
        for to, edge, side, bmin, bmax in mesh.links[here]:
            if edge != out_edge or to == came or mesh.kind[to] == OFFMESH or not rules.passes(mesh.flags[to]):
                continue
            if side == INTERNAL or (bmin, bmax) == (0, 255):
                break
            axis = 2 if side in (0, 4) else 0
            ends = sorted((a[axis] + (b[axis] - a[axis]) * bmin / 255, a[axis] + (b[axis] - a[axis]) * bmax / 255))
            if ends[0] <= leave[axis] <= ends[1]:
                break
        else:
            nx, nz = b[2] - a[2], -(b[0] - a[0])
            size = math.hypot(nx, nz) or 1.0
            return Ray(high, (nx / size, nz / size), out_edge, path, cost, status)
        came, here = here, to


def route(mesh: Mesh, start: int, goal: int, p: Point, q: Point, rules: Filter, **options) -> tuple[float, list[tuple[Point, int, int]], int, bool]:
    """(length or -1, waypoints, polygons in the corridor, whether the way ends short of the goal)."""
    status, corridor = find_corridor(mesh, start, goal, p, q, rules, **options)
    if not corridor:
        return -1.0, [], 0, False
    short = corridor[-1] != goal
    target = clamp_to(mesh, corridor[-1], q) if short else q
    _, points = straighten(mesh, corridor, p, target)
    if len(points) < 2:
        return -1.0, points, len(corridor), short
    return length([x for x, _, _ in points]), points, len(corridor), short
