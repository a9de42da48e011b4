"""Properties of the plain-Python parts, on generated input."""

import math

from hypothesis import given, settings
from hypothesis import strategies as st

from navloom.operators import kernel as k
from navloom.sources import binary, blobs

settings.register_profile("quick", max_examples=60, deadline=None)
settings.load_profile("quick")
coordinate = st.floats(-50, 50, allow_nan=False, width=32).map(float)


@given(st.integers(0, 2**63))
def test_numbers_round_trip(n):
    data = blobs.put_number(n)
    assert blobs.get_number(data + b"\xff", 0) == (n, len(data)) and all(b & 1 for b in data[:-1]) and not data[-1] & 1


@given(st.dictionaries(st.integers(1, 4096), st.integers(1, 5000), max_size=80), st.integers(1, 4096))
def test_indexes_find_what_they_hold(sizes, other):
    entries, at = [], 1
    for key, n in sorted(sizes.items()):
        entries.append((key, at, n))
        at += n
    index = blobs.build_index(entries)
    assert blobs.entries_of(index) == entries
    assert all(blobs.search_index(index, key) == (p, n) for key, p, n in entries)
    assert other in sizes or blobs.search_index(index, other) is None


@given(st.binary(max_size=300))
def test_bytes_round_trip(data):
    assert blobs.unescape(blobs.escape(data)) == data and blobs.inflate(blobs.deflate(data)) == data


@given(st.binary(max_size=200))
def test_decoders_refuse_noise(data):
    assert binary.decode_tile_file(data) is None and binary.decode_terrain(data) is None
    assert (binary.decode_params(data) is None) == (len(data) < 28)


@given(coordinate, coordinate)
def test_clamping_ends_in_the_polygon(x, z):
    square = [(0.0, 0.0, 0.0), (0.0, 1.0, 4.0), (4.0, 2.0, 4.0), (4.0, 1.0, 0.0)]
    mesh = k.Mesh([square], [1], [0], [0], [[]])
    p = k.clamp_to(mesh, 0, (x, 0.0, z))
    assert -1e-9 <= p[0] <= 4 + 1e-9 and -1e-9 <= p[2] <= 4 + 1e-9
    if 0 < x < 4 and 0 < z < 4:
        assert p == (x, 0.0, z)
    else:
        best = math.hypot(max(-x, 0, x - 4), max(-z, 0, z - 4))
        assert math.isclose(math.hypot(p[0] - x, p[2] - z), best, abs_tol=1e-6)


@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 5)), max_size=14), st.tuples(coordinate, coordinate, coordinate, coordinate).map(lambda t: [abs(v) % 6 for v in t]))
def test_rays_stop_at_the_first_wall(blocked, ends):
    """A ray that reaches its target crosses free cells only; one that does not has a blocked cell or the rim right behind."""
    free = {(q, r) for q in range(6) for r in range(6)} - set(blocked)
    ids = {c: i for i, c in enumerate(sorted(free))}
    corners = [[(q, 0.0, r), (q, 0.0, r + 1), (q + 1, 0.0, r + 1), (q + 1, 0.0, r)] for q, r in sorted(free)]
    links = [[(ids[q + a, r + b], e, k.INTERNAL, 0, 255) for e, (a, b) in enumerate(((-1, 0), (0, 1), (1, 0), (0, -1))) if (q + a, r + b) in ids] for q, r in sorted(free)]
    mesh = k.Mesh(corners, [1] * len(ids), [0] * len(ids), [0] * len(ids), links)
    x, z, u, v = ends
    start = (int(x), int(z))
    if start not in ids or x in (0, start[0]) or z in (0, start[1]):
        return
    ray = k.cast_ray(mesh, ids[start], (x, 0.0, z), (u, 0.0, v), k.Filter())
    share = min(ray.t, 1.0)
    for t in [i / 50 * share for i in range(50)]:
        px, pz = x + (u - x) * t, z + (v - z) * t
        near = {(math.floor(px + a), math.floor(pz + b)) for a in (-1e-6, 1e-6) for b in (-1e-6, 1e-6)}
        assert near & free
    if ray.t < 1:
        px, pz = x + (u - x) * ray.t, z + (v - z) * ray.t
        around = {(math.floor(px + a), math.floor(pz + b)) for a in (-1e-6, 1e-6) for b in (-1e-6, 1e-6)}
        assert around - free
