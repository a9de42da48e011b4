"""Geometry, tile and reference arithmetic as column expressions.

Every function takes and returns Columns (or a tuple of them), so all of it stays inside generated
code and can be pushed, folded and reordered by the optimiser. Coordinates are doubles. In mesh space
x and z are horizontal and y is height; in world space x and y are horizontal.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the data model.
WORLD_BOUND = 17066.666
TILE = 533.33333
GRID = 64
CENTRE = 32
SHARD = 8
NO_HEIGHT = -200000.0
NO_PATH = -1.0
HEURISTIC = 0.999
SAME_POINT = (1.0 / 16384.0) ** 2
SNAP = (2.0, 4.0, 2.0)
#: side, dx, dy of the eight neighbours of a tile
SIDES = ((0, 1, 0), (1, 1, 1), (2, 0, 1), (3, -1, 1), (4, -1, 0), (5, -1, -1), (6, 0, -1), (7, 1, -1))
#: (salt, tile, polygon) bits of the two reference layouts
LAYOUTS = {"wide_tile": (12, 21, 31), "wide_poly": (16, 28, 20)}


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def clamp(x, low, high) -> Column:
    return F.greatest(lit(low), F.least(lit(high), lit(x)))


def sqr(x: Column) -> Column:
    return x * x


# --- tiles ---


def tile_of(c) -> Column:
    """File tile index of a world coordinate; may lie outside 0..63."""
    return F.floor(F.lit(float(CENTRE)) - col(c) / F.lit(TILE)).cast("long")


def in_grid(tx: Column, ty: Column) -> Column:
    return tx.between(0, GRID - 1) & ty.between(0, GRID - 1)


def in_world(*coordinates) -> Column:
    return F.greatest(*(F.abs(col(c)) for c in coordinates)) <= F.lit(WORLD_BOUND)


def packed_tile(tx, ty) -> Column:
    return col(tx) * 65536 + col(ty)


def tile_key(tx, ty) -> Column:
    """Key in a tile store; 0 is never used."""
    return col(tx) * GRID + col(ty) + 1


def shard(t, size: int = SHARD) -> Column:
    return F.floor(col(t) / F.lit(size)).cast("long")


def tile_centre(t) -> Column:
    return (F.lit(float(CENTRE)) - (col(t) + F.lit(0.5))) * F.lit(TILE)


def mesh_tile(p, origin: float, width: float) -> Column:
    """Index in the mesh's own grid, which is another one than the files'."""
    return F.floor((col(p) - F.lit(origin)) / F.lit(width)).cast("long")


def opposite(side) -> Column:
    return (col(side) + 4).bitwiseAND(7)


def cover(low, high, padding: int = 0) -> Column:
    """The tile indices from the smaller to the larger of two, padded, as an array."""
    a, b = F.least(col(low), col(high)), F.greatest(col(low), col(high))
    if padding:
        a, b = F.greatest(a - padding, F.lit(0)), F.least(b + padding, F.lit(GRID - 1))
    return F.sequence(a, b)


# --- references ---


def encode_ref(salt, tile, poly, layout: str = "wide_tile") -> Column:
    _, tile_bits, poly_bits = LAYOUTS[layout]
    return F.shiftleft(col(salt).cast("long"), tile_bits + poly_bits).bitwiseOR(F.shiftleft(col(tile).cast("long"), poly_bits)).bitwiseOR(col(poly).cast("long"))


def decode_ref(ref, layout: str = "wide_tile") -> tuple[Column, Column, Column]:
    """(salt, tile, polygon)."""
    salt_bits, tile_bits, poly_bits = LAYOUTS[layout]
    part = lambda shift, bits: F.shiftrightunsigned(col(ref), shift).bitwiseAND(F.lit((1 << bits) - 1))
    return part(tile_bits + poly_bits, salt_bits), part(poly_bits, tile_bits), part(0, poly_bits)


def passes(flags, include=0xFFFF, exclude=0) -> Column:
    """A polygon passes with one of the included flags and none of the excluded; without flags it never does."""
    return (col(flags).bitwiseAND(lit(include)) != 0) & (col(flags).bitwiseAND(lit(exclude)) == 0)


# --- vectors ---


def dist_sqr(a, b) -> Column:
    """Squared distance of two points of equal dimension."""
    return sum((sqr(col(q) - col(p)) for p, q in zip(a, b, strict=True)), F.lit(0.0))


def dist(a, b) -> Column:
    return F.sqrt(dist_sqr(a, b))


def dot(a, b) -> Column:
    return sum((col(p) * col(q) for p, q in zip(a, b, strict=True)), F.lit(0.0))


def cross(a, b) -> tuple[Column, Column, Column]:
    (ax, ay, az), (bx, by, bz) = map(lambda v: tuple(map(col, v)), (a, b))
    return ay * bz - az * by, az * bx - ax * bz, ax * by - ay * bx


def lerp(a, b, t) -> tuple[Column, ...]:
    return tuple(col(p) + (col(q) - col(p)) * t for p, q in zip(a, b, strict=True))


def same_point(a, b) -> Column:
    return dist_sqr(a, b) < F.lit(SAME_POINT)


def perp(ux, uz, vx, vz) -> Column:
    return uz * vx - ux * vz


def area2(a, b, c) -> Column:
    """Twice the signed area of a triangle seen from above; positive if c lies left of a to b."""
    (ax, az), (bx, bz), (cx, cz) = (tuple(map(col, p)) for p in (a, b, c))
    return (cx - ax) * (bz - az) - (bx - ax) * (cz - az)


def nearest_on_segment(p, a, b) -> tuple[Column, Column]:
    """(t, squared distance) of the point of segment ab that is nearest to p, from above; a point segment has t = 0."""
    (px, pz), (ax, az), (bx, bz) = (tuple(map(col, x)) for x in (p, a, b))
    dx, dz = bx - ax, bz - az
    length = dx * dx + dz * dz
    t = clamp(F.when(length > 0, F.try_divide(dx * (px - ax) + dz * (pz - az), length)).otherwise(F.lit(0.0)), 0.0, 1.0)
    return t, sqr(ax + t * dx - px) + sqr(az + t * dz - pz)


def crosses(p, a, b) -> Column:
    """Whether a ray from p along +x crosses edge ab: an odd number over a polygon's edges means inside."""
    (px, pz), (ax, az), (bx, bz) = (tuple(map(col, x)) for x in (p, a, b))
    spans = (az > pz) != (bz > pz)
    return F.when(spans, px < (bx - ax) * F.try_divide(pz - az, bz - az) + ax).otherwise(F.lit(False))


def height_in_triangle(p, a, b, c) -> Column:
    """Height of triangle abc (x, y, z) above p (x, z), edges included; null outside or for a degenerate triangle."""
    px, pz = map(col, p)
    (ax, ay, az), (bx, by, bz), (cx, cy, cz) = (tuple(map(col, v)) for v in (a, b, c))
    ux, uz, vx, vz = cx - ax, cz - az, bx - ax, bz - az
    area = ux * vz - uz * vx
    sign = F.when(area < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    u = (vz * (px - ax) - vx * (pz - az)) * sign
    v = (ux * (pz - az) - uz * (px - ax)) * sign
    inside = (F.abs(area) >= 1e-6) & (u >= 0) & (v >= 0) & (u + v <= area * sign)
    return F.when(inside, ay + F.try_divide((cy - ay) * u + (by - ay) * v, area * sign))


def intersection(a, b, c, d) -> tuple[Column, Column]:
    """(s, t): where lines ab and cd meet, as parameters of each; null if parallel."""
    (ax, az), (bx, bz), (cx, cz), (dx, dz) = (tuple(map(col, p)) for p in (a, b, c, d))
    ux, uz, vx, vz, wx, wz = bx - ax, bz - az, dx - cx, dz - cz, ax - cx, az - cz
    area = perp(ux, uz, vx, vz)
    free = F.abs(area) >= 1e-6
    return F.when(free, F.try_divide(perp(vx, vz, wx, wz), area)), F.when(free, F.try_divide(perp(ux, uz, wx, wz), area))


# --- boxes ---


def overlap(*ranges) -> Column:
    """Closed ranges (low a, high a, low b, high b) that all overlap."""
    out = F.lit(True)
    for la, ha, lb, hb in ranges:
        out = out & (col(la) <= col(hb)) & (col(ha) >= col(lb))
    return out


def quantised(low, high, tile_low, tile_high, factor) -> tuple[Column, Column]:
    """A range in the units of a tile's bounding boxes: rounded out to even and odd numbers, at most 16 bits."""
    a = clamp(col(low), col(tile_low), col(tile_high)) - col(tile_low)
    b = clamp(col(high), col(tile_low), col(tile_high)) - col(tile_low)
    f = lit(factor)
    return F.floor(f * a).cast("long").bitwiseAND(0xFFFE), F.least((F.floor(f * b) + 1).cast("long").bitwiseOR(1), F.lit(65535))


# --- slabs and portals ---


def slabs_meet(a, b, climb, margin=0.01) -> Column:
    """Whether two border edges (low u, low height, high u, high height) overlap along u and come within climb of each other."""
    (au, ay, av, az), (bu, by, bv, bz) = (tuple(map(col, e)) for e in (a, b))
    low, high = F.greatest(au + margin, bu + margin), F.least(av - margin, bv - margin)
    slope_a, slope_b = F.try_divide(az - ay, av - au), F.try_divide(bz - by, bv - bu)
    da_low, da_high = ay + slope_a * (low - au), ay + slope_a * (high - au)
    db_low, db_high = by + slope_b * (low - bu), by + slope_b * (high - bu)
    at_low, at_high = db_low - da_low, db_high - da_high
    reach = sqr(lit(climb) * 2.0)
    meets = (at_low * at_high < 0) | (sqr(at_low) <= reach) | (sqr(at_high) <= reach)
    return F.when(low > high, F.lit(False)).otherwise(F.coalesce(meets, F.lit(False)))


def portal_byte(t) -> Column:
    return F.floor(clamp(t, 0.0, 1.0) * 255.0 + 0.5).cast("long")


# --- terrain ---


def terrain_cell(wx, wy) -> tuple[Column, Column, Column, Column]:
    """(row, column, u, v) in the 128 x 128 cells of a terrain tile."""
    fx = (F.lit(float(CENTRE)) - col(wx) / TILE) * 128.0
    fy = (F.lit(float(CENTRE)) - col(wy) / TILE) * 128.0
    ix, iy = F.floor(fx).cast("long"), F.floor(fy).cast("long")
    return ix.bitwiseAND(127), iy.bitwiseAND(127), fx - ix, fy - iy


def terrain_height(u, v, h1, h2, h3, h4, h5) -> Column:
    """Height in a cell of four corners (h1 to h4) and a doubled centre (h5), by its four triangles."""
    u, v, h1, h2, h3, h4, h5 = map(col, (u, v, h1, h2, h3, h4, h5))
    near, side = u + v < 1.0, u > v
    a = F.when(near, F.when(side, h2 - h1).otherwise(h5 - h1 - h3)).otherwise(F.when(side, h2 + h4 - h5).otherwise(h4 - h3))
    b = F.when(near, F.when(side, h5 - h1 - h2).otherwise(h3 - h1)).otherwise(F.when(side, h4 - h2).otherwise(h3 + h4 - h5))
    k = F.when(near, h1).otherwise(h5 - h4)
    return a * u + b * v + k


def is_hole(holes, row, column) -> Column:
    """Whether the 16 x 16 table of 4 x 4 masks has a hole at a cell."""
    row, column = col(row), col(column)
    mask = F.element_at(holes, (F.floor(row / 8) * 16 + F.floor(column / 8) + 1).cast("int"))
    across = F.shiftleft(F.lit(0x1111), 0) * F.pow(F.lit(2.0), F.floor((column % 8) / 2)).cast("int")
    down = F.lit(0x000F) * F.pow(F.lit(16.0), F.floor((row % 8) / 2)).cast("int")
    return mask.bitwiseAND(across).bitwiseAND(down) != 0
