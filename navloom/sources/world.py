"""A synthetic world over the driver tables: the data that mesh, terrain and route operators work on.

The same definitions are stated as SQL (common table expressions) in WORLD_SQL for the checks.

points(event_id, wx, wy): world points of all events.
pairs(pair_id, x1, y1, x2, y2): origins and destinations of all orders.
polys(pid, r, q, flags, area, ptype, y): one unit cell of a square lattice for each part; a mesh tile has 8 x 8 cells.
where w is the lattice's width, the square root of the number of parts, rounded up.
mesh(ref, x, y, layer, idx, corners, neis, flags, area, ptype, climb): an irregular mesh over the lattice. Inner vertices are
moved off the lattice and have heights of their own; a fifth of the cells are two triangles; on the border between two
tiles each tile has its own vertices, so that edges overlap in part and heights differ by tile; some cells are no
polygon of the first layer but one of a second layer in the same tile, joined by portal edges. neis has, as in mesh
files, for each edge 0 (wall), the neighbour's number in the tile plus one, or 0x8000 and the side the edge faces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from navloom.session import table

SPAN = 34133

WORLD_SQL = {
    "points": f"""points AS (SELECT event_id, cast((event_id * 7919) % {SPAN} AS DOUBLE) - 17066.0 + 0.25 AS wx,
        cast((event_id * 104729) % {SPAN} AS DOUBLE) - 17066.0 + 0.25 AS wy FROM events)""",
    "pairs": f"""pairs AS (SELECT pair_id, x1, y1,
        greatest(-17066.0, least(17066.0, x1 + cast((c * 31) % 1201 AS DOUBLE) - 600.0)) AS x2,
        greatest(-17066.0, least(17066.0, y1 + cast((c * 17) % 1201 AS DOUBLE) - 600.0)) AS y2
      FROM (SELECT o_orderkey AS pair_id, o_custkey AS c, cast((o_orderkey * 7919) % {SPAN} AS DOUBLE) - 17066.0 + 0.25 AS x1,
        cast((o_orderkey * 104729) % {SPAN} AS DOUBLE) - 17066.0 + 0.25 AS y1 FROM orders))""",
    "polys": """size AS (SELECT cast(ceil(sqrt(count(*))) AS BIGINT) AS w FROM part),
      polys AS (SELECT p_partkey AS pid, p_partkey // w AS r, p_partkey % w AS q, cast(p_size AS BIGINT) AS flags,
        cast(p_size % 4 AS BIGINT) AS area, cast(CASE WHEN p_partkey % 23 = 0 THEN 1 ELSE 0 END AS BIGINT) AS ptype, p_retailprice / 100.0 AS y FROM part, size)""",
}


# --- the irregular mesh, once for columns and once for SQL: the expressions below are valid in both -----------------

#: the cell's corners in order, and across each edge: neighbour's column, row and number, the side
_CORNERS = ((0, 0), (0, 1), (1, 1), (1, 0))
_ACROSS = ((-1, 0, "pid - 1", 4), (0, 1, "pid + w", 2), (1, 0, "pid + 1", 0), (0, -1, "pid - w", 6))
CLIMB = 0.5


def _vertex(di: int, dk: int) -> dict[str, str]:
    """Place of the vertex (q + di, r + dk) as its cell's tile has it."""
    i, k = f"(q + {di})", f"(r + {dk})"
    fixed = f"({i} % 4 IN (1, 2) AND {k} % 4 IN (1, 2))"  # the corners of the second layer's polygons
    step_i, step_k = (f"2 * CAST(floor({v} / 8) - floor({c} / 8) AS BIGINT)" for v, c in ((i, "q"), (k, "r")))
    x = f"CASE WHEN {i} % 8 = 0 OR {fixed} THEN 0.0e0 ELSE (({i} * 3 + {k} * 5 + CASE WHEN {k} % 8 = 0 THEN {step_k} ELSE 0 END) % 7 - 3) / 20.0e0 END"
    z = f"CASE WHEN {k} % 8 = 0 OR {fixed} THEN 0.0e0 ELSE (({i} * 5 + {k} * 3 + CASE WHEN {i} % 8 = 0 THEN {step_i} ELSE 0 END) % 7 - 3) / 20.0e0 END"
    y = f"(({i} * 7 + {k} * 11) % 5) / 4.0e0 + ((tx * 2 + ty) % 3) * 0.8e0 + CASE WHEN hole THEN 0.3e0 ELSE 0.0e0 END"
    return {"x": f"CAST({i} + ({x}) AS DOUBLE)", "y": f"CAST({y} AS DOUBLE)", "z": f"CAST({k} + ({z}) AS DOUBLE)"}


def _hole(q: str, r: str, pid: str) -> str:
    return f"(({q}) % 4 = 1 AND ({r}) % 4 = 1 AND ({pid}) % 3 = 0)"


def _neighbour(edge: int) -> str:
    """The neighbour's entry of a quad's edge: across the tile's border or towards another layer a portal, else a number, else a wall."""
    dq, dr, pid, side = _ACROSS[edge]
    q, r = f"q + ({dq})", f"r + ({dr})"
    border = "q % 8 = 0" if dq < 0 else "q % 8 = 7" if dq > 0 else "r % 8 = 7" if dr > 0 else "r % 8 = 0"
    second = f"CASE WHEN ({pid}) % 5 = 0 THEN 1 ELSE 0 END" if edge in (0, 1) else "0"  # its east or south edge belongs to its second triangle
    there = f"{pid} BETWEEN low AND high" + (f" AND {q} < w" if dq > 0 else "")
    return f"CAST(CASE WHEN {border} OR hole OR {_hole(q, r, pid)} THEN {0x8000 + side} WHEN {there} THEN ((({q}) % 8) * 8 + ({r}) % 8) * 2 + {second} + 1 ELSE 0 END AS INT)"


def _shapes() -> list[tuple[str, int, tuple[int, ...], tuple[str, ...]]]:
    """(condition, part, corners, neighbours) of quads and of the two triangles."""
    n = [_neighbour(e) for e in range(4)]
    other = lambda part: f"CAST(idx + {part} + 1 AS INT)"
    return [("NOT split", 0, (0, 1, 2, 3), tuple(n)), ("split", 0, (0, 1, 2), (n[0], n[1], other(1))), ("split", 1, (0, 2, 3), (other(0), n[2], n[3]))]


_CELL = {
    "tx": "CAST(floor(q / 8) AS BIGINT)",
    "ty": "CAST(floor(r / 8) AS BIGINT)",
    "hole": _hole("q", "r", "pid"),
    "split": f"(pid % 5 = 0 AND NOT {_hole('q', 'r', 'pid')})",
    "idx": "((q % 8) * 8 + r % 8) * 2",
}


def _mesh_sql() -> str:
    cell = ", ".join(f"{v} AS {k}" for k, v in _CELL.items())
    corner = [f"{{'x': c{i}x, 'y': c{i}y, 'z': c{i}z}}" for i in range(4)]
    places = ", ".join(f"{v} AS c{i}{k}" for i, c in enumerate(_CORNERS) for k, v in _vertex(*c).items())
    parts = " UNION ALL ".join(
        f"SELECT pid * 2 + {part} AS ref, tx AS x, ty AS y, CAST(CASE WHEN hole THEN 1 ELSE 0 END AS BIGINT) AS layer, CAST(idx + {part} AS BIGINT) AS idx, "
        f"[{', '.join(corner[i] for i in corners)}] AS corners, [{', '.join(neis)}] AS neis, flags, area FROM placed WHERE {condition}"
        for condition, part, corners, neis in _shapes()
    )
    return f"""ends AS (SELECT min(p_partkey) AS low, max(p_partkey) AS high FROM part),
      cells AS (SELECT pid, q, r, flags, area, w, low, high, {cell} FROM polys, size, ends), placed AS (SELECT *, {places} FROM cells), mesh AS ({parts}),
      edges AS (SELECT ref, x, y, layer, idx, e, neis[e + 1] AS nei, corners[e + 1] AS a, corners[(e + 1) % len(corners) + 1] AS b FROM (SELECT *, unnest(range(len(corners))) AS e FROM mesh)),
      boxes AS (SELECT *, list_min(list_transform(corners, lambda c: c.x)) AS lx, list_max(list_transform(corners, lambda c: c.x)) AS hx, list_min(list_transform(corners, lambda c: c.y)) AS ly,
        list_max(list_transform(corners, lambda c: c.y)) AS hy, list_min(list_transform(corners, lambda c: c.z)) AS lz, list_max(list_transform(corners, lambda c: c.z)) AS hz FROM mesh)"""


WORLD_SQL["mesh"] = _mesh_sql()


def mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").agg(F.min("p_partkey"), F.max("p_partkey"), F.ceil(F.sqrt(F.count("*")))).first()
    low, high, w = (int(v or 0) for v in p)
    cells = polys(spark, sf_dir).selectExpr("pid", "q", "r", "flags", "area", f"bigint({w}) AS w", f"bigint({low}) AS low", f"bigint({high}) AS high")
    cells = cells.selectExpr("*", *(f"{v} AS {k}" for k, v in _CELL.items()))
    corner = [F.struct(*(F.expr(v).alias(k) for k, v in _vertex(*c).items())) for c in _CORNERS]
    parts = []
    for condition, part, corners, neis in _shapes():
        polygon = F.struct((F.col("pid") * 2 + part).alias("ref"), (F.col("idx") + part).cast("long").alias("idx"), F.array(*(corner[i] for i in corners)).alias("corners"), F.array(*map(F.expr, neis)).alias("neis"))
        parts.append(F.when(F.expr(condition), polygon))
    t = cells.select("flags", "area", F.col("tx").alias("x"), F.col("ty").alias("y"), F.when(F.col("hole"), 1).otherwise(0).cast("long").alias("layer"), F.explode(F.array_compact(F.array(*parts))).alias("p"))
    return t.select("p.ref", "x", "y", "layer", "p.idx", "p.corners", "p.neis", "flags", "area", F.lit(0).cast("long").alias("ptype"), F.lit(CLIMB).alias("climb"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    place = lambda k: ((F.col("event_id") * k) % SPAN).cast("double") - 17066.0 + 0.25
    return e.select("event_id", place(7919).alias("wx"), place(104729).alias("wy"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    place = lambda k: ((F.col("o_orderkey") * k) % SPAN).cast("double") - 17066.0 + 0.25
    near = lambda c, k: F.greatest(F.lit(-17066.0), F.least(F.lit(17066.0), F.col(c) + ((F.col("c") * k) % 1201).cast("double") - 600.0))
    o = o.select(F.col("o_orderkey").alias("pair_id"), F.col("o_custkey").alias("c"), place(7919).alias("x1"), place(104729).alias("y1"))
    return o.select("pair_id", "x1", "y1", near("x1", 31).alias("x2"), near("y1", 17).alias("y2"))


def width(spark: SparkSession, sf_dir: str) -> int:
    """Cells in a row of the lattice."""
    return int(table(spark, sf_dir, "part").agg(F.ceil(F.sqrt(F.count("*")))).first()[0] or 1)


def polys(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = width(spark, sf_dir)
    p = table(spark, sf_dir, "part")
    pid = F.col("p_partkey")
    return p.select(
        pid.alias("pid"),
        F.floor(pid / w).cast("long").alias("r"),
        (pid % w).alias("q"),
        F.col("p_size").cast("long").alias("flags"),
        (F.col("p_size") % 4).cast("long").alias("area"),
        F.when(F.col("p_partkey") % 23 == 0, 1).otherwise(0).cast("long").alias("ptype"),
        (F.col("p_retailprice") / 100.0).alias("y"),
    )
