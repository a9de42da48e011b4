"""Readers of the binary mesh and terrain files, as DataFrames.

Files are found by Spark (any file system) as rows of path and content; their bytes are decoded in Arrow
batches through numpy record types, without copying. A file with a wrong magic or version, or one that
ends early, has no rows. All numbers are little-endian.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from navloom.operators.mesh import all_links
from navloom.session import ready

# Fixed values of the formats: magic numbers, versions, record layouts.
OUTER = np.dtype([("magic", "<u4"), ("dt_version", "<u4"), ("version", "<u4"), ("size", "<u4"), ("liquids", "<u4")])
OUTER_MAGIC, OUTER_VERSION = 0x4D4D4150, 8
PARAMS = np.dtype([("orig", "<f4", 3), ("tile_w", "<f4"), ("tile_h", "<f4"), ("max_tiles", "<i4"), ("max_polys", "<i4")])
_COUNTS = ("poly_count", "vert_count", "max_links", "detail_count", "detail_verts", "detail_tris", "bv_count", "offmesh_count")
HEADER = np.dtype(
    [("magic", "<i4"), ("version", "<i4"), ("x", "<i4"), ("y", "<i4"), ("layer", "<i4"), ("user", "<u4"), *((n, "<i4") for n in _COUNTS), ("offmesh_base", "<i4")]
    + [("height", "<f4"), ("radius", "<f4"), ("climb", "<f4"), ("bmin", "<f4", 3), ("bmax", "<f4", 3), ("bv_quant", "<f4")]
)
MESH_MAGIC, MESH_VERSION = 0x444E4156, 7
POLY = np.dtype([("first_link", "<u4"), ("verts", "<u2", 6), ("neis", "<u2", 6), ("flags", "<u2"), ("n", "u1"), ("area_type", "u1")])
DETAIL = np.dtype([("vert_base", "<u4"), ("tri_base", "<u4"), ("verts", "u1"), ("tris", "u1"), ("pad", "<u2")])
NODE = np.dtype([("bmin", "<u2", 3), ("bmax", "<u2", 3), ("i", "<i4")])
OFFMESH = np.dtype([("pos", "<f4", 6), ("rad", "<f4"), ("poly", "<u2"), ("flags", "u1"), ("side", "u1"), ("user", "<u4")])
LINK_BYTES = 16
TERRAIN_MAGIC, TERRAIN_VERSION, HEIGHT_MAGIC = 0x5350414D, 0x342E3173, 0x5447484D
FLAT, AS_U16, AS_U8 = 1, 2, 4
MASKS = 256


class Short(ValueError):
    """The bytes end before the records that they announce."""


def _take(data: bytes, at: int, kind, n: int) -> tuple[np.ndarray, int]:
    """n records, and the place after them, padded to four bytes."""
    kind = np.dtype(kind)
    size = kind.itemsize * n
    if n < 0 or at + size > len(data):
        raise Short
    return np.frombuffer(data, kind, n, at), at + (size + 3) // 4 * 4


def decode_params(data: bytes) -> np.void | None:
    try:
        return _take(data, 0, PARAMS, 1)[0][0]
    except Short:
        return None


def decode_mesh(data: bytes) -> dict | None:
    """The sections of a mesh tile: header, verts, polys, details, detail_verts, detail_tris, nodes, offmesh."""
    try:
        (h,), at = _take(data, 0, HEADER, 1)
        if h["magic"] != MESH_MAGIC or h["version"] != MESH_VERSION:
            return None
        out = {"header": h}
        out["verts"], at = _take(data, at, ("<f4", 3), int(h["vert_count"]))
        out["polys"], at = _take(data, at, POLY, int(h["poly_count"]))
        at += LINK_BYTES * int(h["max_links"])  # links are never trusted, they are built anew
        out["details"], at = _take(data, at, DETAIL, int(h["detail_count"]))
        out["detail_verts"], at = _take(data, at, ("<f4", 3), int(h["detail_verts"]))
        out["detail_tris"], at = _take(data, at, ("u1", 4), int(h["detail_tris"]))
        out["nodes"], at = _take(data, at, NODE, int(h["bv_count"]))
        out["offmesh"], at = _take(data, at, OFFMESH, int(h["offmesh_count"]))
        return out
    except Short:
        return None


def decode_tile_file(data: bytes) -> dict | None:
    """A mesh tile file: its outer header, then as many bytes as that says."""
    try:
        (h,), at = _take(data, 0, OUTER, 1)
    except Short:
        return None
    if h["magic"] != OUTER_MAGIC or h["version"] != OUTER_VERSION or at + int(h["size"]) > len(data):
        return None
    return decode_mesh(data[at : at + int(h["size"])])


def decode_terrain(data: bytes) -> dict | None:
    """mode, base, scale, v9, v8, holes of a terrain file."""
    try:
        head, _ = _take(data, 0, "<u4", 10)
        if head[0] != TERRAIN_MAGIC or head[1] != TERRAIN_VERSION:
            return None
        at, holes_at = int(head[4]), int(head[8])
        holes = _take(data, holes_at, "<u2", MASKS)[0] if holes_at else np.zeros(MASKS, "<u2")
        (magic, flags), at = _take(data, at, "<u4", 2)
        (low, high), at = _take(data, at, "<f4", 2)
        if magic != HEIGHT_MAGIC:
            return None
        if flags & FLAT:
            return {"mode": "flat", "base": float(low), "scale": 1.0, "v9": [], "v8": [], "holes": holes.tolist()}
        mode, kind, steps = ("u16", "<u2", 65535) if flags & AS_U16 else ("u8", "u1", 255) if flags & AS_U8 else ("f32", "<f4", 0)
        n9, n8 = 129 * 129, 128 * 128
        if at + np.dtype(kind).itemsize * (n9 + n8) > len(data):
            return None
        v9, v8 = np.frombuffer(data, kind, n9, at), np.frombuffer(data, kind, n8, at + np.dtype(kind).itemsize * n9)
        base, scale = (float(low), (float(high) - float(low)) / steps) if steps else (0.0, 1.0)
        return {"mode": mode, "base": base, "scale": scale, "v9": v9.astype(float).tolist(), "v8": v8.astype(float).tolist(), "holes": holes.tolist()}
    except Short:
        return None


def encode_params(orig: tuple[float, float, float], tile_w: float, tile_h: float, max_tiles: int, max_polys: int) -> bytes:
    """The bytes of a mesh parameter file."""
    p = np.zeros(1, PARAMS)
    p["orig"], p["tile_w"], p["tile_h"], p["max_tiles"], p["max_polys"] = orig, tile_w, tile_h, max_tiles, max_polys
    return p.tobytes()


def _section(records: np.ndarray) -> bytes:
    data = records.tobytes()
    return data + b"\0" * (-len(data) % 4)


def encode_tile(x: int, y: int, layer: int, climb: float, polys: list[dict]) -> bytes:
    """The bytes of a mesh tile file of polygons (corners, neis, flags, area, ptype) by number; numbers that are left out are polygons without corners."""
    h, p = np.zeros(1, HEADER), np.zeros(1 + max((r["idx"] for r in polys), default=-1), POLY)
    verts: list[tuple[float, float, float]] = []
    for r in polys:
        n = len(r["corners"])
        own = p[r["idx"]]
        own["verts"][:n], own["neis"][:n], own["n"] = range(len(verts), len(verts) + n), r["neis"], n
        own["flags"], own["area_type"] = r["flags"], r["area"] | r["ptype"] << 6
        verts += [(c["x"], c["y"], c["z"]) for c in r["corners"]]
    v = np.array(verts, "<f4").reshape(-1, 3)
    h["magic"], h["version"], h["x"], h["y"], h["layer"], h["climb"] = MESH_MAGIC, MESH_VERSION, x, y, layer, climb
    h["poly_count"], h["vert_count"], h["max_links"] = len(p), len(v), 1
    if len(v):
        h["bmin"], h["bmax"] = v.min(0), v.max(0)
    body = _section(h) + _section(v) + _section(p) + b"\0" * LINK_BYTES
    outer = np.zeros(1, OUTER)
    outer["magic"], outer["dt_version"], outer["version"], outer["size"] = OUTER_MAGIC, MESH_VERSION, OUTER_VERSION, len(body)
    return outer.tobytes() + body


def encode_tiles(polys: DataFrame) -> DataFrame:
    """(map_id, x, y, layer, content): a mesh tile file for each tile of polygons with idx; one task holds one tile, at most 65,536 corners."""
    ready(polys.sparkSession)

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        m, x, y, layer = (k.as_py() for k in key)
        content = encode_tile(x, y, layer, rows["climb"][0].as_py(), rows.select(["idx", "corners", "neis", "flags", "area", "ptype"]).to_pylist())
        return pa.table([[m], [x], [y], [layer], pa.array([content], pa.binary())], schema=pa.schema([("map_id", _I), ("x", _I), ("y", _I), ("layer", _I), ("content", pa.binary())]))

    polys = polys if "map_id" in polys.columns else polys.withColumn("map_id", F.lit(0).cast("long"))
    return polys.groupBy("map_id", "x", "y", "layer").applyInArrow(pack, "map_id long, x long, y long, layer long, content binary")


def encode_terrain(mode: str, low: float, high: float, v9: np.ndarray, v8: np.ndarray, holes: np.ndarray) -> bytes:
    """The bytes of a terrain file; heights are given as the mode stores them (none if flat)."""
    kind, flags = {"flat": ("u1", FLAT), "f32": ("<f4", 0), "u16": ("<u2", AS_U16), "u8": ("u1", AS_U8)}[mode]
    body = np.array([HEIGHT_MAGIC, flags], "<u4").tobytes() + np.array([low, high], "<f4").tobytes()
    if mode != "flat":
        body += v9.astype(kind).tobytes() + v8.astype(kind).tobytes()
    head = np.array([TERRAIN_MAGIC, TERRAIN_VERSION, 0, 0, 40, len(body), 0, 0, 40 + len(body), 2 * MASKS], "<u4")
    return head.tobytes() + body + holes.astype("<u2").tobytes()


def number(content, at: int, size: int, signed: bool = False):
    """A little-endian number of up to eight bytes at a place (from 0) of a binary column, as a column; null beyond the end.

    Eight bytes give the 64 bits as a signed number.
    """
    out, bad = F.lit(0).cast("long"), F.octet_length(content) < at + size
    for i in range(size):
        byte = F.conv(F.hex(F.substring(content, at + i + 1, 1)), 16, 10).cast("long")
        out = out.bitwiseOR(F.shiftleft(byte, 8 * i))
    if signed and size < 8:
        out = F.shiftright(F.shiftleft(out, 64 - 8 * size), 64 - 8 * size)
    return F.when(~bad, out)


def _files(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """(path, map_id, tx, ty, content) of the files whose names match; tx and ty are null for map-wide files."""
    ready(spark)
    f = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    number = lambda pattern: F.nullif(F.regexp_extract("path", pattern, 1), F.lit("")).cast("long")
    return f.select("path", number(r"/(\d{3})\d*\.").alias("map_id"), number(r"/\d{3}(\d{2})\d{2}\.").alias("tx"), number(r"/\d{5}(\d{2})\.").alias("ty"), "content")


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length) of all files below a folder; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")


def mesh_params(spark: SparkSession, folder: str) -> DataFrame:
    """(map_id, orig, tile_w, tile_h, max_tiles, max_polys) of the parameter files below a folder."""
    return decode_params_rows(_files(spark, folder, "*.mmap").select("map_id", "content"))


def decode_params_rows(files: DataFrame) -> DataFrame:
    """The same of files (map_id, content). A null content has no row."""
    schema = "map_id long, orig array<double>, tile_w double, tile_h double, max_tiles long, max_polys long"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(m, p) for m, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if c is not None and (p := decode_params(c)) is not None]
            yield pa.record_batch(
                [pa.array([m for m, _ in rows], pa.int64()), pa.array([p["orig"].astype(float).tolist() for _, p in rows], pa.list_(pa.float64()))]
                + [pa.array([float(p[n]) for _, p in rows], pa.float64()) for n in ("tile_w", "tile_h")]
                + [pa.array([int(p[n]) for _, p in rows], pa.int64()) for n in ("max_tiles", "max_polys")],
                ["map_id", "orig", "tile_w", "tile_h", "max_tiles", "max_polys"],
            )

    return files.select("map_id", "content").mapInArrow(work, schema)


_CORNER = pa.struct([("x", pa.float64()), ("y", pa.float64()), ("z", pa.float64())])
POLYS = "map_id long, x long, y long, layer long, pid long, climb double, corners array<struct<x:double,y:double,z:double>>, neis array<int>, flags long, area long, ptype long"
CONNECTIONS = "map_id long, x long, y long, layer long, con long, pid long, ax double, ay double, az double, bx double, by double, bz double, rad double, bidir boolean, side long, user long"
DETAILS = "map_id long, x long, y long, layer long, pid long, tri long, a struct<x:double,y:double,z:double>, b struct<x:double,y:double,z:double>, c struct<x:double,y:double,z:double>, edge_flags long"


def _points(rows: np.ndarray) -> list[dict]:
    return [{"x": float(x), "y": float(y), "z": float(z)} for x, y, z in rows]


def _poly_rows(m: int, t: dict) -> Iterator[tuple]:
    h = t["header"]
    for i, p in enumerate(t["polys"]):
        n = int(p["n"])
        yield m, int(h["x"]), int(h["y"]), int(h["layer"]), i, float(h["climb"]), _points(t["verts"][p["verts"][:n]]), p["neis"][:n].astype(int).tolist(), int(p["flags"]), int(p["area_type"]) & 63, int(p["area_type"]) >> 6


def _connection_rows(m: int, t: dict) -> Iterator[tuple]:
    h = t["header"]
    for i, c in enumerate(t["offmesh"]):
        yield m, int(h["x"]), int(h["y"]), int(h["layer"]), i, int(c["poly"]), *map(float, c["pos"]), float(c["rad"]), bool(c["flags"] & 1), int(c["side"]), int(c["user"])


def _detail_rows(m: int, t: dict) -> Iterator[tuple]:
    """Triangles' corners: below the polygon's own corners its corner, else a detail vertex."""
    h = t["header"]
    for i, d in enumerate(t["details"]):
        p = t["polys"][i]
        n = int(p["n"])
        for k in range(int(d["tris"])):
            *abc, flags = t["detail_tris"][int(d["tri_base"]) + k].tolist()
            at = np.array([t["verts"][p["verts"][j]] if j < n else t["detail_verts"][int(d["vert_base"]) + j - n] for j in abc])
            yield m, int(h["x"]), int(h["y"]), int(h["layer"]), i, k, *_points(at), flags


def _tiles(files: DataFrame, schema: str, rows_of, kinds: list) -> DataFrame:
    names = [x.strip().split()[0] for x in schema.replace("<x:double,y:double,z:double>", "").split(",")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for m, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                t = decode_tile_file(content) if content is not None else None
                rows = list(rows_of(m, t)) if t is not None else []
                if rows:
                    yield pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return files.select("map_id", "content").mapInArrow(work, schema)


_I, _F = pa.int64(), pa.float64()


def polygons(spark: SparkSession, folder: str, glob: str = "*.mmtile") -> DataFrame:
    """POLYS of the mesh tile files whose names match."""
    return decode_polygons(_files(spark, folder, glob))


def decode_polygons(files: DataFrame) -> DataFrame:
    """POLYS of mesh tile files (map_id, content). A null content has no rows."""
    return _tiles(files, POLYS, _poly_rows, [_I] * 5 + [_F, pa.list_(_CORNER), pa.list_(pa.int32()), _I, _I, _I])


def connections(spark: SparkSession, folder: str) -> DataFrame:
    """CONNECTIONS of all mesh tile files."""
    return _tiles(_files(spark, folder, "*.mmtile"), CONNECTIONS, _connection_rows, [_I] * 6 + [_F] * 7 + [pa.bool_(), _I, _I])


def details(spark: SparkSession, folder: str) -> DataFrame:
    """DETAILS of all mesh tile files."""
    return _tiles(_files(spark, folder, "*.mmtile"), DETAILS, _detail_rows, [_I] * 6 + [_CORNER] * 3 + [_I])


def terrain(spark: SparkSession, folder: str, glob: str = "*.map") -> DataFrame:
    """(map_id, tx, ty, mode, base, scale, v9, v8, holes) of the terrain files whose names match."""
    return decode_terrain_rows(_files(spark, folder, glob))


def decode_terrain_rows(files: DataFrame) -> DataFrame:
    """The same of files (map_id, tx, ty, content). A null content has no row."""
    schema = "map_id long, tx long, ty long, mode string, base double, scale double, v9 array<double>, v8 array<double>, holes array<int>"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for m, x, y, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                t = decode_terrain(content) if content is not None else None
                if t is not None:
                    kinds = (_I, _I, _I, pa.string(), _F, _F, pa.list_(_F), pa.list_(_F), pa.list_(pa.int32()))
                    yield pa.record_batch([pa.array([v], k) for v, k in zip((m, x, y, *t.values()), kinds, strict=True)], ["map_id", "tx", "ty", *t])

    return files.select("map_id", "tx", "ty", "content").mapInArrow(work, schema)


# --- links between decoded tiles --------------------------------------------------------------


def tile_links(polys: DataFrame) -> DataFrame:
    """(map_id, src, dst, edge, side, bmin, bmax) between decoded polygons; src and dst are structs (x, y, layer, pid)."""
    return all_links(polys.withColumn("ref", F.struct("x", "y", "layer", "pid")).withColumn("idx", F.col("pid")))


NODES = "map_id long, x long, y long, layer long, bmin array<int>, bmax array<int>, i long"


def _node_rows(m: int, t: dict) -> Iterator[tuple]:
    h = t["header"]
    for n in t["nodes"]:
        yield m, int(h["x"]), int(h["y"]), int(h["layer"]), n["bmin"].astype(int).tolist(), n["bmax"].astype(int).tolist(), int(n["i"])


def nodes(spark: SparkSession, folder: str) -> DataFrame:
    """NODES of all mesh tile files: the box tree in pre-order; i is the polygon of a leaf, or minus how many nodes to skip."""
    return _tiles(_files(spark, folder, "*.mmtile"), NODES, _node_rows, [_I] * 4 + [pa.list_(pa.int32())] * 2 + [_I])
