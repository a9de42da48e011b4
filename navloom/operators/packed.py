"""Meshes of millions of polygons in a task's memory: numbers in arrays, from which the kernel's lists are made where a search comes by."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from navloom.operators import kernel

LINK_COLUMNS = ("src", "dst", "edge", "side", "bmin", "bmax")
_POINT = pa.struct([("x", pa.float64()), ("y", pa.float64()), ("z", pa.float64())])
POLYS = pa.schema([("ref", pa.int64()), ("corners", pa.list_(_POINT)), ("flags", pa.int64()), ("area", pa.int64()), ("ptype", pa.int64()), ("x", pa.int64()), ("y", pa.int64())])
LINKS = pa.schema([(c, pa.int64() if c in ("src", "dst") else pa.int32()) for c in LINK_COLUMNS])
WAYS = [("to", np.int32), ("node", np.int32), ("x", np.float64), ("y", np.float64), ("z", np.float64), ("crosses", bool)]
#: rows of a mesh that are kept as lists; all go when they are so many
KEPT = 20_000
#: polygons up to which a mesh has the ways of all in arrays (some 120 bytes a polygon); beyond, those of SOME polygons are made together
WITH_WAYS = 400_000
SOME = 256
#: rounds after which connected groups of polygons stay as found; they only tell in which order pairs are searched
_ROUNDS = 40
#: packed tables that are unpacked together
_AT_ONCE = 512


class _Made(dict):
    """As a list of n rows, each made by its number when asked for."""

    def __init__(self, make: Callable[[int], list], n: int):
        self.make, self.n = make, n

    def __len__(self) -> int:
        return self.n

    def __missing__(self, i: int) -> list:
        if dict.__len__(self) >= KEPT:
            self.clear()
        row = self[i] = self.make(i)
        return row


class _Index:
    """Places in sorted ids."""

    def __init__(self, ids: np.ndarray):
        self.ids = ids

    def get(self, pid: int) -> int | None:
        i = int(np.searchsorted(self.ids, pid))
        return i if i < len(self.ids) and self.ids[i] == pid else None

    def __getitem__(self, pid: int) -> int:
        if (i := self.get(pid)) is None:
            raise KeyError(pid)
        return i


def pack(rows: pa.Table, kind: pa.Schema) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, kind, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(rows.select(kind.names).cast(kind))
    return sink.getvalue().to_pybytes()


def unpack(column: pa.ChunkedArray, kind: pa.Schema) -> Iterator[pa.Table]:
    """What pack() made, some hundred rows of the column at a time; nulls have nothing."""
    some: list[pa.Table] = []
    for x in column:
        if x.is_valid:
            some.append(pa.ipc.open_stream(x.as_buffer()).read_all())
            if len(some) >= _AT_ONCE:
                yield pa.concat_tables(some)
                some = []
    yield pa.concat_tables([kind.empty_table(), *some])


def _narrow(v: np.ndarray) -> np.ndarray:
    """The same numbers in the smallest type that has them all."""
    kind = np.result_type(np.min_scalar_type(v.min()), np.min_scalar_type(v.max())) if len(v) else np.dtype(np.uint8)
    return v if kind.kind == "f" else v.astype(kind)


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    """One array; the parts are given up."""
    out = np.concatenate(parts)
    parts.clear()
    return out


def _ways(links: dict[str, np.ndarray], place: list[np.ndarray], first: np.ndarray, sides: np.ndarray, tile: np.ndarray) -> np.ndarray:
    """kernel.ways() of links that are in order, between polygons on the ground."""
    src, dst = links["src"], links["dst"]
    # The passage between two polygons is that of their first link.
    by = np.lexsort((np.arange(len(src)), dst, src))
    new = np.ones(len(by), bool)
    new[1:] = (src[by][1:] != src[by][:-1]) | (dst[by][1:] != dst[by][:-1])
    own = np.empty(len(by), np.int64)
    own[by] = by[new][np.cumsum(new) - 1]
    edge, side, low, high = (links[c][own] for c in ("edge", "side", "bmin", "bmax"))
    begin = first[src].astype(np.int64)
    a, b = begin + edge, begin + (edge + 1) % sides[src]
    whole = (side == kernel.INTERNAL) | ((low == 0) & (high == 255))
    out = np.empty(len(by), WAYS)
    for c, v in zip("xyz", place, strict=True):
        p, q = v[a], v[b]
        left, right = np.where(whole, p, p + (q - p) * (low / 255)), np.where(whole, q, p + (q - p) * (high / 255))
        out[c] = left + (right - left) * 0.5
    out["to"], out["crosses"] = dst, (tile[src] != tile[dst]).any(1)
    out["node"] = dst.astype(np.int64) << 7 | np.where(links["side"] == kernel.INTERNAL, 0, links["side"] >> 1)
    return out


def _groups(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The smallest polygon of each one's connected group; in a mesh that takes over _ROUNDS rounds, of a part of it."""
    out = np.arange(n, dtype=np.int32)
    for _ in range(_ROUNDS):
        low = out.copy()
        np.minimum.at(low, dst, out[src])
        np.minimum.at(low, src, out[dst])
        low = low[low]
        if np.array_equal(low, out):
            break
        out = low
    return out


def _links_of(polys: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(polygon, place in the table) of each link of some polygons, in order."""
    n = (stop[polys] - begin[polys]).astype(np.int64)
    src = np.repeat(polys, n)
    return src, np.repeat((begin[polys] - (np.cumsum(n) - n)).astype(np.int32), n) + np.arange(len(src), dtype=np.int32)


def _rows(table: np.ndarray, begin: np.ndarray, stop: np.ndarray, place: list[np.ndarray], first: np.ndarray, sides: np.ndarray, tile: np.ndarray, flags: np.ndarray, area: np.ndarray, group: np.ndarray) -> Callable[[int, kernel.Filter], dict[int, tuple[int, list]]]:
    """kernel.Mesh.rows: the polygons go by group and tile, SOME together."""
    order = np.lexsort((tile[:, 1], tile[:, 0], group)).astype(np.int32)
    position = np.empty(len(order), np.int32)
    position[order] = np.arange(len(order), dtype=np.int32)

    def rows(here: int, rules: kernel.Filter) -> dict[int, tuple[int, list]]:
        k = int(position[here]) // SOME * SOME
        own = order[k : k + SOME]
        src, at = _links_of(own, begin, stop)
        links = {c: table[c][at].astype(np.int32) for c in LINK_COLUMNS[1:]} | {"src": src}
        to = flags[links["dst"]].astype(np.int64)
        passes = (to & rules.include != 0) & (to & rules.exclude == 0)
        out = _ways(links, place, first, sides, tile)[passes].tolist()
        cuts = np.concatenate([[0], np.cumsum(passes)])[np.concatenate([[0], np.cumsum(stop[own] - begin[own])])].tolist()
        return {i: (a, out[x:y]) for i, a, x, y in zip(own.tolist(), area[own].tolist(), cuts, cuts[1:], strict=False)}

    return rows


def mesh_of(polys: Iterable[pa.Table], links: Iterable[pa.Table]) -> kernel.Mesh:
    """A mesh from tables of POLYS and of LINKS. Of repeated polygons the last counts, repeated links are one; links go by edge, then by target.

    All links of a polygon are in one of the tables; of several with links of it the last counts.
    """
    numbers: dict[str, list[np.ndarray]] = {c: [] for c in POLYS.names if c != "corners"}
    sizes: list[np.ndarray] = []
    places: dict[str, list[np.ndarray]] = {k: [] for k in "xyz"}
    for t in polys:
        t = t.select(POLYS.names).cast(POLYS)
        for c, parts in numbers.items():
            v = t[c].fill_null(0).to_numpy()
            parts.append(v.copy() if c == "ref" else _narrow(v))
        corners = t["corners"].combine_chunks()
        sizes.append(pc.fill_null(pc.list_value_length(corners), 0).to_numpy(zero_copy_only=False).copy())
        for parts, v in zip(places.values(), corners.flatten().flatten(), strict=True):
            parts.append(np.array(v.to_numpy(zero_copy_only=False)))
        del t, corners, v
    refs, size = _joined(numbers.pop("ref")), _joined(sizes)
    place = [_joined(parts) for parts in places.values()]
    ids, last = np.unique(refs[::-1], return_index=True)
    order = len(refs) - 1 - last
    at = np.zeros(len(refs) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    first, end = _narrow(at[order]), _narrow(at[order + 1])
    flags, area, kind, x, y = (_joined(numbers[c])[order] for c in ("flags", "area", "ptype", "x", "y"))
    seen: dict[tuple[int, int], tuple[int, int]] = {}
    tile = [seen.setdefault(xy, xy) for xy in zip(memoryview(x), memoryview(y), strict=True)]
    tile_of = np.stack([x.astype(np.int64), y.astype(np.int64)], 1).astype(np.int32)
    del refs, size, last, order, at, x, y

    rows: list[np.ndarray] = [np.zeros(0, [(c, np.uint8) for c in LINK_COLUMNS[1:]])]
    # The ways stay in their parts, so they never take twice their place; part: that of each polygon.
    ways: list[np.ndarray] = [np.zeros(0, WAYS)]
    before, part, sides, plain = [0], np.zeros(len(ids), np.int32), end - first, not np.any(kind == kernel.OFFMESH)
    few = len(ids) <= WITH_WAYS
    begin, stop, total = np.zeros(len(ids), np.int32), np.zeros(len(ids), np.int32), 0
    for t in links:
        own = {c: v.to_numpy() for c, v in zip(LINKS.names, t.select(LINKS.names).cast(LINKS).columns, strict=True)}
        known = np.full(t.num_rows, len(ids) > 0)
        for c in ("src", "dst") if len(ids) else ():
            i = np.searchsorted(ids, own[c])
            known &= ids.take(i, mode="clip") == own[c]
            own[c] = i
        own = {c: v[known] for c, v in own.items()}
        by = np.lexsort([own[c] for c in ("bmax", "bmin", "side", "dst", "edge", "src")])
        own = {c: v[by] for c, v in own.items()}
        fresh = np.ones(len(by), bool)
        fresh[1:] = np.logical_or.reduce([v[1:] != v[:-1] for v in own.values()])
        own = {c: v[fresh] for c, v in own.items()}
        plain = plain and not np.any((own["edge"] < 0) | (own["edge"] >= sides[own["src"]]) | (own["side"] < 0) | (own["side"] > 255))
        if plain and few:
            part[own["src"]] = len(ways)
            before.append(total)
            ways.append(_ways(own, place, first, sides, tile_of))
        own = {c: _narrow(v) for c, v in own.items()}
        src, n = np.unique(own["src"], return_counts=True)
        stop[src] = total + np.cumsum(n)
        begin[src] = stop[src] - n
        total += len(own["src"])
        table = np.empty(len(own["src"]), [(c, own[c].dtype) for c in LINK_COLUMNS[1:]])
        for c in table.dtype.names:
            table[c] = own[c]
        rows.append(table)
    table = _joined(rows)
    pa.default_memory_pool().release_unused()

    def way(i: int) -> list[tuple]:
        k = part[i]
        return ways[k][begin[i] - before[k] : stop[i] - before[k]].tolist()

    n = len(ids)
    rows_of = group = None
    if plain and not few:
        src, at = _links_of(np.arange(n, dtype=np.int32), begin, stop)
        group = _groups(n, src, table["dst"][at])
        del src, at
        rows_of = _rows(table, begin, stop, place, first, sides, tile_of, flags, area, group)
        with contextlib.suppress(OSError, AttributeError):  # of another C library
            ctypes.CDLL(None).malloc_trim(0)
    corners = _Made(lambda i: list(zip(*(v[first[i] : end[i]].tolist() for v in place), strict=True)), n)
    return kernel.Mesh(corners, memoryview(flags), memoryview(area), memoryview(kind), _Made(lambda i: table[begin[i] : stop[i]].tolist(), n), memoryview(ids), tile, _Index(ids), way if plain and few else None, rows_of, group)
