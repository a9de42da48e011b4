"""Files and stores: mesh and terrain bytes written and read back, variable-length numbers, indexes, literals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from navloom.functions import geometry as g
from navloom.plans.base import query
from navloom.plans.tiles import _NAV, nav_tiles
from navloom.session import ready, table
from navloom.sources import binary, blobs
from navloom.sources.world import mesh


@query("SELECT x, y, layer, idx AS pid, e AS edge, a.x::FLOAT::DOUBLE AS cx, a.y::FLOAT::DOUBLE AS cy, a.z::FLOAT::DOUBLE AS cz, nei::BIGINT AS nei, m.flags, m.area, 0.5::DOUBLE AS climb FROM edges JOIN (SELECT ref, flags, area FROM mesh) m USING (ref)", ("polys", "mesh"))
def nav_files(spark, d):
    """Every tile of the mesh as the bytes of a tile file, and the polygons that are read from them."""
    files = binary.encode_tiles(mesh(spark, d))
    t = binary.decode_polygons(files).select("x", "y", "layer", "pid", "climb", "flags", "area", "neis", F.posexplode("corners").alias("edge", "c"))
    return t.select("x", "y", "layer", "pid", F.col("edge").cast("long").alias("edge"), F.col("c.x").alias("cx"), F.col("c.y").alias("cy"), F.col("c.z").alias("cz"), F.get("neis", "edge").cast("long").alias("nei"), "flags", "area", "climb")


def _params(spark, d) -> DataFrame:
    """(map_id, content): a parameter file for each nation; every seventh is too short."""
    ready(spark)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, binary.encode_params((k / 3, -k, 0.5), 533.25, 533.25 + k, 64 * k, -1 if k % 2 else 1 << 20)) for k in batch.column(0).to_pylist()]
            yield pa.record_batch([pa.array([k for k, _ in rows], pa.int64()), pa.array([c[:20] if k % 7 == 0 else c for k, c in rows], pa.binary())], ["map_id", "content"])

    return table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("map_id")).mapInArrow(work, "map_id long, content binary")


@query("SELECT n_nationkey::BIGINT AS map_id, (n_nationkey / 3.0)::FLOAT::DOUBLE AS x, (0 - n_nationkey)::DOUBLE AS y, 533.25::DOUBLE AS tile_w, (533.25 + n_nationkey)::DOUBLE AS tile_h, (64 * n_nationkey)::BIGINT AS max_tiles, CASE WHEN n_nationkey % 2 = 1 THEN -1 ELSE 1048576 END::BIGINT AS max_polys FROM nation WHERE n_nationkey % 7 <> 0")
def param_files(spark, d):
    t = binary.decode_params_rows(_params(spark, d))
    return t.select("map_id", F.get("orig", F.lit(0)).alias("x"), F.get("orig", F.lit(1)).alias("y"), "tile_w", "tile_h", "max_tiles", "max_polys")


@query("SELECT n_nationkey::BIGINT AS map_id, CASE WHEN n_nationkey % 7 <> 0 THEN 64 * n_nationkey END::BIGINT AS max_tiles, CASE WHEN n_nationkey % 7 <> 0 THEN CASE WHEN n_nationkey % 2 = 1 THEN -1 ELSE 1048576 END END::BIGINT AS max_polys, CASE WHEN n_nationkey % 7 <> 0 THEN (64 * n_nationkey) % 256 END::BIGINT AS low_byte, CASE WHEN n_nationkey % 7 <> 0 THEN CASE WHEN n_nationkey % 2 = 1 THEN 65535 ELSE 0 END END::BIGINT AS low_word FROM nation")
def binary_numbers(spark, d):
    """Numbers read from bytes by columns alone."""
    c = F.col("content")
    return _params(spark, d).select("map_id", binary.number(c, 20, 4, True).alias("max_tiles"), binary.number(c, 24, 4, True).alias("max_polys"), binary.number(c, 20, 1).alias("low_byte"), binary.number(c, 24, 2).alias("low_word"))


@query(
    """SELECT n_nationkey::BIGINT AS tx, n_regionkey::BIGINT AS ty, ['flat', 'f32', 'u16', 'u8'][n_nationkey % 4 + 1] AS mode, CASE WHEN n_nationkey % 4 = 0 THEN 0 ELSE (SELECT sum((i * 7 + n_nationkey) % 200) FROM range(129 * 129) r(i)) END::DOUBLE AS sum9,
    CASE WHEN n_nationkey % 4 = 0 THEN 0 ELSE (SELECT sum((i * 3 + n_nationkey) % 200) FROM range(128 * 128) r(i)) END::DOUBLE AS sum8, (SELECT sum((i * 5 + n_nationkey) % 65536) FROM range(256) r(i))::BIGINT AS holes FROM nation"""
)
def terrain_files(spark, d):
    """A terrain file for each nation, in one of the four forms, and what is read from its bytes."""
    ready(spark)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k in batch.column(0).to_pylist():
                v9, v8, holes = (np.arange(129 * 129) * 7 + k) % 200, (np.arange(128 * 128) * 3 + k) % 200, (np.arange(256) * 5 + k) % 65536
                out.append(binary.encode_terrain(("flat", "f32", "u16", "u8")[k % 4], 0.0, 100.0, v9, v8, holes))
            yield pa.record_batch([pa.array([0] * len(out), pa.int64()), batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["map_id", "tx", "ty", "content"])

    files = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("tx"), F.col("n_regionkey").cast("long").alias("ty")).mapInArrow(work, "map_id long, tx long, ty long, content binary")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v)
    return binary.decode_terrain_rows(files).select("tx", "ty", "mode", total("v9").alias("sum9"), total("v8").alias("sum8"), F.aggregate("holes", F.lit(0).cast("long"), lambda s, v: s + v).alias("holes"))


@query("SELECT o_orderkey, n, list_reduce(list_prepend('', list_transform(list_filter(range(9), lambda i: i = 0 OR n >> (7 * i) > 0), lambda i: printf('%02X', (((n >> (7 * i)) & 127) << 1) | CASE WHEN n >> (7 * i + 7) > 0 THEN 1 ELSE 0 END))), lambda a, b: a || b) AS packed FROM (SELECT o_orderkey, o_orderkey * o_orderkey * 37 % 1000000007 AS n FROM orders)")
def variable_numbers(spark, d):
    """A number of each order in variable-length bytes, and as read back from them by columns."""
    ready(spark)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([blobs.put_number(n) for n in batch.column(1).to_pylist()], pa.binary())], ["o_orderkey", "data"])

    t = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") * F.col("o_orderkey") * 37 % 1000000007).alias("n")).mapInArrow(work, "o_orderkey long, data binary")
    return t.select("o_orderkey", blobs.get_number_sql("data").alias("n"), F.hex("data").alias("packed"))


@query(f"WITH {_NAV}, s AS (SELECT tx, ty, tx * 64 + ty + 1 AS k, (tx * 31 + ty * 17) % 900 + 20 AS size FROM nav), o AS (SELECT tx // 8 AS sx, ty // 8 AS sy, k, size, 1 + coalesce(sum(size) OVER (PARTITION BY tx // 8, ty // 8 ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM s), w AS (SELECT sx, sy, x * 64 + y + 1 AS k FROM (SELECT DISTINCT sx, sy FROM o), range(64) a(x), range(64) b(y) WHERE x // 8 = sx AND y // 8 = sy) SELECT sx, sy, k AS tile_key, place::BIGINT AS place, size::BIGINT AS length FROM w LEFT JOIN o USING (sx, sy, k)")
def index_lookup(spark, d):
    """An index of each shard's tiles, and what it answers for every key of the shard, also those that it does not hold."""
    from navloom.operators.store import with_offsets

    ready(spark)
    t = nav_tiles(spark, d).select(g.shard("tx").alias("sx"), g.shard("ty").alias("sy"), g.tile_key("tx", "ty").alias("tile_key"), ((F.col("tx") * 31 + F.col("ty") * 17) % 900 + 20).alias("size"))
    return blobs.look_up_all(blobs.indexes(with_offsets(t, "size").withColumnRenamed("offset", "place"), ["sx", "sy"]), ["sx", "sy"], g.SHARD)


@query("SELECT map_id, tile_key, octet_length(encode(b))::BIGINT AS size, sha256(b) AS digest FROM (SELECT 1::BIGINT AS map_id, tx * 64 + ty + 1 AS tile_key, repeat(chr((65 + tx % 26)::INT), (ty + 1)::INT) AS b FROM (SELECT DISTINCT (p_partkey * 7) % 64 AS tx, (p_partkey * 13 + p_size) % 64 AS ty FROM part))")
def shard_files(spark, d):
    """Tiles packed into shards with index and deflated blobs, and unpacked."""
    ready(spark)
    t = nav_tiles(spark, d)
    blob = F.expr("cast(repeat(char(cast(65 + tx % 26 as int)), cast(ty + 1 as int)) as binary)")
    t = t.select(F.lit(1).cast("long").alias("map_id"), g.shard("tx").alias("sx"), g.shard("ty").alias("sy"), F.lit("nav").alias("kind"), g.tile_key("tx", "ty").alias("tile_key"), blob.alias("blob"))
    back = blobs.import_shards(blobs.export_shards(t))
    return back.select("map_id", "tile_key", F.length("blob").cast("long").alias("size"), F.sha2("blob", 256).alias("digest"))


@query(r"""SELECT event_id, raw AS back, replace(replace(replace(replace(raw, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(13), '\r') AS literal FROM (SELECT event_id, props || chr(10) || '\' || event_type || chr(13) AS raw FROM events)""")
def literals(spark, d):
    """Texts escaped as string literals, and back."""
    ready(spark)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [blobs.escape(t.encode()) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array([blobs.unescape(x).decode() for x in out], pa.string()), pa.array([x.decode() for x in out], pa.string())], ["event_id", "back", "literal"])

    raw = F.concat("props", F.lit("\n\\"), "event_type", F.lit("\r"))
    return table(spark, d, "events").where(raw.isNotNull()).select("event_id", raw.alias("raw")).mapInArrow(work, "event_id long, back string, literal string")
