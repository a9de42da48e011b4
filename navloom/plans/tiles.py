"""Tiles, covers, shards, manifests and inventories: projections, filters and joins on the file grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from navloom.functions import geometry as g
from navloom.operators.tiles import cover, inventory, present, store_counts
from navloom.plans.base import query
from navloom.session import table
from navloom.sources.world import pairs, points

_TILE = "cast(floor(32.0 - {0} / 533.33333) AS BIGINT)"
TX, TY = _TILE.format("wx"), _TILE.format("wy")
_COVER = """cover AS (SELECT DISTINCT pair_id, tx, ty FROM (SELECT pair_id, unnest(range(greatest(a1 - {p}, 0), least(a2 + {p}, 63) + 1)) AS tx, b1, b2 FROM (
    SELECT pair_id, least(ta, tc) AS a1, greatest(ta, tc) AS a2, least(tb, td) AS b1, greatest(tb, td) AS b2 FROM (
    SELECT pair_id, cast(floor(32.0 - x1 / 533.33333) AS BIGINT) AS ta, cast(floor(32.0 - y1 / 533.33333) AS BIGINT) AS tb,
      cast(floor(32.0 - x2 / 533.33333) AS BIGINT) AS tc, cast(floor(32.0 - y2 / 533.33333) AS BIGINT) AS td FROM pairs)
    WHERE least(ta, tb, tc, td) >= 0 AND greatest(ta, tb, tc, td) <= 63)), LATERAL (SELECT unnest(range(greatest(b1 - {p}, 0), least(b2 + {p}, 63) + 1)) AS ty))"""
#: tiles that exist: terrain for customers' tiles, navigation for parts'
_NAV = "nav AS (SELECT DISTINCT (p_partkey * 7) % 64 AS tx, (p_partkey * 13 + p_size) % 64 AS ty FROM part)"
_TERRAIN = "terrain AS (SELECT DISTINCT (c_custkey * 5) % 64 AS tx, (c_custkey * 11) % 64 AS ty FROM customer)"


def nav_tiles(spark, d) -> DataFrame:
    return table(spark, d, "part").select(((F.col("p_partkey") * 7) % 64).alias("tx"), ((F.col("p_partkey") * 13 + F.col("p_size")) % 64).alias("ty")).distinct()


def terrain_tiles(spark, d) -> DataFrame:
    return table(spark, d, "customer").select(((F.col("c_custkey") * 5) % 64).alias("tx"), ((F.col("c_custkey") * 11) % 64).alias("ty")).distinct()


@query(f"SELECT event_id, {TX} AS tx, {TY} AS ty, {TX} BETWEEN 0 AND 63 AND {TY} BETWEEN 0 AND 63 AS in_grid FROM points", ("points",))
def world_to_tile(spark, d):
    tx, ty = g.tile_of("wx"), g.tile_of("wy")
    return points(spark, d).select("event_id", tx.alias("tx"), ty.alias("ty"), g.in_grid(tx, ty).alias("in_grid"))


@query(f"SELECT event_id, {TX} * 65536 + {TY} AS packed, {TX} * 64 + {TY} + 1 AS tile_key FROM points", ("points",))
def pack_tile(spark, d):
    t = points(spark, d).select("event_id", g.tile_of("wx").alias("tx"), g.tile_of("wy").alias("ty"))
    return t.select("event_id", g.packed_tile("tx", "ty").alias("packed"), g.tile_key("tx", "ty").alias("tile_key"))


@query("SELECT event_id, wy AS x, value AS y, wx AS z FROM points JOIN (SELECT event_id AS i, value FROM events) ON i = event_id", ("points",))
def axis_swap(spark, d):
    e = table(spark, d, "events").select("event_id", "value")
    return points(spark, d).join(e, "event_id").select("event_id", F.col("wy").alias("x"), F.col("value").alias("y"), F.col("wx").alias("z"))


@query(f"WITH {_COVER.format(p=0)} SELECT * FROM cover", ("pairs",))
def tile_cover(spark, d):
    return cover(pairs(spark, d), 0)


@query(f"WITH {_COVER.format(p=1)} SELECT * FROM cover", ("pairs",))
def tile_cover_padded(spark, d):
    return cover(pairs(spark, d), 1)


@query("SELECT event_id, cast(floor((wy + 17066.0) / 300.0) AS BIGINT) AS mesh_tx, cast(floor((wx + 17066.0) / 300.0) AS BIGINT) AS mesh_ty FROM points", ("points",))
def mesh_tile_location(spark, d):
    return points(spark, d).select("event_id", g.mesh_tile("wy", -17066.0, 300.0).alias("mesh_tx"), g.mesh_tile("wx", -17066.0, 300.0).alias("mesh_ty"))


@query(
    f"WITH {_NAV}, s(side, dx, dy) AS (VALUES (0,1,0),(1,1,1),(2,0,1),(3,-1,1),(4,-1,0),(5,-1,-1),(6,0,-1),(7,1,-1)) "
    "SELECT tx, ty, side::BIGINT AS side, ((side + 4) & 7)::BIGINT AS opposite, tx + dx AS ntx, ty + dy AS nty FROM nav, s WHERE tx + dx BETWEEN 0 AND 63 AND ty + dy BETWEEN 0 AND 63"
)
def neighbour_tiles(spark, d):
    sides = F.inline(F.array(*(F.struct(F.lit(s).cast("long").alias("side"), F.lit(x).cast("long").alias("dx"), F.lit(y).cast("long").alias("dy")) for s, x, y in g.SIDES)))
    n = nav_tiles(spark, d).select("tx", "ty", sides)
    n = n.select("tx", "ty", "side", g.opposite("side").alias("opposite"), (F.col("tx") + F.col("dx")).alias("ntx"), (F.col("ty") + F.col("dy")).alias("nty"))
    return n.where(g.in_grid(F.col("ntx"), F.col("nty")))


@query(f"WITH {_NAV} SELECT tx, ty, round((32.0::DOUBLE - (tx + 0.5)) * 533.33333, 6)::DOUBLE AS cx, round((32.0::DOUBLE - (ty + 0.5)) * 533.33333, 6)::DOUBLE AS cy, trunc((32.0 - (tx + 0.5)) * 533.33333 + 10)::BIGINT AS dest_x, trunc((32.0 - (ty + 0.5)) * 533.33333 + 10)::BIGINT AS dest_y FROM nav")
def tile_centre(spark, d):
    t = nav_tiles(spark, d)
    cx, cy = g.tile_centre("tx"), g.tile_centre("ty")
    return t.select("tx", "ty", F.round(cx, 6).alias("cx"), F.round(cy, 6).alias("cy"), (cx + 10).cast("long").alias("dest_x"), (cy + 10).cast("long").alias("dest_y"))


@query(
    f"WITH {_NAV} SELECT n_nationkey::BIGINT AS map_id, tx, ty, printf('mmaps/%03d.mmap', n_nationkey) AS params_path, "
    "printf('mmaps/%03d%02d%02d.mmtile', n_nationkey, tx, ty) AS tile_path, printf('maps/%03d%02d%02d.map', n_nationkey, tx, ty) AS terrain_path FROM nav JOIN nation ON n_nationkey = (tx + ty) % 25"
)
def tile_paths(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("map_id"))
    t = nav_tiles(spark, d).join(n, (F.col("tx") + F.col("ty")) % 25 == F.col("map_id"))
    path = lambda f: F.format_string(f, "map_id", "tx", "ty")
    return t.select("map_id", "tx", "ty", F.format_string("mmaps/%03d.mmap", "map_id").alias("params_path"), path("mmaps/%03d%02d%02d.mmtile").alias("tile_path"), path("maps/%03d%02d%02d.map").alias("terrain_path"))


@query(f"WITH {_NAV} SELECT tx, ty, tx // 8 AS sx, ty // 8 AS sy, printf('s%02d_%02d', tx // 8, ty // 8) AS shard FROM nav")
def shard_id(spark, d):
    t = nav_tiles(spark, d).select("tx", "ty", g.shard("tx").alias("sx"), g.shard("ty").alias("sy"))
    return t.withColumn("shard", F.format_string("s%02d_%02d", "sx", "sy"))


@query("SELECT pair_id, greatest(abs(x1 * 1.01), abs(y1), abs(x2), abs(y2)) <= 17066.666 AS ok FROM pairs", ("pairs",))
def bounds_reject(spark, d):
    return pairs(spark, d).select("pair_id", g.in_world(F.col("x1") * 1.01, "y1", "x2", "y2").alias("ok"))


@query("SELECT event_id, ts FROM events WHERE isfinite(value / nullif(value - 0.0, 0)) AND value < 'infinity'::DOUBLE")
def finite_check(spark, d):
    e = table(spark, d, "events")
    ratio = F.try_divide(F.col("value"), F.col("value"))
    return e.where(ratio.isNotNull() & ~F.isnan(ratio) & (F.col("value") < F.lit(float("inf")))).select("event_id", "ts")


@query(f"WITH {_COVER.format(p=0)}, {_NAV} SELECT pair_id, cover.tx, cover.ty, tx * 64 + ty + 1 AS tile_key FROM cover JOIN nav USING (tx, ty)", ("pairs",))
def tile_load(spark, d):
    return cover(pairs(spark, d), 0).join(nav_tiles(spark, d), ["tx", "ty"]).select("pair_id", "tx", "ty", g.tile_key("tx", "ty").alias("tile_key"))


@query(f"WITH {_COVER.format(p=1)}, {_TERRAIN}, req AS (SELECT DISTINCT tx, ty FROM cover) SELECT printf('maps/000%02d%02d.map', tx, ty) AS path, t.tx IS NOT NULL AS present FROM req LEFT JOIN terrain t USING (tx, ty)", ("pairs",))
def manifest_present(spark, d):
    need = cover(pairs(spark, d), 1).select("tx", "ty").distinct()
    return present(need, terrain_tiles(spark, d)).select(F.format_string("maps/000%02d%02d.map", "tx", "ty").alias("path"), "present")


@query(f"WITH {_COVER.format(p=0)}, {_NAV} SELECT DISTINCT tx, ty FROM cover WHERE NOT EXISTS (SELECT 1 FROM nav WHERE nav.tx = cover.tx AND nav.ty = cover.ty)", ("pairs",))
def pending_tiles(spark, d):
    return cover(pairs(spark, d), 0).select("tx", "ty").distinct().join(nav_tiles(spark, d), ["tx", "ty"], "left_anti")


@query(f"WITH {_NAV}, {_TERRAIN} SELECT tx, ty FROM nav SEMI JOIN terrain USING (tx, ty)")
def require_terrain(spark, d):
    return nav_tiles(spark, d).join(terrain_tiles(spark, d), ["tx", "ty"], "left_semi")


@query(f"WITH {_NAV}, {_TERRAIN} SELECT DISTINCT tx // 8 AS sx, ty // 8 AS sy FROM (FROM nav UNION ALL FROM terrain)")
def shard_union(spark, d):
    both = nav_tiles(spark, d).union(terrain_tiles(spark, d))
    return both.select(g.shard("tx").alias("sx"), g.shard("ty").alias("sy")).distinct()


@query(f"WITH {_NAV} SELECT tx // 8 AS sx, ty // 8 AS sy, count(*) AS n, min(tx * 64 + ty + 1) AS first_key, max(tx * 64 + ty + 1) AS last_key FROM nav GROUP BY 1, 2")
def tiles_by_shard(spark, d):
    t = nav_tiles(spark, d).select(g.shard("tx").alias("sx"), g.shard("ty").alias("sy"), g.tile_key("tx", "ty").alias("k"))
    return t.groupBy("sx", "sy").agg(F.count("*").alias("n"), F.min("k").alias("first_key"), F.max("k").alias("last_key"))


@query(
    f"WITH {_NAV}, {_TERRAIN}, t AS (SELECT tx, ty, 'nav' AS kind FROM nav UNION ALL SELECT tx, ty, 'terrain' FROM terrain) "
    "SELECT tx // 8 AS sx, ty // 8 AS sy, count(*) FILTER (kind = 'nav') AS nav, count(*) FILTER (kind = 'terrain') AS terrain FROM t GROUP BY 1, 2"
)
def shard_counts(spark, d):
    kinds = nav_tiles(spark, d).withColumn("kind", F.lit("nav")).union(terrain_tiles(spark, d).withColumn("kind", F.lit("terrain")))
    return store_counts(kinds)


@query(f"WITH {_COVER.format(p=0)} SELECT tx, ty, count(DISTINCT pair_id) AS n_pairs FROM cover GROUP BY 1, 2", ("pairs",))
def distinct_tiles(spark, d):
    return cover(pairs(spark, d), 0).groupBy("tx", "ty").agg(F.countDistinct("pair_id").alias("n_pairs"))


@query(
    f"WITH {_NAV} SELECT path, kind, map_id, tx, ty FROM (SELECT printf('mmaps/%03d%02d%02d.mmtile', 1, tx, ty) AS path, 'nav' AS kind, 1::BIGINT AS map_id, tx, ty FROM nav "
    "UNION ALL SELECT DISTINCT printf('maps/%03d%02d%02d.map', 2, ty, tx), 'terrain', 2::BIGINT, ty, tx FROM nav UNION ALL SELECT 'mmaps/001.mmap', 'params', 1::BIGINT, NULL, NULL)"
)
def manifest_parse(spark, d):
    t = nav_tiles(spark, d)
    lines = t.select(F.format_string("  mmaps\\001%02d%02d.mmtile ", "tx", "ty").alias("value"))
    lines = lines.union(t.select(F.format_string("maps/002%02d%02d.map", "ty", "tx"))).union(spark.createDataFrame([("# comment",), ("",), ("mmaps/001.mmap",), ("   ",)], "value string"))
    return inventory(lines)


@query(f"WITH {_NAV}, s AS (SELECT tx, ty, tx * 64 + ty + 1 AS k, (tx * 31 + ty * 17) % 900 + 20 AS size FROM nav) SELECT tx // 8 AS sx, ty // 8 AS sy, k AS tile_key, size, (1 + coalesce(sum(size) OVER (PARTITION BY tx // 8, ty // 8 ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS offset_ FROM s")
def blob_offsets(spark, d):
    from navloom.operators.store import with_offsets

    t = nav_tiles(spark, d).select(g.shard("tx").alias("sx"), g.shard("ty").alias("sy"), g.tile_key("tx", "ty").alias("tile_key"), ((F.col("tx") * 31 + F.col("ty") * 17) % 900 + 20).alias("size"))
    return with_offsets(t, "size").withColumnRenamed("offset", "offset_")


@query(f"WITH {_NAV} SELECT tx, ty FROM nav ORDER BY (tx * 2654435761 + ty * 40503 + 7) % 1000003, tx, ty LIMIT 40")
def sample_tiles(spark, d):
    order = (F.col("tx") * F.lit(2654435761) + F.col("ty") * 40503 + 7) % 1000003
    return nav_tiles(spark, d).orderBy(order, "tx", "ty").limit(40)


@query(f"WITH {_NAV} SELECT row_number() OVER (ORDER BY path) AS place, path FROM (SELECT DISTINCT printf('maps/000%02d%02d.map', tx, ty) AS path FROM nav)")
def sorted_paths(spark, d):
    from navloom.operators.store import numbered

    return numbered(nav_tiles(spark, d).select(F.format_string("maps/000%02d%02d.map", "tx", "ty").alias("path")).distinct(), "path")


@query("""SELECT event_id, replace('C:\\data\\' || event_type || '\\' || event_id, '\\', '/') AS norm, substr(replace('C:\\data\\' || event_type || '\\' || event_id, '\\', '/'), 9) AS rel,
    lpad(hex(event_id), 8, '0') AS key, substr(event_type, 2, 3) AS part, printf('%.4f', round(value, 4)) AS shown FROM events""")
def path_strings(spark, d):
    raw = F.concat(F.lit("C:\\data\\"), "event_type", F.lit("\\"), F.col("event_id").cast("string"))
    norm = F.replace(raw, F.lit("\\"), F.lit("/"))
    rel = F.when(F.startswith(norm, F.lit("C:/data/")), F.expr("substr(replace(concat('C:/data/', event_type, '/', event_id), '\\\\', '/'), 9)")).otherwise(norm)
    return table(spark, d, "events").select("event_id", norm.alias("norm"), rel.alias("rel"), F.lpad(F.hex("event_id"), 8, "0").alias("key"), F.substring("event_type", 2, 3).alias("part"), F.format_string("%.4f", F.round("value", 4)).alias("shown"))
