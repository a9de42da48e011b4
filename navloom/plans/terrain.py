"""Terrain heights of the events' points over synthetic terrain tiles of all four encodings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from navloom.operators.terrain import heights, with_sentinel
from navloom.plans.base import query, r6
from navloom.plans.tiles import _TERRAIN, terrain_tiles
from navloom.sources.world import points


def terrain(spark, d) -> DataFrame:
    t = terrain_tiles(spark, d)
    mode = F.col("tx") % 4
    name = F.element_at(F.array(*map(F.lit, ("flat", "f32", "u8", "u16"))), (mode + 1).cast("int"))
    seed = F.col("tx") * 7 + F.col("ty") * 3

    def raw(n: int, a: int, b: int):
        def value(i):
            x = F.floor(i / n).cast("long") * a + (i % n) * b + seed
            return F.when(mode == 1, (x % 97) / 4.0).when(mode == 2, (x % 256).cast("double")).otherwise(((x * 257) % 65536).cast("double"))

        return F.transform(F.sequence(F.lit(0), F.lit(n * n - 1)), value)

    base = (F.col("tx") - F.col("ty")).cast("double")
    scale = F.when(mode == 2, F.lit(50.0 / 255)).when(mode == 3, F.lit(50.0 / 65535)).otherwise(F.lit(1.0))
    holes = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.when((i + F.col("tx")) % 5 == 0, 0x0821).otherwise(0))
    return t.select("tx", "ty", name.alias("mode"), F.when(mode == 1, F.lit(0.0)).otherwise(base).alias("base"), scale.alias("scale"), raw(129, 31, 17).alias("v9"), raw(128, 13, 29).alias("v8"), holes.alias("holes"))


def _v(n: str, a: int, b: int, r: str, c: str) -> str:
    x = f"(({r}) * {a} + ({c}) * {b} + tx * 7 + ty * 3)"
    return f"CASE m WHEN 1 THEN ({x} % 97) / 4.0::DOUBLE WHEN 2 THEN ({x} % 256)::DOUBLE ELSE (({x} * 257) % 65536)::DOUBLE END"


_SQL = f"""WITH {_TERRAIN}, p AS (SELECT event_id, cast(floor(32.0 - wx / 533.33333) AS BIGINT) AS tx, cast(floor(32.0 - wy / 533.33333) AS BIGINT) AS ty, (32.0::DOUBLE - wx / 533.33333) * 128.0 AS fx, (32.0::DOUBLE - wy / 533.33333) * 128.0 AS fy FROM points),
    c AS (SELECT p.*, t.tx IS NOT NULL AS there, p.tx % 4 AS m, cast(floor(fx) AS BIGINT) & 127 AS r, cast(floor(fy) AS BIGINT) & 127 AS c, fx - floor(fx) AS u, fy - floor(fy) AS v FROM p LEFT JOIN terrain t USING (tx, ty)),
    h AS (SELECT *, {_v('v9', 31, 17, 'r', 'c')} AS h1, {_v('v9', 31, 17, 'r + 1', 'c')} AS h2, {_v('v9', 31, 17, 'r', 'c + 1')} AS h3, {_v('v9', 31, 17, 'r + 1', 'c + 1')} AS h4, 2.0 * ({_v('v8', 13, 29, 'r', 'c')}) AS h5,
      m <> 0 AND (((r // 8) * 16 + c // 8 + tx) % 5 = 0) AND ((2081 & (4369 << ((c % 8) // 2)) & (15 << (4 * ((r % 8) // 2)))) <> 0) AS hole FROM c),
    k AS (SELECT event_id, CASE WHEN there THEN ['flat', 'f32', 'u8', 'u16'][m + 1] END AS mode, there AND hole AS hole, CASE WHEN NOT there THEN NULL WHEN m = 0 THEN (tx - ty)::DOUBLE WHEN hole THEN NULL ELSE
      (CASE WHEN u + v < 1.0 THEN CASE WHEN u > v THEN (h2-h1)*u + (h5-h1-h2)*v + h1 ELSE (h5-h1-h3)*u + (h3-h1)*v + h1 END
        ELSE CASE WHEN u > v THEN (h2+h4-h5)*u + (h4-h2)*v + (h5-h4) ELSE (h4-h3)*u + (h3+h4-h5)*v + (h5-h4) END END) * CASE m WHEN 2 THEN 50.0::DOUBLE / 255 WHEN 3 THEN 50.0::DOUBLE / 65535 ELSE 1.0 END + CASE m WHEN 1 THEN 0.0 ELSE (tx - ty)::DOUBLE END END AS height FROM h)
    SELECT event_id, mode, hole, round(height, 6) + 0.0 AS height FROM k """


def _mode(mode: str):
    def f(spark, d):
        t = heights(points(spark, d), terrain(spark, d).where(F.col("mode") == mode))
        return t.where(F.col("mode") == mode).select("event_id", "mode", "hole", r6(F.col("height")).alias("height"))

    f.__name__ = f"terrain_{mode}"
    f.__doc__ = f"Heights of the points on tiles of mode {mode}."
    return query(_SQL + f"WHERE mode = '{mode}'", ("points",))(f)


for _m in ("flat", "f32", "u8", "u16"):
    _mode(_m)


@query(_SQL, ("points",))
def terrain_height(spark, d):
    return heights(points(spark, d), terrain(spark, d)).select("event_id", "mode", "hole", r6(F.col("height")).alias("height"))


@query(_SQL.replace("SELECT event_id, mode, hole, round(height, 6) + 0.0 AS height FROM k", "SELECT mode, hole, count(*) AS n, min(round(coalesce(height, -200000.0), 6)) AS lowest FROM k GROUP BY 1, 2"), ("points",))
def terrain_hole(spark, d):
    t = heights(points(spark, d), terrain(spark, d))
    return t.groupBy("mode", "hole").agg(F.count("*").alias("n"), F.min(F.round(with_sentinel(), 6)).alias("lowest"))
