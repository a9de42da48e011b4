"""A sharded tile store in parquet, partitioned by map and shard, and checks of what it holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from navloom.functions import geometry as g
from navloom.session import ready


def numbered(rows: DataFrame, order: str, name: str = "place") -> DataFrame:
    """`rows` and their place (from 1) in the order of a column, nulls first; equal values in any order.

    Rows are sorted by ranges in parallel; a range's rows are numbered in their task after the sum of the ranges before,
    of which there is one number each.
    """
    ready(rows.sparkSession)
    t = rows.orderBy(order).withColumn("__range", F.spark_partition_id()).checkpoint()
    sizes = t.groupBy("__range").agg(F.count("*").alias("n"))
    before = sizes.select("__range", (F.sum("n").over(Window.orderBy("__range")) - F.col("n")).alias("__before"))  # a row for each range
    own = F.row_number().over(Window.partitionBy("__range").orderBy(order))
    return t.join(F.broadcast(before), "__range").withColumn(name, (own + F.col("__before")).cast("long")).drop("__range", "__before")


def with_offsets(blobs: DataFrame, size: str = "size") -> DataFrame:
    """`blobs` (sx, sy, tile_key, ...) and offset: where each starts in its shard's run of bytes, from 1, by tile key."""
    before = Window.partitionBy("sx", "sy").orderBy("tile_key").rowsBetween(Window.unboundedPreceding, -1)
    return blobs.withColumn("offset", F.lit(1) + F.coalesce(F.sum(size).over(before), F.lit(0)))


def write_store(tiles: DataFrame, path: str) -> None:
    """Write (map_id, tx, ty, kind, blob); rows of a shard are written together, sorted by key, so a lookup reads one shard."""
    t = tiles.select("map_id", g.shard("tx").alias("sx"), g.shard("ty").alias("sy"), "kind", g.tile_key("tx", "ty").alias("tile_key"), "blob")
    t.repartition("map_id", "sx", "sy").sortWithinPartitions("map_id", "sx", "sy", "kind", "tile_key").write.mode("overwrite").partitionBy("map_id", "sx", "sy").parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def look_up(store: DataFrame, wanted: DataFrame, kind: str) -> DataFrame:
    """The blobs of wanted (map_id, tx, ty); shards that nobody wants are pruned at run time. A missing tile has no row."""
    w = wanted.select("map_id", "tx", "ty", g.shard("tx").alias("sx"), g.shard("ty").alias("sy"), g.tile_key("tx", "ty").alias("tile_key"))
    return store.where(F.col("kind") == kind).join(w, ["map_id", "sx", "sy", "tile_key"]).select("map_id", "tx", "ty", "blob")


def differences(left: DataFrame, right: DataFrame, key: list[str], value: str = "blob") -> DataFrame:
    """key and status of every key on either side: equal, different, left_only or right_only; values compare by bytes."""
    a = left.select(*key, F.sha2(F.col(value).cast("binary"), 256).alias("__a"), F.lit(True).alias("__l"))
    b = right.select(*key, F.sha2(F.col(value).cast("binary"), 256).alias("__b"), F.lit(True).alias("__r"))
    status = F.when(F.col("__l").isNull(), "right_only").when(F.col("__r").isNull(), "left_only").when(F.col("__a").eqNullSafe(F.col("__b")), "equal").otherwise("different")
    return a.join(b, key, "full_outer").select(*key, status.alias("status"))


def result_diff(left: DataFrame, right: DataFrame, tolerance: float = 0.01, strict: bool = True) -> DataFrame:
    """(pair_id, a, b, ok): results (pair_id, distance) agree if both are negative or their difference is below the tolerance."""
    a, b = left.select("pair_id", F.col("distance").alias("a")), right.select("pair_id", F.col("distance").alias("b"))
    gap = F.abs(F.col("a") - F.col("b"))
    near = gap < tolerance if strict else gap <= tolerance
    return a.join(b, "pair_id").select("pair_id", "a", "b", (((F.col("a") < 0) & (F.col("b") < 0)) | near).alias("ok"))
