"""Sources of mesh and terrain data: anything with the same three tables can be plugged in."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from navloom.operators.store import look_up
from navloom.operators.tiles import present
from navloom.sources import binary


class Source(Protocol):
    """params: mesh_params; blobs: (map_id, tx, ty, blob) of wanted (map_id, tx, ty) of a kind (nav or terrain); a missing tile has no row."""

    def params(self) -> DataFrame: ...

    def blobs(self, wanted: DataFrame, kind: str) -> DataFrame: ...


class FolderSource:
    """Files below a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def params(self) -> DataFrame:
        return binary.mesh_params(self.spark, self.folder)

    def blobs(self, wanted: DataFrame, kind: str) -> DataFrame:
        files = binary._files(self.spark, self.folder, {"nav": "*.mmtile", "terrain": "*.map"}[kind])
        return files.join(wanted.select("map_id", "tx", "ty").distinct(), ["map_id", "tx", "ty"]).select("map_id", "tx", "ty", F.col("content").alias("blob"))


class StoreSource:
    """A parquet store written by navloom.operators.store, and a table of mesh parameters."""

    def __init__(self, store: DataFrame, params: DataFrame):
        self.store, self._params = store, params

    def params(self) -> DataFrame:
        return self._params

    def blobs(self, wanted: DataFrame, kind: str) -> DataFrame:
        return look_up(self.store, wanted.select("map_id", "tx", "ty").distinct(), kind)


class RecordingSource:
    """Another source that also tells which of the wanted tiles there are."""

    def __init__(self, source: Source):
        self.source = source

    def params(self) -> DataFrame:
        return self.source.params()

    def blobs(self, wanted: DataFrame, kind: str) -> DataFrame:
        return self.source.blobs(wanted, kind)

    def record(self, wanted: DataFrame, kind: str) -> DataFrame:
        """(map_id, tx, ty, present) of the wanted tiles."""
        return present(wanted.select("map_id", "tx", "ty").distinct(), self.source.blobs(wanted, kind), ("map_id", "tx", "ty"))


def write_manifest(paths: DataFrame, folder: str) -> None:
    """Write the distinct paths (path), sorted, as lines of text; range partitions keep the order over the files."""
    paths.select("path").distinct().orderBy("path").write.mode("overwrite").text(folder)
