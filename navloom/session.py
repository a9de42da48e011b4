"""Session helpers shared by every operator.

Nothing here starts a cluster-specific service: the functions read the active
session's settings and fall back to values that suit a local test run.
"""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def local_session(cores: int | str = "*", memory: str = "8g", app: str = "navloom") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the session comes from spark-submit."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ready(spark: SparkSession) -> SparkSession:
    """Make this package importable in Python workers and a checkpoint folder available.

    The workers get the folder this package was imported from in PYTHONPATH; a cluster
    that ships the package with --py-files needs nothing more. The checkpoint folder is the
    one named in spark.checkpoint.dir. Where that is unset it lies in the warehouse, which a cluster
    shares, and for a local master (tests, one machine) in a fresh temporary folder that is removed at exit.
    """
    sc = spark.sparkContext
    paths = [p for p in sc.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        sc.environment["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and re.fullmatch(r"local(\[[^,]*\])?", sc.master):
            folder = tempfile.mkdtemp(prefix="navloom-checkpoint-")
            atexit.register(shutil.rmtree, folder, True)
        sc.setCheckpointDir(folder or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints")
    return spark


def shuffle_partitions(spark: SparkSession) -> int:
    """The cluster's own statement of how many partitions a shuffle should have."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables below sf_dir, read by Spark (any file system it knows)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffled(rows: DataFrame) -> DataFrame:
    """`rows`, to be joined by sorting and merging and never broadcast.

    For tables made by generators or Python: Spark's estimate of their size is far below what they have, and a broadcast
    gathers them in the driver.
    """
    return rows.hint("merge")
