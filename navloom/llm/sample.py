"""A bounded, reproducible sample of labelled documents, for fitting the classifiers."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fold(doc_id, folds: int):
    """crc32 of the id's decimal text modulo `folds`; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(folds)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most_rows: int, learn=None) -> DataFrame:
    """(doc_id, label, text) of at most `most_rows` labelled documents.

    A document is taken by the order of a hash of its id, so the sample does not depend on
    file order, and it is the whole labelled set while that has at most `most_rows` rows.
    `learn` is an optional condition on doc_id. Rows with a null id, text or label, and labels
    other than 0 and 1, are not used; an id with several labels counts as 1 if one of them is 1;
    of several rows with one id the smallest text is taken. Only `most_rows` (id, label) rows
    are broadcast, never the label table, and only their texts are shuffled.
    """
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    chosen = chosen.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
    if learn is not None:
        chosen = chosen.where(learn(F.col("doc_id")))
    chosen = chosen.groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def give_back(spark: SparkSession | None = None) -> None:
    """Return the memory of freed arrays to the system: a driver that has fitted a model goes on for hours.

    With a session the JVM collects its garbage too; only then does Spark remove the shuffle files of frames that are gone.
    """
    gc.collect()
    if spark is not None:
        spark.sparkContext._jvm.System.gc()
    _trim()


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


def lean(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`work`, for mapInArrow, returning freed memory to the system when a task ends: Spark keeps a worker for later tasks, and what
    it once took would stand beside the executor's heap from then on."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            _trim()

    return kernel
