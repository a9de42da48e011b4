"""Requests as streams: every micro-batch goes through the batch operators.

Requests land as files in a folder (or any other streaming source with the same columns). foreachBatch
runs the batch operator and writes the answers under the batch's number, so a batch that is run again
after a failure replaces its own answers: exactly once.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from navloom.progress import report
from navloom.session import ready

Operator = Callable[[DataFrame], DataFrame]


def answer_requests(requests: DataFrame, operator: Operator, out: str, state: str, **trigger) -> StreamingQuery:
    """Start a query that answers each micro-batch of streaming `requests` with `operator` into parquet below `out`."""

    def answer(batch: DataFrame, number: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")
        report("requests", batch=number)

    return requests.writeStream.foreachBatch(answer).option("checkpointLocation", state).trigger(**(trigger or {"availableNow": True})).start()


def run_to_end(spark: SparkSession, requests: DataFrame, operator: Operator, files: int = 4, files_a_batch: int = 2) -> DataFrame:
    """Write a table of requests as `files` files in the shared folder, stream them in micro-batches to the end, and read the answers."""
    ready(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/requests-{uuid.uuid4().hex}"
    requests.repartition(files, "pair_id").write.parquet(f"{base}/in")
    stream = spark.readStream.schema(requests.schema).option("maxFilesPerTrigger", files_a_batch).parquet(f"{base}/in")
    query = answer_requests(stream, operator, f"{base}/out", f"{base}/state")
    query.awaitTermination()
    return spark.read.parquet(f"{base}/out").drop("batch")


def grow_mesh(arrivals: DataFrame, links_of: Operator, out: str, state: str) -> StreamingQuery:
    """Append the links that each micro-batch of arriving tiles brings; `links_of` maps new tiles (x, y) to links."""

    def append(batch: DataFrame, number: int) -> None:
        links_of(batch.distinct()).write.mode("overwrite").parquet(f"{out}/batch={number}")
        report("tiles", batch=number)

    return arrivals.writeStream.foreachBatch(append).option("checkpointLocation", state).trigger(availableNow=True).start()
