"""Checks over a stream: each micro-batch of the target is held against the expected frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tidemark.plans.checks import Check, Context, verify


def verify_stream(target: DataFrame, expected: dict[str, DataFrame], dataset: str, checks: list[Check], path: str, checkpoint: str, other: dict[str, DataFrame] | None = None) -> StreamingQuery:
    """Start a query that appends each batch's findings to path. A batch that is run again replaces its own findings."""

    def run(batch: DataFrame, batch_id: int) -> None:
        found = verify(Context(expected, {**(other or {}), dataset: batch}, run_id=f"batch-{batch_id}"), checks)
        found.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)

    return target.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
