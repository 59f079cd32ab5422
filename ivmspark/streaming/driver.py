"""Streams and runs: micro-batches land as commits, and plans step after them.

A batch's tag is the stream's name and the batch's number, so a batch that Spark delivers again after a
failure lands once; a plan whose sources didn't move is skipped. Nothing here waits or schedules: the
stream's own trigger does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from ..operators.zset import WEIGHT, as_zset
from ..plans.run import RunResult, apply_changes
from ..sources.store import attempted, read_tag, run_meta, table


def land(batch: DataFrame, batch_id: int, name: str, *, stream: str, pk=None) -> bool:
    """One micro-batch on a table. With a key, rows (or signed rows) replace their keys' rows; without,
    they are added. Whether rows changed."""
    spark, tag = batch.sparkSession, f"{stream}:{batch_id}"
    if pk:
        return apply_changes(spark, name, batch, pk, tag=tag)
    t = table(spark, name)

    def once() -> bool:
        head = t.head()
        if head < 0:
            t.create(batch, meta=run_meta("ingest", {}, tag))
            return True
        if read_tag(spark, name) == tag:
            return False
        zset = batch if WEIGHT in batch.columns else as_zset(batch)
        return "" in t.commit(zset, kind="ingest", meta=run_meta("ingest", {}, tag), expected=head).streams

    return attempted(once)


def stepper(name: str, *, stream: str, pk=None, steps: Iterable[Callable[[SparkSession], RunResult]] = ()) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: land the batch, then run each step, in order."""

    def each(batch: DataFrame, batch_id: int) -> None:
        land(batch, batch_id, name, stream=stream, pk=pk)
        for step in steps:
            step(batch.sparkSession)

    return each


def follow(frame: DataFrame, name: str, *, stream: str, checkpoint: str, pk=None, steps: Iterable[Callable[[SparkSession], RunResult]] = (), trigger: dict | None = None):
    """Start a streaming query that lands frame on a table and steps plans after each batch. The default
    trigger takes what there is and ends."""
    writer = frame.writeStream.foreachBatch(stepper(name, stream=stream, pk=pk, steps=list(steps)))
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
