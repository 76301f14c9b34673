"""Incremental upkeep as streams: whatever is new since the last run is read once and put in by key."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession

from ..operators.store import upsert_version


def run_incremental(spark: SparkSession, source: str, schema, target: str, checkpoint: str, keys: Sequence[str], order: Sequence[Column], transform: Callable[[DataFrame], DataFrame] = lambda df: df) -> int:
    """Upserts all new files of a Parquet folder into the table at target; returns how many batches ran.

    Only the buckets of the table that a batch touches are written again. A batch that is run again after
    a failure gives the same table, as the upsert is by key."""
    ran = []

    def put(batch: DataFrame, _: int) -> None:
        upsert_version(transform(batch), target, keys, order)
        ran.append(1)

    query = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return len(ran)
