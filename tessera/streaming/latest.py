"""The latest row of every key, kept in a stream's state, as a counterpart of rewriting a table for every batch.

latest_rows() holds one row a key in the state store: a batch's rows of a key are reduced to the last one before they leave the
tasks that read them, meet what the state has, and only keys whose row changed are given on. With `expire_ms` a
key that was not seen for so long is forgotten (its next row counts as new).

Defined results: rows with a null in their key are left out; ties in `order` go to the row that came later, within a
batch to the larger other columns; a restart goes on from the checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.lake import Lake
from ..session import ship

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Latest(StatefulProcessor):
    def __init__(self, keys: Sequence[str], schema: str, names: Sequence[str], order: Sequence[str], expire_ms: int | None):
        self.keys, self.schema, self.names, self.order, self.expire_ms = list(keys), schema, list(names), list(order), expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.row = handle.getValueState("row", self.schema, self.expire_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - Spark's names
        best, at = None, [self.names.index(c) for c in self.order]
        if self.row.exists():
            best = tuple(self.row.get())
        known = best
        for p in rows:
            for r in p[self.names].itertuples(index=False, name=None):
                r = tuple(None if v is pd.NaT or v != v else v.to_pydatetime() if isinstance(v, pd.Timestamp) else v.item() if hasattr(v, "item") else v for v in r)
                place = lambda x: [(x[i] is not None, x[i]) for i in at]  # noqa: E731 - nulls first
                if best is None or place(r) >= place(best):
                    best = r
        if best is not None and best != known:
            self.row.update(best)
            yield pd.DataFrame([best], columns=self.names)

    def close(self) -> None:
        """The store is Spark's."""


def latest_rows(stream: DataFrame, keys: Sequence[str], order: Sequence[str], expire_ms: int | None = None) -> DataFrame:
    """Rows of the keys whose latest row a batch has changed, for a stream in update mode."""
    ship(stream.sparkSession)
    known = stream.where(" and ".join(f"`{k}` is not null" for k in keys))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)
    processor = Latest(keys, schema, stream.columns, order, expire_ms)
    return known.groupBy(*keys).transformWithStateInPandas(processor, schema, "Update", "ProcessingTime" if expire_ms else "None")


def keep_latest(spark: SparkSession, source: str, schema, lake: Lake, name: str, checkpoint: str, keys: Sequence[str], order: Sequence[str], files: int | None = None, transform: Callable[[DataFrame], DataFrame] = lambda df: df, expire_ms: int | None = None) -> int:
    """Reads what is new in a Parquet folder, in batches of `files`, and puts the changed latest rows into a lake's table; how many batches ran."""
    ran = []

    def put(batch: DataFrame, _: int) -> None:
        lake.upsert(name, batch)  # by key, so a batch that is run again changes nothing
        ran.append(1)

    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files or 1000).parquet(source)
        query = latest_rows(transform(stream), keys, order, expire_ms).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)
    return len(ran)
