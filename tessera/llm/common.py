"""Shared helpers: the folder all executors see, written tables, row keys, Arrow batches."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import placed, plain_scan, release, remove, scratch, shared_dir, ship, written, written_at  # noqa: F401

#: Maximal runs that are not ASCII white space; bytes.split() cuts UTF-8 the same way.
WORD = r"[^\x20\x09-\x0D]+"


def map_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """df.mapInArrow with this package at hand in the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def with_key(df: DataFrame, name: str) -> DataFrame:
    """A number for each row, repeated rows included, for use within one scan: another scan may cut the input otherwise and number it otherwise."""
    return df.withColumn(name, F.monotonically_increasing_id())


def keyed(df: DataFrame, name: str) -> DataFrame:
    """A key for each row, repeated rows included, that every scan gives alike: struct (file long, row long).

    A table read from Parquet has its rows' files (as a hash of the path) and places there, however the
    scan is cut and whoever runs it. Any other input is written once, with numbered rows."""
    if plain_scan(df):
        try:
            meta = df.metadataColumn("_metadata")
            return df.withColumn(name, F.struct(F.xxhash64(meta["file_path"]).alias("file"), meta["row_index"].cast("long").alias("row")))
        except AnalysisException:  # no table of files
            pass
    return written(df.withColumn(name, F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("row"))), "keyed")


#: A key is hot if it holds more rows than this and than one in HOT_KEYS of all, so there are HOT_KEYS hot keys at most.
HOT_ROWS = 1_000_000
HOT_KEYS = 1000


def hot_keys(counts: DataFrame, key: str, total: int) -> list:
    """The hot ones of counts (key, n), where total is the sum of n."""
    least = max(HOT_ROWS, total // HOT_KEYS)
    return [r[0] for r in counts.where(F.col("n") > least).select(key).collect()] if total > least else []


def join_one(many: DataFrame, one: DataFrame, key: str, hot: list, how: str = "inner") -> DataFrame:
    """many joined (inner or left) to one, which has a row for each key: rows of hot keys stay where they are, and what `one` has for these goes to every task."""
    if not hot:
        return many.join(one, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    return many.where(~is_hot).join(one.where(~is_hot), key, how).unionByName(many.where(is_hot).join(F.broadcast(one.where(is_hot)), key, how))


def whole_rows(docs: DataFrame, *needed: str) -> DataFrame:
    """docs as one struct `row` beside the needed columns, so that no other column's name matters; select("row.*") undoes it."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *needed)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df has not."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def utf8(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8 bytes, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def arrow_rows(schema: pa.Schema, row: Callable[[int, bytes], tuple]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over columns (doc_id, text): row(doc_id, utf8) makes each output row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [row(i, t) for i, t in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    return run


def settle(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that are done with; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
