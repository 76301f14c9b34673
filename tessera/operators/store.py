"""Tables kept by key: upserts, what is still to do, and synchronisation.

Parquet has no MERGE, so each operator returns the table's next version. write_version() writes a whole
one beside the current one, upsert_version() only the buckets that new rows touch; both then swap a
pointer file, so that readers never see half a table.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import snippet
from ..session import remove, written_at

LONGER_THAN = 50


def upsert_latest(current: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Per key, the row that comes last in `order`; rows of `new` win ties. One shuffle, with a map-side limit of one row a key."""
    both = current.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    best = Window.partitionBy(*keys).orderBy(*[c.desc() for c in order], F.desc("_new"))
    return both.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n", "_new")


def upsert_partial(current: DataFrame, new: DataFrame, key: str, update: Sequence[str]) -> DataFrame:
    """New keys are inserted; known keys get the columns in `update` and keep all others."""
    a, b = current.alias("a"), new.alias("b")
    known, given = F.col(f"a.{key}").isNotNull(), F.col(f"b.{key}").isNotNull()
    columns = [F.coalesce(f"a.{key}", f"b.{key}").alias(key)]
    for c in (x for x in current.columns if x != key):
        there = F.col(f"b.{c}") if c in new.columns else F.lit(None).cast(current.schema[c].dataType)
        columns.append((F.when(given, there).otherwise(F.col(f"a.{c}")) if c in update else F.when(known, F.col(f"a.{c}")).otherwise(there)).alias(c))
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer").select(*columns)


def mark_processed(documents: DataFrame, done: DataFrame, key: str = "document_id", flags: Sequence[str] = ("text_extracted", "is_processed")) -> DataFrame:
    """documents with both flags set where the key is in `done`; others keep theirs."""
    ids = done.select(F.col(key).alias("_done")).distinct()
    joined = documents.join(ids, documents[key] == ids["_done"], "left")
    return joined.select(*[(F.col("_done").isNotNull() | F.col(c)).alias(c) if c in flags else F.col(c) for c in documents.columns])


def existing_ids(store: DataFrame, key: str = "section_id", model_name: str | None = None) -> DataFrame:
    return (store if model_name is None else store.where(F.col("model_name") == model_name)).select(key).distinct()


def embeddable(sections: DataFrame, text: str = "text") -> DataFrame:
    return sections.where(F.col(text).isNotNull() & (F.length(text) > LONGER_THAN))


def unprocessed(documents: DataFrame, limit: int | None = None, order: Sequence[str] = ("created_at", "document_id")) -> DataFrame:
    found = documents.where(~F.col("text_extracted"))
    return found if limit is None else found.orderBy(*order).limit(limit)


def pending(sections: DataFrame, existing: DataFrame, key: str = "section_id", order: Sequence[str] = ("extracted_at", "section_id"), limit: int | None = None, compat: bool = False) -> DataFrame:
    """Embeddable sections without an embedding; with a limit the oldest ones.

    compat: the limit is applied to twice as many of the oldest sections before the known ones are
    left out, which can give nothing for ever once the oldest are done."""
    found = embeddable(sections)
    if limit is not None and compat:
        found = found.orderBy(*order).limit(2 * limit)
    found = without(found, existing, key)
    return found if limit is None else found.orderBy(*order).limit(limit)


#: Bits of a filter of known ids, places that an id has in it, and ids that only seem known and are sent to every task at most.
FILTER_BITS, PLACES = 1 << 23, 4
SEEMING = 100_000


def _place(key: str, i: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(i), key), F.lit(FILTER_BITS))


def without(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """rows whose key is not in known (key), as by an anti join; what rows hold besides does not cross a shuffle.

    A Bloom filter over the known ids, summed up by words of 64 bits and of fixed size (a megabyte), goes to every task.
    A row whose id it does not know passes at once. Other ids, alone, meet the known ones; those that only seemed
    known are few and go to every task, or, if they are more than SEEMING, meet the rows in a join."""
    spark = rows.sparkSession
    ids = known.select(key).where(F.col(key).isNotNull())
    at = ids.select(F.explode(F.array(*[_place(key, i) for i in range(PLACES)])).alias("p"))
    words = at.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits")).collect()  # FILTER_BITS / 64 at most
    filled = np.zeros(FILTER_BITS // 64, np.int64)
    filled[[r["w"] for r in words]] = [r["bits"] for r in words]
    shared = spark.sparkContext.broadcast(filled)

    @F.pandas_udf("boolean")
    def seems(*places: pd.Series) -> pd.Series:
        found = np.ones(len(places[0]), bool)
        for p in places:
            p = p.to_numpy(np.int64)
            found &= (shared.value[p >> 6] >> (p & 63)) & 1 == 1
        return pd.Series(found)

    marked = rows.withColumn("_seems", F.col(key).isNotNull() & seems(*[_place(key, i) for i in range(PLACES)]))
    path, wrong = written_at(marked.where("_seems").select(key).distinct().join(ids, key, "left_anti"), "seeming")
    wrong = F.broadcast(wrong) if wrong.count() <= SEEMING else wrong
    return marked.where("not _seems").drop("_seems").unionByName(marked.where("_seems").drop("_seems").join(wrong, key, "left_semi"))


def embedding_rows(sections: DataFrame, model_name: str, now: Column, text: str = "text") -> DataFrame:
    """Rows of the embedding table for sections with an `embedding`: snippet, full length, model and time."""
    return sections.where(F.col("embedding").isNotNull()).select(
        "section_id", "bid_id", "embedding", F.lit(model_name).alias("model_name"), F.lit(None).cast("string").alias("model_version"),
        snippet(F.col(text)).alias("text_snippet"), F.length(text).alias("char_count"), now.alias("created_at"),
    )


def sync(source: DataFrame, target: DataFrame, keys: Sequence[str] = ("section_id", "model_name"), preserve_char_count: bool = True) -> DataFrame:
    """target with every row of source put in; preserve_char_count=False counts the snippet instead."""
    if not preserve_char_count:
        source = source.withColumn("char_count", F.length("text_snippet"))
    return target.join(source.select(*keys).distinct(), list(keys), "left_anti").select(target.columns).unionByName(source.select(target.columns))


#: Versions of a table that stay for readers, and buckets of a table that is kept by upserts.
KEPT = 3
BUCKETS = 16


def write_version(df: DataFrame, path: str) -> str:
    """Writes a whole new version under path and points CURRENT at it."""
    version = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{version}")
    _point(df.sparkSession, path, {"version": version})
    return version


def upsert_version(new: DataFrame, path: str, keys: Sequence[str], order: Sequence[Column], buckets: int = BUCKETS) -> str | None:
    """The next version of the table at path, with new put in by key (see upsert_latest).

    The table lies in buckets by hash of the keys; only those that new has rows of are read and written
    again, the version takes the others from older ones. How many there are is settled when the table is
    first written so; tables of more than some GB want more than BUCKETS."""
    spark = new.sparkSession
    scratch, new = written_at(new, "upsert")
    state = _state(spark, path)
    parts = (state or {}).get("parts")
    if parts is not None and (tuple(keys) != tuple(state["keys"]) or new.schema.names != _schema_of(state).names):
        raise ValueError(f"the table is kept by {state['keys']} with columns {_schema_of(state).names}")
    buckets = state["buckets"] if parts is not None else buckets
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    touched = sorted(r[0] for r in new.select(bucket).distinct().collect())  # `buckets` numbers at most
    if parts is None and state:  # a whole table is dealt into buckets
        current, touched = read_version(spark, path), range(buckets)
    else:
        current = _read(spark, path, [parts[str(b)] for b in touched if str(b) in parts] if parts else [], new.schema)
    version = None
    if touched:
        version = f"v-{uuid.uuid4().hex}"
        upsert_latest(current, new, keys, order).withColumn("_b", bucket).hint("rebalance", "_b").write.partitionBy("_b").parquet(f"{path}/{version}")
        fs, place = _files(spark, path)
        there = {str(b): f"{version}/_b={b}" for b in touched if fs.exists(place(f"{version}/_b={b}"))}
        _point(spark, path, {"version": version, "buckets": buckets, "keys": list(keys), "schema": new.schema.json(), "parts": (parts or {}) | there})
    remove(spark, scratch)
    return version


def _point(spark: SparkSession, path: str, state: dict) -> None:
    """Makes state the current one, and deletes what only states before the last KEPT ones hold.

    NEXT is whole before CURRENT goes, so a swap that breaks off leaves one of them to read."""
    fs, place = _files(spark, path)
    old = _state(spark, path)
    before = [_folders(old), *old.get("before", [])] if old else []
    state = state | {"before": before[: KEPT - 1]}
    if not fs.exists(place("CURRENT")) and old:
        fs.rename(place("NEXT"), place("CURRENT"))
    out = fs.create(place("NEXT"), True)
    out.write(bytearray(json.dumps(state).encode()))
    out.close()
    fs.delete(place("CURRENT"), False)
    fs.rename(place("NEXT"), place("CURRENT"))
    live = {*_folders(state), *(f for x in state["before"] for f in x)}
    for folder in {f for x in before[KEPT - 1 :] for f in x} - live:
        fs.delete(place(folder), True)


def _folders(state: dict) -> list[str]:
    """Where a version's rows lie, below the table's path."""
    return list(state["parts"].values()) if "parts" in state else [state["version"]]


def _schema_of(state: dict) -> T.StructType:
    return T.StructType.fromJson(json.loads(state["schema"]))


def _files(spark: SparkSession, path: str):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs_path = jvm.org.apache.hadoop.fs.Path
    return fs_path(path).getFileSystem(conf), lambda name: fs_path(f"{path}/{name}")


def _state(spark: SparkSession, path: str) -> dict | None:
    """The state that CURRENT holds, or NEXT where CURRENT is gone; None where neither is whole."""
    fs, place = _files(spark, path)
    name = next((x for x in ("CURRENT", "NEXT") if fs.exists(place(x))), None)
    line = spark.read.text(f"{path}/{name}").first() if name else None
    try:
        return json.loads(line[0]) if line else None
    except ValueError:
        if name == "CURRENT":
            raise
        return None  # a first version whose pointer broke off while it was written


def _read(spark: SparkSession, path: str, folders: Sequence[str], schema) -> DataFrame:
    return spark.read.schema(schema).parquet(*[f"{path}/{f}" for f in folders]) if folders else spark.createDataFrame([], schema)


def read_version(spark: SparkSession, path: str, schema=None) -> DataFrame | None:
    """The current version, or None (or an empty table of `schema`) if there is none yet."""
    state = _state(spark, path)
    if state is None:
        return None if schema is None else spark.createDataFrame([], schema)
    return _read(spark, path, _folders(state), _schema_of(state)) if "parts" in state else spark.read.parquet(f"{path}/{state['version']}")


class ParquetVectorStore:
    """A vector store over a table of a Lake: initialize, upsert, existing_ids, search, count, close."""

    SCHEMA = "section_id string, bid_id string, embedding array<float>, model_name string, model_version string, text_snippet string, char_count int, created_at timestamp"
    TABLE = "vectors"

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str] = ("section_id", "model_name")):
        from .lake import Lake

        self.spark, self.path, self.keys, self.lake = spark, path, tuple(keys), Lake(spark, path)

    def initialize(self) -> None:
        if not self.lake.version():
            self.lake.create(self.TABLE, self.SCHEMA, self.keys, ["created_at"])

    def table(self) -> DataFrame:
        self.initialize()
        return self.lake.read(self.TABLE)

    def upsert(self, rows: DataFrame) -> None:
        """Writes as much as it is given; a key's latest row by created_at stays."""
        self.initialize()
        self.lake.upsert(self.TABLE, rows)

    def changes(self, since: int) -> DataFrame:
        """What has changed since a version of the store, for keeping another one in step."""
        return self.lake.changes(self.TABLE, since)

    def existing_ids(self, model_name: str | None = None) -> DataFrame:
        return existing_ids(self.table(), model_name=model_name)

    def search(self, query: Sequence[float], k: int = 5, min_similarity: float | None = 0.5, model_name: str | None = None) -> DataFrame:
        from .vector import top_k

        rows = self.table()
        return top_k(rows if model_name is None else rows.where(F.col("model_name") == model_name), query, k, min_similarity)

    def count(self) -> int:
        return self.table().count()

    def close(self) -> None:
        """Nothing is held open."""
