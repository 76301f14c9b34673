"""Two whole plans: build an index of chunks, and answer a question from it."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import embed, rag, store, vector
from ..operators.stats import with_row_number
from ..session import remove


def index_chunks(chunks: DataFrame, embedder: embed.Embedder, path: str, place: str) -> tuple[str | None, int]:
    """Embeds chunks (chunk, source, ...) and writes them under path with ids chunk_0, chunk_1, ... in order of a unique column.

    Chunks without an embedding are left out. Returns the path and the count; (None, 0) without chunks."""
    spark = chunks.sparkSession
    own = f"{path}/run-{uuid.uuid4().hex}"  # a folder for each run, so that two do not meet
    embed.embed(chunks, embedder, "chunk", dim=None).where("embedding is not null").write.parquet(own)
    rows = with_row_number(spark.read.parquet(own), place)
    n = rows.count()
    if n:
        store.write_version(rows.withColumn("chunk_id", F.concat(F.lit("chunk_"), F.col("row_no").cast("string"))).drop("row_no"), path)
    remove(spark, own)
    return (path, n) if n else (None, 0)


def find_context(index: DataFrame, embedder: embed.Embedder, question: str, issues: DataFrame | None = None) -> DataFrame:
    """One row, `context`: the status block that the question asks for, then its passages, the nearest first.

    How many passages there are depends on the question; issues are the tracker's (key, summary, status, status_category)."""
    spark = index.sparkSession
    asked = spark.range(1).select(rag.intent(F.lit(question)).alias("intent"), rag.passages(F.lit(question), F.lit(index.count())).alias("k")).first()
    query = embedder.embed([question])[0]
    hits = vector.top_k(index, query, asked["k"], None, "chunk_id").withColumn("query_id", F.lit(0))
    hits = hits.select("query_id", F.struct((-F.col("similarity")).alias("d"), "chunk_id").alias("place"), "source", F.col("chunk").alias("text"))
    block = None
    if issues is not None and asked["intent"]:
        block = "status"
        hits = hits.crossJoin(F.broadcast(rag.status_context(issues, asked["intent"]).withColumnRenamed("status_context", "status")))  # one row
    return rag.assemble_context(hits, order="place", status=block).select("context")


def answer(index: DataFrame, embedder: embed.Embedder, generator: embed.Generator, question: str, issues: DataFrame | None = None) -> Iterator[str]:
    """The generator's answer, piece by piece."""
    found = find_context(index, embedder, question, issues).first()
    return generator.chat(rag.PROMPT + (found["context"] if found else ""), question)
