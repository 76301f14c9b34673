"""Embedding text with a pluggable model, in batches inside tasks, and the incremental embedding job."""

from __future__ import annotations

import json
import time
import urllib.request
import uuid
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import for_embedding, strip
from ..session import remove, ship
from .store import ParquetVectorStore, embedding_rows, pending

DIMENSIONS, BATCH = 1024, 50


class Embedder(Protocol):
    """Texts to vectors in the same order; None where a text has none. Made once in a task, so it must pickle."""

    model: str

    def embed(self, texts: Sequence[str]) -> list[list[float] | None]: ...


class Generator(Protocol):
    """A chat model: streams the answer to a prompt under a system prompt."""

    def chat(self, system: str, prompt: str) -> Iterator[str]: ...


class HttpEmbedder:
    """A model server's /api/embeddings: groups of `concurrency` requests at once with a pause between groups; a
    request that fails is tried again up to `retries` times, and then gives None."""

    def __init__(self, url: str, model: str = "bge-m3", concurrency: int = BATCH, timeout: float = 120, pause: float = 0.1, retries: int = 2):
        self.url, self.model, self.concurrency, self.timeout, self.pause, self.retries = url.rstrip("/"), model, concurrency, timeout, pause, retries

    def _one(self, text: str) -> list[float] | None:
        request = urllib.request.Request(f"{self.url}/api/embeddings", json.dumps({"model": self.model, "prompt": text}).encode(), {"Content-Type": "application/json"})
        for n in range(self.retries + 1):
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as r:
                    return json.loads(r.read()).get("embedding") or None
            except (OSError, ValueError):
                if n < self.retries:
                    time.sleep(self.pause * 2**n)
        return None

    def embed(self, texts: Sequence[str]) -> list[list[float] | None]:
        out: list[list[float] | None] = []
        with ThreadPoolExecutor(self.concurrency) as pool:
            for at in range(0, len(texts), self.concurrency):
                if at:
                    time.sleep(self.pause)
                out += pool.map(self._one, texts[at : at + self.concurrency])
        return out

    def available(self) -> bool:
        """Whether the server has the model, tags aside."""
        try:
            with urllib.request.urlopen(f"{self.url}/api/tags", timeout=10) as r:
                names = [m.get("name", "") for m in json.loads(r.read()).get("models", [])]
        except (OSError, ValueError):
            return False
        return any(n.split(":")[0] == self.model.split(":")[0] for n in names)


def embed(rows: DataFrame, embedder: Embedder, text: str = "text", dim: int | None = DIMENSIONS) -> DataFrame:
    """rows with `embedding` (null for blank texts and failures) and `dim_ok`; texts are cut before they leave the JVM."""
    ship(rows.sparkSession)
    ready = rows.withColumn("_t", F.when(strip(F.col(text)) != "", for_embedding(F.col(text))))
    names = rows.columns

    def run(batches):
        for batch in batches:
            asked = batch["_t"].notna()
            found = pd.Series([None] * len(batch), index=batch.index, dtype=object)
            if asked.any():
                found[asked] = pd.Series(embedder.embed(batch.loc[asked, "_t"].tolist()), index=batch.index[asked], dtype=object)
            yield batch[names].assign(embedding=found)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    out = ready.mapInPandas(run, f"{kinds}, embedding array<float>")
    return out if dim is None else out.withColumn("dim_ok", F.size("embedding") == dim)


def embedding_job(sections: DataFrame, store: ParquetVectorStore, embedder: Embedder, limit: int | None = None, compat: bool = False) -> dict[str, int]:
    """Embeds the sections that the store lacks and upserts them; returns generated, errors and total."""
    todo = pending(sections, store.existing_ids(embedder.model), limit=limit, compat=compat)
    path = f"{store.path}/run-{uuid.uuid4().hex}"  # a folder for each run, so that two jobs on one store do not meet
    embed(todo, embedder, dim=None).write.parquet(path)
    done = sections.sparkSession.read.parquet(path)
    counts = done.agg(F.count("embedding").alias("generated"), F.count_if(F.col("embedding").isNull()).alias("errors"), F.count(F.lit(1)).alias("total")).first().asDict()
    if counts["generated"]:
        store.upsert(embedding_rows(done, embedder.model, F.current_timestamp()))
    remove(sections.sparkSession, path)
    return counts | {"backend": "parquet"}


def search_text(store: ParquetVectorStore, embedder: Embedder, question: str, k: int = 5, min_similarity: float | None = 0.5) -> DataFrame:
    """The stored sections nearest to a question; no rows if it cannot be embedded."""
    vector = embedder.embed([question])[0] if question.strip() else None
    return store.table().limit(0).withColumn("similarity", F.lit(None).cast("double")) if vector is None else store.search(vector, k, min_similarity)


def choose_store(candidates: Sequence, force: str | None = None):
    """The first (name, open) candidate that opens; a forced one that does not open is an error."""
    for name, opening in candidates:
        if force in (None, name):
            try:
                return opening()
            except Exception:
                if force == name:
                    raise
    raise RuntimeError("no vector store can be opened")
