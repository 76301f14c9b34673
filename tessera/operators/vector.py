"""Exact cosine search over stored vectors.

A single query vector is a literal, so the search is a scan with a top-k. Many queries are held in a
block of bounded size (QUERY_BYTES) that every task has: a task multiplies its rows with the block and
hands on its k best rows for each query.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import ship

TOP_K, LIST_K, MIN_SIMILARITY = 5, 30, 0.5
#: Bytes of the query vectors that a task holds; queries multiplied at once, and pairs whose exact score is taken at once.
QUERY_BYTES, QUERY_STRIP, PAIRS = 32 << 20, 256, 1 << 18


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def vector(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def dim_ok(c: Column, dim: int) -> Column:
    return F.size(c) == dim


def top_k(corpus: DataFrame, query: Sequence[float], k: int = TOP_K, min_similarity: float | None = MIN_SIMILARITY, key: str = "section_id", embedding: str = "embedding") -> DataFrame:
    """corpus with `similarity`, the k best first (ties: smaller key); without a threshold if min_similarity is None."""
    scored = corpus.withColumn("similarity", cosine(F.col(embedding), vector(query)))
    if min_similarity is not None:
        scored = scored.where(F.col("similarity") >= min_similarity)
    return scored.orderBy(F.desc("similarity"), F.col(key)).limit(k)


def top_k_batch(corpus: DataFrame, queries: DataFrame, k: int = TOP_K, min_similarity: float | None = None, key: str = "vec_id", query_key: str = "query_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, key, similarity): the k best rows of corpus for each row of queries (query_id, query_embedding).

    Queries go through in blocks of about QUERY_BYTES, found by hash, so what is sent to the tasks has a bound; each
    block is a scan of the corpus, and nothing of the corpus is shuffled. A task scores a batch of rows against its block as one matrix product and keeps k rows a query, so only these are
    shuffled. Vectors of another length than a query's, null ones and those without direction are no candidates."""
    spark = corpus.sparkSession
    size = queries.agg(F.sum(F.size("query_embedding").cast("long")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-8 * size // QUERY_BYTES))
    asked = queries.select(F.col(query_key).alias("q"), F.col("query_embedding").cast("array<double>").alias("e"))
    rows = corpus.select(F.col(key).alias("key"), F.col(embedding).cast("array<double>").alias("e"))
    kinds = f"q {asked.schema['q'].dataType.simpleString()}, key {rows.schema['key'].dataType.simpleString()}, similarity double"
    best = Window.partitionBy("q").orderBy(F.desc("similarity"), "key")
    found = None
    ship(spark)
    for b in range(blocks):
        block = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b)
        shared = spark.sparkContext.broadcast(by_length((r["q"], r["e"]) for r in block.collect() if r["e"] and None not in r["e"] and any(r["e"])))

        def run(batches, shared=shared):
            return best_of(batches, shared.value, k, min_similarity)

        part = rows.mapInPandas(run, kinds)
        found = part if found is None else found.unionByName(part)
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select(F.col("q").alias(query_key), "rank", F.col("key").alias(key), "similarity")


def by_length(asked: Iterable[tuple]) -> dict[int, tuple[list, np.ndarray]]:
    """Queries (q, e) as q and a matrix for each length of e: a quarter of what lists of numbers take."""
    names, vectors = {}, {}
    for q, e in asked:
        names.setdefault(len(e), []).append(q)
        vectors.setdefault(len(e), []).append(np.array(e, dtype=float))
    return {d: (names[d], np.stack(vectors.pop(d))) for d in sorted(names)}


def best_of(batches: Iterator[pd.DataFrame], asked: dict[int, tuple[list, np.ndarray]] | list[tuple], k: int, least: float | None) -> Iterator[pd.DataFrame]:
    """q, key, similarity: of all batches (key, e) the k best rows for each query (q, e), given as such or by_length().

    A product of matrices says which rows can be among them; their scores are then taken one by one, so that equal
    vectors score alike and ties go by key."""
    asked = asked if isinstance(asked, dict) else by_length(asked)
    dims = sorted(asked)
    names, queries = ({d: asked[d][n] for d in dims} for n in (0, 1))
    sizes = {d: np.sqrt((x * x).sum(axis=1)) for d, x in queries.items()}
    floor = {d: np.full(len(names[d]), -2.0 if least is None else least) for d in dims}  # the k-th best score so far
    kept: dict[tuple, pd.DataFrame] = {}  # by length of the vectors and strip of queries
    for batch in batches:
        batch = batch[batch["e"].notna()]
        for d in dims:
            part = batch[batch["e"].map(len) == d]
            if part.empty:
                continue
            x, ids = np.stack(part["e"].to_numpy()).astype(float), part["key"].to_numpy()
            size = np.sqrt((x * x).sum(axis=1))
            good = np.isfinite(size) & (size > 0)
            if not good.any():
                continue
            x, size, ids = x[good], size[good], ids[good]
            unit = (x / size[:, None]).T
            for at in range(0, len(names[d]), QUERY_STRIP):
                strip = slice(at, at + QUERY_STRIP)
                rough = (queries[d][strip] / sizes[d][strip, None]) @ unit
                kth = np.partition(rough, max(0, len(ids) - k), axis=1)[:, max(0, len(ids) - k)]
                near = rough >= np.maximum(kth if len(ids) > k else -2.0, floor[d][strip])[:, None] - 1e-9
                # Many rows can share the k-th score, so queries are taken together as far as their rows go.
                ends = np.flatnonzero(np.diff(np.cumsum(near.sum(axis=1)) // PAIRS, append=-1)) + 1
                for first, last in zip([0, *ends[:-1]], ends, strict=True):
                    i, j = np.nonzero(near[first:last])
                    if not len(i):
                        continue
                    i += at + first
                    s = np.concatenate([(x[j[n : n + PAIRS]] * queries[d][i[n : n + PAIRS]]).sum(axis=1) for n in range(0, len(i), PAIRS)]) / (size[j] * sizes[d][i])
                    ok = slice(None) if least is None else s >= least
                    new = pd.DataFrame({"i": i[ok], "key": ids[j][ok], "similarity": s[ok]})
                    top = pd.concat([kept[d, at], new]) if (d, at) in kept else new
                    kept[d, at] = top.sort_values(["i", "similarity", "key"], ascending=[True, False, True]).groupby("i", sort=False).head(k)
                    full = kept[d, at].groupby("i")["similarity"].agg(["size", "min"])
                    full = full[full["size"] == k]
                    floor[d][full.index.to_numpy()] = full["min"].to_numpy()
    for (d, _), best in kept.items():
        yield pd.DataFrame({"q": np.array(names[d], dtype=object)[best["i"].to_numpy()], "key": best["key"].to_numpy(), "similarity": best["similarity"].to_numpy()})
