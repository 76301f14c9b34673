"""A stored vector index: inverted lists that upserts extend, searched by probes or exactly by angle bounds.

VectorIndex keeps its vectors in lists, one for each of a bounded number of centroids (spherical k-means over
a bounded sample). Lists are folders of a version (see store.py), and so is a map from keys to lists, in
buckets by hash: an upsert finds where its keys stood, writes again only the lists and buckets that they
leave or enter, and takes all others over. Of each list the state has its number of rows and its angle, the
widest between its centroid and one of its vectors.

top_k() looks through the `probes` nearest lists of each query. exact() gives the same rows as a full scan: the
nearest list yields k scores; a list whose bound, the cosine of the angle to its centroid less the list's
own angle, is below the k-th score or the threshold holds no better row and is skipped.

Queries meet rows by list, as a grid: lists of more than CELL rows are cut into cells and the queries of a list into
blocks of QUERIES, so each group is of bounded size, whatever its list, and only k rows of a group go on.

Defined results: vectors that are null, of another length, without direction, or hold null or non-finite components are
not indexed and give no results as queries; of rows with one key the one last in `order` stays; ties go to
the smaller key; an empty index or no queries give no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import remove, ship, written, written_at
from .store import _files, _point, _read, _state

#: Vectors from which centroids are learned for each list, and lists.
SAMPLE_PER, MIN_LISTS, MAX_LISTS = 64, 4, 1024
ROUNDS = 8
#: Rows and queries that meet in one group.
CELL, QUERIES = 16_384, 4096
KEY_BUCKETS = 64
#: Scores that a Python worker holds at once.
PAIRS = 1 << 18
#: What rounding may add to a bound.
SLACK = 1e-9


def usable(embedding: str, dim: int) -> Column:
    e = F.col(embedding)
    whole = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(e) == dim) & whole & F.exists(e, lambda x: x != 0), F.lit(False))


def unit(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(size > 0, size, 1)


def learn(vectors: np.ndarray, lists: int, seed: int = 1) -> np.ndarray:
    """Unit centroids of the unit vectors, `lists` at most: spherical k-means; a centroid that loses all its vectors starts anew from the worst placed one."""
    rng = np.random.default_rng(seed)
    x = unit(vectors)
    c = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(ROUNDS):
        score = x @ c.T
        near = score.argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        empty = np.flatnonzero(np.bincount(near, minlength=len(c)) == 0)
        sums[empty] = x[np.argsort(score.max(axis=1), kind="stable")[: len(empty)]]
        c = unit(sums)
    return c


def _near_lists(df: DataFrame, centroids: np.ndarray, n: int, columns: Sequence[str]) -> DataFrame:
    """columns, e, and for each row its n nearest centroids as list and cosine; PAIRS rows at once."""
    shared = df.sparkSession.sparkContext.broadcast(centroids)  # MAX_LISTS rows at most
    ship(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = shared.value
        step = max(1, PAIRS // max(1, len(c)))
        for whole in batches:
            for at in range(0, len(whole), step):
                p = whole.iloc[at : at + step]
                score = unit(np.stack(p["e"].to_numpy()).astype(float)) @ c.T
                near = np.argsort(-score, axis=1, kind="stable")[:, :n]
                out = p.loc[p.index.repeat(near.shape[1])].reset_index(drop=True)
                yield out.assign(list=near.ravel().astype(np.int32), cos=np.take_along_axis(score, near, axis=1).ravel())

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*columns, "e").schema)
    return df.select(*columns, "e").mapInPandas(run, f"{schema}, list int, cos double")


def _visited(asked: DataFrame, centroids: np.ndarray, numbers: np.ndarray, angles: np.ndarray | None, probes: int, floor: float) -> DataFrame:
    """row, q and list of the lists that each query (row, q, e, and with angles near and kth) has to look through: the `probes` nearest ones, or with
    angles all but `near` whose bound reaches both kth and floor. Vectors are left behind, and PAIRS scores are held at once."""
    shared = asked.sparkSession.sparkContext.broadcast((centroids, numbers, angles))  # MAX_LISTS rows at most
    ship(asked.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c, names, wide = shared.value
        step = max(1, PAIRS // max(1, len(c)))
        for whole in batches:
            for at in range(0, len(whole), step):
                p = whole.iloc[at : at + step]
                score = unit(np.stack(p["e"].to_numpy()).astype(float)) @ c.T
                if wide is None:
                    lists = np.argsort(-score, axis=1, kind="stable")[:, :probes]
                    i, lists = np.repeat(np.arange(len(p)), lists.shape[1]), lists.ravel()
                else:
                    bound = np.cos(np.maximum(0.0, np.arccos(np.clip(score, -1, 1)) - wide)) + SLACK
                    near = bound >= np.maximum(floor, p["kth"].fillna(-2.0).to_numpy(float))[:, None]
                    near &= names[None, :] != p["near"].to_numpy()[:, None]
                    i, lists = np.nonzero(near)
                yield pd.DataFrame({"row": p["row"].to_numpy()[i], "q": p["q"].to_numpy()[i], "list": names[lists]})

    return asked.mapInPandas(run, f"row long, q {asked.schema['q'].dataType.simpleString()}, list int")


def _numbers(n: str) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1)


def best_in_group(k: int, least: float | None):
    """For cogroup: the k best rows (key, e) for each query (q, e) of one group, as (q, key, similarity); PAIRS scores are held at once."""

    def run(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = [(np.array([], int), np.array([], int), np.array([]))]
        if len(rows) and len(asked):
            rows = rows.sort_values("key", ignore_index=True)
            x = np.stack(rows["e"].to_numpy()).astype(float)
            sx = np.sqrt((x * x).sum(axis=1))
            directions, step = (x / sx[:, None]).T, max(1, PAIRS // len(x))
            for at in range(0, len(asked), step):
                y = np.stack(asked["e"].iloc[at : at + step].to_numpy()).astype(float)
                sy = np.sqrt((y * y).sum(axis=1))
                rough = (y / sy[:, None]) @ directions
                floor = np.full(len(y), -2.0 if least is None else least)
                if k < len(x):
                    floor = np.maximum(floor, np.partition(rough, len(x) - k, axis=1)[:, len(x) - k])
                for i in range(len(y)):
                    near = np.flatnonzero(rough[i] >= floor[i] - SLACK)
                    s = (x[near] * y[i]).sum(axis=1) / (sx[near] * sy[i])  # one by one, so that equal vectors score alike
                    if least is not None:
                        near, s = near[s >= least], s[s >= least]
                    first = np.argsort(-s, kind="stable")[:k]  # rows stand by key, so ties go to the smaller one
                    out.append((np.full(len(first), at + i), near[first], s[first]))
        i, j, s = (np.concatenate(c) for c in zip(*out, strict=True))
        return pd.DataFrame({"q": asked["q"].to_numpy()[i], "key": rows["key"].to_numpy()[j], "similarity": s})

    return run


class VectorIndex:
    """Inverted lists over vectors (key, embedding) at a path."""

    def __init__(self, spark: SparkSession, path: str, key: str = "vec_id", embedding: str = "embedding"):
        self.spark, self.path, self.key, self.embedding = spark, path, key, embedding

    def state(self) -> dict | None:
        return _state(self.spark, self.path)

    def build(self, rows: DataFrame, lists: int | None = None, order: Sequence[Column] = ()) -> None:
        """Learns the lists (about the square root of the number of rows, between MIN_LISTS and MAX_LISTS) and puts all rows in."""
        if self.state():
            raise ValueError(f"there is an index at {self.path}; upsert() extends it")
        lengths = rows.where(F.size(self.embedding) > 0).groupBy(F.size(self.embedding).alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
        dim = lengths[0]["dim"] if lengths else 0
        good = rows.where(usable(self.embedding, dim))
        n = good.count()
        lists = lists or int(min(MAX_LISTS, max(MIN_LISTS, n**0.5)))
        share = min(1.0, lists * SAMPLE_PER / max(n, 1))
        sample = good.where(F.pmod(F.xxhash64(self.key, F.lit(7)), F.lit(1_000_000)) < int(share * 1_000_000) + 1).select(F.col(self.embedding).cast("array<double>").alias("e")).limit(2 * lists * SAMPLE_PER).collect()
        vectors = np.array([r["e"] for r in sample]) if sample else np.zeros((0, max(dim, 1)))
        kind = rows.schema[self.key].dataType.simpleString()
        _point(self.spark, self.path, {"version": "none", "dim": dim, "key": kind, "parts": {}, "lists": {}, "centroids": learn(vectors, lists).tolist() if len(vectors) else []})
        self.upsert(rows, order)

    def upsert(self, rows: DataFrame, order: Sequence[Column] = ()) -> list[str]:
        """Puts rows in by key and returns the names of the lists and key buckets that were written."""
        state = self.state()
        parts, dim = state["parts"], state["dim"]
        places = []

        def keep(df: DataFrame, label: str) -> DataFrame:
            at, df = written_at(df, label)
            places.append(at)
            return df

        given = rows.select(F.col(self.key).alias("key"), F.col(self.embedding).cast("array<double>").alias("e"), usable(self.embedding, dim).alias("ok"), *[c.alias(f"_o{i}") for i, c in enumerate(order)])
        last = Window.partitionBy("key").orderBy(*[F.desc(f"_o{i}") for i in range(len(order))], F.desc(F.xxhash64("e")))
        given = keep(given.where("key is not null").withColumn("_n", F.row_number().over(last)).where("_n = 1").select("key", "e", "ok"), "index-new")
        new = keep(_near_lists(given.where("ok"), np.array(state["centroids"]).reshape(-1, max(dim, 1)), 1, ["key"]) if state["centroids"] else self._none("key {}, e array<double>, list int, cos double"), "index-placed")
        bucket = F.pmod(F.xxhash64("key"), F.lit(KEY_BUCKETS)).cast("int")
        buckets = [f"key/{r[0]}" for r in given.select(bucket).distinct().collect()]  # KEY_BUCKETS at most
        known = self._part([parts[b] for b in buckets if b in parts], "key {}, list int")
        moved = known.join(given.select("key"), "key", "left_semi").select("list").distinct().collect()
        touched = sorted({f"list/{r[0]}" for r in [*moved, *new.select("list").distinct().collect()]})  # MAX_LISTS each at most
        if not touched:
            for p in places:
                remove(self.spark, p)
            return []
        version = f"v-{uuid.uuid4().hex}"
        stay = self._part([parts[x] for x in touched if x in parts], "key {}, e array<double>, cos double, list int").join(given.select("key"), "key", "left_anti")
        columns = ["key", "e", "cos", "list"]
        stay.select(columns).unionByName(new.select(columns)).withColumn("_b", F.col("list")).hint("rebalance", "_b").write.partitionBy("_b").parquet(f"{self.path}/{version}/list")
        keys = known.join(given.select("key"), "key", "left_anti").unionByName(new.select("key", "list")).withColumn("_b", bucket)
        keys.hint("rebalance", "_b").write.partitionBy("_b").parquet(f"{self.path}/{version}/key")
        fs, place = _files(self.spark, self.path)
        there = {x: f"{version}/{x.replace('/', '/_b=')}" for x in [*touched, *buckets]}
        there = {x: f for x, f in there.items() if fs.exists(place(f))}
        gone = {*touched, *buckets} - there.keys()
        now = {x: f for x, f in (parts | there).items() if x not in gone}
        counts = self._part([there[x] for x in touched if x in there], "cos double, list int").groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.min("cos").alias("cos")).collect()
        lists = {x: v for x, v in state["lists"].items() if f"list/{x}" not in touched} | {str(r["list"]): [r["n"], r["cos"]] for r in counts}
        _point(self.spark, self.path, {k: v for k, v in state.items() if k != "before"} | {"version": version, "parts": now, "lists": lists})
        for p in places:
            remove(self.spark, p)
        return [*touched, *buckets]

    def _none(self, schema: str) -> DataFrame:
        return self.spark.createDataFrame([], schema.format(self.state()["key"]))

    def _part(self, folders: Sequence[str], schema: str) -> DataFrame:
        return _read(self.spark, self.path, folders, self._none(schema).schema)

    def count(self) -> int:
        return sum(n for n, _ in self.state()["lists"].values())

    def _asked(self, queries: DataFrame) -> DataFrame:
        return queries.where(usable("query_embedding", self.state()["dim"])).select(F.monotonically_increasing_id().alias("row"), F.col("query_id").alias("q"), F.col("query_embedding").cast("array<double>").alias("e"))

    def _lists(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the lists that have rows: their centroids, numbers and angles."""
        state = self.state()
        numbers = np.array(sorted(int(x) for x in state["lists"]), np.int32)
        return np.array(state["centroids"])[numbers], numbers, np.arccos(np.clip([state["lists"][str(i)][1] for i in numbers], -1, 1))

    def _scored(self, visits: DataFrame, asked: DataFrame, k: int, least: float | None) -> DataFrame:
        """q, key and similarity of the k best rows of each group of a list's rows and queries; visits (row, q, list) of asked (row, e), both written tables."""
        state = self.state()
        lists = [(int(x), -(-n // CELL)) for x, (n, _) in state["lists"].items()]
        per = visits.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("blocks"))
        cut = F.broadcast(per.join(F.broadcast(self.spark.createDataFrame(lists, "list int, cells int")), "list"))  # a row a list
        rows = self._part([f for x, f in state["parts"].items() if x.startswith("list/")], "key {}, e array<double>, list int").join(cut, "list")
        rows = rows.select("list", F.pmod(F.xxhash64("key"), F.col("cells").cast("long")).alias("cell"), F.explode(_numbers("blocks")).alias("block"), "key", "e")
        asked = visits.join(asked.select("row", "e").hint("merge"), "row").join(cut, "list").select("list", F.explode(_numbers("cells")).alias("cell"), F.pmod(F.xxhash64("q"), F.col("blocks").cast("long")).alias("block"), "q", "e")
        ship(self.spark)
        group, kinds = ["list", "cell", "block"], f"q {visits.schema['q'].dataType.simpleString()}, key {state['key']}, similarity double"
        return rows.groupBy(*group).cogroup(asked.groupBy(*group)).applyInPandas(best_in_group(k, least), kinds)

    @staticmethod
    def _ranked(found: DataFrame, k: int, key: str) -> DataFrame:
        best = Window.partitionBy("q").orderBy(F.desc("similarity"), "key")
        ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        return ranked.select(F.col("q").alias("query_id"), "rank", F.col("key").alias(key), "similarity")

    def _nothing(self, queries: DataFrame) -> DataFrame:
        return self.spark.createDataFrame([], f"query_id {queries.schema['query_id'].dataType.simpleString()}, rank int, {self.key} {self.state()['key']}, similarity double")

    def top_k(self, queries: DataFrame, k: int = 5, probes: int | None = None, min_similarity: float | None = None) -> DataFrame:
        """query_id, rank, key, similarity for queries (query_id, query_embedding) from the probes nearest lists (half of them, if None)."""
        lists = len(self.state()["lists"])
        if not lists:
            return self._nothing(queries)
        asked, (centroids, numbers, _) = written(self._asked(queries), "index-asked"), self._lists()
        visits = written(_visited(asked, centroids, numbers, None, min(lists, probes or -(-lists // 2)), floor=-2.0), "index-visits")
        return self._ranked(self._scored(visits, asked, k, min_similarity), k, self.key)

    def exact(self, queries: DataFrame, k: int = 5, min_similarity: float | None = None) -> DataFrame:
        """As top_k(), with the rows that a full scan gives; `last_visits` is then the table of lists looked through (q, list)."""
        state = self.state()
        if not state["lists"]:
            return self._nothing(queries)
        asked, (centroids, numbers, angles) = written(self._asked(queries), "index-asked"), self._lists()
        floor = -2.0 if min_similarity is None else float(min_similarity)
        nearest = written(_visited(asked, centroids, numbers, None, 1, floor), "index-nearest")
        first = written(self._scored(nearest, asked, k, min_similarity), "index-first")
        kth = first.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("similarity"), "key"))).where(F.col("place") == k).select("q", F.col("similarity").alias("kth"))
        bounded = asked.join(nearest.select("row", F.col("list").alias("near")), "row").join(kth, "q", "left")
        others = written(_visited(bounded, centroids, numbers, angles, 0, floor), "index-others")
        self.last_visits = nearest.unionByName(others).select("q", "list")
        return self._ranked(first.unionByName(self._scored(others, asked, k, min_similarity)), k, self.key)
