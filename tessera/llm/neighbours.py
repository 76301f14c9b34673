"""Approximate nearest neighbours over learned partitions.

Learning, on a bounded sample of SAMPLE_PER distinct vectors for each partition: the exact neighbour graph of
the sample; its balanced partitioning (balanced seeds, then rounds in which vectors move to the part
where most of their neighbours are, as far as room allows); a small classifier (one hidden layer)
that learns from the vectors in which parts their neighbours are. Every row is then put in its most
probable partition, and a query is routed to its most probable ones: as many as have a probability of
`mass` together, which is chosen on sample vectors that the classifier has not seen so that RECALL of
their neighbours are found. So a query that lies within one part visits few, one between parts more.
Candidates there are reranked by exact inner products in double precision.

There is a partition for about PART_ROWS distinct vectors, MIN_PARTS at least from MIN_LEARN distinct
vectors on (fewer are one partition). Above MAX_PARTS partitions the router has two levels: the parts
of the first one are partitioned again, each by a router learned from a bounded sample of its own, in
tasks of their own. So partitions keep their size up to MAX_PARTS squared of them.

Search goes by partition and block: partitions of more than ROWS rows are cut into blocks by hash,
and so are their queries beyond QUERIES, so that no task holds more than one block of each. A query
whose partitions hold too few rows visits the next probable ones as well. Equal vectors of a block are scored once. A query's own rows are left out before the best are taken.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no
part; vectors of another length than the commonest are searched whole, among those of their own length; ties go to
the smaller vec_id; rows with the query's own vec_id are no candidates of it; repeated query rows
count as one query, but each different vector of a repeated vec_id is a query of its own, with its own
ranks; repeated candidate rows are listed each; rows without vec_id take no part; an empty table gives
an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import ship
from .common import load, map_arrow, written

K = 20
EVERY = 20
#: Distinct vectors a partition should have, the fewest and most partitions of a level, and sample vectors for each partition.
PART_ROWS = 4096
MIN_PARTS = 8
MAX_PARTS = 256
SAMPLE_PER = 128
MIN_SAMPLE = 2048
#: Numbers in a sample at most, and distinct vectors from which on partitions are learned.
MAX_SAMPLE = 1 << 24
MIN_LEARN = 256
RECALL = 0.94
ROWS = 8192
QUERIES = 2048


def usable(rows: DataFrame) -> DataFrame:
    """vec_id and vec (array of double) of the rows that take part, whatever their length."""
    v = F.col("vec")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec")).where(F.col("vec_id").isNotNull() & (F.size("vec") > 0) & good)


def graph(x: np.ndarray, k: int) -> np.ndarray:
    """Row i: the k vectors with the largest inner product with vector i, itself left out."""
    out = np.empty((len(x), k), np.int64)
    for at in range(0, len(x), 1024):
        s = x[at : at + 1024] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        out[at : at + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced(x: np.ndarray, near: np.ndarray, parts: int, seed: int = 0, rounds: int = 12) -> np.ndarray:
    """A part for every vector: parts of nearly equal size that cut few edges of the graph."""
    n, rng = len(x), np.random.default_rng(seed)
    label = np.zeros(n, np.int64)
    todo = [(np.arange(n), 0, parts)]
    while todo:  # halves along the main direction of each piece, until there are enough parts
        rows, first, m = todo.pop()
        if m == 1:
            label[rows] = first
            continue
        c = x[rows] - x[rows].mean(axis=0)
        d = rng.standard_normal(x.shape[1])
        for _ in range(8):
            d = c.T @ (c @ d)
            d /= max(float(np.linalg.norm(d)), 1e-30)
        order = rows[np.argsort(c @ d, kind="stable")]
        cut = len(rows) * (m // 2) // m
        todo += [(order[:cut], first, m // 2), (order[cut:], first + m // 2, m - m // 2)]
    room = int(np.ceil(n / parts * 1.1)) + 1
    src = np.repeat(np.arange(n), near.shape[1])
    dst = near.ravel()
    for _ in range(rounds):
        votes = np.zeros((n, parts))
        np.add.at(votes, (src, label[dst]), 1)
        np.add.at(votes, (dst, label[src]), 1)
        gain = votes.max(axis=1) - votes[np.arange(n), label]
        want, counts, moved = votes.argmax(axis=1), np.bincount(label, minlength=parts), 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if counts[want[i]] < room and rng.random() < 0.7:
                counts[label[i]] -= 1
                counts[want[i]] += 1
                label[i] = want[i]
                moved += 1
        if not moved:
            break
    return label


class Router:
    """A classifier with one hidden layer: probabilities of parts for vectors."""

    def __init__(self, x: np.ndarray, soft: np.ndarray, hidden: int = 128, epochs: int = 40, seed: int = 0):
        rng = np.random.default_rng(seed)
        d, p = x.shape[1], soft.shape[1]
        self.scale = 1 / max(float(np.sqrt((x**2).sum(axis=1).mean())), 1e-30) * np.sqrt(d)
        w = [rng.standard_normal((d, hidden)) / np.sqrt(d), np.zeros(hidden), rng.standard_normal((hidden, p)) / np.sqrt(hidden), np.zeros(p)]
        m, v, step = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
        z = x * self.scale
        for _ in range(epochs):
            order = rng.permutation(len(z))
            for at in range(0, len(z), 256):
                a, y = z[order[at : at + 256]], soft[order[at : at + 256]]
                h = np.maximum(a @ w[0] + w[1], 0)
                o = h @ w[2] + w[3]
                o = np.exp(o - o.max(axis=1, keepdims=True))
                g = (o / o.sum(axis=1, keepdims=True) - y) / len(a)
                gh = (g @ w[2].T) * (h > 0)
                step += 1
                for k, grad in enumerate((a.T @ gh + 1e-4 * w[0], gh.sum(axis=0), h.T @ g + 1e-4 * w[2], g.sum(axis=0))):
                    m[k] = 0.9 * m[k] + 0.1 * grad
                    v[k] = 0.999 * v[k] + 0.001 * grad**2
                    w[k] = w[k] - 0.002 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        self.w = w

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x * self.scale) @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3]

    def before(self, x: np.ndarray) -> np.ndarray:
        """For each vector and part: the probability of all parts that are more probable."""
        p = self.scores(x)
        p = np.exp(p - p.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        order = np.argsort(-p, axis=1, kind="stable")
        ranked = np.take_along_axis(p, order, axis=1)
        out = np.empty_like(p)
        np.put_along_axis(out, order, np.cumsum(ranked, axis=1) - ranked, axis=1)
        return out


class Index:
    """What is learned from a sample: the router, and the probability that a query's partitions have together.

    children: indices of parts that are partitioned again, by part. A partition's number is part * stride + the child's part."""

    def __init__(self, sample: np.ndarray, parts: int, k: int = K, recall: float = RECALL):
        self.parts, self.router, self.mass, self.children, self.stride = parts, None, 1.0, {}, MAX_PARTS
        x = np.unique(sample, axis=0)
        if parts == 1 or len(x) < 2 * parts:
            self.parts = 1
            return
        k = min(k, len(x) - 1)
        near = graph(x, k)
        label = balanced(x, near, parts)
        soft = 0.2 * np.eye(parts)[label] + 0.8 * np.stack([np.bincount(r, minlength=parts) for r in label[near]]) / k
        fit, test = np.arange(len(x)) % 5 != 0, np.arange(len(x)) % 5 == 0  # mass is chosen on rows the router has not seen
        trial = Router(x[fit], soft[fit])
        home = trial.scores(x).argmax(axis=1)
        needed = np.take_along_axis(trial.before(x[test]), home[near[test]], axis=1)
        self.mass = float(np.quantile(needed, recall, method="higher"))
        self.router = Router(x, soft)

    def homes(self, x: np.ndarray) -> np.ndarray:
        """The partition of each vector."""
        part = self.router.scores(x).argmax(axis=1) if self.router else np.zeros(len(x), np.int64)
        out = part * self.stride
        for p, child in self.children.items():
            at = np.flatnonzero(part == p)
            if len(at):
                out[at] += child.homes(x[at]) // self.stride
        return out

    def routes(self, x: np.ndarray) -> list[list[int]]:
        """The partitions that each vector's query visits."""
        if not self.router:
            return [[0]] * len(x)
        visit = self.router.before(x) <= self.mass
        out = [(np.flatnonzero(v) * self.stride).tolist() for v in visit]
        for p, child in self.children.items():
            at = np.flatnonzero(visit[:, p])
            for i, below in zip(at, child.routes(x[at]) if len(at) else (), strict=True):
                out[i] = [q for q in out[i] if q != p * self.stride] + [p * self.stride + q // self.stride for q in below]
        return out

    def routes_to(self, x: np.ndarray, least: list[int], rows: dict[int, int]) -> list[list[int]]:
        """routes(), with the next probable parts added where the partitions hold fewer rows than a query needs; rows: of each partition."""
        out = self.routes(x)
        short = [i for i, parts in enumerate(out) if sum(rows.get(p, 0) for p in parts) < least[i]]
        if short and self.router:
            within: dict[int, list[int]] = {}
            for p in rows:
                within.setdefault(p // self.stride, []).append(p)
            for i, order in zip(short, np.argsort(self.router.before(x[short]), axis=1, kind="stable"), strict=True):
                parts, have = list(out[i]), sum(rows.get(p, 0) for p in out[i])
                for part in order.tolist():
                    more = [p for p in within.get(part, ()) if p not in parts] if have < least[i] else []
                    parts += more
                    have += sum(rows[p] for p in more)
                out[i] = parts
        return out


def n_parts(n: int) -> int:
    """How many partitions of one level n distinct vectors get."""
    return 1 if n < MIN_LEARN else int(min(MAX_PARTS, max(MIN_PARTS, -(-n // PART_ROWS))))


def sample_size(parts: int, dim: int) -> int:
    return min(max(MIN_SAMPLE, SAMPLE_PER * parts), MAX_SAMPLE // dim)


def learn(vectors: DataFrame) -> Index | None:
    """The first level of the index for vectors (vec) of one length, from the distinct ones with the smallest hashes.

    A threshold on the hash leaves about twice the sample, so neither copies nor the number of rows or
    partitions decide what is shuffled or reaches the driver."""
    h = F.xxhash64("vec")
    n, dim = vectors.agg(F.approx_count_distinct(h), F.max(F.size("vec"))).first()
    if not n:
        return None
    parts = n_parts(n)
    size = sample_size(parts, dim)
    drawn = vectors.select("vec", F.pmod(h, F.lit(1 << 40)).alias("h")).where(F.col("h") < int(min(1.0, 2 * size / n) * (1 << 40))).distinct()
    return Index(np.array([r["vec"] for r in drawn.orderBy("h", "vec").limit(size).collect()]), parts)


def learn_children(index: Index, homes: DataFrame, dim: int) -> dict[int, Index]:
    """Indices of the parts of index that have more than 2 * PART_ROWS distinct vectors, each learned in a task of its own; homes: vec, part."""
    h = F.xxhash64("vec")
    counts = {r["part"] // index.stride: r["n"] for r in homes.groupBy("part").agg(F.approx_count_distinct(h).alias("n")).collect()}
    large = {p: n for p, n in counts.items() if n > 2 * PART_ROWS}
    if index.parts < MAX_PARTS or not large:
        return {}
    parts = {p: n_parts(n) for p, n in large.items()}
    size, stride = {p: sample_size(n, dim) for p, n in parts.items()}, index.stride
    least = F.element_at(F.array(*[F.lit(int(min(1.0, 1.2 * size[p] / large[p]) * (1 << 40)) if p in large else 0) for p in range(index.parts)]), (F.col("part") / index.stride).cast("int") + 1)
    drawn = homes.where(F.pmod(h, F.lit(1 << 40)) < least).select("part", "vec").distinct()

    def fit(rows):
        import pandas as pd

        p = int(rows["part"].iloc[0]) // stride
        return pd.DataFrame({"part": [p], "model": [pickle.dumps(Index(np.stack(rows["vec"].to_numpy()), parts[p]))]})

    ship(homes.sparkSession)
    models = written(drawn.groupBy("part").applyInPandas(fit, "part long, model binary"), "ann-routers")
    return {r["part"]: pickle.loads(r["model"]) for r in models.collect()}  # MAX_PARTS routers at most


def nearest(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of the query, vec_id, score of each query's k nearest; equal vectors are scored once and alike."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    unique, inverse, counts = np.unique(x + 0.0, axis=0, return_inverse=True, return_counts=True)
    members = np.argsort(inverse.ravel(), kind="stable")
    first = np.r_[0, np.cumsum(counts)]
    own = np.searchsorted(ids, q_ids, "right") - np.searchsorted(ids, q_ids, "left")  # rows that are no candidates of the query
    out_q, out_v, out_s = [], [], []
    for at in range(0, len(q), 256):
        approx = q[at : at + 256] @ unique.T
        best = min(k + max(1, int(own[at : at + 256].max())), len(unique))
        kth = np.partition(approx, len(unique) - best, axis=1)[:, len(unique) - best]
        for r in range(len(approx)):
            near = np.flatnonzero(approx[r] >= kth[r] - 1e-9 * max(1.0, abs(kth[r])))
            score = (unique[near] * q[at + r]).sum(axis=1)
            most = k + own[at + r]
            cand = np.concatenate([members[first[u] : min(first[u + 1], first[u] + most)] for u in near])
            s = np.repeat(score, np.minimum(counts[near], most))
            keep = ids[cand] != q_ids[at + r]
            cand, s = cand[keep], s[keep]
            top = np.lexsort((ids[cand], -s))[:k]
            out_q.append(np.full(len(top), at + r))
            out_v.append(ids[cand[top]])
            out_s.append(s[top])
    return tuple(np.concatenate(o) if o else np.array([], t) for o, t in ((out_q, np.int64), (out_v, np.int64), (out_s, np.float64)))


def _mapped(run):
    """For mapInArrow over (vec_id, vec, own), vectors of one length: run(matrix, own) gives the partitions of each as a list."""

    def mapped(batches):
        for b in batches:
            x = np.stack([np.asarray(v) for v in b.column("vec").to_numpy(zero_copy_only=False)]) if b.num_rows else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("vec"), pa.array(run(x, b.column("own").to_pylist()) if len(x) else [], pa.list_(pa.int64()))], names=["vec_id", "vec", "parts"])

    return mapped


def search(rows: DataFrame, is_query, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of every row for which is_query (a Column over vec_id) holds."""
    spark = rows.sparkSession
    vectors = usable(rows)
    length = F.size("vec")
    lengths = vectors.groupBy(length.alias("length")).count()
    common = lengths.orderBy(F.desc("count"), "length").first()
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = common["length"]
    usual, schema = vectors.where(length == dim), "vec_id long, vec array<double>, parts array<long>"
    index = learn(usual)

    def placed(index: Index) -> DataFrame:
        shared = spark.sparkContext.broadcast(index)
        homes = map_arrow(usual.withColumn("own", F.lit(0)), _mapped(lambda x, _: shared.value.homes(x)[:, None].tolist()), schema).select("vec_id", "vec", F.col("parts")[0].alias("part"))
        others = vectors.where(length != dim).select("vec_id", "vec", (-length).cast("long").alias("part"))  # a partition for each other length
        return written(homes.unionByName(others), "ann-rows")

    homes = placed(index)
    index.children = learn_children(index, homes.where("part >= 0"), dim)
    if index.children:
        homes = placed(index)
    sizes = written(homes.groupBy("part").agg(F.count(F.lit(1)).alias("r")), "ann-sizes")
    # MAX_PARTS squared partitions at most. A query needs k rows besides its own.
    shared = spark.sparkContext.broadcast((index, {r["part"]: r["r"] for r in sizes.where("part >= 0").collect()}))
    queries = homes.where(is_query).groupBy("vec_id", "vec").agg(F.min("part").alias("part"), F.count(F.lit(1)).alias("n"))
    queries = queries.join(queries.groupBy("vec_id").agg(F.sum("n").alias("own")), "vec_id")
    usual = queries.where("part >= 0").select("vec_id", "vec", "own")
    routed = map_arrow(usual, _mapped(lambda x, own: shared.value[0].routes_to(x, [k + n for n in own], shared.value[1])), schema).select("vec_id", "vec", F.explode("parts").alias("part"))
    routed = written(routed.unionByName(queries.where("part < 0").select("vec_id", "vec", "part")), "ann-queries")
    # Blocks of each partition, a row each.
    blocks = sizes.join(routed.groupBy("part").agg(F.count(F.lit(1)).alias("q")), "part").select("part", F.ceil(F.col("r") / ROWS).cast("int").alias("rbs"), F.ceil(F.col("q") / QUERIES).cast("int").alias("qbs"))
    blocks = written(blocks, "ann-blocks")
    cell = lambda n: F.pmod(F.xxhash64("vec_id", "vec"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = routed.join(blocks, "part").withColumn("qb", cell(F.col("qbs"))).withColumn("rb", every("rbs")).select("part", "rb", "qb", "vec_id", "vec", F.xxhash64("vec").alias("qh"))
    right = homes.join(blocks, "part").withColumn("rb", cell(F.col("rbs"))).withColumn("qb", every("qbs")).select("part", "rb", "qb", "vec_id", "vec")

    def cells(q, x):
        import pandas as pd

        i, v, s = nearest(q["vec_id"].to_numpy(), np.stack(q["vec"].to_numpy()), x["vec_id"].to_numpy(), np.stack(x["vec"].to_numpy()), k) if len(q) and len(x) else (np.array([], int), [], [])
        return pd.DataFrame({"query_id": q["vec_id"].to_numpy(np.int64)[i], "qh": q["qh"].to_numpy(np.int64)[i], "vec_id": np.asarray(v, np.int64), "score": np.asarray(s, np.float64)})

    key = ["part", "rb", "qb"]
    ship(spark)
    found = left.groupBy(key).cogroup(right.groupBy(key)).applyInPandas(cells, "query_id long, qh long, vec_id long, score double")
    best = Window.partitionBy("query_id", "qh").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(load(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)
