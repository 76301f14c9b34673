"""SimHash near-duplicates by bit-sliced comparison.

fingerprints(): 64-bit majority fingerprints over 3-word shingles. near_components(): documents whose
fingerprints differ in RADIUS bits or fewer are linked, and every linked group gets its smallest doc_id.

Candidate search is exact: fingerprints are cut into RADIUS + m pieces, and two that differ in RADIUS
bits agree on m pieces at least, so each choice of m pieces is one table whose key is their bits; m
grows with the number of distinct fingerprints, which keeps the buckets small. Within a bucket the
fingerprints are held as bit planes, 64 lanes to a word; distances of many lanes are counted with
carry-save adders, and a block is abandoned once all its lanes exceed the radius. A bucket emits only
a spanning forest of its links. Buckets of more than CELL fingerprints are cut into cells, and every
pair of cells is compared in a task of its own. Equal fingerprints are one from the start, so groups
of copies cost nothing. Components of the forest edges are found by large-star and small-star rounds
over tables in the shared folder; the pairs of a node that has very many (a hub) are not moved by its
joins, nor are the rows of a very frequent fingerprint.

Defined results: null and empty texts have fingerprint zero and are linked as any other; one or two
words make one shingle; repeated rows fall in one group; rows with null doc_id keep their row and take
the group's smallest id (null if it has none); an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hot_keys, join_one, load, map_arrow, remove, utf8, written, written_at

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Fingerprints compared in one task as a block; larger buckets are cut into cells.
CELL = 2048
SMALL = 48
#: About as many fingerprints of independent texts share a bucket.
MEAN_BUCKET = 512
QUERIES = 256


def fingerprint(text: bytes) -> int:
    words = text.lower().split()  # bytes: A-Z only; cut at ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - SHINGLE + 1)
    h = xxhash.xxh64_intdigest
    if n == 1:
        return h(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: n - 1].tolist()]
    stops = (ends[SHINGLE - 1 :] - 1).tolist()
    votes = np.zeros(64, np.int64)
    for i in range(0, n, 65536):
        x = np.array([h(joined[a:b], SEED) for a, b in zip(starts[i : i + 65536], stops[i : i + 65536], strict=True)], "<u8")
        votes += np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *beside: str) -> DataFrame:
    """doc_id and fp (signed 64 bits) of each row of docs (doc_id, text), and the long columns named beside."""
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "fp", *beside)])

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t) for t in utf8(b.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(fp), *b.columns[2:]], schema=schema)

    return map_arrow(docs.select("doc_id", "text", *beside), run, ", ".join(f"{c} long" for c in schema.names))


def planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes: 64 rows, one lane for each fingerprint, 64 lanes to a word."""
    n = len(fps)
    bits = np.zeros((64, -(-n // 64) * 64), np.uint8)
    bits[:, :n] = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little").T
    return np.packbits(bits, axis=1, bitorder="little").view("<u8")


def _count(plane, shape: tuple, radius: int) -> np.ndarray:
    """Lanes (as bits) with at most radius (3) set planes; plane(p) gives the words of plane p.

    ones and twos hold each lane's count mod 4; a carry out of twos marks the lane as over."""
    ones, twos, over = (np.zeros(shape, np.uint64) for _ in range(3))
    for p in range(0, 64, 4):
        a, b, c, d = (plane(p + k) for k in range(4))
        x = ones ^ a
        carry1 = (ones & a) | (x & b)
        ones = x ^ b
        x = ones ^ c
        carry2 = (ones & c) | (x & d)
        ones = x ^ d
        x = twos ^ carry1
        over |= (twos & carry1) | (x & carry2)
        twos = x ^ carry2
        if not (~over).any():
            break
    if radius < 3:
        over |= twos if radius == 1 else twos & ones if radius == 2 else twos | ones
    return ~over


def close_pairs(queries: np.ndarray, fps: np.ndarray, radius: int = RADIUS):
    """Yields (i, j) arrays of query i and lane j within the radius, a block of queries at a time."""
    stored = planes(fps)
    full = ~np.uint64(0)
    for at in range(0, len(queries), QUERIES):
        q = queries[at : at + QUERIES].astype(np.uint64)
        sign = [np.where((q >> np.uint64(p)) & np.uint64(1), full, np.uint64(0))[:, None] for p in range(64)]
        near = _count(lambda p, s=sign: stored[p][None, :] ^ s[p], (len(q), stored.shape[1]), radius)
        if near.any():
            i, w = np.nonzero(near)
            bits = np.unpackbits(near[i, w].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            k, lane = np.nonzero(bits)
            j = w[k] * 64 + lane
            keep = j < len(fps)
            yield at + i[k][keep], j[keep]


def join_labels(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Hooks linked labels together until each set has its smallest one."""
    while True:
        a, b = labels[i], labels[j]
        differ = a != b
        if not differ.any():
            return
        a, b, i, j = a[differ], b[differ], i[differ], j[differ]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while (labels[labels] != labels).any():
            labels[:] = labels[labels]


def forest(fps: np.ndarray, groups: np.ndarray, sides: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest over links within equal groups (sorted); of large two-sided groups only links across the sides."""
    n = len(fps)
    labels = np.arange(n)
    cuts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1], True]) if n else np.array([0])
    small = np.ones(n, bool)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b - a > SMALL:
            small[a:b] = False
            left, right = (np.flatnonzero(sides[a:b] == s) + a for s in (0, 1))
            for x, y in [(left, right)] if len(right) else [(left, left)]:
                for i, j in close_pairs(fps[x], fps[y]):
                    join_labels(labels, x[i], y[j])
    for d in range(1, SMALL):  # all small groups at once: each lane against the one d places on
        i = np.flatnonzero((groups[d:] == groups[:-d]) & small[d:]) if d < n else np.array([], int)
        if not len(i):
            break
        for k in range(0, len(i), 1 << 18):
            part = i[k : k + (1 << 18)]
            x = planes(fps[part].astype(np.uint64) ^ fps[part + d].astype(np.uint64))
            near = _count(lambda p, x=x: x[p], x.shape[1:], RADIUS)
            hit = part[np.unpackbits(near.astype("<u8").view(np.uint8), bitorder="little")[: len(part)].astype(bool)]
            join_labels(labels, hit, hit + d)
    moved = np.flatnonzero(labels != np.arange(n))
    return fps[moved], fps[labels[moved]]


def tables(n: int) -> list[list[tuple[int, int]]]:
    """For n distinct fingerprints: of each table the (shift, width) of its pieces."""
    for m in (1, 2, 3, 4):
        pieces = RADIUS + m
        if n <= MEAN_BUCKET * 2 ** (64 * m // pieces) or m == 4:
            edges = [64 * k // pieces for k in range(pieces + 1)]
            cut = [(edges[k], edges[k + 1] - edges[k]) for k in range(pieces)]
            return [list(c) for c in combinations(cut, m)]
    raise AssertionError


def links(distinct: DataFrame, n: int) -> DataFrame:
    """Forest edges (a, b) over distinct fingerprints (column fp, n of them) within the radius."""
    keys = []
    for t, pieces in enumerate(tables(n)):
        key, at = F.lit(0).cast("long"), 0
        for shift, width in pieces:
            key = key.bitwiseOR(F.shiftleft(F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1)), at))
            at += width
        keys.append(F.struct(F.lit(t).alias("t"), key.alias("key")))
    rows = distinct.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.t", "k.key")
    large = rows.groupBy("t", "key").count().where(F.col("count") > CELL)
    cells = F.coalesce(F.ceil(F.col("count") / CELL), F.lit(1)).cast("int")
    rows = rows.join(large, ["t", "key"], "left").withColumn("cells", cells).withColumn("cell", F.pmod(F.xxhash64("fp"), "cells").cast("int"))
    # Cell c is side 0 of the pairs (c, j), j >= c, and side 1 of the pairs (i, c), i < c.
    placed = rows.select("fp", "t", "key", "cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("other")).select(
        "fp", "t", "key", F.least("cell", "other").alias("i"), F.greatest("cell", "other").alias("j"), (F.col("other") < F.col("cell")).cast("int").alias("side")
    )
    placed = placed.repartition("t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j", "side", "fp")

    def run(batches):
        kept: pd.DataFrame | None = None
        ident = ["t", "key", "i", "j"]

        def done(p: pd.DataFrame) -> pa.RecordBatch:
            groups = np.cumsum((p[ident] != p[ident].shift()).any(axis=1).to_numpy())
            a, b = forest(p["fp"].to_numpy().view(np.uint64), groups, p["side"].to_numpy())
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            p = batch.to_pandas()
            p = p if kept is None else pd.concat([kept, p], ignore_index=True)
            last = (p[ident] == p[ident].iloc[-1]).all(axis=1).to_numpy() if len(p) else np.array([], bool)
            kept = p[last]  # its group may go on in the next batch
            if not last.all():
                yield done(p[~last])
        if kept is not None and len(kept):
            yield done(kept)

    return map_arrow(placed, run, "a long, b long")


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """node and root for every node of edges (a, b) (long): root is the smallest node it is connected with.

    Large-star and small-star rounds; each round is a table in the shared folder."""
    path, now = written_at(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), label)
    state = None
    while True:
        mark = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state == mark or not mark["n"]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        degree = lambda pairs, total: hot_keys(pairs.groupBy("u").agg(F.count(F.lit(1)).alias("n")), "u", total)
        least = both.groupBy("u").agg(F.min("v").alias("m0")).select("u", F.least("u", "m0").alias("m"))
        large = join_one(both, least, "u", degree(both, 2 * mark["n"])).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = join_one(large, low, "u", degree(large, 2 * mark["n"]))
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        old, (path, now) = path, written_at(small, label)
        remove(edges.sparkSession, old)


def with_roots(groups: DataFrame) -> DataFrame:
    """groups, a written table with a row for each fp, and the root of the component that fp takes part in."""
    edges = links(groups.select("fp"), groups.count())
    roots = components(edges, "simhash-rounds")
    # A group takes part in a component under its root; the others are their own.
    return groups.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_components(fps: DataFrame) -> DataFrame:
    """doc_id, fp and component_id for each row of fps (doc_id, fp), which should be a written table."""
    groups = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")), "simhash-groups")
    total, n_groups = groups.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    named = with_roots(groups)
    lowest = named.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("n"))
    table = written(join_one(named.select("fp", "root"), lowest.drop("n"), "root", hot_keys(lowest, "root", n_groups)).select("fp", "component_id"), "simhash-ids")
    return join_one(fps.select("doc_id", "fp"), table, "fp", hot_keys(groups, "fp", total)).select("doc_id", "fp", "component_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    fps = written(fingerprints(load(spark, sf_dir, "documents")), "simhash-fps")
    return near_components(fps).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
