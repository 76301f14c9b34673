"""Near copies by wide SimHash: bit-sliced distances propose, the exact similarity of word shingles decides.

keep_first() leaves one document of each group linked by a Jaccard similarity of SIMILARITY or more of
the sets of SHINGLE-word shingles. Such texts differ in some 10 of 64 SimHash bits, where agreeing pieces
of a fingerprint select nothing, so it differs from op8's search in three places:

- Fingerprints have 256 bits, and the radius follows from the similarity: the share of differing bits
  expected at it, and DEVIATIONS standard deviations more.
- Two fingerprints meet in a bucket if all ROWS least hashes of one of BANDS bands agree, as 99.5 % of
  the pairs at a similarity of 0.8 do, and more above. Within a bucket the fingerprints are bit planes;
  carry-save adders count many distances at once, and a block is abandoned once all its lanes exceed
  the radius.
- A bucket emits a spanning forest of its links, near ones first, and each link of it is confirmed by
  the exact similarity of both texts, so nothing less similar is linked. A link that fails may have stood for
  others, so forests can be made again over what such links had joined, without them and starting from what is confirmed,
  until no link is left to propose or `rounds` times (ROUNDS).

What SimHash leaves out (a pair that no bucket holds, or beyond the radius, or in whose place a less similar link
stands) is found exactly by left_out(), among texts that are not joined yet: the groups are those of all pairs of the
threshold. Texts of similarity t share t of the shingles of each, so of their least hashes
(1 - t + SHARED of all) they share SHARED of all; texts that have less in common with all others are set aside, and of
the rest those hashes meet that fewest texts have. What meets is compared within its bucket by size and by parities of the
sets, so only pairs that may be similar leave it.

Equal sets of shingles are one from the start. Buckets of more than CELL fingerprints are compared as
pairs of cells, each in a task of its own. Components as in simhash.

Defined results: null, empty and wordless texts are copies of each other; texts of fewer than SHINGLE
words are one shingle; repeated rows leave one; rows with null doc_id are kept as any other; an empty
table gives an empty result; all columns are returned as they are, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, join_one, keyed, map_arrow, placed, release, settle, utf8, whole_rows, written, written_at
from .simhash import components

SHINGLE = 5
SIMILARITY = 0.8
SEED = 42
LONGS = 4
BANDS, ROWS = 10, 4
DEVIATIONS = 4
#: Fingerprints compared in one task as a block; larger buckets are cut into cells.
CELL = 2048
SMALL = 48
#: Links of one text that are compared in one place.
HUB = 500
#: Forests made again after links have failed; left_out() finds what they stood for as well.
ROUNDS = 0
#: Share of a text's shingles that must be among the least hashes of both texts of a pair.
SHARED = 0.05
#: Places of the parities of a set of up to NARROW_SET hashes; twice as many for sets up to twice as large, and so on.
NARROW, NARROW_SET = 1024, 448
QUERIES = 128
#: Shares of the radius within which links are taken, one after the other.
STEPS = (0.3, 0.55, 0.8, 1.0)
#: Shingles hashed at once.
CHUNK = 4096
ODD = np.array([xxhash.xxh64_intdigest(str(k), SEED) | 1 for k in range(BANDS * ROWS)], np.uint64)


def radius_of(similarity: float) -> int:
    """Differing bits allowed: at a given Jaccard similarity the angle is widest between sets of equal size."""
    bits, p = 64 * LONGS, math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(bits * p + DEVIATIONS * math.sqrt(bits * p * (1 - p)))


def shingle_set(text: bytes, words: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of the shingles, sorted."""
    cut = text.lower().split()  # bytes: A-Z only; cut at ASCII white space only
    if not cut:
        return np.array([], np.uint64)
    joined, n, h = b" ".join(cut), max(1, len(cut) - words + 1), xxhash.xxh64_intdigest
    if n == 1:
        return np.array([h(joined, SEED)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in cut])
    return np.unique(np.array([h(joined[a:b], SEED) for a, b in zip([0, *ends[: n - 1].tolist()], (ends[words - 1 :] - 1).tolist(), strict=True)], np.uint64))


def mixed(x: np.ndarray) -> np.ndarray:
    for shift, k in ((33, 0), (29, 1)):
        x = (x ^ (x >> np.uint64(shift))) * ODD[k]
    return x ^ (x >> np.uint64(32))


def signature(shingles: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Of a set of hashes: its digest, its fingerprint (LONGS words) and the keys of its buckets."""
    n, salt = len(shingles), np.arange(LONGS, dtype=np.uint64)[:, None] * ODD[2]
    if not n:
        return 0, np.zeros(LONGS, np.uint64), np.array([], np.uint64)
    votes, least = np.zeros((LONGS, 64), np.int64), np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, n, CHUNK):
        x = shingles[at : at + CHUNK][None, :]
        bits = np.unpackbits(mixed(x ^ salt).astype("<u8").view(np.uint8).reshape(LONGS, -1, 8), axis=2, bitorder="little")
        votes += bits.sum(axis=1, dtype=np.int64)
        np.minimum(least, (x * ODD[:, None]).min(axis=1), out=least)
    fp = np.packbits(2 * votes > n, axis=1, bitorder="little").view("<u8")[:, 0]
    bands = (least.reshape(BANDS, ROWS) * ODD[:ROWS]).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * ODD[ROWS]
    return int(shingles.sum(dtype=np.uint64)), fp, mixed(bands)


def prefix_sizes(n: int, similarity: float) -> tuple[int, int]:
    """Of a set of n shingles: how many of its least hashes are compared, and how many of them a set as similar has among its own.

    A similar set has at least ceil(similarity * n) of the n, so the first hashes in common lie within the n less that of the start, and as many
    more as are asked for; the other set, which has similarity * n shingles at least, asks for as many at least."""
    # A little less than the product, so that rounding keeps pairs in.
    common = lambda m: math.ceil(similarity * m - 1e-9)
    asked = lambda m: min(common(m), int(SHARED * m) + 1)
    return n - common(n) + asked(n), asked(common(n))


def parities(shingles: np.ndarray) -> np.ndarray:
    """Of a set of hashes: whether an odd number of them falls in a place, a bit for each of at least NARROW places, which grow with the set.

    Sets differ in no fewer hashes than their parities in bits, so parities too far apart rule a pair out. Halves laid upon each other are those of half as many places."""
    places = NARROW << max(0, math.ceil(math.log2(max(1, len(shingles)) / NARROW_SET)))
    odd = np.bincount((shingles & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def csa(a, b, c):
    x = a ^ b
    return x ^ c, (a & b) | (x & c)


def above(counter: list[np.ndarray], value: int) -> np.ndarray:
    """Lanes (as bits) whose number, held in bit planes from the lowest, is above value."""
    more, equal = np.zeros_like(counter[0]), ~np.zeros_like(counter[0])
    for k in range(len(counter) - 1, -1, -1):
        if value >> k & 1:
            equal &= counter[k]
        else:
            more |= equal & counter[k]
            equal &= ~counter[k]
    return more


def within(plane, shape: tuple, radius: int) -> np.ndarray:
    """Lanes (as bits) with at most radius set planes; plane(p) gives the words of plane p."""
    ones, twos, fours, *eights = (np.zeros(shape, np.uint64) for _ in range(3 + (8 * LONGS).bit_length()))
    for p in range(0, 64 * LONGS, 8):
        d = [plane(p + k) for k in range(8)]
        ones, a = csa(ones, d[0], d[1])
        ones, b = csa(ones, d[2], d[3])
        twos, e = csa(twos, a, b)
        ones, a = csa(ones, d[4], d[5])
        ones, b = csa(ones, d[6], d[7])
        twos, f = csa(twos, a, b)
        fours, carry = csa(fours, e, f)
        for k, c in enumerate(eights):
            eights[k], carry = c ^ carry, c & carry
        if p % 32 == 24 and not (~above(eights, radius // 8)).any():
            return np.zeros(shape, np.uint64)
    return ~above([ones, twos, fours, *eights], radius)


def planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes of fingerprints (n, LONGS): a row for each bit, 64 lanes to a word."""
    n = len(fps)
    bits = np.zeros((64 * LONGS, -(-n // 64) * 64), np.uint8)
    bits[:, :n] = np.unpackbits(np.ascontiguousarray(fps, "<u8").view(np.uint8).reshape(n, 8 * LONGS), axis=1, bitorder="little").T
    return np.packbits(bits, axis=1, bitorder="little").view("<u8")


def close_pairs(queries: np.ndarray, fps: np.ndarray, radius: int):
    """Yields (i, j) arrays of query i and lane j within the radius, a block of queries at a time."""
    stored, full = planes(fps), ~np.uint64(0)
    for at in range(0, len(queries), QUERIES):
        q = np.unpackbits(np.ascontiguousarray(queries[at : at + QUERIES], "<u8").view(np.uint8).reshape(-1, 8 * LONGS), axis=1, bitorder="little")
        sign = np.where(q.T[:, :, None], full, np.uint64(0))
        near = within(lambda p, s=sign: stored[p][None, :] ^ s[p], (len(q), stored.shape[1]), radius)
        if near.any():
            i, w = np.nonzero(near)
            k, lane = np.nonzero(np.unpackbits(near[i, w].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            j = w[k] * 64 + lane
            keep = j < len(fps)
            yield at + i[k][keep], j[keep]


def hooked(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Joins linked labels, and returns the places of the links that did it, the first ones where several do."""
    at, kept = np.arange(len(i)), [np.array([], int)]
    while True:
        a, b = labels[i[at]], labels[j[at]]
        at, a, b = (x[a != b] for x in (at, a, b))
        if not len(at):
            return np.concatenate(kept)
        high, first = np.unique(np.maximum(a, b), return_index=True)
        labels[high] = np.minimum(a, b)[first]
        kept.append(at[first])
        while (labels[labels] != labels).any():
            labels[:] = labels[labels]


def forest(fps: np.ndarray, groups: np.ndarray, sides: np.ndarray, radius: int, labels: np.ndarray | None = None, refused=None) -> tuple[np.ndarray, np.ndarray]:
    """Places of the links of a spanning forest within equal groups (sorted), near links first; of large two-sided groups only links across the sides.

    labels: what is joined already (smallest places); refused(i, j): which links are not to be made."""
    n, out = len(fps), [(np.array([], int), np.array([], int))]
    labels = np.arange(n) if labels is None else labels

    def take(i, j):
        if refused is not None:
            good = ~refused(i, j)
            i, j = i[good], j[good]
        order = np.argsort(np.bitwise_count(fps[i] ^ fps[j]).sum(axis=1), kind="stable")
        i, j = i[order], j[order]
        kept = hooked(labels, i, j)
        out.append((i[kept], j[kept]))

    cuts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1], True]) if n else np.array([0])
    small = np.ones(n, bool)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b - a > SMALL:
            small[a:b] = False
            left, right = (np.flatnonzero(sides[a:b] == s) + a for s in (0, 1))
            x, y = (left, right) if len(right) else (left, left)
            for step in STEPS:
                for i, j in close_pairs(fps[x], fps[y], int(step * radius)):
                    take(x[i], y[j])
    found = []
    for d in range(1, SMALL):  # all small groups at once: each lane against the one d places on
        i = np.flatnonzero((groups[d:] == groups[:-d]) & small[d:]) if d < n else np.array([], int)
        if not len(i):
            break
        for k in range(0, len(i), 1 << 15):
            part = i[k : k + (1 << 15)]
            x = planes(fps[part] ^ fps[part + d])
            near = within(lambda p, x=x: x[p], x.shape[1:], radius)
            hit = part[np.unpackbits(near.astype("<u8").view(np.uint8), bitorder="little")[: len(part)].astype(bool)]
            found.append((hit, hit + d))
    if found:
        take(*(np.concatenate(x) for x in zip(*found, strict=True)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def proposed(groups: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) over groups (gid, fp array, keys array) to be confirmed.

    Where groups have root and failed as well, rows of one root are joined already, and failed has the gids that a row is not to be linked with."""
    again = ["root", "failed"] if "root" in groups.columns else []
    rows = groups.select("gid", "fp", F.explode("keys").alias("key"), *again)
    large = rows.groupBy("key").count().where(F.col("count") > CELL)
    rows = rows.join(large, "key", "left").withColumn("cells", F.coalesce(F.ceil(F.col("count") / CELL), F.lit(1)).cast("int"))
    rows = rows.withColumn("cell", F.pmod(F.xxhash64("gid"), "cells").cast("int"))
    # Cell c is side 0 of the pairs (c, j), j >= c, and side 1 of the pairs (i, c), i < c.
    placed = rows.select("gid", "fp", "key", "cell", *again, F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("other")).select(
        *again, "gid", *[F.col("fp")[k].alias(f"w{k}") for k in range(LONGS)], "key", F.least("cell", "other").alias("i"), F.greatest("cell", "other").alias("j"), (F.col("other") < F.col("cell")).cast("int").alias("side")
    )
    ident = ["key", "i", "j"]
    placed = placed.repartition(*ident).sortWithinPartitions(*ident, "side", "gid")

    def run(batches):
        kept: pd.DataFrame | None = None

        def done(p: pd.DataFrame) -> pa.RecordBatch:
            p = p[p.duplicated(ident, keep=False).to_numpy()]
            same = np.cumsum((p[ident] != p[ident].shift()).any(axis=1).to_numpy())
            fps = p[[f"w{k}" for k in range(LONGS)]].to_numpy(np.int64).view(np.uint64).reshape(-1, LONGS)
            ids, labels, refused = p["gid"].to_numpy(), None, None
            if again:
                labels = p.assign(same=same, at=np.arange(len(p))).groupby(["same", "root"])["at"].transform("min").to_numpy()
                pairs = pd.MultiIndex.from_tuples([(i, f) for i, fs in zip(ids.tolist(), p["failed"], strict=True) if fs is not None for f in fs], names=["a", "b"])
                refused = lambda i, j: pd.MultiIndex.from_arrays([ids[i], ids[j]]).isin(pairs) if len(pairs) else np.zeros(len(i), bool)
            a, b = forest(fps, same, p["side"].to_numpy(), radius, labels, refused)
            return pa.RecordBatch.from_arrays([pa.array(np.maximum(ids[a], ids[b])), pa.array(np.minimum(ids[a], ids[b]))], names=["a", "b"])

        for batch in batches:
            p = batch.to_pandas()
            p = p if kept is None else pd.concat([kept, p], ignore_index=True)
            last = (p[ident] == p[ident].iloc[-1]).all(axis=1).to_numpy() if len(p) else np.array([], bool)
            kept = p[last]  # its group may go on in the next batch
            if not last.all():
                yield done(p[~last])
        if kept is not None and len(kept):
            yield done(kept)

    return map_arrow(placed, run, "a long, b long").distinct()


def signatures(docs: DataFrame, words: int, *beside: str, similarity: float = SIMILARITY) -> DataFrame:
    """gid, fp and keys of each row of docs (text), its number of shingles n, `shared` and the least hashes of prefix_sizes(), its parities, and the long columns named beside."""
    longs = pa.list_(pa.int64())
    schema = pa.schema([("gid", pa.int64()), ("fp", longs), ("keys", longs), ("n", pa.int64()), ("shared", pa.int64()), ("least", longs), ("parity", longs), *((c, pa.int64()) for c in beside)])

    def run(batches):
        for b in batches:
            sets = [shingle_set(t, words) for t in utf8(b.column(0))]
            got = [signature(x) for x in sets]
            gid = pa.array(np.array([g for g, _, _ in got], np.uint64).view(np.int64))
            lists = [pa.array([x[k].view(np.int64) for x in got], longs) for k in (1, 2)]
            sizes = [(len(x), *prefix_sizes(len(x), similarity)) for x in sets]
            n, shared = (pa.array([z[k] for z in sizes], pa.int64()) for k in (0, 2))
            least = pa.array([x[: z[1]].view(np.int64) for x, z in zip(sets, sizes, strict=True)], longs)  # sets are sorted
            parity = pa.array([parities(x).view(np.int64) for x in sets], longs)
            yield pa.RecordBatch.from_arrays([gid, *lists, n, shared, least, parity, *b.columns[1:]], schema=schema)

    return map_arrow(docs.select("text", *beside), run, ", ".join(["gid long, fp array<long>, keys array<long>, n long, shared long, least array<long>, parity array<long>", *(f"{c} long" for c in beside)]))


def left_out(groups: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """A written table of links (a, b) to be confirmed that hold every pair of groups (gid, n, shared, least, parity) of the similarity with different roots (gid, root; others are alone)."""
    spark, before = groups.sparkSession, placed(groups.sparkSession)
    rooted = written(groups.join(roots, "gid", "left").select("gid", F.coalesce("root", "gid").alias("root"), "n", "shared", "least"), "copies-least")
    settle(spark)
    # A hash within one root joins nothing new and counts as one that no other text has.
    counts = rooted.select("root", F.explode("least").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high"))
    counts = written(counts.where("low <> high").select("key", "n"), "copies-counts")
    settle(spark)
    hot = hot_keys(counts, "key", counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    met = join_one(rooted.select("gid", F.explode("least").alias("key")), counts.hint("merge"), "key", hot).groupBy("gid").agg(F.array_sort(F.collect_list(F.struct(F.col("n").alias("count"), "key"))).alias("keys"))
    # By rarity, hashes that no other root has come first; a pair shares `shared` of a text's hashes, so the rarest of these is not among its last shared - 1.
    met = rooted.drop("least").join(met.where(F.size("keys") > 0).hint("merge"), "gid").where(F.size("keys") >= F.col("shared"))
    kept = met.select("gid", "root", "n", F.explode(F.slice("keys", F.lit(1), (F.size("keys") - F.col("shared") + 1).cast("int"))).alias("k")).select("gid", "root", "n", "k.key", "k.count")
    kept = written(kept, "copies-rare")
    settle(spark)
    # Buckets of the same texts make the same pairs: one of them stands for all.
    buckets = kept.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("gid")).alias("h1"), F.bit_xor(F.xxhash64(F.lit(SEED), "gid")).alias("h2")).where("n > 1")
    buckets = written(buckets.groupBy("n", "h1", "h2").agg(F.min("key").alias("key")).select("key", F.col("n").alias("count")), "copies-buckets")
    hot = hot_keys(buckets.withColumnRenamed("count", "n"), "key", buckets.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0])
    met = join_one(kept.select("gid", "root", "n", "key"), buckets.hint("merge"), "key", hot).join(groups.select("gid", "parity").hint("merge"), "gid")
    path, found = written_at(alike(met.withColumn("cells", F.ceil(F.col("count") / CELL).cast("int")), similarity).distinct(), "copies-proposed")
    release(spark, keep={*before, path})
    settle(spark)
    return found


def alike(rows: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of rows (gid, root, n, parity, key, cells) of one key that may be similar and have different roots, all of them: sizes and parities leave nothing similar out."""
    rows = rows.withColumn("cell", F.pmod(F.xxhash64("gid"), "cells").cast("int"))
    dealt = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("other")).select(
        "gid", "root", "n", "parity", "key", F.least("cell", "other").alias("i"), F.greatest("cell", "other").alias("j"), (F.col("other") < F.col("cell")).cast("int").alias("side")
    )
    ident = ["key", "i", "j"]
    dealt = dealt.repartition(*ident).sortWithinPartitions(*ident)

    def run(batches):
        for t in whole_groups(batches, ident):
            p = t.drop_columns("parity").to_pandas()
            same = np.cumsum((p[ident] != p[ident].shift()).any(axis=1).to_numpy())
            flat, ids = t.column("parity").combine_chunks(), p["gid"].to_numpy()
            words, ends = flat.flatten().to_numpy().view(np.uint64), flat.value_lengths().to_numpy().cumsum()
            a, b = pairs_of(same, p["side"].to_numpy(), (p["i"] == p["j"]).to_numpy(), p["root"].to_numpy(), p["n"].to_numpy(), words, ends, similarity)
            found = pd.DataFrame({"a": np.maximum(ids[a], ids[b]), "b": np.minimum(ids[a], ids[b])}).drop_duplicates()
            yield pa.RecordBatch.from_arrays([pa.array(found[c].to_numpy()) for c in ("a", "b")], names=["a", "b"])

    return map_arrow(dealt, run, "a long, b long")


def whole_groups(batches, ident: list[str]):
    """Tables of the batches' rows, sorted by ident, none of which ends within a group."""
    kept: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        ends = [b.column(c).to_numpy() for c in ident]
        cut = int(np.logical_or.reduce([x != x[-1] for x in ends]).sum())
        if cut or kept and any(x[-1] != kept[-1].column(c)[-1].as_py() for x, c in zip(ends, ident, strict=True)):
            yield pa.Table.from_batches([*kept, b.slice(0, cut)])
            kept = []
        kept.append(b.slice(cut))
    if kept:
        yield pa.Table.from_batches(kept)


def pairs_of(groups, sides, within_cell, roots, n, words, ends, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs within equal groups (sorted) that may be similar and have different roots; of two cells only pairs across the sides."""
    out = [(np.array([], int), np.array([], int))]
    widths = np.diff(ends, prepend=0)
    place, folded = {}, {}
    for w in np.unique(widths).tolist():  # texts of similar sizes have as many words or twice as many
        at = np.flatnonzero((widths == w) | (widths == 2 * w))
        m = np.empty((w, len(at)), np.uint64)
        wide = widths[at] == 2 * w
        starts = (ends - widths)[at]
        for k in range(w):
            m[k] = words[starts + k]
            m[k, wide] ^= words[starts[wide] + k + w]
        place[w] = np.zeros(len(n), int)
        place[w][at] = np.arange(len(at))
        folded[w] = m
    differ = (1 - similarity) / (1 + similarity)

    def take(w, x, y):
        """x against y (places that broadcast), by parities of w words."""
        m, u, v = folded[w], place[w][x], place[w][y]
        d = np.zeros(np.broadcast_shapes(x.shape, y.shape), np.int32)
        for k in range(w):
            d += np.bitwise_count(m[k][u] ^ m[k][v])
        small, large = np.minimum(n[x], n[y]), np.maximum(n[x], n[y])
        return (d <= differ * (small + large) + 1e-6) & (small >= similarity * large - 1e-9) & (roots[x] != roots[y])

    cuts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1], True]) if len(n) else np.array([0])
    small = np.ones(len(n), bool)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b - a <= SMALL:
            continue
        small[a:b] = False
        rows = np.arange(a, b)
        for w in np.unique(widths[a:b]).tolist():
            for ours, theirs in ((w, w), (w, 2 * w), (2 * w, w)):
                x, y = rows[(widths[a:b] == ours) & (sides[a:b] == 0)], rows[(widths[a:b] == theirs) & (sides[a:b] == (not within_cell[a]))]
                if within_cell[a] and ours > theirs:
                    continue
                for k in range(0, len(x), QUERIES):
                    q = x[k : k + QUERIES]
                    i, j = np.nonzero(take(w, q[:, None], y[None, :]))
                    i, j = q[i], y[j]
                    once = (i < j) | (ours != theirs) | (not within_cell[a])
                    out.append((i[once], j[once]))
    for d in range(1, SMALL):
        i = np.flatnonzero((groups[d:] == groups[:-d]) & small[d:]) if d < len(n) else np.array([], int)
        if not len(i):
            break
        i = i[(within_cell[i] | (sides[i] != sides[i + d])) & (roots[i] != roots[i + d])]
        least = np.minimum(widths[i], widths[i + d])
        for w in np.unique(least).tolist():
            x = i[(least == w) & (np.maximum(widths[i], widths[i + d]) <= 2 * w)]
            x = x[take(w, x, x + d)]
            out.append((x, x + d))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def confirmed(edges: DataFrame, groups: DataFrame, rows: DataFrame, similarity: float, words: int) -> DataFrame:
    """A written table of the edges (a, b), a written table too, whose texts are similar enough. Only texts that take part are read again."""
    spark, before = edges.sparkSession, placed(edges.sparkSession)
    ends = edges.select(F.explode(F.array("a", "b")).alias("gid")).distinct()
    places = written(groups.join(ends, "gid").select("gid", F.struct("first.file", F.col("first.place").alias("row")).alias("k")), "copies-ends")

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_set(t, words).view(np.int64) for t in utf8(b.column(1))], pa.list_(pa.int64()))], names=["gid", "set"])

    sets = written(map_arrow(rows.select("k", "text").join(places, "k").select("gid", "text"), run, "gid long, set array<long>"), "copies-sets")
    settle(spark)
    # A set travels with the edges of the end that has fewer; the other end's stands in as many parts as hold HUB edges each.
    parts = written(edges.select(F.explode(F.array("a", "b")).alias("gid")).groupBy("gid").agg(F.count(F.lit(1)).alias("n")).withColumn("parts", F.ceil(F.col("n") / HUB)), "copies-degrees")
    pairs = edges
    for c in ("a", "b"):
        pairs = pairs.join(parts.select(F.col("gid").alias(c), F.col("n").alias(f"n_{c}"), F.col("parts").alias(f"parts_{c}")), c)
    fewer = F.col("n_a") <= F.col("n_b")
    end = lambda c, d: F.when(fewer, F.col(c)).otherwise(F.col(d))
    pairs = pairs.select("a", "b", end("a", "b").alias("s"), end("b", "a").alias("t"), end("parts_a", "parts_b").alias("parts_s"), end("parts_b", "parts_a").alias("parts_t"))
    pairs = pairs.withColumn("part_s", F.pmod(F.xxhash64("t"), "parts_s")).withColumn("part_t", F.pmod(F.xxhash64("s"), "parts_t"))
    dealt = sets.join(parts.select("gid", "parts"), "gid").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    for c in ("s", "t"):
        pairs = pairs.join(dealt.select(F.col("gid").alias(c), F.col("part").alias(f"part_{c}"), F.col("set").alias(f"{c}_set")), [c, f"part_{c}"])
    both = F.size(F.array_intersect("s_set", "t_set"))
    path, good = written_at(pairs.where(both >= F.lit(similarity) * (F.size("s_set") + F.size("t_set") - both)).select("a", "b"), "copies-links")
    release(spark, keep={*before, path})
    settle(spark)
    return good


def linked(groups: DataFrame, rows: DataFrame, similarity: float, words: int, rounds: int) -> DataFrame:
    """gid and root of the groups that confirmed links join."""
    radius = radius_of(similarity)
    edges = written(proposed(groups, radius), "copies-proposed")
    good = confirmed(edges, groups, rows, similarity, words)
    failed = written(edges.join(good, ["a", "b"], "left_anti"), "copies-failed") if rounds else None
    for left in range(rounds, -1, -1):
        roots = components(good, "copies-rounds").withColumnRenamed("node", "gid")
        if not left or failed.isEmpty():
            break
        # What failing links had joined may hold others that they stood for.
        roots = written(roots, "copies-roots")
        joined = components(good.unionByName(failed), "copies-rounds").withColumnRenamed("root", "whole")
        torn = joined.join(failed.select(F.col("a").alias("node")), "node", "left_semi").select("whole").distinct()
        affected = joined.join(torn, "whole", "left_semi").select(F.col("node").alias("gid"))
        apart = failed.unionByName(failed.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy(F.col("a").alias("gid")).agg(F.collect_list("b").alias("failed"))
        again = groups.join(affected, "gid", "left_semi").join(roots, "gid", "left").join(apart, "gid", "left").select("gid", "fp", "keys", F.coalesce("root", "gid").alias("root"), "failed")
        edges = written(proposed(written(again, "copies-again"), radius), "copies-proposed")
        if edges.isEmpty():
            break
        new = confirmed(edges, groups, rows, similarity, words)
        failed = written(failed.unionByName(edges.join(new, ["a", "b"], "left_anti")), "copies-failed")
        good = written(good.unionByName(new), "copies-links")
    roots = written(roots, "copies-roots")
    edges = left_out(groups, roots, similarity)
    new = confirmed(edges, groups, rows, similarity, words)
    return roots if new.isEmpty() else components(good.unionByName(new), "copies-rounds").withColumnRenamed("node", "gid")


def keep_first(docs: DataFrame, similarity: float = SIMILARITY, words: int = SHINGLE, rounds: int = ROUNDS) -> DataFrame:
    """docs without near copies: of each group one row stays, that of the smallest doc_id (a null one goes last).

    Among rows of equal ids two hashes of the text decide, then the row's place in its table. The text
    crosses one shuffle, by the row's key, and texts with a proposed link one more."""
    no_id, some_id = F.col("doc_id").isNull().cast("long").alias("no_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("id")
    h1, h2 = F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(SEED), "text").alias("h2")
    rows = keyed(whole_rows(docs, "doc_id", "text"), "k")
    spark, before = docs.sparkSession, placed(docs.sparkSession)
    order = ["no_id", "id", "h1", "h2", "file", "place"]
    signed = signatures(rows.select("text", no_id, some_id, h1, h2, F.col("k.file").alias("file"), F.col("k.row").alias("place")), words, *order, similarity=similarity)
    # Equal sets have equal fingerprints and keys, so those of the first row are the group's.
    groups = signed.groupBy("gid").agg(F.min(F.struct(*order, "fp", "keys", "n", "shared", "least", "parity")).alias("first"))
    groups = written(groups.select("gid", F.struct(*[f"first.{c}" for c in order]).alias("first"), *[f"first.{c}" for c in ("fp", "keys", "n", "shared", "least", "parity")]), "copies-groups")
    settle(spark)
    roots = linked(groups, rows, similarity, words, rounds)
    least = groups.select("gid", F.struct(*[f"first.{c}" for c in order]).alias("first")).join(roots, "gid", "left").groupBy(F.coalesce("root", "gid").alias("root")).agg(F.min("first").alias("first"))
    path, keep = written_at(least.select(F.struct(F.col("first.file").alias("file"), F.col("first.place").alias("row")).alias("k")), "copies-keep")
    release(spark, keep={*before, path})  # the rows are scanned again, so nothing else is needed
    settle(spark)
    return rows.select("row", "k").join(keep, "k", "left_semi").select("row.*")
