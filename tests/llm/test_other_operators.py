import hashlib
import io
import random
import re
import wave
import zlib
from collections import Counter

import numpy as np
import pyarrow.fs as pafs
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import common, media, mixing, near_copies, neighbours, packing, simhash, urlfilter
from tessera.llm.common import keyed, placed, release, remove, scratch, written

from . import helpers as h


@pytest.fixture(scope="module")
def docs(spark):
    return h.clashing(h.documents(spark)).cache()


# SimHash


def brute_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    votes = [xxhash.xxh64(" ".join(w[i : i + 3]).encode(), seed=42).intdigest() for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in votes) > len(votes))


def brute_components(fps):
    root = list(range(len(fps)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def as_long(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def test_fingerprints_and_components(spark, docs):
    rows = h.awkward()
    got = simhash.near_components(simhash.written(simhash.fingerprints(docs), "t")).collect()
    fps = [brute_fingerprint(r[1]) for r in rows]
    comp = brute_components(fps)
    lowest = {c: min((r[0] for r, x in zip(rows, comp, strict=True) if x == c and r[0] is not None), default=None) for c in set(comp)}
    assert Counter(map(tuple, got)) == Counter((r[0], as_long(f), lowest[c]) for r, f, c in zip(rows, fps, comp, strict=True))


@pytest.mark.parametrize(("cell", "small", "mean"), [(2048, 48, 512), (16, 8, 512), (16, 48, 1)])
def test_planted_neighbours(spark, monkeypatch, cell, small, mean):
    monkeypatch.setattr(simhash, "CELL", cell)
    monkeypatch.setattr(simhash, "SMALL", small)
    monkeypatch.setattr(simhash, "MEAN_BUCKET", mean)
    r = random.Random(cell + mean)
    base = [r.getrandbits(64) for _ in range(60)]
    fps = base + [b ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for b in base for _ in range(3)]
    fps += [base[0] ^ (1 << i) for i in range(64)] + [base[1] ^ (0b11 << i) for i in range(63)] + base[:5]
    got = {x["doc_id"]: x["component_id"] for x in simhash.near_components(simhash.written(spark.createDataFrame([(i, as_long(f)) for i, f in enumerate(fps)], "doc_id long, fp long"), "t")).collect()}
    assert [got[i] for i in range(len(fps))] == brute_components(fps)


def test_kernel_counts_bits():
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 2**63, 300, dtype=np.uint64)
    fps[:150] = fps[0] ^ (np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64))
    for radius in (0, 1, 2, 3):
        want = set(zip(*map(list, np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius)), strict=True))
        assert {(a, b) for i, j in simhash.close_pairs(fps, fps, radius) for a, b in zip(i, j, strict=True)} == want


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001), (5, 5)], "a long, b long")
    got = dict(h.rows_of(simhash.components(edges)))
    assert got == {i: 0 for i in range(201)} | {1000: 1000, 1001: 1000}


def test_components_with_hubs(spark, monkeypatch):
    """Hot nodes take the other join; the result is the same."""
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    monkeypatch.setattr(common, "HOT_KEYS", 1000)
    pairs = [(7, 100 + i) for i in range(60)] + [(100 + i, 300 + i) for i in range(60)] + [(3, 300), (900, 901), (902, 901)]
    got = dict(h.rows_of(simhash.components(spark.createDataFrame(pairs, "a long, b long"))))
    assert got == {x: 3 for p in pairs[:-2] for x in p} | {900: 900, 901: 900, 902: 900}
    fps = written(spark.createDataFrame([(i, 0 if i < 40 else i << 20) for i in range(60)] + [(None, 0)], "doc_id long, fp long"), "t")
    assert Counter(h.rows_of(simhash.near_components(fps).select("doc_id", "component_id"))) == Counter({(r["doc_id"], r["component_id"]): 1 for r in near_by_brute(fps.collect())})


def near_by_brute(rows):
    comp = brute_components([r["fp"] & ((1 << 64) - 1) for r in rows])
    return [{"doc_id": r["doc_id"], "component_id": min(x["doc_id"] for x, d in zip(rows, comp, strict=True) if d == c and x["doc_id"] is not None)} for r, c in zip(rows, comp, strict=True)]


def test_row_keys(spark, sf, tmp_path):
    """Rows of a table of files have the same keys however the scan is cut; other inputs are written once."""
    table = spark.read.parquet(f"{sf}/documents.parquet")
    first = {r["doc_id"]: tuple(r["k"]) for r in keyed(table.select("doc_id"), "k").collect()}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert {r["doc_id"]: tuple(r["k"]) for r in keyed(table.where("doc_id >= 0").select("text", "doc_id"), "k").collect()} == first and len(set(first.values())) == len(first) == table.count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for other in (table.select("doc_id", F.explode(F.array(F.lit(1), F.lit(2)))), table.unionByName(table), spark.range(5), table.withColumn("_metadata", F.lit("x"))):
        got = keyed(other, "k").collect()
        assert len({tuple(r["k"]) for r in got}) == other.count() == len(got)


def brute_copies(texts, similarity=0.8):
    """For each text the least place it is linked with through Jaccard similarities of sets of five words."""
    sets = []
    for t in texts:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets.append({b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or both and both >= similarity * (len(sets[i]) + len(sets[j]) - both):
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    return root


def least_rows(rows):
    """What keep_first leaves of rows (doc_id, text, ...): doc_id and component."""
    comp = brute_copies([r[1] for r in rows])
    return Counter(min((r[0] is None, r[0] or 0) for r, c in zip(rows, comp, strict=True) if c == k) for k in set(comp))


def edited(text, every, seed):
    """text with a new word at some places, `every` words apart on average."""
    r = random.Random(seed)
    return " ".join(f"new{seed}x{i}" if r.random() < 1 / every else w for i, w in enumerate(text.split()))


def test_keep_first(spark, docs):
    out = near_copies.keep_first(docs)
    rows = out.collect()
    assert out.columns == docs.columns and Counter((r["doc_id"] is None, r["doc_id"] or 0) for r in rows) == least_rows(h.awkward())


@pytest.mark.parametrize(("cell", "small"), [(2048, 48), (16, 3), (7, 1000)])
def test_near_copies_go_and_others_stay(spark, monkeypatch, cell, small):
    monkeypatch.setattr(near_copies, "CELL", cell)
    monkeypatch.setattr(near_copies, "SMALL", small)
    base = [h.prose("en", 200, 5000 + i) for i in range(25)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + 10 * i + k, edited(t, 150, 10 * i + k)) for i, t in enumerate(base) for k in range(4)]  # near copies
    rows += [(500 + i, " ".join(t.split()[:100]) + " " + h.prose("de", 100, i)) for i, t in enumerate(base)]  # half of it shared
    rows += [(1000 + i, edited(base[0], 400, 7000 + i)) for i in range(60)]  # a large group of unlike copies
    rows = [(*r, "en", "a", 1) for r in rows]
    want = least_rows(rows)
    assert 50 <= len(want) < 100
    got = Counter((r["doc_id"] is None, r["doc_id"] or 0) for r in near_copies.keep_first(h.documents(spark, rows)).collect())
    assert got == want


def test_failed_links_do_not_hide_others(spark, monkeypatch):
    """With a radius that lets everything pass, most proposed links fail; forests are made again until all true ones are found."""
    monkeypatch.setattr(near_copies, "radius_of", lambda s: 256)
    monkeypatch.setattr(near_copies, "signature", lambda x, real=near_copies.signature: (*real(x)[:2], np.array([7], np.uint64)))  # all in one bucket
    monkeypatch.setattr(near_copies, "HUB", 3)
    base = [h.prose("en", 60, 8000 + i) for i in range(2)]
    rows = [(i, t, "en", "a", 1) for i, t in enumerate(base)] + [(10 + 10 * i + k, edited(t, 200, 100 * i + k), "en", "a", 1) for i, t in enumerate(base) for k in range(2)]
    got = Counter((False, r["doc_id"]) for r in near_copies.keep_first(h.documents(spark, rows), rounds=20).collect())
    assert got == least_rows(rows) and len(got) < 6


@pytest.mark.parametrize("lost", ["buckets", "radius", "forest"])
def test_links_that_simhash_leaves_out_are_found(spark, monkeypatch, lost):
    """No bucket, no distance and no link in another's place hides a pair of the threshold."""
    if lost == "radius":
        monkeypatch.setattr(near_copies, "radius_of", lambda s: 0)
    if lost == "forest":
        monkeypatch.setattr(near_copies, "radius_of", lambda s: 256)
    keys = np.array([7] if lost == "forest" else [], np.uint64)
    monkeypatch.setattr(near_copies, "signature", lambda x, real=near_copies.signature: (*real(x)[:2], keys))
    monkeypatch.setattr(near_copies, "CELL", 4)
    line, base = h.prose("en", 12, 77), [h.prose("en", n, 8100 + n) for n in (5, 6, 9, 40, 150, 151)]
    texts = [t for b in base for t in (b, *(edited(b, e, e) for e in (20, 60, 90, 200)), b + " end", b + " " + b)]
    texts += [line + " " + h.prose("de", 30, i) for i in range(30)] + ["one two three four five six seven", "one two three four five six seven eight"]
    rows = [(i, t, "en", "a", 1) for i, t in enumerate(texts)]
    got = Counter((False, r["doc_id"]) for r in near_copies.keep_first(h.documents(spark, rows)).collect())
    assert got == least_rows(rows) and len(got) < len(rows) - 12


def test_unlike_texts_that_share_a_passage_are_not_proposed(spark, monkeypatch):
    """What meets by a common passage leaves its bucket only if it may be similar, so links do not grow with the square of a group."""
    monkeypatch.setattr(near_copies, "SMALL", 8)
    shared = h.prose("en", 60, 4000)
    texts = [f"{shared} {h.prose('de', 60, 4100 + i)}" for i in range(40)] + [h.prose("de", 150, 4200), h.prose("de", 150, 4200) + " end"]
    signed = near_copies.signatures(spark.createDataFrame([(t,) for t in texts], "text string"), near_copies.SHINGLE)
    roots = spark.createDataFrame([], "gid long, root long")
    alike = {tuple(sorted(r)) for r in near_copies.left_out(near_copies.written(signed, "signed"), roots, 0.8).collect()}
    want = tuple(sorted(int(np.uint64(near_copies.shingle_set(t.encode()).sum(dtype=np.uint64)).view(np.int64)) for t in texts[-2:]))
    assert alike == {want}


@pytest.mark.parametrize("small", [1, 5, 1000])
def test_pairs_of_a_bucket_by_brute_force(monkeypatch, small):
    """No similar pair of different roots is lost, whatever the sizes of the sets, and none is given that sizes or parities rule out."""
    monkeypatch.setattr(near_copies, "SMALL", small)
    monkeypatch.setattr(near_copies, "QUERIES", 7)
    rng, sets, groups, sides, cells = np.random.default_rng(3), [], [], [], []
    for g, (count, size) in enumerate([(2, 3), (30, 40), (40, 447), (25, 900), (1, 10), (20, 1800)]):
        x = rng.integers(0, 2**64, size * 2, dtype=np.uint64)
        side = np.sort(rng.integers(0, 2, count)) if g % 2 else np.zeros(count, int)
        for k in range(count):
            n = int(size * rng.uniform(0.85, 1.2)) + 1
            sets.append(np.unique(np.concatenate([x[: n - n * k // 300], rng.integers(0, 2**64, n * k // 300, dtype=np.uint64)])))
            groups.append(g), sides.append(int(side[k])), cells.append(g % 2 == 0)
    roots, n = rng.integers(0, 40, len(sets)), np.array([len(x) for x in sets])
    bits = [near_copies.parities(x) for x in sets]
    got = near_copies.pairs_of(np.array(groups), np.array(sides), np.array(cells), roots, n, np.concatenate(bits), np.cumsum([len(b) for b in bits]), 0.8)
    found = [tuple(sorted(p)) for p in zip(*(x.tolist() for x in got), strict=True)]
    want = set()
    for j in range(len(sets)):
        for i in range(j):
            both = len(np.intersect1d(sets[i], sets[j]))
            if groups[i] == groups[j] and roots[i] != roots[j] and (cells[i] or sides[i] != sides[j]) and both >= 0.8 * (n[i] + n[j] - both):
                want.add((i, j))
    assert len(found) == len(set(found)) and want <= set(found) and len(want) > 200 and len(found) < 2 * len(want)
    assert len(set(near_copies.parities(x).size for x in sets)) == 4


def test_similar_sets_share_least_hashes():
    rng = np.random.default_rng(5)
    for n in [*range(1, 40), 100, 333]:
        for m in range(n, int(n / 0.8) + 1):
            common = next(c for c in range(m + 1) if c >= 0.8 * (n + m - c))
            if common > n:
                continue
            x = rng.permutation(10 * m)[: n + m - common]
            a, b = np.sort(x[:n]), np.sort(x[n - common :])
            (size_a, shared_a), (size_b, shared_b) = near_copies.prefix_sizes(n, 0.8), near_copies.prefix_sizes(m, 0.8)
            assert len(np.intersect1d(a[:size_a], b[:size_b])) >= max(shared_a, shared_b) >= 1


def test_copies_of_a_given_table_by_all_pairs(spark):
    """sf0.01, five words, 0.8: what stays is what comparing all pairs leaves."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    sets = [near_copies.shingle_set((t or "").encode()) for _, t in rows]
    holders, root = {}, list(range(len(rows)))
    for i, x in enumerate(sets):
        for v in x.tolist():
            holders.setdefault(v, []).append(i)

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    empty = [i for i, x in enumerate(sets) if not len(x)]
    pairs = Counter((a, b) for at in holders.values() for n, b in enumerate(at) for a in at[:n])
    near = [p for p, both in pairs.items() if both >= 0.8 * (len(sets[p[0]]) + len(sets[p[1]]) - both)] + list(zip(empty, empty[1:], strict=False))
    for a, b in near:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {min(rows[i][0] for i in range(len(rows)) if find(i) == k) for k in {find(i) for i in range(len(rows))}}
    got = [r["doc_id"] for r in near_copies.keep_first(docs).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(near) > 50


def test_signatures_alone(spark):
    assert near_copies.signatures(spark.createDataFrame([("a b c d e f",), (None,)], "text string"), 5).count() == 2


def test_wide_distances_by_brute_force():
    rng = np.random.default_rng(1)
    f = rng.integers(0, 2**64, (200, near_copies.LONGS), dtype=np.uint64)
    f[100:] = f[:100]
    for k in range(100):
        for b in rng.choice(256, k, replace=False):
            f[100 + k, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    d = np.bitwise_count(f[:, None] ^ f[None]).sum(axis=2)
    for r in (0, 7, 8, 61, 63, 64, 100):
        assert {(a, b) for i, j in near_copies.close_pairs(f, f, r) for a, b in zip(i.tolist(), j.tolist(), strict=True)} == set(zip(*(x.tolist() for x in np.nonzero(d <= r)), strict=True))


def test_keep_first_keeps_a_row_of_every_group(spark):
    texts = [h.prose("en", 60, 900 + i) for i in range(6)]
    rows = [(None, t, "en", "a", i) for i, t in enumerate(texts[:4]) for _ in range(3)] + [(5, t, "en", "a", 9) for t in texts[4:]] + [(6, texts[4], "en", "a", 9), (7, texts[3], "en", "a", 9)]
    got = Counter((r["doc_id"], r["text"]) for r in near_copies.keep_first(h.documents(spark, rows)).collect())
    assert got == Counter([*((None, t) for t in texts[:3]), (7, texts[3]), (5, texts[4]), (5, texts[5])])


# Neighbours


def test_clustered_vectors_are_found_in_few_partitions(spark, monkeypatch):
    """Around centres a query has no need to see more than a quarter of the rows; a router that visits everything fails."""
    rng = np.random.default_rng(11)
    c = rng.normal(size=(40, 32))
    x = c[rng.integers(0, 40, 8000)] + 0.1 * rng.normal(size=(8000, 32))
    table = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got, learned, homes, routes = {}, [], [], []
    monkeypatch.setattr(neighbours, "PART_ROWS", 1000)
    real = neighbours.learn
    monkeypatch.setattr(neighbours, "learn", lambda v: learned.append(real(v)) or learned[-1])
    for r in neighbours.search(table, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    index = learned[0]
    homes = index.homes(x)
    sizes = dict(enumerate(np.bincount(homes, minlength=index.parts).tolist()))
    routes = index.routes_to(x[::20], [21] * 400, sizes)
    assert np.mean([sum(sizes.get(p, 0) for p in r) for r in routes]) <= 0.25 * len(x)
    queries = np.arange(0, 8000, 20)
    score = x[queries] @ x.T
    score[np.arange(len(queries)), queries] = -np.inf
    want = np.argsort(-score, axis=1, kind="stable")[:, :20]
    assert np.mean([len(got[q] & set(w.tolist())) / 20 for q, w in zip(queries.tolist(), want, strict=True)]) >= 0.9


def vectors(n, dim=16, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((8, dim))
    return centres[rng.integers(0, 8, n)] + 0.5 * rng.standard_normal((n, dim))


def brute_nearest(rows, k):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    for i, q in zip(ids, x, strict=True):
        if i % 20 == 0:
            s = (x * q).sum(axis=1)
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            yield int(i), [(int(ids[j]), s[j]) for j in order]


def recall(rows, got, k=20):
    """The share of true neighbours found; ranks, order and scores are checked on the way."""
    hit = n = 0
    x = dict(rows)
    for q, want in brute_nearest(rows, k):
        mine = got[got.query_id == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, k + 1)) and q not in mine.vec_id.tolist()
        assert list(zip(-mine.score, mine.vec_id, strict=True)) == sorted(zip(-mine.score, mine.vec_id, strict=True))
        assert all(abs(s - float(np.dot(x[q], x[v]))) < 1e-9 for v, s in zip(mine.vec_id, mine.score, strict=True))
        hit += len(set(mine.vec_id) & {v for v, _ in want})
        n += k
    return hit / n


@pytest.mark.parametrize("part_rows", [4096, 200])
def test_recall_and_exact_scores(spark, monkeypatch, part_rows):
    monkeypatch.setattr(neighbours, "PART_ROWS", part_rows)
    monkeypatch.setattr(neighbours, "ROWS", 300)
    monkeypatch.setattr(neighbours, "QUERIES", 40)
    rows = [(i, v.astype(np.float32).astype(float).tolist()) for i, v in enumerate(vectors(3000))]
    df = h.clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert recall(rows, neighbours.search(df, F.col("vec_id") % 20 == 0).toPandas()) >= 0.9
    # The queries go to partitions, and to few of them.
    index = neighbours.learn(neighbours.usable(df))
    routes = index.routes(np.array([v for i, v in rows if i % 20 == 0]))
    assert index.parts == neighbours.n_parts(3000) == (8 if part_rows == 4096 else 15) and np.mean([len(r) for r in routes]) < 0.6 * index.parts


@pytest.mark.parametrize("table", ["sf0.01", "sf0.1"])
def test_generated_vectors_go_through_the_router(spark, sf, table):
    """Vectors without any clusters: recall holds, and still not all partitions are visited."""
    folder = sf.rpartition("/")[0] + "/" + table
    rows = [(r["vec_id"], [float(v) for v in r["embedding"]]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    assert recall(rows, neighbours.op2_nearest(spark, folder).toPandas()) >= 0.9
    index = neighbours.learn(neighbours.usable(spark.read.parquet(f"{folder}/embeddings.parquet")))
    assert index.router is not None and np.mean([len(r) for r in index.routes(np.array([v for _, v in rows]))]) < 0.95 * index.parts


def test_two_levels(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PART_ROWS", 100)
    monkeypatch.setattr(neighbours, "MAX_PARTS", 8)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors(4000, 16, 5))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    seen, place = [], neighbours.learn_children

    def spy(*a):
        seen.append(place(*a))
        return seen[-1]

    monkeypatch.setattr(neighbours, "learn_children", spy)
    assert recall(rows, neighbours.search(df, F.col("vec_id") % 20 == 0).toPandas()) >= 0.85 and len(seen[0]) > 2


def test_awkward_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [None, 1.0]), (7, [1.0, 0.0, 0.0]), (60, [1.0, 2.0, 0.0]), (None, [1.0, 0.0]), (9, [1.0, 0.0]), (8, [1.0, 0.0]), (20, [0.5, 0.5]), (20, [0.5, 0.5]), (40, None)]
    got = h.rows_of(neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank"))
    assert [(q, r, v) for q, r, v, _ in got if q == 0] == [(0, 1, 8), (0, 2, 9), (0, 3, 20), (0, 4, 20)]
    assert [v for q, _, v, _ in got if q == 20] == [0, 8, 9]
    assert [(v, s) for q, _, v, s in got if q == 60] == [(7, 1.0)] and {q for q, *_ in got} == {0, 20, 60}


def test_one_id_with_different_vectors(spark):
    """Each different vector of an id is a query of its own; none of the id's rows is a candidate."""
    rows = [(20, [float(i), 1.0]) for i in range(30)] + [(20, [3.0, 1.0])] * 2 + [(i + 100, [1.0, float(i)]) for i in range(1, 29)]
    got = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") == 20).toPandas()
    assert len(got) == 30 * 20 and set(got["rank"].value_counts()) == {30} and 20 not in set(got.vec_id)


def test_many_equal_vectors(spark):
    rows = [(i, [1.0, 2.0]) for i in range(500)] + [(1000 + i, [float(i), 1.0]) for i in range(5)]
    got = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") == 40)
    best = [r["vec_id"] for r in got.orderBy("rank").collect()]
    assert best == [1004, *range(19)] and got.columns == ["query_id", "rank", "vec_id", "score"]


@pytest.mark.parametrize("own", [[[1.0, 0.0]] * 25, [[1.0 + i, 0.0] for i in range(25)]])
def test_own_rows_take_no_place(own):
    x = np.array(own + [[1.0, 0.0]] * 30)
    ids = np.array([0] * len(own) + list(range(1, 31)))
    assert neighbours.nearest(np.array([0]), np.array([[1.0, 0.0]]), ids, x, 20)[1].tolist() == list(range(1, 21))


def test_a_third_of_the_rows_are_copies(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PART_ROWS", 200)
    monkeypatch.setattr(neighbours, "MIN_SAMPLE", 300)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors(1000))] + [(5000 + i, [1.0] * 16) for i in range(300)] + [(7, [0.5] * 16)] * 300
    index = neighbours.learn(neighbours.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    homes = index.homes(vectors(1000)) // index.stride
    assert index.parts > 3 and np.bincount(homes, minlength=index.parts).max() < 1000 * 2 / index.parts
    assert np.isfinite(index.router.scores(vectors(10))).all()


def test_balanced_parts():
    x = vectors(1000)
    label = neighbours.balanced(x, neighbours.graph(x, 10), 8)
    assert np.bincount(label, minlength=8).max() <= np.ceil(1000 / 8 * 1.1) + 1


# Media


def test_media_round_trip(spark, docs):
    path = scratch(spark, "media-test")
    assert media.write_archives(docs, path, archive_bytes=2000) == docs.count()
    got = media.media_columns(media.read_archives(spark, path, rangeBytes=700, batchBytes=1000)).collect()
    assert len(got) == docs.count()
    want = Counter()
    for r in h.awkward():
        raw = (r[1] or "").encode()
        p = raw + bytes(-len(raw) % 64 if raw else 64)
        want[r[0], len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])] += 1
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == want
    by = {}
    for r in got:
        assert by.setdefault(r["payload_sha256"], (r["feature"], r["media_sha256"])) == (r["feature"], r["media_sha256"]) and r["media_bytes"] == r["payload_bytes"] + 44
    # The stored form as another writer makes it, and the features from their definitions.
    for _, text, *_ in h.awkward():
        raw = (text or "").encode()
        p = raw + bytes(-len(raw) % 64 if raw else 64)
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(1)
            w.setframerate(8000)
            w.writeframes(p)
        x = [b - 128 for b in p]
        crossings = sum((a >= 0) != (b >= 0) for a, b in zip(x, x[1:], strict=False))
        feature = f"mean={sum(x) / len(x):.6f};rms={(sum(v * v for v in x) / len(x)) ** 0.5:.6f};zcr={crossings / (len(x) - 1):.6f};peak={max(map(abs, x))}"
        assert by[hashlib.sha256(p).hexdigest()] == (feature, hashlib.sha256(out.getvalue()).hexdigest())


def test_members_fail_one_by_one(spark, docs):
    path = scratch(spark, "media-bad")
    media.write_archives(docs.where("doc_id >= 100 and doc_id < 120").coalesce(1), path)
    local = path.removeprefix("file://")
    name = [f for f in pafs.LocalFileSystem().get_file_info(pafs.FileSelector(local)) if f.path.endswith(".zip")][0].path
    data = bytearray(open(name, "rb").read())
    data[60:70] = b"\xff" * 10  # in the first member's payload
    open(name, "wb").write(data)
    got = media.read_archives(spark, path, retries=2, retrySeconds=0).orderBy("offset").collect()
    assert len(got) == 20 and got[0]["error"] and got[0]["payload"] is None and all(r["error"] is None and r["payload"] for r in got[1:])


def test_damaged_directory_is_one_error(spark, docs):
    path = scratch(spark, "media-cut")
    media.write_archives(docs.where("doc_id >= 100 and doc_id < 130").repartition(2), path)
    names = sorted(f.path for f in pafs.LocalFileSystem().get_file_info(pafs.FileSelector(path.removeprefix("file://"))) if f.path.endswith(".zip"))
    data = open(names[0], "rb").read()
    open(names[0], "wb").write(data[:-30])  # the end of the directory is gone
    got = media.read_archives(spark, path, retries=2, retrySeconds=0, rangeBytes=900).collect()
    bad = [r for r in got if r["error"]]
    assert len(bad) == 1 and bad[0]["member"] is None and "BadZipFile" in bad[0]["error"] and len(got) > 5 and all(r["payload"] for r in got if not r["error"])


def test_member_is_tried_again(monkeypatch):
    calls = []

    def flaky(fs, archive, info, source=None):
        calls.append(source)
        if len(calls) < 3:
            raise OSError("lost")
        return b"data"

    monkeypatch.setattr(media, "member_bytes", flaky)
    reader = media.ArchiveReader({"path": "/nowhere", "retryseconds": "0"})
    assert reader.member(None, "a", None, "open file") == (b"data", None, 2) and calls == ["open file", None, None]


# URLs


def brute_verdict(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x.group().lower(), m[1]), m[2]) if m else ("", "")
    fits = [(len(a + b), a + b, v) for a, b, v in urlfilter.RULES if (host == a or host.endswith("." + a)) and path.startswith(b)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


URLS = [None, "", "no scheme", "http://", "http://ORG/", "http://org", "http://a.org?x/", "https://Example.ORG/en/1", "https://x.example.org/en/17#a", "https://badexample.org/es/", "https://example.org/es", "https://u@a.com:80/de/", "https://a.com/de/?q", "http://a.com/fr/", "ftp://é.com/de/x", "a://b://c.org/", "http://org./", "http://.org/", "http://" + "a." * 5000 + "org/" + "p" * 5000, "http://example.org/es/http://x.com/de/"]


@pytest.mark.parametrize("bound", [100_000, 0])
@pytest.mark.parametrize("digits", [8, 1, 0])
def test_urls_match_brute_force(spark, monkeypatch, bound, digits):
    """With one digit or none, pairs meet many rules that only the whole digests tell apart."""
    monkeypatch.setattr(urlfilter, "BROADCAST_RULES", bound)
    monkeypatch.setattr(urlfilter, "PREFIX_HEX", digits)
    rows = [(i, u) for i, u in enumerate(URLS)] + [(7, URLS[7]), (None, URLS[8])]
    got = h.rows_of(urlfilter.filter_urls(h.clashing(spark.createDataFrame(rows, "page_id long, url string")), urlfilter.rule_frame(spark, urlfilter.RULES)).drop("n_fits"))
    assert Counter(got) == Counter((i, *brute_verdict(u)) for i, u in rows)


def test_pairs_meet_rules_on_the_short_prefix_only(spark):
    out = urlfilter.filter_urls(spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string"), urlfilter.rule_frame(spark, urlfilter.RULES))
    join = next(x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join LeftOuter" in x)
    assert "short" in join and "digest" not in join


def test_too_many_shapes_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(urlfilter, "MAX_SHAPES", 2)
    with pytest.raises(ValueError, match="combinations"):
        urlfilter.filter_urls(spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string"), urlfilter.rule_frame(spark, urlfilter.RULES))


def test_no_rules_and_no_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    assert h.rows_of(urlfilter.filter_urls(pages, urlfilter.rule_frame(spark, []))) == [(1, "a.org", "/", None, "allow", 0)]
    assert urlfilter.filter_urls(pages.where("false"), urlfilter.rule_frame(spark, urlfilter.RULES)).count() == 0


def exists(path):
    return pafs.LocalFileSystem().get_file_info("/" + path.removeprefix("file:").lstrip("/")).type != pafs.FileType.NotFound


def test_scratch_is_released(spark):
    before = placed(spark)
    kept, gone = written(spark.range(3), "x"), written(spark.range(3), "y")
    paths = [x.inputFiles()[0].rpartition("/")[0] for x in (kept, gone)]
    keep = [x for x in placed(spark) if "/x-" in x]
    assert release(spark, keep={*before, *keep}) == 1 and [exists(p) for p in paths] == [True, False] and placed(spark) == [*before, *[x for x in keep if x not in before]]
    remove(spark, scratch(spark, "never-written"))
    release(spark, keep=before)
    assert not exists(paths[0]) and placed(spark) == before


# Empty tables and the pipeline


def test_empty_tables(spark, tmp_path):
    docs = h.clashing(h.empty(spark))
    assert simhash.near_components(simhash.written(simhash.fingerprints(docs), "t")).count() == near_copies.keep_first(docs).count() == 0
    assert media.media_columns(media.read_archives(spark, p)).count() == 0 if (p := scratch(spark, "none")) and media.write_archives(docs, p) == 0 else False
    assert neighbours.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).count() == 0
    assert corpus_pipeline.run(spark, h.table(docs, tmp_path)).count() == 0


def test_pipeline_stages(spark, docs, tmp_path):
    folder, now, columns = h.table(docs, tmp_path), docs, docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        now = simhash.written(stage(spark, now, folder), name)
        kept[name] = now
        if name != corpus_pipeline.STAGES[-1][0]:
            assert now.columns == columns, name
    prose = lambda df: {r["doc_id"] for r in df.collect() if (r["doc_id"] or 0) >= 100}
    assert len(prose(kept["language_id"])) == 101 and not {1, 2, 3, 4} & {r["doc_id"] for r in kept["language_id"].collect()}
    assert prose(kept["simhash_near_dedup"]) == {*range(100, 130), *range(200, 230), 300}
    assert not kept["secret_scan"].where("text like '%AKIA%'").count()
    check_mix(kept["secret_scan"].collect(), kept["source_mix"].collect())
    check_bins(kept["source_mix"].collect(), kept["best_fit_packing"].collect())


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def check_mix(before, after):
    """Each source's words come to its target; texts are whole, but for the last of a source, which keeps its first words."""
    sizes, taken = Counter(), Counter()
    for r in before:
        sizes[r["source"]] += len(words(r["text"]))
    for r in after:
        taken[r["source"]] += len(words(r["text"]))
    want = h.brute_targets(sizes, mixing.WEIGHTS, mixing.RATIO, mixing.CAP)
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    texts = {}
    for r in before:
        texts.setdefault(r["doc_id"], set()).add(r["text"])
    cut = Counter()
    for r in after:
        if r["text"] not in texts[r["doc_id"]]:
            cut[r["source"]] += 1
            assert any(words(t)[: len(words(r["text"]))] == words(r["text"]) for t in texts[r["doc_id"]]) and r["n_chars"] == len(r["text"])
    assert max(cut.values(), default=0) <= 1


def check_bins(before, after):
    """The rows alone give back every bin and, in order of place, every text word by word."""
    bins, pieces = {}, Counter()
    for r in after:
        bins.setdefault(r["bin"], []).append(r)
        assert len(words(r["text"])) == r["n_words"]
        pieces[(r["doc_id"], r["start_word"], tuple(words(r["text"])))] += 1
    for rows in bins.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["n_words"]
        assert at == rows[0]["used"] <= rows[0]["capacity"] and len({(r["used"], r["capacity"], r["shard"]) for r in rows}) == 1
    top = packing.LENGTHS[-1]
    assert pieces == Counter((r["doc_id"], a, tuple(words(r["text"])[a : a + top])) for r in before for a in range(0, len(words(r["text"])), top))


def test_pipeline_keeps_unlike_texts_without_ids(spark, tmp_path):
    """Null and shared ids: every text that is no duplicate is in the result, and the released tables are not needed for it."""
    texts = [h.prose("en", 60, 900 + i) for i in range(5)]
    rows = [(None, texts[0], "en", "a", 1), (None, texts[1], "en", "a", 1), (None, texts[1], "en", "a", 1), (5, texts[2], "en", "a", 1), (5, texts[3], "en", "b", 1), (6, texts[4], "de", "b", 1)]
    rows += [(10 + i, h.prose("de", 60, i), "de", "c", 1) for i in range(20)] + [(50 + i, h.prose("en", 60, i), "en", "c", 1) for i in range(20)]
    folder = h.table(h.documents(spark, rows), tmp_path)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:2]:
        docs = written(stage(spark, docs, folder), name)
    assert Counter(r["text"] for r in docs.collect() if r["source"] in "ab") == Counter(texts)
    before = placed(spark)
    out = corpus_pipeline.run(spark, folder)
    left = [p for p in placed(spark) if p not in before]
    assert sum("pipeline-" in p for p in left) == 1 and not [p for p in left if "/copies-" in p or "/mix-" in p]
    assert {r["text"] for r in out.collect()} <= {r[1] for r in rows} | {r["text"] for r in out.collect() if len(words(r["text"])) < 60}
    release(spark, keep=before)


@pytest.mark.parametrize("bound", [0, 100])
def test_rules_are_met_on_the_short_prefix_in_both_branches(spark, monkeypatch, bound):
    monkeypatch.setattr(urlfilter, "BROADCAST_RULES", bound)
    rules = [("org", f"/p{i}", "block") for i in range(30)] + urlfilter.RULES
    pages = spark.createDataFrame([(i, f"http://h{i}.org/p{i % 40}/x") for i in range(50)], "page_id long, url string")
    plan = urlfilter.filter_urls(pages, urlfilter.rule_frame(spark, rules))._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.split("\n") if "Join" in x and "r_short" in x]
    assert joins and not any("r_digest" in x for x in joins)


def test_large_host_and_many_rules(spark, monkeypatch):
    """Every url of one host, whose expressions are hot, beside others; as many rules as make the second branch."""
    rows = [(i, f"http://a.big.com/x{i % 3}/y") for i in range(400)] + [(1000 + i, f"http://h{i}.org/z") for i in range(50)] + [(None, None)] * 2
    rules = [("com", "/x1", "block"), ("big.com", "/x1/", "allow"), ("big.com", "/", "allow"), ("h3.org", "/", "block")] + [(f"r{i}.net", "/", "block") for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    want = Counter(map(tuple, urlfilter.filter_urls(pages, urlfilter.rule_frame(spark, rules)).collect()))
    monkeypatch.setattr(urlfilter, "BROADCAST_RULES", 10)
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    monkeypatch.setattr(common, "HOT_KEYS", 50)
    assert Counter(map(tuple, urlfilter.filter_urls(pages, urlfilter.rule_frame(spark, rules)).collect())) == want
    assert sum(n for r, n in want.items() if r[3] == "big.com/x1/" and r[5] == 3) == 133
