"""Repeated substrings, exactly: suffixes sorted by external induced sorting, with common-prefix values.

repeated() finds every byte of a text that is covered by a string of SPAN bytes which also starts anywhere else.
Texts are never compared as wholes, nor sorted in one place:

1. Of each window of SPAN bytes the GRAM-byte string of least hash is its anchor (the first one, if several
   are equal), so equal windows have equal anchors at equal distances. Consecutive windows with one
   anchor make a segment; suffixes of different anchors need no comparison. Anchors of one hash are a shard's unit.
2. Segments whose anchor stands once in the corpus hold no repeated window and go. Of equal ones one is
   kept, with their number.
3. Segments are partitioned by the upper bits of the anchor's hash, and each task sorts the suffixes that begin
   at its anchors through a disk-backed priority queue: sorted runs of bounded size in files, merged block by
   block, so a shard can be far larger than memory. From neighbours in this order come the common prefixes.
4. The order of the suffixes one byte further left is induced from this one, and again from that: a suffix is
   its first byte and the rank of the suffix after it, so a stable sort by anchor and byte suffices, and two
   neighbours have in common one byte more than the least common prefix between their successors. Suffixes
   that cannot reach SPAN any more leave. A window is repeated if a neighbour shares SPAN bytes or more, or
   if equal segments hold it.
5. Repeated windows go back to all places of their segments and are merged by document.

Anchors of more than HOT different segments (a passage that very many documents hold between other words) would
be one task's; their windows are counted by digest instead, which Spark sums up in the tasks first.

Defined results: null texts are empty; texts of fewer than SPAN bytes have no window, so nothing goes; repeated
rows and null ids are documents of their own; runs of one byte overlap themselves and are repeated; an
empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import os
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keyed, load, map_arrow, settle, utf8, written

SPAN = 200
GRAM = 64
#: Bytes of a text that are looked at together.
CHUNK = 1 << 19
#: Different segments of one anchor that one task compares.
HOT = 20_000
#: Segments in memory at once, and in a sorted run of the queue.
BLOCK = 20_000
RADIX_BITS = 16
BASE = 0x9E3779B97F4A7C15
ODD = np.uint64(0xD6E8FEB86659FD93)
PLACE = np.uint64(CHUNK - 1)


def _powers(base: int) -> np.ndarray:
    x = np.full(CHUNK + SPAN, np.uint64(base & (1 << 64) - 1))
    x[0] = 1
    return np.cumprod(x)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * ODD
    return x ^ (x >> np.uint64(29))


class Anchors:
    """Finds the segments of texts, for one span and length of anchors."""

    def __init__(self, span: int, gram: int):
        self.span, self.gram = span, gram
        self.up, self.down = _powers(BASE), _powers(pow(BASE, -1, 1 << 64))
        self.value = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))

    def of(self, text: bytes):
        """Yields hash of the anchor, first and last window, and the anchor's place, as arrays over segments; long texts in chunks of windows."""
        n = len(text) - self.span + 1
        step = CHUNK - self.span  # places in a chunk fit into PLACE
        data = np.frombuffer(text, np.uint8)
        for at in range(0, max(0, n), step):
            m = min(step, n - at)
            x = data[at : at + m + self.span - 1]
            sums = np.zeros(len(x) + 1, np.uint64)
            np.cumsum(self.value[x] * self.up[: len(x)], out=sums[1:])
            grams = len(x) - self.gram + 1
            h = mixed((sums[self.gram :] - sums[:grams]) * self.down[:grams])
            key = (h & ~PLACE) | np.arange(grams, dtype=np.uint64)
            place = (_least(key, self.span - self.gram + 1) & PLACE).astype(np.int64)
            first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
            yield h[place[first]], first + at, np.r_[first[1:], m] - 1 + at, place[first] + at


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w consecutive values: prefix minima of blocks of w meet suffix minima."""
    n = len(x)
    full = np.full(-(-n // w) * w, ~np.uint64(0))
    full[:n] = x
    rows = full.reshape(-1, w)
    upto, since = np.minimum.accumulate(rows, axis=1).ravel(), np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(since[: n - w + 1], upto[w - 1 : n])


def segments(docs: DataFrame, span: int, gram: int) -> DataFrame:
    """key (of the anchor), digest (of the segment), its document k, first and last window, the anchor's distance, and further first windows of equal segments of the document."""
    fields = [("key", pa.int64()), ("digest", pa.int64()), ("file", pa.int64()), ("row", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("far", pa.int32()), ("more", pa.list_(pa.int32()))]

    def run(batches):
        anchors, out, size = Anchors(span, gram), [], 0

        def rows():
            cols = [np.concatenate([r[c] for r in out]) for c in range(7)]
            arrays = [pa.array(x, t) for x, (_, t) in zip(cols, fields, strict=False)] + [pa.array([m for r in out for m in r[7]], fields[7][1])]
            return pa.RecordBatch.from_arrays(arrays, schema=pa.schema(fields))

        for b in batches:
            for text, file, row in zip(utf8(b.column(0)), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                for key, lo, hi, at in anchors.of(text):
                    digest = np.array([xxhash.xxh3_64_intdigest(text[a:z], d) for a, z, d in zip(lo.tolist(), (hi + span).tolist(), (at - lo).tolist(), strict=True)], np.uint64).view(np.int64)
                    more = [None] * len(lo)
                    kinds, place = np.unique(digest, return_index=True)
                    if len(kinds) < len(lo):  # of equal segments one row
                        kept = np.sort(place)
                        others = {d: [] for d in digest[kept].tolist()}
                        for i in np.setdiff1d(np.arange(len(lo)), kept).tolist():
                            others[int(digest[i])].append(int(lo[i]))
                        key, lo, hi, at, digest = (x[kept] for x in (key, lo, hi, at, digest))
                        more = [others[d] or None for d in digest.tolist()]
                    out.append((key.view(np.int64), digest, np.full(len(lo), file), np.full(len(lo), row), lo, hi, at - lo, more))
                    size += len(lo)
                if size > 20_000:
                    yield rows()
                    out, size = [], 0
        if out:
            yield rows()

    longs = docs.where(F.octet_length("text") >= span).select("text", "k.file", "k.row")
    return map_arrow(longs, run, "key long, digest long, file long, row long, lo int, hi int, far int, more array<int>")


class SuffixQueue:
    """A disk-backed priority queue of suffix tuples: what is put in goes to files as sorted runs, and comes out in order, block by block.

    Tuples are rows of an Arrow table with columns key and suffix; a block holds whole keys."""

    def __init__(self, block: int):
        self.block, self.folder, self.waiting, self.rows, self.runs = block, None, [], 0, []

    def __enter__(self):
        return self

    def __exit__(self, *_):
        if self.folder:
            self.folder.cleanup()

    def put(self, batch: pa.RecordBatch) -> None:
        self.waiting.append(batch)
        self.rows += len(batch)
        if self.rows >= self.block:
            self._spill()

    @staticmethod
    def _in_order(tables: list) -> pa.Table:
        t = pa.concat_tables(tables)
        return t.take(pc.sort_indices(t, [("key", "ascending"), ("suffix", "ascending")])).combine_chunks()

    def _spill(self) -> None:
        self.folder = self.folder or tempfile.TemporaryDirectory(prefix="suffixes-")
        run = self._in_order([pa.Table.from_batches(self.waiting)])
        path = os.path.join(self.folder.name, str(len(self.runs)))
        with pa.OSFile(path, "wb") as f, pa.ipc.new_file(f, run.schema) as w:
            w.write_table(run, max_chunksize=max(1, self.block // 16))
        self.runs.append(path)
        self.waiting, self.rows = [], 0

    def blocks(self):
        """Everything that was put in, in order: as long as a run can still hold a key that heads' rows wait for, it is read on."""
        rest = [self._in_order([pa.Table.from_batches(self.waiting)])] if self.waiting else []
        readers = [pa.ipc.open_file(pa.memory_map(p)) for p in self.runs]
        at, heads = [0] * len(readers), [None] * len(readers)
        ready, size = [], 0
        while True:
            for i, r in enumerate(readers):
                if heads[i] is None and at[i] < r.num_record_batches:
                    heads[i] = pa.Table.from_batches([r.get_batch(at[i])])
                    at[i] += 1
            # Keys below the last one of every head that goes on are complete.
            bounds = [h["key"][-1].as_py() for i, h in enumerate(heads) if h is not None and at[i] < readers[i].num_record_batches]
            bound = min(bounds, default=None)
            for part in (heads, rest):
                for i, h in enumerate(part):
                    if h is None:
                        continue
                    n = len(h) if bound is None else int(np.searchsorted(h["key"].to_numpy(), bound))
                    if n:
                        ready.append(h.slice(0, n))
                        size += n
                    part[i] = h.slice(n) if n < len(h) else None
            if bound is None:
                break
            if size >= self.block:
                yield self._in_order(ready)
                ready, size = [], 0
            for i, r in enumerate(readers):  # the run that holds the bound is read on
                if at[i] < r.num_record_batches and heads[i] is not None and heads[i]["key"][-1].as_py() == bound:
                    heads[i] = pa.concat_tables([heads[i], pa.Table.from_batches([r.get_batch(at[i])])])
                    at[i] += 1
        if size:
            yield self._in_order(ready)


def common_prefixes(suffix: list[bytes], same: np.ndarray) -> np.ndarray:
    """Of sorted suffixes: how many bytes each has in common with the one before, 0 where not `same`."""
    width = max(map(len, suffix), default=0)
    x = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in suffix), np.uint8).reshape(len(suffix), width)
    size = np.array([len(s) for s in suffix])
    differ = x[1:] != x[:-1]
    found = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    return np.r_[0, np.where(same[1:], np.minimum(found, np.minimum(size[1:], size[:-1])), 0)]


def least_between(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of values[a+1 .. b] for a < b: two overlapping ranges of a power of two."""
    if not len(a):
        return np.array([], values.dtype)
    out, length = values[b].copy(), b - a
    table, level = values, 0
    while (1 << (level + 1)) <= length.max():
        table = np.minimum(table[: len(table) - (1 << level)], table[1 << level :])
        level += 1
        rows = np.flatnonzero((length >> level) == 1)
        out[rows] = np.minimum(table[a[rows] + 1], table[b[rows] - (1 << level) + 1])
    return out


def induced(group: np.ndarray, left: list[bytes], near: np.ndarray, count: np.ndarray, common: np.ndarray, span: int):
    """Yields (row, distance) arrays: the windows that begin so many bytes left of row's anchor and are repeated.

    Rows stand in the order of the suffixes at their anchors. left: the bytes left of each anchor; near: the least
    distance at which a window begins; count: how many equal segments there are; common: prefix common with the row before."""
    far = np.array([len(x) for x in left])
    ends = np.cumsum(far)
    data = np.frombuffer(b"".join(left), np.uint8)
    row, distance = np.arange(len(group)), 0
    while len(row):
        best = np.maximum(common, np.r_[common[1:], 0])
        hit = ((best >= span) | (count[row] > 1)) & (near[row] <= distance)
        if hit.any():
            yield row[hit], np.full(int(hit.sum()), distance)
        # Each step left adds one byte at most.
        on = np.flatnonzero((far[row] > distance) & ((best + far[row] - distance >= span) | (count[row] > 1)))
        if not len(on):
            return
        distance += 1
        byte = data[ends[row[on]] - distance]
        kind = group[row[on]] * 256 + byte
        order = np.argsort(kind, kind="stable")
        on, kind = on[order], kind[order]
        same = np.flatnonzero(kind[1:] == kind[:-1]) + 1
        after = np.zeros(len(on), common.dtype)
        after[same] = 1 + least_between(common, on[same - 1], on[same])
        row, common = row[on], after


def ranges(row: np.ndarray, window: np.ndarray, n: int) -> list[list[int]]:
    """Of each of n rows its windows as first, last, first, last ... of consecutive ones."""
    out: list[list[int]] = [[] for _ in range(n)]
    if not len(row):
        return out
    order = np.lexsort((window, row))
    row, window = row[order], window[order]
    first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (window[1:] != window[:-1] + 1)])
    last = np.r_[first[1:], len(row)] - 1
    for r, a, z in zip(row[first].tolist(), window[first].tolist(), window[last].tolist(), strict=True):
        out[r] += a, z
    return out


FOUND = pa.schema([("key", pa.int64()), ("digest", pa.int64()), ("found", pa.list_(pa.int32()))])


def sorted_windows(parts: DataFrame, span: int, block: int = BLOCK) -> DataFrame:
    """key, digest and found (ranges of repeated windows, from the segment's start) for parts (key, digest, n, far, last, body): steps 3 and 4."""

    def run(batches):
        with SuffixQueue(block) as queue:
            for b in batches:
                t = pa.Table.from_batches([b])
                body, far = t["body"].to_pylist(), t["far"].to_pylist()
                queue.put(t.append_column("suffix", pa.array([x[f:] for x, f in zip(body, far, strict=True)], pa.binary())).append_column("left", pa.array([x[:f] for x, f in zip(body, far, strict=True)], pa.binary())).drop_columns(["body"]).combine_chunks().to_batches()[0])
            for t in queue.blocks():
                key, far, last = (t[c].to_numpy() for c in ("key", "far", "last"))
                same = np.r_[False, key[1:] == key[:-1]]
                common = common_prefixes(t["suffix"].to_pylist(), same)
                hits = list(induced(np.cumsum(~same), t["left"].to_pylist(), far - last, t["n"].to_numpy(), common, span))
                row, distance = (np.concatenate([h[k] for h in hits]) if hits else np.array([], np.int64) for k in (0, 1))
                out = pa.RecordBatch.from_arrays([t["key"].combine_chunks(), t["digest"].combine_chunks(), pa.array(ranges(row, far[row] - distance, len(t)), FOUND.field(2).type)], schema=FOUND)
                yield out.filter(pc.greater(pc.list_value_length(out.column(2)), 0))

    return map_arrow(parts.repartition(F.shiftrightunsigned("key", 64 - RADIX_BITS)), run, "key long, digest long, found array<int>")


def counted_windows(parts: DataFrame, span: int) -> DataFrame:
    """As sorted_windows(), with each window's digest counted instead."""
    fields = pa.schema([("key", pa.int64()), ("digest", pa.int64()), ("n", pa.int64()), ("place", pa.int32()), ("far", pa.int32()), ("window", pa.int64())])

    def run(batches):
        for b in batches:
            for key, digest, n, far, last, body in zip(*(b.column(c).to_pylist() for c in ("key", "digest", "n", "far", "last", "body")), strict=True):
                place = list(range(last + 1))
                windows = np.array([xxhash.xxh3_64_intdigest(body[p : p + span]) for p in place], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([x] * len(place), t) for x, t in ((key, pa.int64()), (digest, pa.int64()), (n, pa.int64()))] + [pa.array(place, pa.int32()), pa.array([far - p for p in place], pa.int32()), pa.array(windows)], schema=fields)

    each = written(map_arrow(parts, run, "key long, digest long, n long, place int, far int, window long"), "suffix-windows")
    twice = each.groupBy("key", "far", "window").agg(F.sum("n").alias("n")).where("n > 1").drop("n")
    hit = each.join(twice, ["key", "far", "window"], "left_semi").groupBy("key", "digest").agg(F.array_sort(F.collect_list("place")).alias("p"))
    return hit.select("key", "digest", F.flatten(F.transform("p", lambda x: F.array(x, x))).alias("found"))


def repeated(docs: DataFrame, span: int = SPAN, gram: int = GRAM, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """k and spans (first and last window of repeated runs, in no order) for docs (k struct (file, row), text), for texts that have any."""
    every = segments(docs, span, gram)
    n = F.lit(1) + F.coalesce(F.array_size("more"), F.lit(0)).cast("long")
    twice = every.groupBy("key").agg(F.sum(n).alias("n")).where("n > 1").select("key")
    places = written(every.join(twice, "key", "left_semi"), "suffix-places")
    settle(docs.sparkSession)
    kinds = places.groupBy("key", "digest").agg(F.sum(n).alias("n"), F.min(F.struct("file", "row", "lo", "hi", "far")).alias("one"))
    wanted = kinds.groupBy(F.struct("one.file", "one.row").alias("k")).agg(F.collect_list(F.struct("key", "digest", "n", "one.lo", "one.hi", "one.far")).alias("cut"))
    text = F.col("text").cast("binary")
    parts = docs.select("k", text.alias("text")).join(wanted, "k").select("text", F.explode("cut").alias("c"))
    parts = written(parts.select("c.key", "c.digest", "c.n", "c.far", (F.col("c.hi") - F.col("c.lo")).alias("last"), F.expr(f"substring(text, c.lo + 1, c.hi - c.lo + {span})").alias("body")), "suffix-parts")
    settle(docs.sparkSession)
    large = parts.groupBy("key").count().where(F.col("count") > hot).select("key")
    found = sorted_windows(parts.join(large, "key", "left_anti"), span, block)
    if not large.isEmpty():
        found = found.unionByName(counted_windows(parts.join(large, "key", "left_semi"), span))
    found = written(found, "suffix-found")
    starts = F.concat(F.array("lo"), F.coalesce("more", F.expr("cast(array() as array<int>)")))
    hits = places.select("key", "digest", F.struct("file", "row").alias("k"), starts.alias("starts")).join(found, ["key", "digest"])
    spans = F.flatten(F.transform("starts", lambda s: F.transform("found", lambda f: f + s)))
    return hits.select("k", spans.alias("spans")).groupBy("k").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def removed(n: int, spans: list[int] | None, span: int) -> list[tuple[int, int]]:
    """The maximal runs (start, end) of bytes that the windows cover; spans: first and last window of runs, in any order."""
    if spans is None or not len(spans):
        return []
    x = np.asarray(spans, np.int64).reshape(-1, 2)
    x = x[np.argsort(x[:, 0], kind="stable")]
    end = np.maximum.accumulate(x[:, 1] + span)
    first = np.flatnonzero(np.r_[True, x[1:, 0] > end[:-1]])
    return list(zip(x[first, 0].tolist(), end[np.r_[first[1:], len(x)] - 1].tolist(), strict=True))


def without_repeats(docs: DataFrame, span: int = SPAN, gram: int = GRAM, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes) for each row of docs (doc_id, text)."""
    rows = keyed(docs.select("doc_id", "text"), "k")
    spans = written(repeated(rows, span, gram, hot, block), "suffix-spans")
    settle(docs.sparkSession)
    kinds = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            texts, out = utf8(b.column(1)), []
            for t, s in zip(texts, b.column(2).to_pylist(), strict=True):
                cut = removed(len(t), s, span)
                places = [0, *(x for c in cut for x in c), len(t)]
                out.append((len(t), sum(z - a for a, z in cut), len(cut), b"".join(t[a:z] for a, z in zip(places[::2], places[1::2], strict=True))))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[k] for r in out], pa.int64()) for k in range(3)), pa.array([r[3] for r in out], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    joined = rows.join(spans, "k", "left").select("doc_id", "text", "spans")
    return map_arrow(joined, run, f"doc_id {kinds}, n_bytes long, n_removed long, n_spans long, kept binary")


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(load(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
