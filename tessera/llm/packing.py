"""Best-fit packing with variable capacities.

Documents are cut into pieces of the largest permitted length at most, and pieces are dealt to shards
of about SHARD_PIECES by hash. Each shard packs its pieces longest first, each into the open bin with
the least room that still takes it. When none does, a bin is opened at the size of least cost: for
every permitted size the bin is filled in thought from the histogram of the lengths that are left
(longest first), and the size with the least cost a word wins, where a bin costs the size it would be
cut down to plus BIN_COST. The whole shard is also packed under each fixed floor (no bin under it is
opened), and the packing with the least total cost is kept, so it is never worse than these. At the
end each bin is downsized to the smallest permitted length that holds its contents.

Lengths are words, or any other unit whose number a column holds (tokens, say). pack_documents gives a
row for each piece with the key of the row it comes from; pack_texts gives the pieces' texts and all
columns of the documents as well, so that bins can be rebuilt from its rows alone.

Defined results: null, empty and wordless texts have no pieces and no rows; a text longer than the
largest length gives several pieces; ties of length go by doc_id (null first), row key and piece;
repeated rows are packed each, under keys of their own; an empty table gives an empty result; other
columns of the input are ignored by pack_documents and kept by pack_texts, where those with the names
of PLACE are replaced.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, keyed, load, map_arrow, utf8, whole_rows

LENGTHS = (512, 1024, 2048, 4096)
BIN_COST = 16
SHARD_PIECES = 50_000
#: Columns that say where a piece lies.
PLACE = ("piece", "start_word", "n_words", "shard", "bin", "offset", "used", "capacity")
SCHEMA = "row_file long, row_number long, doc_id long, piece int, start_word long, n_words int, shard int, bin long, offset int, used int, capacity int"


class Room:
    """Open bins by free room; a bit for each amount of room that some bin has."""

    def __init__(self):
        self.bits, self.bins = 0, {}

    def put(self, room: int, item) -> None:
        if room > 0:
            self.bins.setdefault(room, []).append(item)
            self.bits |= 1 << room

    def take(self, need: int):
        """(room, bin) with the least room that is enough, or None."""
        above = self.bits >> need
        if not above:
            return None
        room = need + (above & -above).bit_length() - 1
        stack = self.bins[room]
        item = stack.pop()
        if not stack:
            self.bits &= ~(1 << room)
        return room, item


def smallest(lengths: tuple[int, ...], n: int) -> int:
    return next(c for c in lengths if c >= n)


class Left:
    """The histogram of the lengths that are still to be packed."""

    def __init__(self, ns: list[int]):
        self.counts = Counter(ns)
        self.bits = sum(1 << n for n in self.counts)

    def remove(self, n: int) -> None:
        self.counts[n] -= 1
        if not self.counts[n]:
            self.bits &= ~(1 << n)

    def fill(self, room: int) -> int:
        """How much of the room the lengths left would take, longest first."""
        taken, most = 0, room
        while most > 0:
            n = (self.bits & ((2 << most) - 1)).bit_length() - 1
            if n <= 0:
                break
            taken += min(self.counts[n], (room - taken) // n) * n
            most = min(room - taken, n - 1)
        return taken


def opening(n: int, left: Left, lengths: tuple[int, ...]) -> int:
    """The size of the new bin for a piece of length n: the least cost a word, ties to the smaller."""

    def cost(size: int) -> float:
        used = n + left.fill(size - n)
        return (smallest(lengths, used) + BIN_COST) / used

    return min((c for c in lengths if c >= n), key=lambda c: (cost(c), c))


def place(ns: list[int], lengths: tuple[int, ...], floor: int | None) -> tuple[list[tuple[int, int]], list[int]]:
    """(bin, offset) of each length (longest first), and what each bin holds; floor: the smallest size opened, None for the least-cost one."""
    room, left, used, places = Room(), Left(ns) if floor is None else None, [], []
    for n in ns:
        if left:
            left.remove(n)
        found = room.take(n)
        if found is None:
            size, k = opening(n, left, lengths) if left else smallest(lengths, max(n, floor)), len(used)
            used.append(0)
        else:
            size, k = found
        places.append((k, used[k]))
        used[k] += n
        room.put(size - n, k)
    return places, used


def total_cost(used: list[int], lengths: tuple[int, ...]) -> int:
    return sum(smallest(lengths, u) + BIN_COST for u in used)


def pack(ns: list[int], lengths: tuple[int, ...]) -> list[tuple[int, int, int, int]]:
    """For lengths, longest first: bin, offset, words in the bin, downsized capacity of each; the cheapest of the packings tried."""
    places, used = min((place(ns, lengths, floor) for floor in (None, *lengths)), key=lambda x: total_cost(x[1], lengths))
    return [(k, at, used[k], smallest(lengths, used[k])) for k, at in places]


def word_counts(rows: DataFrame) -> DataFrame:
    """k, doc_id and n (words of the whole text) of each row of rows (k, doc_id, text)."""
    schema = pa.schema([("file", pa.int64()), ("row", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64())])

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2).cast(pa.int64()), pa.array([len(t.split()) for t in utf8(b.column(3))], pa.int64())], schema=schema)

    counted = map_arrow(rows.select("k.file", "k.row", "doc_id", "text"), run, "file long, row long, doc_id long, n long")
    return counted.select(F.struct("file", "row").alias("k"), "doc_id", "n")


def assign(counted: DataFrame, lengths: tuple[int, ...], shard_pieces: int) -> DataFrame:
    """The columns of SCHEMA for each piece of counted (k, doc_id, n)."""
    lengths = tuple(sorted(lengths))
    top = lengths[-1]
    pieces = counted.where("n > 0").select("k.file", "k.row", "doc_id", "n", F.explode(F.expr(f"sequence(0L, (n - 1) div {top})")).alias("piece"))
    n_pieces = counted.agg(F.sum(F.expr(f"(n + {top - 1}) div {top}"))).first()[0] or 0
    shards = max(1, -(-n_pieces // shard_pieces))
    dealt = pieces.select(F.pmod(F.xxhash64("file", "row", "piece"), F.lit(shards)).cast("int").alias("shard"), "file", "row", F.col("doc_id").cast("long").alias("doc_id"), "piece", F.expr(f"least({top}, n - piece * {top})").alias("n"))
    dealt = dealt.repartition(shards, "shard").sortWithinPartitions("shard")
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]

    def packed(shard: int, rows: list[tuple]):
        rows.sort(key=lambda r: (-r[4], r[2] is not None, r[2] or 0, r[0], r[1], r[3]))
        out = [(f, r, d, i, i * top, n, shard, (shard << 40) | k, at, used, size) for (f, r, d, i, n), (k, at, used, size) in zip(rows, pack([x[4] for x in rows], lengths), strict=True)]
        for i in range(0, len(out), 20_000):
            part = out[i : i + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in part], t) for c, t in enumerate(types)], names=names)

    def run(batches):
        now, rows = None, []
        for b in batches:
            for shard, *rest in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if shard != now and rows:
                    yield from packed(now, rows)
                    rows = []
                now = shard
                rows.append(tuple(rest))
        if rows:
            yield from packed(now, rows)

    return map_arrow(dealt, run, SCHEMA)


def _counted(rows: DataFrame, size: str | None) -> DataFrame:
    return rows.select("k", "doc_id", F.coalesce(F.col("size").cast("long"), F.lit(0).cast("long")).alias("n")) if size else word_counts(rows)


def pack_documents(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS, shard_pieces: int = SHARD_PIECES, size: str | None = None) -> DataFrame:
    """A row for each piece: its document's row and id, its words in the document, its bin, its place there, and the bin's capacity.

    size: a column with the documents' lengths in another unit, which start_word and n_words then count. row_file
    and row_number say which row of docs it is: the hash of its file's path and its place there, if docs is a table
    of files."""
    rows = keyed(docs.select("doc_id", F.col(size).alias("size") if size else "text"), "k")
    return assign(_counted(rows, size), lengths, shard_pieces)


def pack_texts(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """docs with a row for each piece: text holds the piece's words, n_chars (where there is one) counts them, and the columns of PLACE follow.

    A text in one piece stays as it is, one in several has single spaces between words. Texts cross one shuffle."""
    rows = keyed(whole_rows(docs, "doc_id", "text"), "k")
    found = assign(word_counts(rows), lengths, shard_pieces)
    each = found.groupBy(F.struct(F.col("row_file").alias("file"), F.col("row_number").alias("row")).alias("k")).agg(F.sort_array(F.collect_list(F.struct(*PLACE))).alias("p"))
    joined = rows.select("row", "k").join(each, "k")
    cut = F.size("p") > 1

    def piece(words, p):
        text = F.when(cut, F.array_join(F.slice(words, (p["start_word"] + 1).cast("int"), p["n_words"]), " ")).otherwise(F.col("row.text"))
        own = {"text": text} | ({"n_chars": F.when(cut, F.length(text)).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
        fields = [own.get(c, F.col("row")[c]).alias(c) for c in docs.columns if c not in PLACE]
        return F.struct(*fields, *[p[c].alias(c) for c in PLACE])

    # The words are bound once for all pieces of a document.
    words = F.array(F.when(cut, F.regexp_extract_all("row.text", F.lit(WORD), F.lit(0))))
    return joined.select(F.explode(F.transform(words, lambda w: F.transform("p", lambda p: piece(w, p)))[0]).alias("out")).select("out.*")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(load(spark, sf_dir, "documents"))
