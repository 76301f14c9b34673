"""Language identification by compression: one raw-content zstandard dictionary per language.

A text is lower-cased, everything but letters (categories L, and M after a letter) is blanked, and the
rest is cut into blocks of BLOCK bytes, so that the dictionary counts as much at the end of a long text
as at its start. Every block of the whole text is compressed with each language's dictionary; the
language with the smallest sum is chosen. score is the margin 1 - best/second, scaled to 0..1 by
FULL_MARGIN; a text whose margin is under min_margin is rejected (column rejected), though its best
guess is still given.

Dictionaries are learned from a bounded sample: of each language the SAMPLE_DOCS different texts with
the smallest hash, found in one pass in which every task keeps no more than that. A sampled text is
cut whole into pieces of PIECE bytes, and the DICT_BYTES / SAMPLE_DOCS bytes of pieces with the
smallest hashes are learned. Only text and lang are used for learning, only text for prediction.
More than max_langs languages are an error, so what reaches the driver and each task is bounded.

Defined results: null texts and texts without letters give `und`, score 0, rejected; ties of sizes go
to the smaller language name; repeated rows give repeated results, and are learned once; with no
labelled row every text is `und`; with one language learned every text with letters is that one,
with score 1; a language whose sampled texts hold no letter is not learned and never predicted; other
columns of the input are ignored.
"""

from __future__ import annotations

import heapq
import sys
import unicodedata
import re

from functools import cache

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import fresh, load, map_arrow, written

SAMPLE_DOCS = 128
DICT_BYTES = 64 * 1024
PIECE = 128
#: Languages that may be learned; each has a dictionary of DICT_BYTES bytes.
MAX_LANGS = 256
BLOCK = 4096
LEVEL = 6
#: The margin that counts as certain, and the one under which a text is rejected.
FULL_MARGIN = 0.10
MIN_MARGIN = 0.005
UND = "und"
#: Blanks the ASCII characters that are no lower-case letters.
_TABLE = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _class(first: str) -> str:
    """The characters of a general category, as ranges for a character class."""
    spans: list[list[int]] = []
    for c in range(sys.maxunicode + 1):
        if unicodedata.category(chr(c))[0] == first:
            if spans and spans[-1][1] == c - 1:
                spans[-1][1] = c
            else:
                spans.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans)


@cache
def _patterns():
    """What is neither ASCII nor a letter; that and no mark either; marks that follow no letter."""
    letters, marks = _class("L"), _class("M")
    return re.compile(f"[^\\x00-\\x7f{letters}]"), re.compile(f"[^\\x00-\\x7f{letters}{marks}]+"), re.compile(f"(?<![{letters}{marks}])[{marks}]+")


def normal(text: str | None) -> bytes:
    low = (text or "").lower()
    if not low.isascii():
        any_other, other, stray = _patterns()
        if any_other.search(low):
            low = stray.sub(" ", other.sub(" ", low))
    return b" ".join(low.encode("utf-8", "replace").translate(_TABLE).split())


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def excerpt(data: bytes, most: int) -> bytes:
    """At most `most` bytes of a whole normal text: the pieces with the smallest hashes, in their order."""
    if len(data) <= most:
        return data
    pieces = [data[i : i + PIECE] for i in range(0, len(data), PIECE)]
    best = sorted(heapq.nsmallest(most // PIECE, range(len(pieces)), key=lambda i: (xxhash.xxh64_intdigest(pieces[i]), i)))
    return b" ".join(pieces[i] for i in best)[:most]


def _sampled(max_langs: int):
    """For mapInArrow over (lang, text). lang, h, part: of each language the SAMPLE_DOCS different texts of this task with the smallest hashes."""

    def run(batches):
        kept: dict[str, list[tuple[int, bytes]]] = {}  # heaps, the largest hash first
        for b in batches:
            for lang, raw in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                h, heap = -(xxhash.xxh64_intdigest(raw) >> 1), kept.setdefault(lang, [])
                if len(kept) > max_langs:
                    raise ValueError(f"more than {max_langs} languages are labelled")
                if (len(heap) < SAMPLE_DOCS or h > heap[0][0]) and all(h != x[0] for x in heap):
                    part = excerpt(normal(raw.decode("utf-8", "replace")), DICT_BYTES // SAMPLE_DOCS)
                    (heapq.heappush if len(heap) < SAMPLE_DOCS else heapq.heappushpop)(heap, (h, part))
        rows = [(lang, -h, part) for lang, heap in kept.items() for h, part in heap]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.binary()))], names=["lang", "h", "part"])

    return run


def learn(docs: DataFrame, max_langs: int = MAX_LANGS) -> dict[str, bytes]:
    """Dictionaries by language from labelled rows (text, lang); see the bounds above."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    first = Window.partitionBy("lang").orderBy("h")
    found = map_arrow(labelled, _sampled(max_langs), "lang string, h long, part binary").dropDuplicates(["lang", "h"])
    found = written(found.withColumn("n", F.row_number().over(first)).where(F.col("n") <= SAMPLE_DOCS), "language-sample")
    if (n := found.select("lang").distinct().count()) > max_langs:
        raise ValueError(f"{n} languages are labelled, more than {max_langs}")
    out: dict[str, list[bytes]] = {}
    for r in sorted(found.collect(), key=lambda r: (r["lang"], r["h"])):
        if part := bytes(r["part"]):
            out.setdefault(r["lang"], []).append(part)
    return {lang: b" ".join(parts)[-DICT_BYTES:].rjust(8) for lang, parts in out.items()}  # a dictionary has 8 bytes at least


class Classifier:
    def __init__(self, dicts: dict[str, bytes]):
        self.langs = sorted(dicts)
        self.by = []
        for lang in self.langs:
            d = zstandard.ZstdCompressionDict(dicts[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.by.append(zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False))

    def sizes(self, data: bytes) -> list[int]:
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        return [sum(len(c.compress(b)) for b in blocks) for c in self.by]

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, score and raw margin."""
        data = normal(text)
        if not data or not self.langs:
            return UND, 0.0, 0.0
        sizes = self.sizes(data)
        order = sorted(range(len(sizes)), key=lambda i: (sizes[i], self.langs[i]))
        margin = 1 - sizes[order[0]] / sizes[order[1]] if len(order) > 1 else FULL_MARGIN
        return self.langs[order[0]], min(1.0, margin / FULL_MARGIN), margin


def classify(docs: DataFrame, dicts: dict[str, bytes], min_margin: float = MIN_MARGIN, names: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """docs with language, score and rejection appended under these names; the dictionaries (DICT_BYTES a language) go to each task.

    Columns of docs with these names are replaced."""
    docs = docs.drop(*names)
    shared = docs.sparkSession.sparkContext.broadcast(dicts)
    at = docs.columns.index("text")

    def run(batches):
        c = Classifier(shared.value)
        for batch in batches:
            found = [c.predict(t) for t in batch.column(at).to_pylist()]
            extra = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[0] == UND or x[2] < min_margin for x in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, *names])

    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType()), T.StructField(names[2], T.BooleanType())])
    return map_arrow(docs, run, schema)


def keep_certain(docs: DataFrame, dicts: dict[str, bytes], min_margin: float = MIN_MARGIN) -> DataFrame:
    """The rows of docs that are not rejected, with all their columns as they are."""
    names = tuple(fresh(docs, x) for x in ("lang_pred", "score", "rejected"))
    return classify(docs, dicts, min_margin, names).where(~F.col(names[2])).drop(*names)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    dicts = learn(docs.where(~held_out(F.col("doc_id"))))
    found = classify(docs.select("doc_id", "text"), dicts)
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
