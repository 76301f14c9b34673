"""Token counts without token ids.

The pieces of a pre-token do not depend on its surroundings, so they are counted once for each
distinct pre-token of the corpus and joined to the pre-token frequencies of each document. In the
joins a pre-token goes by its key: itself up to KEY_BYTES bytes, else its digest, which is longer. The
most frequent keys, HEAD of them at most and so 64 * HEAD bytes, are sent to every task, where a
document's frequencies meet them on the spot; what remains, the long tail, meets its counts in a
shuffle join on the key. A key of that tail has less than one in HEAD of all occurrences, about, so no
word becomes a hot key, however frequent or long, and nothing that grows with the corpus is broadcast.
Ids are never stored.

Pre-tokens are cut by the tokenizer's own pre-tokenizer, or, for texts made only of characters
whose classes cannot differ between Unicode versions, by the same pattern in `re`. Strings of
special tokens inside a text count one token each, as the library has it by default.

Defined results: null and empty texts have 0 tokens and 0 bytes; repeated rows are counted each;
an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections import Counter
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, map_arrow, utf8, with_key, written

HEAD = 131_072
KEY_BYTES = 48
LIMIT = 1024
#: Distinct pre-tokens that a task gathers before it hands them on.
FLUSH = 200_000
#: Characters whose classes are the same in every Unicode version: ASCII but \x1c-\x1f, and Latin letters.
LETTERS = "A-Za-zÀ-ÖØ-öø-ſ"
_PLAIN = re.compile(r"[\t\n\r\x20-\x7eÀ-ÖØ-öø-ſ]*")


@cache
def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _plain_pattern(pattern: str) -> str:
    """The pattern for plain texts: classes spelt out, as `re` has no \\p and runs them faster."""
    inside = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^\\s{LETTERS}0-9]")
    return inside.replace(r"\p{L}", f"[{LETTERS}]").replace(r"\p{N}", "[0-9]")


@cache
def _cutter(path: str, pattern: str | None):
    """text -> list of pre-tokens, and the number of special tokens cut out."""
    t = _tokenizer(path)
    special = [x.content for x in t.get_added_tokens_decoder().values()]
    split = re.compile("|".join(re.escape(x) for x in sorted(special, key=len, reverse=True))) if special else None
    find = re.compile(_plain_pattern(pattern)).findall if pattern else None
    pre = t.pre_tokenizer.pre_tokenize_str

    def own(part: str) -> list[str]:
        return [part[a:b] for _, (a, b) in pre(part)]

    def cut(text: str) -> tuple[list[str], int]:
        plain = find and _PLAIN.fullmatch(text)
        if split is None or not any(x in text for x in special):
            return (find(text) if plain else own(text)), 0
        parts = split.split(text)
        return [w for p in parts if p for w in (find(p) if plain else own(p))], len(parts) - 1

    return cut


def key_of(pre: str) -> str:
    """What stands for a pre-token in joins: itself if it has KEY_BYTES bytes at most, else the 64 digits of its digest."""
    if len(pre) * 4 <= KEY_BYTES or len(raw := pre.encode()) <= KEY_BYTES:
        return pre
    return hashlib.blake2b(raw, digest_size=32).hexdigest()


def pretoken_counts(docs: DataFrame, path: str, pattern: str | None) -> DataFrame:
    """pre, n: how often each distinct pre-token stands in the corpus."""

    def run(batches):
        cut, seen = _cutter(path, pattern), Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    seen.update(cut(t)[0])
                if len(seen) > FLUSH:
                    yield pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array(list(seen.values()), pa.int64())], names=["pre", "n"])
                    seen = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["pre", "n"])

    return map_arrow(docs.select("text"), run, "pre string, n long").groupBy("pre").agg(F.sum("n").alias("n"))


def piece_counts(pres: DataFrame, path: str) -> DataFrame:
    """key, n, pieces: each distinct pre-token is encoded once."""

    def run(batches):
        t = _tokenizer(path)
        for b in batches:
            words = b.column(0).to_pylist()
            found = [len(e.ids) for i in range(0, len(words), 4096) for e in t.encode_batch_fast(words[i : i + 4096], add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([pa.array([key_of(w) for w in words], pa.string()), b.column(1), pa.array(found, pa.int64())], names=["key", "n", "pieces"])

    return map_arrow(pres.select("pre", "n"), run, "key string, n long, pieces long")


def frequent(vocabulary: DataFrame, head: int) -> DataFrame:
    """The most frequent rows, head of them at most: those above the lowest frequency class that leaves room.

    Classes are sixteenths of powers of two, so there are under 1,100, and no task sorts the candidates."""
    level = F.floor(F.log2("n") * 16).cast("int")
    classes, total, least = vocabulary.groupBy(level.alias("level")).count().collect(), 0, None
    for c in sorted(classes, key=lambda c: -c["level"]):
        total += c["count"]
        if total > head:
            break
        least = c["level"]
    return vocabulary.where(level >= least) if least is not None else vocabulary.where("false")


def token_counts(docs: DataFrame, path: str, pattern: str | None = None, limit: int = LIMIT, head: int = HEAD) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row of docs (doc_id, text).

    pattern: the pre-tokenizer's own, if it is one; it only speeds plain texts up."""
    vocabulary = written(piece_counts(pretoken_counts(docs, path, pattern), path), "token-pieces")
    top = frequent(vocabulary, head).select("key", "pieces").toArrow()
    shared = docs.sparkSession.sparkContext.broadcast(dict(zip(top.column(0).to_pylist(), top.column(1).to_pylist(), strict=True)))
    names = ["k", "doc_id", "n_bytes", "base", "key", "n"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.int64()]

    def run(batches):
        cut, known = _cutter(path, pattern), shared.value
        for b in batches:
            rows, size = [], 0
            for k, i, t, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), utf8(b.column(2)), strict=True):
                words, total = cut(t) if t else ((), 0)
                tail = Counter()
                for w, c in Counter(words).items():
                    pieces = known.get(key := key_of(w))
                    if pieces is None:
                        tail[key] = c
                    else:
                        total += pieces * c
                rows.append((k, i, len(raw), True, str(k), total))
                rows += [(k, None, None, False, w, c) for w, c in tail.items()]
                size += len(tail) + 1
                if size > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], x) for c, x in enumerate(types)], names=names)
                    rows, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], x) for c, x in enumerate(types)], names=names)

    freq = map_arrow(with_key(docs.select("doc_id", "text"), "k").select("k", "doc_id", "text"), run, "k long, doc_id long, n_bytes long, base boolean, key string, n long")
    pieces = vocabulary.select("key", F.lit(False).alias("base"), "pieces")
    # A document's own row carries a key of its own, so that these rows spread evenly.
    joined = freq.join(pieces, ["base", "key"], "left")
    each = joined.groupBy("k").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum(F.col("n") * F.coalesce("pieces", F.lit(1))).alias("n_tokens"))
    return each.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
