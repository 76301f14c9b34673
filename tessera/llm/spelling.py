"""Spelling variants: words that differ by one code point, found by deletion keys, grouped under their frequent form.

near_words() links words that differ by exactly one inserted, deleted or replaced code point. Leaving out the
code point at place i of a word gives a shorter string. A word that is this string is near by insertion; two
words that give the same string from the same place are near by replacement. So every word has an integer
key for each string that it gives, and one for itself, and words are near only if keys agree. The key of
what remains without place i is a polynomial hash, put together from the hash of the prefix before i and
that of the suffix after i, which NumPy takes for all places of a batch of words from one running sum. Within a
run of equal code points all places give the same string, so they make one row with the places' range.

Rows (key, word's number, places) are partitioned by the upper bits of the key and sorted by key; only rows whose
key another word shares go on. These get their words and are grouped again, and the strings themselves are
compared, so keys that agree by chance link nothing. Of a group no pairs are made: a string and a place leave at
most one word for each letter, each word gets the number of the others and the best of them. Numbers
are summed up and the best taken for each word. Roots follow forms by pointer doubling; each form is at
least `ratio` times as frequent as what it stands for, so there are few rounds.

Defined results: null and empty texts hold no words; a null doc_id is written as an empty one; runs of any length
are words, keys of long ones go in slices; repeated rows count again; ties of frequency go to the smaller
word by code point; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, map_arrow, remove, utf8, written, written_at

MIN_LENGTH = 7
MIN_COUNT = 2
#: A form is so many times as frequent as the words it stands for.
RATIO = 10
#: One in so many runs loses a code point (fixed by the query's contract); None leaves the runs as they are.
DAMAGE = 31
FLUSH = 200_000
#: Rows of keys that leave a task at once, and bits of a key by which rows are partitioned.
SLICE = 1 << 18
RADIX_BITS = 16
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
ODD = np.uint64(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * ODD
    return x ^ (x >> np.uint64(29))


def word_counts(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, damage: int | None = DAMAGE) -> DataFrame:
    """id, word and n of the words of docs (doc_id, text), as a written table; ids number the rows."""
    letters = re.compile(f"[a-zÀ-ÿ]{{{min_length},}}")  # a shorter run does not get long enough

    def run(batches):
        seen: Counter = Counter()

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), utf8(b.column(1)), strict=True):
                for w, n in Counter(letters.findall(t.lower().decode("utf-8", "replace"))).items():  # bytes: A-Z only
                    if damage:
                        h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
                        if h % damage == 0:
                            w = w[: (at := h % len(w))] + w[at + 1 :]
                            if len(w) < min_length:
                                continue
                    seen[w] += n
                if len(seen) > FLUSH:
                    yield rows()
                    seen.clear()
        yield rows()

    counted = map_arrow(docs.select("doc_id", "text"), run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
    return written(counted.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "spelling-words")


def deletion_keys(words: list[str]) -> tuple[np.ndarray, ...]:
    """key, word's place in the list, and first and last place that can be left out (-1 for the word itself) of each row."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    size = np.array([len(w) for w in words])
    start = np.cumsum(size) - size
    word = np.repeat(np.arange(len(words)), size)
    at = np.arange(len(codes)) - start[word]
    powers = np.ones(int(size.max()) + 1, np.uint64)
    powers[1:] = BASE
    powers = np.cumprod(powers)
    term = mixed((codes.astype(np.uint64) + np.uint64(1)) * BASE) * powers[at]
    upto = np.cumsum(term)  # modulo 2^64, like all that follows
    before_word = upto[start] - term[start]
    prefix, total = upto - term - before_word[word], upto[start + size - 1] - before_word
    without = prefix + (total[word] - prefix - term) * INVERSE
    first = np.flatnonzero((at == 0) | (codes != np.r_[codes[:1], codes[:-1]]))
    last = np.r_[first[1:] - 1, len(codes) - 1]
    length = lambda n: n.astype(np.uint64) * ODD
    own, left = mixed(total + length(size)), mixed(without[first] + length(size[word[first]] - 1))
    none = np.full(len(words), -1)
    return np.r_[own, left], np.r_[np.arange(len(words)), word[first]], np.r_[none, at[first]].astype(np.int32), np.r_[none, at[last]].astype(np.int32)


def _keys(words: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            if not texts:
                continue
            key, word, lo, hi = deletion_keys(texts)
            ids = b.column(0).to_numpy()[word]
            for i in range(0, len(key), SLICE):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + SLICE]) for x in (key.view(np.int64), ids, lo, hi)], names=["key", "id", "lo", "hi"])

    return map_arrow(words.select("id", "word"), run, "key long, id long, lo int, hi int")


def by_key(rows: DataFrame) -> DataFrame:
    return rows.repartition(F.shiftrightunsigned("key", 64 - RADIX_BITS)).sortWithinPartitions("key")


def _shared(batches):
    """Of batches sorted by key, those rows whose key is not the only one of its kind."""
    kept = None
    for b in batches:
        b = pa.Table.from_batches([b] if kept is None else [kept, b]).combine_chunks().to_batches()
        if not b:
            continue
        b = b[0]
        key = b.column(0).to_numpy()
        same = key[1:] == key[:-1]
        end = len(key) - 1 - int(np.argmin(same[::-1])) if not same.all() else 0  # the last key may go on in the next batch
        kept = b.slice(end)
        twice = np.r_[False, same] | np.r_[same, False]
        if twice[:end].any():
            yield b.filter(pa.array(np.r_[twice[:end], np.zeros(len(key) - end, bool)]))
    if kept is not None and len(kept) > 1:
        yield kept


def best_two(rows: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    return sorted(rows, key=lambda r: (-r[0], r[1]))[:2]


def near_in_group(rows: list[tuple[int, str, int, int, int]]):
    """(id, n_near, n, word and id of the best near word) as far as rows (id, word, n, lo, hi) of one key tell."""
    strings = defaultdict(lambda: (list(), list()))
    for i, w, n, lo, hi in rows:
        strings[w if lo < 0 else w[:lo] + w[lo + 1 :]][lo >= 0].append((i, w, n, lo, hi))
    for itself, longer in strings.values():
        if itself and longer:
            i, w, n, _, _ = itself[0]
            yield (i, len(longer), *best_two([(m, x, k) for k, x, m, _, _ in longer])[0])
            for k, *_ in longer:
                yield k, 1, n, w, i
        if len(longer) > 1:
            places = defaultdict(list)
            for i, w, n, lo, hi in longer:
                for p in range(lo, hi + 1):
                    places[p].append((n, w, i))
            for at in places.values():
                if len(at) > 1:
                    top = best_two(at)
                    for n, w, i in at:
                        yield (i, len(at) - 1, *top[w == top[0][1]])


def _near(batches):
    """Of batches (key, id, word, n, lo, hi) sorted by key, what near_in_group() tells of each key."""
    group, last, out = [], None, []

    def rows():
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()))], names=["id", "n_near", "near_n", "near", "near_id"])

    for b in batches:
        for key, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if key != last:
                if len(group) > 1:
                    out += near_in_group(group)
                group, last = [], key
            group.append(row)
        if len(out) > 10_000:
            yield rows()
            out.clear()
    out += near_in_group(group)
    yield rows()


def near_words(words: DataFrame) -> DataFrame:
    """id, n_near, and near_n, near and near_id of the most frequent near word, for the words (id, word, n; a written table) that have any."""
    shared = map_arrow(by_key(_keys(words)), _shared, "key long, id long, lo int, hi int")
    named = by_key(shared.join(words, "id").select("key", "id", "word", "n", "lo", "hi"))
    found = map_arrow(named, _near, "id long, n_near long, near_n long, near string, near_id long")
    best = F.min(F.struct((-F.col("near_n")).alias("a"), "near", "near_id"))
    return found.groupBy("id").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("id", "n_near", (-F.col("b.a")).alias("near_n"), "b.near", "b.near_id")


def roots(forms: DataFrame) -> DataFrame:
    """id and root of forms (id, to): where following `to` ends."""
    path, now = written_at(forms.select("id", F.col("to").alias("root")), "spelling-roots")
    while True:
        ahead = now.select(F.col("id").alias("root"), F.col("root").alias("next"))
        after, then = written_at(now.join(ahead, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        remove(forms.sparkSession, path)
        path, now = after, then.drop("moved")
        if then.where("moved").isEmpty():
            return now


def variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: float = RATIO, damage: int | None = None) -> DataFrame:
    """word, n, n_near, form, form_n and root of each word of docs (doc_id, text) of at least min_length code points and min_count occurrences."""
    words = word_counts(docs, min_length, min_count, damage)
    named = words.join(near_words(words), "id", "left")
    is_form = F.col("near_n") >= F.lit(ratio) * F.col("n")
    only = lambda c: F.when(is_form, F.col(c))
    named = written(named.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), only("near").alias("form"), only("near_n").alias("form_n"), only("near_id").alias("to")), "spelling-forms")
    ends = roots(named.where("to is not null").select("id", "to")).join(words.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root").select("id", "root_word")
    return named.join(ends, "id", "left").select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(load(spark, sf_dir, "documents"), damage=DAMAGE)
