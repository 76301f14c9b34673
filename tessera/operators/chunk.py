"""Sentence-aware chunks with overlap.

Sentences are packed greedily: a chunk ends before the sentence that would bring its length over
`size`, and the next one begins with as many of its last sentences as fit in `overlap` when joined.
The running length counts joins only in what is carried over. All of it is one fold over a
document's array of sentence lengths, so a document needs no shuffle and no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_korean_text, split_sentences

SIZE, OVERLAP, LONGER_THAN = 500, 100, 50
_STATE = "struct<i:int,s:int,cur:bigint,out:array<struct<s:int,e:int>>>"


def pack(lengths: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Array of (s, e): sentences s..e-1 (from 0) of each chunk."""

    def step(acc: Column, n: Column) -> Column:
        flush = (acc["cur"] + n > size) & (acc["i"] > acc["s"])
        # A sentence has one character at least, so no more than overlap / 2 + 1 sentences are carried over.
        first = F.greatest(acc["s"], acc["i"] - (overlap // 2 + 2))
        tail = F.reverse(F.slice(lengths, first + 1, acc["i"] - first))
        carry = F.aggregate(
            tail,
            F.expr("named_struct('k', 0, 'n', 0L, 'open', true)"),
            lambda c, m: F.when(
                c["open"] & (c["n"] + m + F.when(c["k"] > 0, 1).otherwise(0) <= overlap),
                F.struct((c["k"] + 1).alias("k"), (c["n"] + m + F.when(c["k"] > 0, 1).otherwise(0)).cast("long").alias("n"), F.lit(True).alias("open")),
            ).otherwise(F.struct(c["k"].alias("k"), c["n"].alias("n"), F.lit(False).alias("open"))),
        )
        moved = F.element_at(
            F.transform(F.array(carry), lambda c: F.struct(
                (acc["i"] + 1).alias("i"), (acc["i"] - c["k"]).alias("s"), (c["n"] + n).cast("long").alias("cur"), F.concat(acc["out"], F.array(F.struct(acc["s"].alias("s"), acc["i"].alias("e")))).alias("out"))), 1
        )
        stayed = F.struct((acc["i"] + 1).alias("i"), acc["s"].alias("s"), (acc["cur"] + n).cast("long").alias("cur"), acc["out"].alias("out"))
        return F.when(flush, moved.cast(_STATE)).otherwise(stayed.cast(_STATE))

    start = F.expr("named_struct('i', 0, 's', 0, 'cur', 0L, 'out', cast(array() as array<struct<s:int,e:int>>))").cast(_STATE)
    end = lambda acc: F.when(acc["i"] > acc["s"], F.concat(acc["out"], F.array(F.struct(acc["s"].alias("s"), acc["i"].alias("e"))))).otherwise(acc["out"])
    return F.aggregate(lengths, start, step, end)


def chunks_of(text: Column, size: int = SIZE, overlap: int = OVERLAP, longer_than: int = LONGER_THAN) -> Column:
    """Array of chunk texts of a raw text (an expression to use on small inputs; chunk_documents keeps the arrays apart)."""
    sentences = split_sentences(clean_korean_text(text))
    cut = pack(F.transform(sentences, lambda s: F.length(s)), size, overlap)
    return F.filter(F.transform(cut, lambda c: F.array_join(F.slice(sentences, c["s"] + 1, c["e"] - c["s"]), " ")), lambda t: F.length(t) > longer_than)


def chunk_documents(docs: DataFrame, text: str = "text", size: int = SIZE, overlap: int = OVERLAP, longer_than: int = LONGER_THAN) -> DataFrame:
    """The other columns of docs, with chunk_pos (from 0), chunk and n_chars of each chunk kept."""
    others = [c for c in docs.columns if c not in (text, "chunk_pos", "chunk", "n_chars")]
    df = docs.select(*others, split_sentences(clean_korean_text(F.col(text))).alias("_ss"))
    df = df.withColumn("_len", F.transform("_ss", lambda s: F.length(s)))
    df = df.withColumn("_cut", pack(F.col("_len"), size, overlap))
    texts = F.filter(F.transform("_cut", lambda c: F.array_join(F.slice("_ss", c["s"] + 1, c["e"] - c["s"]), " ")), lambda t: F.length(t) > longer_than)
    return df.select(*others, F.posexplode(texts).alias("chunk_pos", "chunk")).withColumn("n_chars", F.length("chunk"))
