"""Corpus pipeline: five stages over documents, each a written table that the next one reads.

A document passes language ID unless its language is uncertain; of each group of near-duplicates one
stays; reported secrets are masked; sources are mixed to their target weights, a document taken twice
being there twice and one taken in part holding the words taken; what is left is packed, a row for each
piece with its text, so that bins can be rebuilt from the result alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import langid, mixing, near_copies, packing, secrets
from tessera.llm.common import load, placed, release, written_at

#: No SQL: compression, 64-bit hashing and packing have no counterpart there.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is certain enough; the classifier learns from the labelled ones, held-out rows aside."""
    return langid.keep_certain(docs, langid.learn(docs.where(~langid.held_out(F.col("doc_id")))))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.keep_first(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.assemble(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_texts(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("secret_scan", mask_secrets),
    ("source_mix", mix_sources),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = load(spark, sf_dir, "documents"), placed(spark)
    for name, stage in STAGES[:-1]:
        path, docs = written_at(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(spark, keep={*before, path})  # what the stage needed, and the table before it
    return STAGES[-1][1](spark, docs, sf_dir)
