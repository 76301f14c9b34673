"""Document files to rows: extraction by extension, sections, records, and the incremental extraction job."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import remove_nul, section_id, unix_path
from ..operators.stats import run_stats
from ..operators.store import mark_processed, unprocessed, upsert_partial
from ..session import scratch, ship, written
from . import parsers
from .vault import plain_path

SECTION = "struct<section_type:string,section_title:string,text:string,page_number:int,section_order:int,word_count:int,char_count:int,source_file:string>"
RESULT = f"text string, method string, page_count int, word_count int, char_count int, error string, encrypted boolean, encryption_type string, files_processed int, files_skipped int, sections array<{SECTION}>"
#: Files that are read by name at once.
MAX_PATHS = 10_000
_COLUMNS = [c.split()[0] for c in RESULT.split(", ")]


def read_files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """path and content of files; a file is one row, so archives of several GB do not fit this source."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return raw.select(plain_path(F.col("path")).alias("path"), "content")


def extract(files: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """path, the carried columns and a result for each row of files (path, content); the bytes never leave the task."""
    ship(files.sparkSession)
    names = ["path", *carry]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = pd.DataFrame([parsers.parse_file(p, c) for p, c in zip(batch["path"], batch["content"], strict=True)], columns=_COLUMNS)
            for c in ("page_count", "files_processed", "files_skipped"):
                found[c] = found[c].astype("Int32")
            yield pd.concat([batch[names].reset_index(drop=True), found], axis=1)

    kinds = ", ".join(f"`{c}` {files.schema[c].dataType.simpleString()}" for c in names)
    return files.select(*names, "content").mapInPandas(run, f"{kinds}, {RESULT}")


def section_rows(results: DataFrame, document_id: str = "document_id", bid_id: str = "bid_id") -> DataFrame:
    """Rows of the section table: NUL characters leave text and title, counts stay as they were taken before."""
    s = results.where(F.col("error").isNull()).select(document_id, bid_id, F.explode("sections").alias("s"))
    text = F.coalesce(remove_nul(F.col("s.text")), F.lit(""))
    return s.select(
        section_id(F.col(document_id), F.coalesce("s.section_order", F.lit(1))).alias("section_id"), bid_id, F.col(document_id).alias("document_id"), F.coalesce("s.section_type", F.lit("unknown")).alias("section_type"),
        F.coalesce(remove_nul(F.col("s.section_title")), F.lit("")).alias("section_title"), text.alias("text"), text.alias("cleaned_text"), F.lit("ko").alias("language"),
        F.col("s.page_number").alias("page_number"), F.coalesce("s.section_order", F.lit(1)).alias("section_order"), F.coalesce("s.word_count", F.lit(0)).alias("word_count"), F.coalesce("s.char_count", F.lit(0)).alias("char_count"),
    )


def contents(spark: SparkSession, root: str, wanted: DataFrame) -> DataFrame:
    """path and content of the files under root that stand in wanted (path), read by name, MAX_PATHS in a scan; others are listed, not read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    listed = raw.select("path", plain_path(F.col("path")).alias("_plain"))  # without content no file is opened
    paths = [re.sub(r"([\\{}\[\]*?])", r"\\\1", r["path"]) for r in listed.join(wanted.select(F.col("path").alias("_plain")).distinct(), "_plain", "left_semi").collect()]
    found = raw.limit(0)
    for i in range(0, len(paths), MAX_PATHS):
        part = spark.read.format("binaryFile").load(paths[i : i + MAX_PATHS])
        found = found.unionByName(part) if i else part
    return found.select(plain_path(F.col("path")).alias("path"), "content")


def extraction_job(documents: DataFrame, sections: DataFrame, root: str, limit: int | None = None) -> dict[str, DataFrame]:
    """One run over unprocessed documents: the next versions of both tables and the run's statistics.

    Documents meet their files by path, so a missing file is an error row, and files that no pending document
    names are not read; more than MAX_PATHS go in groups, one after the other. Failed documents stay unmarked. The extraction is written once, and all results read it.
    Of sections with one id the first by document, order and text stays."""
    spark = documents.sparkSession
    todo = unprocessed(documents, limit).withColumn("path", F.concat(F.lit(root.rstrip("/") + "/"), unix_path(F.col("file_path")))).select("document_id", "bid_id", "path")
    todo = written(todo, "extraction-todo")
    groups = max(1, -(-todo.count() // MAX_PATHS))
    place = scratch(spark, "extraction")
    for g in range(groups):  # so the driver knows some MAX_PATHS names at a time, and no file is read that no document names
        part = todo.where(F.pmod(F.xxhash64("path"), F.lit(groups)) == g)
        extract(part.join(contents(spark, root, part), "path", "left"), ("document_id", "bid_id")).write.mode("append").parquet(place)
    found = spark.read.parquet(place)
    done = found.where(F.col("error").isNull())
    rows = section_rows(found)
    first = Window.partitionBy("section_id").orderBy("document_id", "section_order", "text")
    rows = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return {
        "results": found,
        "sections": upsert_partial(sections, rows, "section_id", ("text", "word_count", "char_count")),
        "documents": mark_processed(documents, done),
        "stats": run_stats(found, F.col("error").isNotNull()),
    }


def hwp_records(streams: DataFrame) -> DataFrame:
    """path, offset, tag_id, level, size, data of every tagged record of inflated streams (path, content); join tag names with tag_name()."""
    ship(streams.sparkSession)

    def run(batches):
        for batch in batches:
            rows = [(p, *r) for p, c in zip(batch["path"], batch["content"], strict=True) for r in parsers.records(c or b"")]
            yield pd.DataFrame(rows, columns=["path", "offset", "tag_id", "level", "size", "data"])

    return streams.select("path", "content").mapInPandas(run, "path string, offset long, tag_id long, level int, size long, data binary")


def pdf_texts(files: DataFrame) -> DataFrame:
    """path, text and error of each row of files (path, content): the texts of the pages that have one, a line break between pages."""
    ship(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows.append((path, "\n".join(t for t in parsers.pdf_pages(content or b"")[0] if t), None))
                except Exception as e:  # noqa: BLE001 - a file that cannot be read is a row with its error
                    rows.append((path, "", str(e)))
            yield pd.DataFrame(rows, columns=["path", "text", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, text string, error string")


def preview(content: Column) -> Column:
    """A file's bytes as base64, for showing it in place."""
    return F.base64(content)
