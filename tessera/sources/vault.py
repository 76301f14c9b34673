"""Markdown vaults: listing, texts and metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.binary import has_hidden_part
from ..functions.text import markdown_to_text
from ..operators.stats import file_metadata


def plain_path(path: Column) -> Column:
    """A path without scheme and authority."""
    return F.regexp_replace(path, r"\A[a-z][a-z0-9+.-]*:(?://[^/]*)?", "")


def markdown_files(spark: SparkSession, root: str, recursive: bool = False) -> DataFrame:
    """path, content and size of *.md files, those with a hidden part in their path left out."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", str(recursive).lower()).load(root)
    return raw.select(plain_path(F.col("path")).alias("path"), "content", F.col("length").alias("size")).where(~has_hidden_part(F.col("path")))


def vault_texts(files: DataFrame, root: str) -> DataFrame:
    """source, folder, path and text of each file; one that is not UTF-8 has an empty text."""
    text = F.coalesce(markdown_to_text(F.try_validate_utf8(F.col("content").cast("string"))), F.lit(""))
    return files.select(file_metadata(F.col("path"), root).alias("m"), text.alias("text")).select("m.*", "text")


def folders(files: DataFrame, root: str) -> DataFrame:
    """The root and every folder below it that is on the way to a file, not hidden; in order."""
    base = root.rstrip("/")
    below = F.split(F.substring("path", len(base) + 2, 2**31 - 1), "/")
    ways = F.transform(F.sequence(F.lit(1), F.greatest(F.size(below) - 1, F.lit(1))), lambda n: F.when(n < F.size(below), F.concat(F.lit(base + "/"), F.array_join(F.slice(below, 1, n), "/"))))
    found = files.select(F.explode(F.concat(F.array(F.lit(base)), ways)).alias("folder")).where(F.col("folder").isNotNull()).distinct()
    return found.where(~has_hidden_part(F.substring("folder", len(base) + 1, 2**31 - 1))).orderBy("folder")


def vault_folders(spark: SparkSession, root: str) -> list[str]:
    """The root and all folders below it, empty ones too, in order; none but the root if any part of the whole path is hidden.

    Folders are listed by the driver, level by level: meant for one person's notes."""
    jvm, base = spark.sparkContext._jvm, root.rstrip("/")
    top = jvm.org.apache.hadoop.fs.Path(base)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(top):
        return []
    found, todo = [base], [top]
    while todo and not any(part.startswith(".") for part in base.split("/")):
        for x in fs.listStatus(todo.pop()):
            if x.isDirectory() and not x.getPath().getName().startswith("."):
                todo.append(x.getPath())
                found.append(base + x.getPath().toUri().getPath()[len(top.toUri().getPath()) :])
    return sorted(found, key=lambda f: f.split("/"))


def file_preview(files: DataFrame, limit: int = 10) -> list[str]:
    """Names of the first files by path, and a line that counts the rest."""
    names = [r["path"].rpartition("/")[2] for r in files.select("path").orderBy("path").limit(limit).collect()]
    more = files.count() - len(names)
    return names + ([f"... 외 {more}개"] if more else [])


def vault_corpus(files: DataFrame, root: str, chunk_fn) -> DataFrame:
    return chunk_fn(vault_texts(files, root).where(F.col("text") != ""))


def vault_stats(files: DataFrame, root: str, folders_below: int | None = None) -> DataFrame:
    """One row: files, whole KiB, and the folders right below root that are not hidden.

    These are the ones that hold files, unless their number is given (see subfolder_count)."""
    base = root.rstrip("/")
    below = F.split(F.substring("path", len(base) + 2, 2**31 - 1), "/")
    first = F.when((F.size(below) > 1) & ~F.startswith(below[0], F.lit(".")), below[0])
    return files.agg(F.count(F.lit(1)).alias("file_count"), F.expr("coalesce(sum(size), 0) div 1024").alias("total_size_kb"), (F.countDistinct(first) if folders_below is None else F.lit(folders_below).cast("long")).alias("subfolders"))


def subfolder_count(spark: SparkSession, root: str) -> int:
    """The folders right below root that are not hidden, empty ones too."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    return sum(x.isDirectory() and not x.getPath().getName().startswith(".") for x in top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(top))
