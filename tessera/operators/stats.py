"""Sections, counts, numbers and statistics over documents and folders."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import S, section_id, strip, word_count
from ..session import plain_scan, written

BATCH = 50
#: Rows of a range that is ranked in one task, about, and the most ranges.
RANGE_ROWS, MAX_RANGES = 100_000, 4096


def line_sections(docs: DataFrame, key: str = "doc_id", text: str = "text", separator: str = "\n") -> DataFrame:
    """A section for each non-blank part between separators, numbered by its place (gaps stay)."""
    parts = docs.select(F.col(key), F.posexplode(F.split(F.col(text), separator, -1)).alias("p", "text")).where(F.col("text").rlike(f"[^{S[1:-1]}]"))
    order = (F.col("p") + 1).alias("section_order")
    return parts.select(key, order, section_id(F.col(key).cast("string"), F.col("p") + 1).alias("section_id"), "text", word_count(F.col("text")).alias("word_count"), F.length("text").alias("char_count"))


def reassemble(sections: DataFrame, key: str, order: str = "section_order", text: str = "text", separator: str = "\n\n") -> DataFrame:
    """(key, text): sections joined in order."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return sections.groupBy(key).agg(F.array_join(F.transform(rows, lambda x: x["t"]), separator).alias("text"))


def batch_numbers(rows: DataFrame, order: str, size: int = BATCH) -> DataFrame:
    """rows with row_no (from 0 by order), batch_no and n_batches; ranks are taken per range of `order` and shifted, so no task sees all rows."""
    rows = once(rows)
    return with_row_number(rows, order).withColumn("batch_no", F.floor(F.col("row_no") / size) + 1).withColumn("n_batches", F.lit(-(-rows.count() // size)).cast("long"))


def once(rows: DataFrame) -> DataFrame:
    """rows, as a written table unless they only read one."""
    return rows if plain_scan(rows) else written(rows, "rows")


def with_row_number(rows: DataFrame, order: str, name: str = "row_no", range_rows: int = RANGE_ROWS, then: Sequence[str] = ()) -> DataFrame:
    """rows numbered from 0 in the order of a numeric column, then of others, that are unique together: ranges by
    quantiles of the first, counts per range, ranks within.

    The input is evaluated once. There are MAX_RANGES ranges at most, so plan and counts stay small; larger ranges are
    sorted with spilling."""
    rows = once(rows)
    n = rows.count()
    cuts = _cuts(rows, order, n, range_rows)
    placed = rows.withColumn("_b", _cuts_below(F.col(order), cuts))
    counts = dict(placed.groupBy("_b").count().collect()) if cuts else {0: n}
    starts = [0, *accumulate(counts.get(b, 0) for b in range(len(cuts)))]
    rank = F.row_number().over(Window.partitionBy("_b").orderBy(order, *then)) - 1
    return placed.withColumn(name, (rank + F.element_at(F.lit(starts).cast("array<long>"), F.col("_b") + 1)).cast("long")).drop("_b")

def _cuts(rows: DataFrame, order: str, n: int, range_rows: int) -> list[float]:
    """Values of a numeric column that cut n rows into ranges of about range_rows, MAX_RANGES at most."""
    ranges = min(MAX_RANGES, max(1, n // range_rows))
    return sorted(set(rows.approxQuantile(order, [k / ranges for k in range(1, ranges)], 1 / (4 * ranges)))) if ranges > 1 else []


def _cuts_below(x: Column, cuts: list[float]) -> Column:
    """How many of the sorted cuts are under x (0 for null), by halving."""
    if not cuts:
        return F.lit(0)
    steps = F.lit([1 << k for k in reversed(range(len(cuts).bit_length()))])
    under = lambda at: (at <= len(cuts)) & (F.get(F.lit(cuts), at - 1) < x)
    return F.aggregate(steps, F.lit(0), lambda low, s: F.when(under(low + s), low + s).otherwise(low))


def renumber(sections: DataFrame, container: str, order: list[str], title: str, member: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Sections of a container's members in one row of numbers from 1; titles say the member.

    Where the first column of `order` is a number, a large container is numbered in ranges of it, each in a task of its own,
    and shifted by the rows of the container's ranges before; else a container is sorted in one task, with spilling."""
    sections = once(sections)
    numeric = isinstance(sections.schema[order[0]].dataType, T.NumericType)
    cuts = _cuts(sections, order[0], sections.count(), range_rows) if numeric else []
    placed = sections.withColumn("_b", _cuts_below(F.col(order[0]), cuts))
    rank = F.row_number().over(Window.partitionBy(container, "_b").orderBy(*order))
    numbered = placed.withColumn("section_order", rank)
    if cuts:
        before = F.sum("_n").over(Window.partitionBy("_c").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
        counts = placed.groupBy(F.col(container).alias("_c"), "_b").agg(F.count(F.lit(1)).alias("_n")).select("_c", F.col("_b").alias("_r"), F.coalesce(before, F.lit(0)).alias("_before"))
        numbered = numbered.join(counts, F.col(container).eqNullSafe(F.col("_c")) & (F.col("_b") == F.col("_r"))).withColumn("section_order", (F.col("section_order") + F.col("_before")).cast("int")).drop("_c", "_r", "_before")
    return numbered.drop("_b").withColumn(title, F.concat(F.lit("["), F.col(member), F.lit("] "), F.coalesce(F.col(title), F.lit(""))))


def run_stats(results: DataFrame, failed: Column) -> DataFrame:
    return results.agg(F.count_if(~failed).alias("extracted"), F.count_if(failed).alias("errors"), F.count(F.lit(1)).alias("total"))


def folder_stats(files: DataFrame, folder: str = "folder", size: str = "size") -> DataFrame:
    """Files and whole KiB of each folder."""
    return files.groupBy(folder).agg(F.count(F.lit(1)).alias("file_count"), F.expr(f"sum({size}) div 1024").alias("size_kb"))


def file_metadata(path: Column, root: str) -> Column:
    """(source, folder, path): file name, name of its folder, path below root (whole if not under it)."""
    parts = F.split(path, "/")
    below = root.rstrip("/") + "/"
    return F.struct(
        F.element_at(parts, -1).alias("source"), F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit("")).alias("folder"),
        F.when(F.startswith(path, F.lit(below)), F.substring(path, len(below) + 1, 2**31 - 1)).otherwise(path).alias("path"),
    )


__all__ = ["batch_numbers", "file_metadata", "folder_stats", "line_sections", "reassemble", "renumber", "run_stats", "strip", "with_row_number"]
