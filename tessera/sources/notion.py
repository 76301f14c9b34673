"""Wiki sources: JSON of pages and blocks to text and metadata, and a REST data source."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSourceStreamReader

from .rest import RestPartition, RestSource, rows_of

API = "https://api.notion.com/v1"
VERSION = "2022-06-28"
#: Title properties in order of preference, and block types by how they are shown.
TITLES = ["title", "Title", "Name", "name", "이름", "제목"]
PLAIN, HEADINGS, ITEMS = ["paragraph", "quote", "callout", "toggle"], ["heading_1", "heading_2", "heading_3"], ["bulleted_list_item", "numbered_list_item"]
LINKS, MEDIA = ["bookmark", "embed", "link_preview"], ["image", "video", "file", "pdf"]
PAYLOAD = "struct<rich_text:array<struct<plain_text:string>>,language:string,checked:boolean,title:string,url:string,caption:array<struct<plain_text:string>>>"
PAGE = "struct<id:string,object:string,url:string,last_edited_time:string,properties:map<string,struct<type:string,title:array<struct<plain_text:string>>>>>"
LEAST = 50


def rich_text(c: Column) -> Column:
    return F.array_join(F.transform(F.coalesce(c, F.expr("cast(array() as array<struct<plain_text:string>>)")), lambda x: F.coalesce(x["plain_text"], F.lit(""))), "")


def block_text(block_json: Column) -> Column:
    """One block as a line of text; types that show nothing, and unknown ones, give an empty text."""
    kind = F.get_json_object(block_json, "$.type")
    payload = F.from_json(F.call_function("get_json_object", block_json, F.concat(F.lit("$."), kind)), PAYLOAD)
    text, caption = rich_text(payload["rich_text"]), rich_text(payload["caption"])
    named = lambda label: F.concat(F.lit(f"[{label}: "), F.coalesce(payload["title"], F.lit("Untitled")), F.lit("]"))
    label = F.initcap(kind)
    shown = (
        F.when(kind.isin(PLAIN), text).when(kind.isin(HEADINGS), F.concat(F.lit("\n"), text, F.lit("\n"))).when(kind.isin(ITEMS), F.concat(F.lit("- "), text))
        .when(kind == "code", F.concat(F.lit("[Code ("), F.coalesce(payload["language"], F.lit("")), F.lit(")]: "), text))
        .when(kind == "to_do", F.concat(F.when(F.coalesce(payload["checked"], F.lit(False)), "[x] ").otherwise("[ ] "), text))
        .when(kind == "child_page", named("Page")).when(kind == "child_database", named("Database"))
        .when(kind.isin(LINKS) & (F.coalesce(payload["url"], F.lit("")) != ""), F.concat(F.lit("[Link: "), payload["url"], F.lit("]")))
        .when(kind.isin(MEDIA), F.concat(F.lit("["), label, F.when(caption != "", F.concat(F.lit(": "), caption)).otherwise(""), F.lit("]")))
    )
    return F.coalesce(shown, F.lit(""))


def page_title(properties: Column) -> Column:
    """The first preferred property of type title, else any such, else Untitled; an empty title stays empty."""
    own = [F.when(F.try_element_at(properties, F.lit(t))["type"] == "title", rich_text(F.try_element_at(properties, F.lit(t))["title"])) for t in TITLES]
    other = F.filter(F.map_values(properties), lambda p: p["type"] == "title")
    return F.coalesce(*own, F.when(F.size(other) > 0, rich_text(other[0]["title"])), F.lit("Untitled"))


def parse_pages(raw: DataFrame, column: str = "value") -> DataFrame:
    return raw.select(F.from_json(column, PAGE).alias("p")).select("p.*")


def only_pages(found: DataFrame) -> DataFrame:
    """The pages among search results, which hold databases as well."""
    return found.where(F.col("object") == "page")


def page_texts(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """pages (id, ...) with title and text: title line, then blocks (parent_id, pos, block) in order.

    A block's children follow it, two spaces in; theirs are left out. Parents meet children by one
    shuffle on the block's id, and pages their lines by one on the page's."""
    b = blocks.select("parent_id", "pos", "block", F.get_json_object("block", "$.id").alias("block_id"), F.coalesce(F.get_json_object("block", "$.has_children") == "true", F.lit(False)).alias("has_children"))
    top = b.join(pages.select(F.col("id").alias("page_id")), F.col("parent_id") == F.col("page_id"), "left_semi")
    lines = top.select(F.col("parent_id").alias("id"), F.struct(F.col("pos").alias("p"), F.lit(-1).cast(b.schema["pos"].dataType).alias("c"), block_text(F.col("block")).alias("t")).alias("line"))
    parents = top.where("has_children").select("block_id", F.col("parent_id").alias("id"), F.col("pos").alias("p"))
    kids = b.select(F.col("parent_id").alias("block_id"), F.col("pos").alias("c"), block_text(F.col("block")).alias("t")).where("t <> ''")
    nested = parents.join(kids, "block_id").select("id", F.struct("p", "c", F.concat(F.lit("  "), "t").alias("t")).alias("line"))
    body = lines.where("line.t <> ''").unionByName(nested).groupBy("id").agg(F.transform(F.array_sort(F.collect_list("line")), lambda x: x["t"]).alias("lines"))
    out = pages.withColumn("title", page_title(F.col("properties"))).join(body, "id", "left")
    head = F.when(F.col("title") != "", F.array(F.concat(F.lit("# "), F.col("title")))).otherwise(F.expr("cast(array() as array<string>)"))
    return out.withColumn("text", F.array_join(F.concat(head, F.coalesce("lines", F.expr("cast(array() as array<string>)"))), "\n")).drop("lines")


def page_metadata(pages: DataFrame) -> DataFrame:
    return pages.withColumns({"source": F.col("title"), "type": F.lit("notion_page"), "page_id": F.coalesce("id", F.lit("Unknown")), "url": F.coalesce("url", F.lit("")), "last_edited": F.coalesce("last_edited_time", F.lit(""))})


def page_corpus(pages: DataFrame, blocks: DataFrame, chunk_fn) -> DataFrame:
    """Chunks of the texts of pages (not databases) of LEAST characters or more, with their metadata."""
    rows = page_metadata(page_texts(only_pages(pages), blocks)).where(F.length("text") >= LEAST)
    return chunk_fn(rows.select("text", "source", "type", "page_id", "url", "last_edited"))


class EditedReader(DataSourceStreamReader):
    """Blocks of the pages that were edited since the last run, a partition for each page; offsets are times of the last edit.

    Pages of the last offset's own time are read again with the next change, since times are whole minutes; so
    what is kept from the stream should go by page."""

    def __init__(self, base: str, headers: dict, opener: str | None, size: int):
        self.base, self.headers, self.opener, self.size = base, headers, opener, size

    def _pages(self, size: int, more: bool):
        """(time, id) of pages, the last edited first."""
        body = {"page_size": size, "filter": {"property": "object", "value": "page"}, "sort": {"timestamp": "last_edited_time", "direction": "descending"}}
        for _, _, value, error in rows_of({"url": f"{self.base}/search", "body": body, "list": "results", "cursor": more}, self.headers, self.opener):
            if error:
                raise OSError(error)
            page = json.loads(value)
            yield page["last_edited_time"], page["id"]

    def initialOffset(self) -> dict:  # noqa: N802 - Spark's names
        return {"edited": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"edited": next((t for t, _ in self._pages(1, False)), "")}

    def partitions(self, start: dict, end: dict) -> list[RestPartition]:
        found = []
        for t, page in self._pages(self.size, True):
            if t < start["edited"]:
                break  # all that follow are older
            if t <= end["edited"]:
                found.append(RestPartition({"url": f"{self.base}/blocks/{page}/children", "params": {"page_size": 100}, "list": "results", "cursor": True, "parent": page}))
        return found

    def read(self, partition: RestPartition):
        yield from rows_of(partition.request, self.headers, self.opener)

    def commit(self, end: dict) -> None:
        """Nothing is kept but the checkpoint."""


class NotionSource(RestSource):
    """format("notion"); option token, and query/filter_type/page_size (one page of results), or parent (block children of
    comma-separated ids, a partition each), database, or page. Column value: JSON. As a stream: see EditedReader."""

    @classmethod
    def name(cls) -> str:
        return "notion"

    def streamReader(self, schema) -> EditedReader:  # noqa: N802 - Spark's name
        return EditedReader(self.options.get("url", API), self.headers(), self.options.get("opener"), int(self.options.get("page_size", "100")))

    def requests(self, schema) -> list[dict]:
        o, base = self.options, self.options.get("url", API)
        if o.get("page"):
            return [{"url": f"{base}/pages/{o['page']}", "list": ""}]
        if o.get("parent"):
            return [{"url": f"{base}/blocks/{p}/children", "params": {"page_size": 100}, "list": "results", "cursor": True, "parent": p} for p in o["parent"].split(",")]
        size = int(o.get("page_size", "100"))
        if o.get("database"):
            return [{"url": f"{base}/databases/{o['database']}/query", "body": {"page_size": size}, "list": "results", "cursor": True}]
        body = {"page_size": size} | ({"query": o["query"]} if o.get("query") else {}) | ({"filter": {"property": "object", "value": o["filter_type"]}} if o.get("filter_type") else {})
        return [{"url": f"{base}/search", "body": body, "list": "results"}]

    def headers(self) -> dict:
        return {"Authorization": f"Bearer {self.options.get('token', '').strip()}", "Notion-Version": VERSION, "Content-Type": "application/json"}
