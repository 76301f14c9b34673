"""Markup, tracker and wiki JSON, and vaults made from the documents table, row by row, for the queries that read such forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Block types of a wiki page, one line after the other.
KINDS = [
    "paragraph", "heading_1", "bulleted_list_item", "code", "to_do", "divider", "child_page", "child_database", "bookmark", "embed", "link_preview", "pdf", "image", "quote", "callout", "toggle",
    "heading_2", "heading_3", "numbered_list_item", "video", "file", "unknown_kind",
]


def words(c: Column) -> Column:
    """Letters and digits alone, single spaces between."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\p{L}\p{N}]++", " "))


def lines(c: Column) -> Column:
    """The words of each line."""
    return F.transform(F.split(F.coalesce(c, F.lit("")), "\n", -1), words)


def korean(c: Column) -> Column:
    """A text in other letters, with full-width stops and page footers between its lines."""
    return F.concat(F.translate(F.regexp_replace(c, "\n", "　- 12 -\t"), "aeinorst.,", "가에이나오라사타．，"), F.lit("。 \n"))


def wiki_markup(key: Column, text: Column) -> Column:
    """Each line of words under some markup, blank lines between."""

    def marked(w: Column, i: Column) -> Column:
        of = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
        k = i % 6
        link = F.when(key % 2 == 0, of("[", w, "|http://x/y]")).otherwise(of("[~", w, "]"))
        shown = F.when(k == 0, of("h2. ", w)).when(k == 1, of("*", w, "*")).when(k == 2, of("{code:java}", w, "{code}")).when(k == 3, link).when(k == 4, of("{color:red}", w, "{color} !img-1.png!"))
        return F.when(w != "", shown.otherwise(of("_", w, "_   ", w)))

    return F.array_join(F.transform(lines(text), marked), "\n\n\n\n")


def document_trees(docs: DataFrame) -> DataFrame:
    """doc_id and tree: a JSON tree of paragraphs, mentions and lists of the document's lines."""
    node = lambda kind, *inside: F.concat(F.lit(f'{{"type":"{kind}","content":['), *[x for i, c in enumerate(inside) for x in ([F.lit(","), c] if i else [c])], F.lit("]}"))
    quoted = F.expr("substring(to_json(named_struct('t', line)), 6, length(to_json(named_struct('t', line))) - 6)")  # the line as a JSON string
    word = F.concat(F.lit('{"type":"text","text":'), quoted, F.lit("}"))
    mention = F.concat(F.lit('{"type":"mention","attrs":{"text":"@'), (F.col("at") + 1).cast("string"), F.lit('"}}'))
    shown = F.when(F.col("at") % 3 == 2, node("bulletList", node("listItem", node("paragraph", word)))).when(F.col("at") % 3 == 0, node("paragraph", word)).otherwise(node("paragraph", word, mention))
    parts = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("at", "line")).select("doc_id", "at", shown.alias("node"))
    nodes = parts.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "node"))), lambda x: x["node"]).alias("nodes"))
    return nodes.select("doc_id", F.concat(F.lit('{"type":"doc","content":['), F.array_join("nodes", ","), F.lit("]}")).alias("tree"))


def issues(docs: DataFrame) -> DataFrame:
    """value: an issue for each document, as the tracker's JSON; some without status, assignee, project or description."""
    k = F.col("doc_id") % 5
    status = F.when(k == 0, F.struct(F.lit("완료").alias("name"), F.struct(F.lit("Done").alias("name")).alias("statusCategory"))).when(k == 2, F.struct(F.lit("할일").alias("name"), F.struct(F.lit("To Do").alias("name")).alias("statusCategory")))
    status = F.when(k.isin(0, 2), status).when(k.isin(1, 3), F.struct(F.when(k == 1, "진행 중").otherwise("Closed").alias("name"), F.lit(None).cast("struct<name:string>").alias("statusCategory")))
    w = words(F.col("text"))
    leaf = F.array(F.struct(F.lit("text").alias("type"), w.alias("text")))
    tree = F.struct(F.lit("doc").alias("type"), F.array(F.struct(F.lit("paragraph").alias("type"), leaf.alias("content"))).alias("content"))
    bodies = F.array(F.struct(F.concat(F.lit("h1. *"), F.coalesce("lang", F.lit("none")), F.lit("* [site|http://x]")).alias("body")), F.struct(F.lit("").alias("body")))
    common = [
        words(F.left(F.col("text"), F.lit(150))).alias("summary"), status.alias("status"), F.when(F.col("doc_id") % 2 == 0, F.struct(F.col("lang").alias("displayName"))).alias("assignee"),
        F.when(F.col("doc_id") % 3 != 0, F.struct(F.lit("AB").alias("key"))).alias("project"), F.struct(bodies.alias("comments")).alias("comment"),
    ]
    as_json = lambda description: F.to_json(F.struct(F.concat(F.lit("AB-"), F.col("doc_id").cast("string")).alias("key"), F.struct(*common, description.alias("description")).alias("fields")))
    return docs.select(F.when(F.col("doc_id") % 3 == 0, as_json(tree)).otherwise(as_json(F.when(F.col("doc_id") % 3 == 1, w))).alias("value"))


def pages(docs: DataFrame) -> DataFrame:
    """value: a wiki page, or for every tenth document a database, as JSON."""
    titled = lambda c: F.struct(F.lit("title").alias("type"), F.array(F.struct(c.alias("plain_text"))).alias("title"))
    k, common = F.col("doc_id") % 3, [F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("id"), F.when(F.col("doc_id") % 10 == 9, "database").otherwise("page").alias("object"), F.lit("2024-01-01T00:00:00Z").alias("last_edited_time")]
    url = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("https://n/"), F.col("doc_id").cast("string"))).alias("url")
    as_json = lambda properties: F.to_json(F.struct(*common, url, properties.alias("properties")))
    other = F.struct(titled(F.col("lang")).alias("Etc"), F.struct(F.lit("text").alias("type")).alias("Name"))
    return docs.select(F.when(k == 0, as_json(F.struct(titled(F.col("source")).alias("Name")))).when(k == 1, as_json(other)).otherwise(as_json(F.struct(F.struct(F.lit("text").alias("type")).alias("Name")))).alias("value"))


def block_json(kind: Column, w: Column, i: Column, id: Column, has_children: Column) -> Column:
    """A block of a kind; what its payload lacks depends on its place i."""
    empty = F.lit(None).cast("string")
    payload = F.struct(
        F.array(F.struct(w.alias("plain_text")), F.struct(F.lit("!").alias("plain_text")), F.struct(empty.alias("plain_text"))).alias("rich_text"), F.when(i % 4 != 0, "python").alias("language"), (i % 2 == 0).alias("checked"),
        F.when(i % 2 == 0, w).alias("title"), F.when(i % 5 == 0, "").otherwise("http://x").alias("url"), F.when(i % 3 != 0, F.array(F.struct(w.alias("plain_text")))).alias("caption"),
    )
    return F.concat(F.lit('{"id":"'), id, F.lit('","has_children":'), has_children.cast("string"), F.lit(',"type":"'), kind, F.lit('","'), kind, F.lit('":'), F.to_json(payload), F.lit("}"))


def blocks(docs: DataFrame) -> DataFrame:
    """doc_id, parent_id, pos and block of the lines of each document; every paragraph has a quote below it, and that a paragraph of its own."""
    line = docs.select("doc_id", F.posexplode(lines(F.col("text"))).alias("pos", "w"))
    kind = F.element_at(F.lit(KINDS), (F.col("pos") % len(KINDS) + 1).cast("int"))
    d, p = F.col("doc_id").cast("string"), F.col("pos").cast("string")
    top, below, last = (F.concat(F.lit(x), d, F.lit("-"), p) for x in "bcd")
    at = lambda parent, pos, block: F.struct(parent.alias("parent_id"), pos.alias("pos"), block.alias("block"))
    of = lambda kind, id, more: block_json(kind, F.col("w"), F.col("pos"), id, more)
    own = at(F.concat(F.lit("p"), d), F.col("pos"), of(kind, top, kind == "paragraph"))
    children = F.array(own, at(top, F.lit(0), of(F.lit("quote"), below, F.lit(True))), at(below, F.lit(0), of(F.lit("paragraph"), last, F.lit(False))))
    return line.select("doc_id", F.explode(F.when(kind == "paragraph", children).otherwise(F.array(own))).alias("b")).select("doc_id", "b.*")


def vault(docs: DataFrame) -> DataFrame:
    """path and content of a note for each document; some hidden, some outside the vault, some not UTF-8."""
    folder = F.when(F.col("doc_id") % 11 == 0, "/vault/.trash/").when(F.col("doc_id") % 5 == 0, "/other/").otherwise(F.concat(F.lit("/vault/"), F.coalesce("source", F.lit("none")), F.lit("/")))
    content = F.col("text").cast("binary")
    return docs.select(F.concat(folder, F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.when(F.col("doc_id") % 13 == 0, F.concat(content, F.unhex(F.lit("FFFE")))).otherwise(content).alias("content"))
