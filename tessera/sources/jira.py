"""Issue-tracker sources: JSON of issues to text and metadata, and a REST data source."""

from __future__ import annotations

import json
import operator
import re
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, IsNotNull, LessThan, LessThanOrEqual, Not

from ..functions.text import clean_jira_markup, strip
from ..session import ship, written
from .rest import RestPartition, RestReader, RestSource

#: Fields asked for, and query templates.
FIELDS = ["summary", "description", "comment", "status", "assignee", "reporter", "created", "updated"]
JQL_TEMPLATES = {
    "project": "project = {project_key} ORDER BY updated DESC",
    "project_recent": "project = {project_key} AND updated >= -{days}d ORDER BY updated DESC",
    "my_issues": "assignee = currentUser() ORDER BY updated DESC",
    "mentioned": "text ~ {search_term} ORDER BY updated DESC",
}
#: A status's category, its exact names, and the words added to the text.
RENDER = (
    ("Done", ["done", "완료", "closed", "resolved"], " - 완료된 작업, done task, completed"),
    ("In Progress", ["in progress", "진행중", "진행 중"], " - 진행중인 작업, in progress task, working"),
    ("To Do", ["to do", "open", "대기", "할일"], " - 대기중인 작업, pending task, todo"),
)
ISSUE = (
    "key string, fields struct<summary:string,status:struct<name:string,statusCategory:struct<name:string>>,"
    "assignee:struct<displayName:string,name:string>,project:struct<key:string>,description:string,comment:struct<comments:array<struct<body:string>>>>"
)
BLOCKS, LISTS = {"paragraph", "heading", "listItem", "tableCell"}, {"bulletList", "orderedList", "table"}


def adf_text(node) -> str:
    """Text of a document tree, depth first, without recursion: a stack of (node, texts of its children)."""
    leaf = {"text": lambda n: n.get("text", ""), "mention": lambda n: n.get("attrs", {}).get("text", ""), "emoji": lambda n: n.get("attrs", {}).get("shortName", "")}
    root: list[str] = []
    todo: list[tuple] = [("open", node, root)]
    while todo:
        what, n, into = todo.pop()
        if what == "close":
            n, own = n
            kind = n.get("type", "")
            text = " ".join(x for x in own if x) + ("\n" if kind in BLOCKS or kind in LISTS else "")
            into.append(text)
        elif isinstance(n, str):
            into.append(n)
        elif isinstance(n, dict):
            if n.get("type", "") in leaf:
                into.append(leaf[n["type"]](n) or "")
                continue
            own: list[str] = []
            todo.append(("close", (n, own), into))
            children = n.get("content", [])
            todo += [("open", c, own) for c in reversed(children if isinstance(children, list) else [])]
    return "".join(root).strip()


def _adf_json(text: str | None) -> str:
    try:
        tree = json.loads(text) if text else None
    except ValueError:
        return ""
    return adf_text(tree) if isinstance(tree, dict) else ""


def adf_to_text(c: Column) -> Column:
    """Text of document trees given as JSON; anything but an object gives an empty text. A tree of any depth needs Python."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(_adf_json)

    return run(c)


def tree_texts(rows: DataFrame, key: str, tree: str) -> DataFrame:
    """key and text of document trees given as JSON, for rows (key, unique; tree) whose tree is an object, as adf_to_text() gives them.

    Trees become VARIANTs and are opened level by level, each level a table with a row for each node and the node's path;
    then texts are put together from the deepest level up, the children of a node in the order of their places. Nodes
    of one tree, however large, are spread over all tasks, and no Python runs. As many jobs as the deepest tree has levels."""
    levels = []
    now = rows.select(F.col(key).alias("key"), F.expr("cast(array() as array<int>)").alias("path"), F.try_parse_json(tree).alias("v")).where("schema_of_variant(v) like 'OBJECT%'")
    while True:
        kind = F.coalesce(F.try_variant_get("v", "$.type", "string"), F.lit(""))
        leaf = F.when(F.col("shape") == "STRING", F.try_variant_get("v", "$", "string"))
        for name, path in (("text", "$.text"), ("mention", "$.attrs.text"), ("emoji", "$.attrs.shortName")):
            leaf = leaf.when(F.col("kind") == name, F.coalesce(F.try_variant_get("v", path, "string"), F.lit("")))
        opened = now.withColumn("shape", F.schema_of_variant("v")).where("shape = 'STRING' or shape like 'OBJECT%'").withColumn("kind", kind).withColumn("leaf", leaf)
        content = F.when(F.col("leaf").isNull(), F.try_variant_get("v", "$.content", "array<variant>"))
        level = written(opened.select("key", "path", "kind", "leaf", content.alias("content")), "tree-level")
        levels.append(level)
        now = level.select("key", "path", F.posexplode("content").alias("at", "v")).select("key", F.concat("path", F.array("at")).alias("path"), "v")
        if level.where(F.size("content") > 0).isEmpty():
            break
    texts = None
    for level in reversed(levels):
        own = level.select("key", "path", "leaf", F.when(F.col("kind").isin(*BLOCKS, *LISTS), "\n").otherwise("").alias("end"))
        if texts is not None:
            children = texts.where("text <> ''").groupBy("key", F.slice("path", F.lit(1), F.size("path") - 1).alias("path")).agg(F.array_sort(F.collect_list(F.struct(F.element_at("path", -1).alias("at"), "text"))).alias("c"))
            # Columns of nodes are estimated far too small beside `content`, so without the hint whole levels would be broadcast.
            own = own.join(children.hint("merge"), ["key", "path"], "left")
            joined = F.coalesce(F.array_join(F.transform("c", lambda x: x["text"]), " "), F.lit(""))
        else:
            joined = F.lit("")
        texts = own.select("key", "path", F.coalesce("leaf", F.concat(joined, "end")).alias("text"))
    return texts.select(F.col("key").alias(key), strip(F.col("text")).alias("text"))


def _is_tree(c: Column) -> Column:
    return F.startswith(F.ltrim(c), F.lit('{"')) & F.get_json_object(c, "$.type").isNotNull()


def _bodies(c: Column) -> Column:
    """Texts of an array of bodies: wiki markup is cleaned in place; only document trees go through Python."""

    @F.pandas_udf("array<string>")
    def trees(s: pd.Series) -> pd.Series:
        return s.map(lambda bodies: [_adf_json(b) for b in bodies])

    found = trees(F.transform(c, lambda b: F.when(_is_tree(b), b)))
    return F.zip_with(c, found, lambda b, t: F.when(_is_tree(b), t).otherwise(clean_jira_markup(b)))


def parse_issues(raw: DataFrame, column: str = "value") -> DataFrame:
    """key and fields of issues given as JSON, one a row."""
    return raw.select(F.from_json(column, f"struct<{ISSUE.replace('key string', 'key:string').replace('fields struct', 'fields:struct')}>").alias("i")).select("i.*")


def issue_texts(issues: DataFrame) -> DataFrame:
    """issues (key, fields) with `text`: summary with status, status words, assignee, description, comments."""
    ship(issues.sparkSession)
    f, name, category = F.col("fields"), F.coalesce("fields.status.name", F.lit("")), F.coalesce("fields.status.statusCategory.name", F.lit(""))
    words = F.lit("")
    for cat, names, extra in reversed(RENDER):
        words = F.when((category == cat) | F.lower(name).isin(names), extra).otherwise(words)
    summary = F.concat(F.lit("["), F.coalesce("key", F.lit("Unknown")), F.lit("]"), F.when(name != "", F.concat(F.lit(" (상태: "), name, F.lit(")"))).otherwise(""), F.lit(" "), f["summary"])
    status = F.concat(F.lit("이슈 상태: "), name, F.when(category != "", F.concat(F.lit(" ("), category, F.lit(")"))).otherwise(""), words)
    assignee = F.coalesce(f["assignee"]["displayName"], f["assignee"]["name"])
    comments = F.coalesce(F.transform(f["comment"]["comments"], lambda c: c["body"]), F.expr("cast(array() as array<string>)"))
    rows = issues.withColumn("text", _bodies(F.concat(F.array(f["description"]), comments)))  # the description, then the comments
    parts = F.array(F.when(f["summary"] != "", summary), F.when(name != "", status), F.when(assignee != "", F.concat(F.lit("담당자: "), assignee)))
    return rows.withColumn("text", F.array_join(F.concat(F.filter(parts, lambda p: p.isNotNull()), F.filter("text", lambda t: t != "")), "\n\n"))


def issue_metadata(issues: DataFrame) -> DataFrame:
    known = lambda c: F.coalesce(c, F.lit("Unknown"))
    return issues.withColumns({
        "source": known(F.col("key")), "type": F.lit("jira_issue"), "summary": F.left(F.coalesce("fields.summary", F.lit("")), F.lit(100)),
        "status": known(F.col("fields.status.name")), "status_category": F.coalesce("fields.status.statusCategory.name", F.lit("")), "project": known(F.col("fields.project.key")),
    })


def issue_corpus(issues: DataFrame, chunk_fn) -> DataFrame:
    """Chunks of the non-empty issue texts with their metadata; chunk_fn maps a frame with `text` to one with chunks."""
    return chunk_fn(issue_metadata(issue_texts(issues)).where(F.col("text") != "").drop("key", "fields"))


#: Columns of kind=issues, and what the tracker's language calls those that it can select by.
ISSUE_COLUMNS = "key string, project string, status string, assignee string, summary string, updated timestamp, value string, error string"
SELECTABLE = {"key": "key", "project": "project", "status": "status", "updated": "updated"}
#: The tracker reads times in a zone of its own, so bounds in its language are a day wider.
SLACK = timedelta(days=1)
_COMPARE = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}


def jql_text(v: str) -> str:
    return '"' + v.replace("\\", "\\\\").replace('"', '\\"') + '"'


def jql_of(f: Filter) -> str | None:
    """A condition in the tracker's language that holds for all issues that f holds for (empty if all do); None if there is none."""
    if isinstance(f, Not) or len(getattr(f, "attribute", ())) != 1 or (name := SELECTABLE.get(f.attribute[0])) is None:
        return None
    if isinstance(f, IsNotNull):
        return f"{name} is not EMPTY" if name != "key" else ""
    if isinstance(f, In) and name != "updated" and all(isinstance(v, str) for v in f.value):
        return f"{name} in ({', '.join(map(jql_text, f.value))})"
    if name == "updated" and type(f) in _COMPARE and isinstance(f.value, datetime):
        low, high = ((f.value + d).strftime("%Y/%m/%d %H:%M") for d in (-SLACK, SLACK))
        parts = [f'updated >= "{low}"'] * isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)) + [f'updated <= "{high}"'] * isinstance(f, (EqualTo, LessThan, LessThanOrEqual))
        return " AND ".join(parts)
    return f"{name} = {jql_text(f.value)}" if isinstance(f, EqualTo) and isinstance(f.value, str) else None


def holds(f: Filter, row: dict) -> bool:
    """Whether a pushed filter holds for a row, exactly: the tracker's own comparison is wider (letters' case, minutes)."""
    v = row[f.attribute[0]]
    if isinstance(f, IsNotNull):
        return v is not None
    if v is None:
        return False
    if isinstance(f, In):
        return v in f.value
    return _COMPARE[type(f)](*(x.timestamp() if isinstance(x, datetime) else x for x in (v, f.value)))


class IssueReader(RestReader):
    """Issues as columns; conditions on SELECTABLE columns are put into the query, and what the tracker gives is compared again."""

    def __init__(self, base: str, options: dict, headers: dict):
        super().__init__([], headers, options.get("opener"))
        self.base, self.options, self.pushed = base, options, []

    def pushFilters(self, filters):  # noqa: N802 - Spark's name
        for f in filters:
            if jql_of(f) is None:
                yield f
            else:
                self.pushed.append(f)

    def jql(self) -> str:
        given = re.split(r"(?i)\border by\b", self.options.get("jql", ""), maxsplit=1)
        parts = [f"({given[0].strip()})"] * bool(given[0].strip()) + list(dict.fromkeys(filter(None, map(jql_of, self.pushed))))
        return (" AND ".join(parts) + (" ORDER BY " + given[1].strip() if len(given) > 1 else "")).strip()

    def partitions(self) -> list[RestPartition]:
        fields = ",".join(dict.fromkeys([*FIELDS, "project"]))
        return [RestPartition({"url": f"{self.base}/rest/api/3/search/jql", "params": {"jql": self.jql(), "maxResults": self.options.get("max_results", "50"), "fields": fields}, "list": "issues", "cursor": True, "token": True})]

    def read(self, partition: RestPartition):
        for _, _, value, error in super().read(partition):
            if error:
                yield (None,) * 7 + (error,)
                continue
            issue = json.loads(value)
            f = issue.get("fields") or {}
            who = f.get("assignee") or {}
            at = datetime.fromisoformat(f["updated"]) if f.get("updated") else None
            row = {"key": issue.get("key"), "project": (f.get("project") or {}).get("key"), "status": (f.get("status") or {}).get("name"), "assignee": who.get("displayName") or who.get("name"), "summary": f.get("summary"), "updated": at}
            if all(holds(x, row) for x in self.pushed):
                yield (*row.values(), value, None)


class JiraSource(RestSource):
    """format("jira"); options url, email, token, and jql + max_results (one page), or kind=projects, or key=<issue>. Column value: JSON.

    kind=issues: all pages of the issues that jql (if given) selects, with the columns ISSUE_COLUMNS. Where Spark is set
    to push filters to Python sources (spark.sql.python.filterPushdown.enabled), the tracker selects by them."""

    def schema(self) -> str:
        return ISSUE_COLUMNS if self.options.get("kind") == "issues" else super().schema()

    def reader(self, schema) -> RestReader:
        base = self.options.get("url", "").strip().rstrip("/")
        return IssueReader(base, dict(self.options), self.headers()) if self.options.get("kind") == "issues" else super().reader(schema)

    @classmethod
    def name(cls) -> str:
        return "jira"

    def requests(self, schema) -> list[dict]:
        o, base = self.options, self.options.get("url", "").strip().rstrip("/")
        if o.get("kind") == "projects":
            return [{"url": f"{base}/rest/api/3/project", "list": None}]
        if o.get("key"):
            return [{"url": f"{base}/rest/api/3/issue/{o['key']}", "list": ""}]
        return [{"url": f"{base}/rest/api/3/search/jql", "params": {"jql": o.get("jql", ""), "maxResults": o.get("max_results", "50"), "fields": o.get("fields", ",".join(FIELDS))}, "list": "issues"}]

    def headers(self) -> dict:
        import base64

        token = base64.b64encode(f"{self.options.get('email', '').strip()}:{self.options.get('token', '').strip()}".encode()).decode()
        return {"Authorization": f"Basic {token}", "Accept": "application/json", "Content-Type": "application/json"}
