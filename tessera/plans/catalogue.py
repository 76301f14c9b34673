"""Every query by name, with its DuckDB counterpart where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import binary, text
from ..operators import chunk, rag, stats, store, vector
from ..operators.index import VectorIndex
from ..operators.lake import Lake
from ..session import scratch, ship
from ..sources import jira, notion, vault
from ..streaming.latest import keep_latest
from . import fixtures as fx
from . import inputs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: White space for DuckDB's regular expressions.
SP = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def query(oracle: str | None = None):
    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rep(c: str, *steps: tuple[str, str]) -> str:
    for pattern, by in steps:
        c = f"regexp_replace({c}, {q(pattern)}, {q(by)}, 'g')"
    return c


def strip_sql(c: str) -> str:
    return rep(c, (rf"^{SP}+", ""), (rf"{SP}+$", ""))


def clean_sql(c: str) -> str:
    return strip_sql(f"translate({rep(c, (SP + '+', ' '), (r'^[0-9]+ ?$', ''), (r'- [0-9]+ -', ''))}, '．，', '.,')")


def sentences_sql(c: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all({c}, '[^.!?。]*[.!?。] *|[^.!?。]+$'), lambda s: trim(s)), lambda s: s <> '')"


def values(rows: list[tuple], names: str) -> str:
    show = lambda v: "null" if v is None else q(v) if isinstance(v, str) else f"{v}::bigint" if isinstance(v, int) and abs(v) >= 2**31 else str(v)
    return f"(values {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) as v({names})"


# Cleaning and splitting


@query(f"select doc_id, {clean_sql('text')} as cleaned from documents")
def clean_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.clean_korean_text(F.col("text")).alias("cleaned"))


_korean = "(translate(replace(text, chr(10), chr(12288) || '- 12 -' || chr(9)), 'aeinorst.,', '가에이나오라사타．，') || '。 ' || chr(10))"


@query(f"select id, {clean_sql('t')} as cleaned, array_to_string({sentences_sql(clean_sql('t'))}, '|') as sentences from (select id, t from {values(fx.KOREAN, 'id, t')} union all select doc_id + 1000, {_korean} from documents)")
def clean_korean_fixture(spark, sf_dir):
    """The documents in Korean letters, with full-width stops and page footers, and a few odd texts."""
    rows = spark.createDataFrame(fx.KOREAN, "id long, t string").unionByName(table(spark, sf_dir, "documents").select((F.col("doc_id") + 1000).alias("id"), inputs.korean(F.col("text")).alias("t")))
    cleaned = text.clean_korean_text(F.col("t"))
    # In two steps, so that a text is cleaned once.
    return rows.select("id", cleaned.alias("cleaned")).select("id", "cleaned", F.array_join(text.split_sentences(F.col("cleaned")), "|").alias("sentences"))


@query(f"with s as (select doc_id, {sentences_sql(clean_sql('text'))} as ss from documents) select doc_id, unnest(range(len(ss)))::int as pos, unnest(ss) as sentence from s")
def sentence_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.split_sentences(text.clean_korean_text(F.col("text")))).alias("pos", "sentence"))


CHUNKS = f"""with recursive s as (select doc_id, lang, source, {sentences_sql(clean_sql('text'))} as ss from documents),
n as (select doc_id, lang, source, ss, len(ss) as n, list_transform(range(len(ss) + 1), lambda i: coalesce(list_sum(list_transform(ss[1:i], lambda x: length(x))), 0)::bigint) as p from s where len(ss) > 0),
cut as (
  select doc_id, ss, n, p, 0::bigint as k, 0::bigint as b, coalesce(list_min(list_filter(range(1, n), lambda i: p[i + 2] > 500)), n)::bigint as e from n
  union all
  select doc_id, ss, n, p, k + 1, b2, coalesce(list_min(list_filter(range(e + 1, n), lambda i: case when b2 < e then p[e + 1] - p[b2 + 1] + e - b2 - 1 else 0 end + p[i + 2] - p[e + 1] > 500)), n)::bigint
  from (select *, coalesce(list_min(list_filter(range(b, e), lambda j: p[e + 1] - p[j + 1] + e - j - 1 <= 100)), e)::bigint as b2 from cut where e < n)
),
t as (select doc_id, k, array_to_string(ss[b + 1:e], ' ') as chunk from cut),
chunks as (select doc_id, (row_number() over (partition by doc_id order by k) - 1)::int as chunk_pos, chunk, length(chunk)::int as n_chars from t where length(chunk) > 50)
"""


@query(CHUNKS + "select * from chunks")
def chunk_documents(spark, sf_dir):
    return chunk.chunk_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query(CHUNKS + "select lang, count(*) as n_chunks, sum(chunks.n_chars)::bigint as total_chars, max(chunks.n_chars) as longest, count(distinct doc_id) as n_docs from chunks join documents using (doc_id) group by lang")
def chunk_stats_by_lang(spark, sf_dir):
    c = chunk.chunk_documents(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    return c.groupBy("lang").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("n_chars").alias("total_chars"), F.max("n_chars").alias("longest"), F.countDistinct("doc_id").alias("n_docs"))


@query(CHUNKS + "select 'chunk_' || (row_number() over (order by doc_id, chunk_pos) - 1) as chunk_id, doc_id, chunk_pos from chunks")
def chunk_ids(spark, sf_dir):
    c = chunk.chunk_documents(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "chunk_pos")
    return stats.with_row_number(c, "doc_id", then=("chunk_pos",)).select(F.concat(F.lit("chunk_"), F.col("row_no").cast("string")).alias("chunk_id"), "doc_id", "chunk_pos")


@query(f"select doc_id, len(list_filter(regexp_split_to_array(text, '{SP}+'), lambda w: w <> ''))::int as word_count, length(text)::int as char_count from documents")
def word_char_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.word_count(F.col("text")).alias("word_count"), text.char_count(F.col("text")).alias("char_count"))


SECTIONS = f"""with p as (select doc_id, unnest(string_split(text, chr(10))) as text, generate_subscripts(string_split(text, chr(10)), 1)::int as section_order from documents),
s as (select doc_id, section_order, left(doc_id::varchar, 80) || '_sec_' || section_order as section_id, text, len(list_filter(regexp_split_to_array(text, '{SP}+'), lambda w: w <> ''))::int as word_count, length(text)::int as char_count from p where {strip_sql('text')} <> '')
"""


@query(SECTIONS + "select * from s")
def line_sections(spark, sf_dir):
    return stats.line_sections(table(spark, sf_dir, "documents"))


@query(SECTIONS + "select doc_id, string_agg(text, chr(10) || chr(10) order by section_order) as text from s group by doc_id")
def reassemble_sections(spark, sf_dir):
    return stats.reassemble(stats.line_sections(table(spark, sf_dir, "documents")), "doc_id")


@query(f"select id, {rep('t', ('[一-鿿]+', ''), (r'\p{C}', ''))} as cleaned from (select id, t from {values(fx.HAN, 'id, t')} union all select doc_id + 1000, text from documents)")
def strip_han_control(spark, sf_dir):
    rows = spark.createDataFrame(fx.HAN, "id long, t string").unionByName(table(spark, sf_dir, "documents").select((F.col("doc_id") + 1000).alias("id"), F.col("text").alias("t")))
    return rows.select("id", text.strip_han_control(F.col("t")).alias("cleaned"))


def markdown_sql(c: str) -> str:
    """The rules for markdown, written for DuckDB."""
    return strip_sql(rep(
        f"replace(replace({c}, chr(13) || chr(10), chr(10)), chr(13), chr(10))",
        (r"^---\n(?s:.*?)\n---\n", ""), (r"\[([^\]]+)\]\([^)]+\)", r"\1"), (r"\[\[([^\]|]+)(\|[^\]]+)?\]\]", r"\1"), (r"!\[[^\]]*\]\([^)]+\)", ""), (r"```(?s:.*?)```", ""), (r"`[^`]+`", ""),
        (rf"(?m)^##?#?#?#?#?{SP}+", ""), (r"\*\*?([^*]+)\*\*?", r"\1"), (r"__?([^_]+)__?", r"\1"), (rf"(?m)^>{SP}*", ""), (rf"(?m)^[-_*][-_*][-_*]+{SP}*$", ""), (rf"(?m)^{SP}*[-+*]{SP}+", ""), (rf"(?m)^{SP}*[0-9]+\.{SP}+", ""),
        ("#[A-Za-z가-힣][A-Za-z0-9가-힣_/-]*", ""),
    ))


@query(f"select id, {markdown_sql('t')} as text from (select id, t from {values(fx.MARKDOWN, 'id, t')} union all select doc_id + 1000, text from documents)")
def markdown_to_text(spark, sf_dir):
    rows = spark.createDataFrame(fx.MARKDOWN, "id long, t string").unionByName(table(spark, sf_dir, "documents").select((F.col("doc_id") + 1000).alias("id"), F.col("text").alias("t")))
    return rows.select("id", text.markdown_to_text(F.col("t")).alias("text"))


#: What the made inputs are made of, in SQL: words of a text, and the words of each line.
_words = lambda c: f"trim(regexp_replace(coalesce({c}, ''), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
_lines = f"list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {_words('x')})"


@query(f"""select doc_id, trim(coalesce(array_to_string(list_transform({_lines}, lambda w, i: case when w = '' or i % 6 = 3 then null when i % 6 = 4 and doc_id % 2 <> 0 then '~' || w when i % 6 = 5 then w || ' '
when i % 6 = 0 then w || ' ' || w else w end), chr(10) || chr(10)), '')) as text from documents""")
def jira_markup_clean(spark, sf_dir):
    """The documents' lines under wiki markup, and without it again."""
    return table(spark, sf_dir, "documents").select("doc_id", text.clean_jira_markup(inputs.wiki_markup(F.col("doc_id"), F.col("text"))).alias("text"))


TREE_TEXTS = f"""with l as (select doc_id, unnest(string_split(text, chr(10))) as t, generate_subscripts(string_split(text, chr(10)), 1) as i from documents)
select doc_id, {strip_sql("string_agg(case when i % 3 = 0 then t || repeat(chr(10), 3) when i % 3 = 1 then t || chr(10) else t || case when t <> '' then ' ' else '' end || '@' || i || chr(10) end, ' ' order by i)")} as text from l group by doc_id"""


@query(TREE_TEXTS)
def adf_to_text(spark, sf_dir):
    """As document_trees, each tree in one row's expression."""
    ship(spark)
    return inputs.document_trees(table(spark, sf_dir, "documents")).select("doc_id", jira.adf_to_text(F.col("tree")).alias("text"))


@query(TREE_TEXTS)
def document_trees(spark, sf_dir):
    """Every document as a tree of paragraphs, mentions and lists, and its text again."""
    return jira.tree_texts(inputs.document_trees(table(spark, sf_dir, "documents")), "doc_id", "tree")


@query(f"""with d as (select doc_id, {_words('left(text, 150)')} as s, {_words('text')} as w, lang, 'AB-' || doc_id as key, case doc_id % 5 when 0 then '완료' when 1 then '진행 중' when 2 then '할일' when 3 then 'Closed' end as st from documents)
select key as source, 'jira_issue' as type, left(s, 100) as summary, coalesce(st, 'Unknown') as status, case when doc_id % 3 = 0 then 'Unknown' else 'AB' end as project,
concat_ws(chr(10) || chr(10), case when s <> '' then '[' || key || ']' || coalesce(' (상태: ' || st || ')', '') || ' ' || s end,
  case doc_id % 5 when 0 then '이슈 상태: 완료 (Done) - 완료된 작업, done task, completed' when 1 then '이슈 상태: 진행 중 - 진행중인 작업, in progress task, working' when 2 then '이슈 상태: 할일 (To Do) - 대기중인 작업, pending task, todo'
    when 3 then '이슈 상태: Closed - 완료된 작업, done task, completed' end,
  case when doc_id % 2 = 0 and lang <> '' then '담당자: ' || lang end, case when doc_id % 3 <> 2 and w <> '' then w end, coalesce(lang, 'none') || ' site') as text from d""")
def issue_render(spark, sf_dir):
    """An issue of the tracker for each document, as text with metadata."""
    found = jira.parse_issues(inputs.issues(table(spark, sf_dir, "documents")))
    return jira.issue_metadata(jira.issue_texts(found)).select("source", "type", "summary", "status", "project", "text")


BLOCKS = f"""with l as (select doc_id, source, lang, unnest({_lines}) as w, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 as i from documents),
k as (select *, (i % 22)::int as k from l),
b as (select *, case when k in (0, 13, 14, 15) then w || '!' when k in (1, 16, 17) then chr(10) || w || '!' || chr(10) when k in (2, 18) then '- ' || w || '!' when k = 3 then '[Code (' || case when i % 4 = 0 then '' else 'python' end || ')]: ' || w || '!'
when k = 4 then case when i % 2 = 0 then '[x] ' else '[ ] ' end || w || '!' when k in (6, 7) then case k when 6 then '[Page: ' else '[Database: ' end || case when i % 2 = 0 then w else 'Untitled' end || ']'
when k in (8, 9, 10) and i % 5 <> 0 then '[Link: http://x]' when k in (11, 12, 19, 20) then '[' || case k when 11 then 'Pdf' when 12 then 'Image' when 19 then 'Video' else 'File' end || case when i % 3 <> 0 and w <> '' then ': ' || w else '' end || ']' else '' end as t from k)
"""


@query(BLOCKS + "select doc_id, i::int as pos, t as text from b")
def notion_blocks(spark, sf_dir):
    """A block of the wiki for each line of the documents, of every kind in turn."""
    rows = inputs.blocks(table(spark, sf_dir, "documents")).where(F.startswith("parent_id", F.lit("p")))
    return rows.select("doc_id", "pos", notion.block_text(F.col("block")).alias("text"))


@query(BLOCKS + """, p as (select doc_id, source, lang, string_agg(case when k = 0 then t || chr(10) || '  ' || w || '!' when t <> '' then t end, chr(10) order by i) as body from b group by all),
h as (select *, case doc_id % 3 when 0 then coalesce(source, '') when 1 then coalesce(lang, '') else 'Untitled' end as title from p where doc_id % 10 <> 9)
select title as source, 'notion_page' as type, 'p' || doc_id as page_id, case when doc_id % 2 = 0 then 'https://n/' || doc_id else '' end as url, '2024-01-01T00:00:00Z' as last_edited, coalesce(concat_ws(chr(10), case when title <> '' then '# ' || title end, body), '') as text from h""")
def notion_page_content(spark, sf_dir):
    """A page of the wiki for each document, of blocks with blocks below them."""
    docs = table(spark, sf_dir, "documents")
    found = notion.page_texts(notion.only_pages(notion.parse_pages(inputs.pages(docs))), inputs.blocks(docs).drop("doc_id"))
    return notion.page_metadata(found).select("source", "type", "page_id", "url", "last_edited", "text")


# What is to do, and upserts


@query("select doc_id, length(text)::int as char_count from documents where text is not null and length(text) > 50")
def embeddable_sections(spark, sf_dir):
    return store.embeddable(table(spark, sf_dir, "documents")).select("doc_id", F.length("text").alias("char_count"))


@query("select doc_id, lang from documents d where length(text) > 50 and not exists (select 1 from labels l where l.doc_id = d.doc_id)")
def incremental_anti_join(spark, sf_dir):
    docs = store.embeddable(table(spark, sf_dir, "documents"))
    return store.without(docs, store.existing_ids(table(spark, sf_dir, "labels"), "doc_id"), "doc_id").select("doc_id", "lang")


@query("select doc_id from documents d where length(text) > 50 and not exists (select 1 from labels l where l.doc_id = d.doc_id) order by doc_id limit 25")
def pending_batch_limit(spark, sf_dir):
    return store.pending(table(spark, sf_dir, "documents"), store.existing_ids(table(spark, sf_dir, "labels"), "doc_id"), "doc_id", ["doc_id"], 25).select("doc_id")


@query("select doc_id from (select doc_id from documents where length(text) > 50 order by doc_id limit 50) d where not exists (select 1 from labels l where l.doc_id = d.doc_id) order by doc_id limit 25")
def pending_batch_limit_compat(spark, sf_dir):
    return store.pending(table(spark, sf_dir, "documents"), store.existing_ids(table(spark, sf_dir, "labels"), "doc_id"), "doc_id", ["doc_id"], 25, compat=True).select("doc_id")


@query("select user_id, event_id, event_type, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events) where n = 1")
def upsert_latest(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return store.upsert_latest(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "event_type", "value")


@query("""select coalesce(d.doc_id, n.doc_id) as doc_id, case when n.doc_id is not null then n.lang else d.lang end as lang, case when d.doc_id is not null then d.source else n.source end as source
from (select * from documents where doc_id % 3 <> 0) d full join (select doc_id, 'new ' || lang as lang, 'new' as source from documents where doc_id % 3 = 0 or doc_id % 2 = 0) n on d.doc_id = n.doc_id""")
def upsert_partial(spark, sf_dir):
    """Two sides that cover all documents between them: rows to keep, rows to update, and new ones."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    new = d.where("doc_id % 3 = 0 or doc_id % 2 = 0").select("doc_id", F.concat(F.lit("new "), "lang").alias("lang"), F.lit("new").alias("source"))
    return store.upsert_partial(d.where("doc_id % 3 <> 0"), new, "doc_id", ["lang"])


@query("select d.doc_id as document_id, (d.doc_id % 7 = 0 or l.doc_id is not null) as text_extracted, (l.doc_id is not null) as is_processed from documents d left join (select distinct doc_id from labels) l on d.doc_id = l.doc_id")
def mark_processed(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), (F.col("doc_id") % 7 == 0).alias("text_extracted"), F.lit(False).alias("is_processed"))
    return store.mark_processed(docs, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("document_id")))


@query("select doc_id, source, length(text)::int as n from documents where doc_id % 5 <> 0 and doc_id % 3 <> 0 union all select doc_id, 'new', length(left(text, 500))::int from documents where doc_id % 3 = 0 or doc_id % 5 = 0")
def sync_union(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    old = d.where("doc_id % 5 <> 0").select("doc_id", "source", F.length("text").alias("n"))
    new = d.where("doc_id % 3 = 0 or doc_id % 5 = 0").select("doc_id", F.lit("new").alias("source"), F.length(text.snippet(F.col("text"))).alias("n"))
    return store.sync(new, old, ["doc_id"])


# Tables that grow

_LATEST = "(select user_id, event_id, event_type, value, ts from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events{where}) where n = 1)"
_EVENTS = "user_id long, event_id long, event_type string, value double, ts timestamp"


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.col("value").cast("double").alias("value"), F.col("ts").cast("timestamp").alias("ts"))


@query(f"select user_id, event_id, event_type, value::double as value from {_LATEST.format(where='')}")
def lake_upserts(spark, sf_dir):
    """The latest event of every user, put in by ten upserts."""
    lake, events = Lake(spark, scratch(spark, "lake")), _events(spark, sf_dir)
    lake.create("latest", _EVENTS, ["user_id"], ["ts", "event_id"])
    for batch in range(10):
        lake.upsert("latest", events.where(F.col("event_id") % 10 == batch))
    return lake.read("latest").drop("ts")


@query(f"select user_id, event_id, event_type, value::double as value from {_LATEST.format(where='')}")
def stateful_latest(spark, sf_dir):
    """The latest event of every user, from a stream that keeps them in its state; four files, two in a batch."""
    lake, place = Lake(spark, scratch(spark, "lake")), scratch(spark, "events")
    _events(spark, sf_dir).repartition(4).write.parquet(place)
    lake.create("latest", _EVENTS, ["user_id"], ["ts", "event_id"])
    keep_latest(spark, place, _EVENTS, lake, "latest", scratch(spark, "stream"), ["user_id"], ["ts", "event_id"], files=2)
    return lake.read("latest").drop("ts")


@query(f"""with a as {_LATEST.format(where=' where event_id % 2 = 0')}, b as (select * from {_LATEST.format(where='')} where user_id % 7 <> 0)
select coalesce(b.user_id, a.user_id) as user_id, coalesce(b.event_id, a.event_id) as event_id, case when a.user_id is null then 'insert' when b.user_id is null then 'delete' else 'update' end as change
from a full join b on a.user_id = b.user_id where a.event_id is distinct from b.event_id""")
def change_feed(spark, sf_dir):
    """What leads from the users' latest even events to the latest of all, when every seventh user has left."""
    lake, events = Lake(spark, scratch(spark, "lake")), _events(spark, sf_dir)
    lake.create("latest", _EVENTS, ["user_id"], ["ts", "event_id"])
    since = lake.upsert("latest", events.where("event_id % 2 = 0"))
    lake.upsert("latest", events.where("event_id % 2 = 1"))
    lake.transact(lambda t: t.delete("latest", events.where("user_id % 7 = 0")))
    return lake.changes("latest", since).select("user_id", "event_id", F.col("_change").alias("change"))


@query(f"select user_id, event_id, event_type, value::double as value from {_LATEST.format(where='')} where user_id % 7 <> 0")
def feed_sync(spark, sf_dir):
    """A second table kept in step with the first by its feeds alone."""
    source, target, events = Lake(spark, scratch(spark, "lake")), Lake(spark, scratch(spark, "lake")), _events(spark, sf_dir)
    for lake in (source, target):
        lake.create("latest", _EVENTS, ["user_id"], ["ts", "event_id"])
    first = source.upsert("latest", events.where("event_id % 2 = 0"))
    target.apply("latest", source.changes("latest", 0, first))
    source.upsert("latest", events.where("event_id % 2 = 1"))
    source.transact(lambda t: t.delete("latest", events.where("user_id % 7 = 0")))
    target.apply("latest", source.changes("latest", first))
    return target.read("latest").drop("ts")


@query("""select d.doc_id, l.doc_id is not null as processed, case when l.doc_id is not null then length(coalesce(d.text, ''))::int end as section_chars
from documents d left join (select distinct doc_id from labels) l on d.doc_id = l.doc_id""")
def sections_and_flags(spark, sf_dir):
    """Sections of the labelled documents and the documents' flags, put in by one commit."""
    lake, docs = Lake(spark, scratch(spark, "lake")), table(spark, sf_dir, "documents")
    lake.transact(lambda t: (t.create("documents", "doc_id long, lang string, processed boolean", ["doc_id"]), t.create("sections", "doc_id long, text string", ["doc_id"])))
    lake.upsert("documents", docs.select("doc_id", "lang", F.lit(False).alias("processed")))
    done = docs.join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi")

    def both(t):
        t.upsert("sections", done.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
        t.update("documents", done.select("doc_id", F.lit(True).alias("processed")), ["processed"])

    lake.transact(both)
    sections = lake.read("sections").select("doc_id", F.length("text").alias("section_chars"))
    return lake.read("documents").join(sections, "doc_id", "left").select("doc_id", "processed", "section_chars")


# Search


_first = "(select embedding::double[] from embeddings where vec_id = 0)"
_sim = "list_cosine_similarity(embedding::double[], q)"


def _one(spark, sf_dir, k, least):
    e = table(spark, sf_dir, "embeddings")
    found = vector.top_k(e, e.where("vec_id = 0").first()["embedding"], k, least, "vec_id")
    return found.select("vec_id", "label", F.round("similarity", 6).alias("similarity"))


@query(f"select vec_id, label, round(s, 6) as similarity from (select *, {_sim} as s from embeddings, (select {_first} as q)) where s >= 0.1 order by s desc, vec_id limit 10")
def vector_topk(spark, sf_dir):
    return _one(spark, sf_dir, 10, 0.1)


@query(f"select vec_id, label, round(s, 6) as similarity from (select *, {_sim} as s from embeddings, (select {_first} as q)) where s >= 0.5 order by s desc, vec_id limit 5")
def vector_topk_default(spark, sf_dir):
    return _one(spark, sf_dir, 5, 0.5)


TOP = """select query_id, vec_id, rank, s from (select *, row_number() over (partition by query_id order by s desc, vec_id)::int as rank from
(select a.vec_id as query_id, b.vec_id, list_cosine_similarity(b.embedding::double[], a.embedding::double[]) as s from embeddings a, embeddings b where a.vec_id % 20 = 0)) where rank <= 5"""


def _batch(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return vector.top_k_batch(e, e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_embedding")), 5)


@query(f"select query_id, rank, vec_id, round(s, 6) as similarity from ({TOP})")
def vector_topk_batch(spark, sf_dir):
    return _batch(spark, sf_dir).withColumn("similarity", F.round("similarity", 6))


def _index(spark, sf_dir):
    """An index of the even vectors, extended by the odd ones, and the queries."""
    e = table(spark, sf_dir, "embeddings")
    found = VectorIndex(spark, scratch(spark, "index"))
    found.build(e.where("vec_id % 2 = 0"))
    found.upsert(e.where("vec_id % 2 = 1"))
    return found, e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_embedding"))


@query()
def indexed_topk(spark, sf_dir):
    """The five nearest vectors by the stored index, from four fifths of its lists: the given vectors are random directions, so less does not reach the recall."""
    found, queries = _index(spark, sf_dir)
    return found.top_k(queries, 5, probes=max(1, len(found.state()["lists"]) * 4 // 5)).withColumn("similarity", F.round("similarity", 6))


@query(f"select query_id, rank, vec_id, round(s, 6) as similarity from ({TOP})")
def pruned_topk(spark, sf_dir):
    """The five nearest vectors exactly, without the lists that cannot hold any."""
    found, queries = _index(spark, sf_dir)
    return found.exact(queries, 5).withColumn("similarity", F.round("similarity", 6))


@query(f"select a.vec_id as query_id, b.vec_id, round(list_cosine_similarity(b.embedding::double[], a.embedding::double[]), 6) as similarity from embeddings a, embeddings b where a.vec_id % 20 = 0 and list_cosine_similarity(b.embedding::double[], a.embedding::double[]) >= {vector.MIN_SIMILARITY}")
def pruned_threshold(spark, sf_dir):
    """Every vector as similar as the threshold asks for, however many there are."""
    found, queries = _index(spark, sf_dir)
    return found.exact(queries, found.count(), vector.MIN_SIMILARITY).select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"))


@query("select vec_id, len(embedding) = 64 as dim_ok, len(embedding) = 1024 as default_ok from embeddings")
def vector_dim_check(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", vector.dim_ok(F.col("embedding"), 64).alias("dim_ok"), vector.dim_ok(F.col("embedding"), 1024).alias("default_ok"))


@query("select doc_id, left(text, 500) as text_snippet, length(text)::int as char_count, length(left(text, 6000))::int as embed_chars from documents")
def snippet_projection(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.snippet(F.col("text")).alias("text_snippet"), F.length("text").alias("char_count"), F.length(text.for_embedding(F.col("text"))).alias("embed_chars"))


# Questions


def _any(c: str, words: list[str]) -> str:
    return "(" + " or ".join(f"contains({c}, {q(w)})" for w in words) + ")"


_has = lambda *words: _any("lower(text)", list(words))
_list = _has("보여", "show me", "list", "리스트", "목록", "전체", "모든", "all")


@query(f"""select id, case when {_has('done', 'closed', 'resolved', 'finished', '완료', '끝난')} then 'done' when {_has('progress', 'working', '진행')} then 'progress' when {_has('pending', 'todo', 'to do', 'open', 'backlog', '대기', '할일')} then 'pending' end as intent,
{_list} as list_intent, case when {_list} then 30 else 5 end::int as k from (select conv_id * 1000 + turn as id, text from conversations union all select -id, t from {values(fx.PROMPTS, 'id, t')})""")
def intent_router(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text").unionByName(spark.createDataFrame(fx.PROMPTS, "id long, text string").withColumn("id", -F.col("id")))
    t = F.col("text")
    return rows.select("id", rag.intent(t).alias("intent"), rag.wants_list(t).alias("list_intent"), rag.passages(t, 1000).alias("k"))


_status = "case o_orderstatus when 'O' then 'To Do' when 'P' then 'In Progress' else 'Done' end"


@query(f"""with o as (select 'AB-' || o_orderkey as key, o_orderpriority as summary, {_status} as cat, lower({_status}) as status from orders)
select cat as status_category, count(*) as n, min(key) as first_key from o where cat = 'Done' or contains(status, 'done') group by cat
union all select cat, count(*), min(key) from o where cat = 'In Progress' group by cat union all select cat, count(*), min(key) from o where cat = 'To Do' group by cat""")
def status_filter(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    cat = F.when(F.col("o_orderstatus") == "O", "To Do").when(F.col("o_orderstatus") == "P", "In Progress").otherwise("Done")
    issues = o.select(F.concat(F.lit("AB-"), F.col("o_orderkey").cast("string")).alias("key"), cat.alias("status_category"), F.lower(cat).alias("status"))
    tagged = issues.withColumn("groups", F.array(*[F.when(rag.status_group(F.col("status"), F.col("status_category"), g), g) for g in rag.STATUS]))
    return tagged.where(F.exists("groups", lambda g: g.isNotNull())).groupBy("status_category").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first_key"))


@query("""select o_custkey, chr(10) || chr(10) || '[완료 상태 이슈 ' || count(*) || '개]' || chr(10) || string_agg('- AB-' || o_orderkey || ': ' || o_orderpriority || ' (상태: done)' || chr(10), '' order by o_orderkey) as status_context
from orders where o_orderstatus = 'F' group by o_custkey""")
def status_context(spark, sf_dir):
    """The finished issues of every customer, who stands for a session."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    issues = o.select("o_custkey", "o_orderkey", F.concat(F.lit("AB-"), F.col("o_orderkey").cast("string")).alias("key"), F.col("o_orderpriority").alias("summary"), F.lit("done").alias("status"), F.lit("Done").alias("status_category"))
    return rag.status_context(issues, "done", "o_orderkey", "o_custkey")


CONTEXT = f"""with top as ({TOP}), c as (select query_id, string_agg('[출처: ' || coalesce(d.source, 'unknown') || ']' || chr(10) || d.text, {q(rag.SEPARATOR)} order by rank) as context
from top join documents d on d.doc_id = top.vec_id group by query_id)"""


def _contexts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "source", "text")
    return rag.assemble_context(_batch(spark, sf_dir).join(docs, "vec_id"))


@query(CONTEXT + " select query_id, context from c")
def context_assembly(spark, sf_dir):
    return _contexts(spark, sf_dir)


@query(CONTEXT + f" select query_id, {q(rag.PROMPT)} || context as prompt from c")
def prompt_build(spark, sf_dir):
    return _contexts(spark, sf_dir).select("query_id", rag.build_prompt(F.col("context")).alias("prompt"))


# Statistics, names and paths


@query("select source as folder, count(*) as file_count, (sum(n_chars) // 1024)::bigint as size_kb from documents group by source")
def folder_stats(spark, sf_dir):
    return stats.folder_stats(table(spark, sf_dir, "documents").select(F.col("source").alias("folder"), F.col("n_chars").alias("size")))


@query("select c_custkey, 'rag-0123abcd-' || left(md5(c_name), 8) as collection from customer")
def collection_name(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", text.collection_name("0123abcd-ffff", F.col("c_name")).alias("collection"))


@query("""select page_id, string_split(url, '/')[-1] as source, string_split(url, '/')[-2] as folder, case when starts_with(url, 'https:/') then url[8:] else url end as path from pages""")
def file_metadata(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", stats.file_metadata(F.col("url"), "https:/").alias("m")).select("page_id", "m.*")


@query(f"select page_id as id, url as p, list_bool_or(list_transform(string_split(url, '/'), lambda x: starts_with(x, '.'))) as hidden from pages union all select -id, t, list_bool_or(list_transform(string_split(t, '/'), lambda x: starts_with(x, '.'))) from {values(fx.PATHS, 'id, t')}")
def hidden_path_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("p")).unionByName(spark.createDataFrame(fx.PATHS, "id long, p string").withColumn("id", -F.col("id")))
    return rows.withColumn("hidden", binary.has_hidden_part(F.col("p")))


@query("select count(l.doc_id) as extracted, count(*) - count(l.doc_id) as errors, count(*) as total from documents d left join (select distinct doc_id from labels) l on d.doc_id = l.doc_id")
def run_stats(spark, sf_dir):
    done = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("_l")).distinct()
    d = table(spark, sf_dir, "documents").select("doc_id")
    return stats.run_stats(d.join(done, F.col("doc_id") == F.col("_l"), "left"), F.col("_l").isNull())


@query("select doc_id, row_number() over (order by doc_id) - 1 as row_no, ((row_number() over (order by doc_id) - 1) // 50 + 1)::bigint as batch_no, ceil((select count(*) from documents) / 50)::bigint as n_batches from documents")
def batch_numbering(spark, sf_dir):
    return stats.batch_numbers(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query("select source as container, doc_id, row_number() over (partition by source order by doc_id)::int as section_order, '[' || lang || '] ' || text as section_title from documents")
def zip_renumber(spark, sf_dir):
    s = table(spark, sf_dir, "documents").select(F.col("source").alias("container"), "doc_id", "lang", F.col("text").alias("section_title"))
    return stats.renumber(s, "container", ["doc_id"], "section_title", "lang").select("container", "doc_id", "section_order", "section_title")


_bit = lambda n: f"(flags >> {n}) & 1 = 1"


@query(f"with o as (select o_orderkey, o_orderkey % 2048 as flags from orders) select o_orderkey, flags, {', '.join(f'{_bit(n)} as {name}' for n, name in binary.HEADER_FLAGS.items())}, case when {_bit(1)} or {_bit(8)} then 'password' when {_bit(4)} or {_bit(9)} then 'drm' when {_bit(2)} then 'distribution' end as encryption_type, ({_bit(1)} or {_bit(8)} or {_bit(4)} or {_bit(9)}) as is_encrypted from o")
def hwp_flag_decode(spark, sf_dir):
    """A file header for each order, whose flags are the low bits of its key."""
    key = F.format_string("%08X", F.col("o_orderkey") % 2048)
    header = F.unhex(F.concat(F.lit("00" * 36), *[F.substring(key, p, 2) for p in (7, 5, 3, 1)]))
    flags = F.col("flags")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", binary.u32(header, 36).alias("flags"))
    return rows.select("o_orderkey", "flags", binary.header_flags(flags).alias("h"), binary.encryption_type(flags).alias("encryption_type"), binary.is_encrypted(flags).alias("is_encrypted")).select("o_orderkey", "flags", "h.*", "encryption_type", "is_encrypted")


_tags = " ".join(f"when {n} then '{name}'" for n, name in binary.TAGS.items())


@query(f"with w as (select event_id, (event_id * 2654435761) % 4294967296 as word from events) select event_id, word, word & 1023 as tag_id, (word >> 10) & 1023 as level, (word >> 20) & 4095 as size, case word & 1023 {_tags} else 'UNKNOWN_0x' || lpad(upper(to_hex(word & 1023)), 3, '0') end as tag_name from w")
def record_header_split(spark, sf_dir):
    """A record's first word for each event, from a multiple of its id."""
    w = table(spark, sf_dir, "events").select("event_id", ((F.col("event_id") * 2654435761) % 4294967296).alias("word"))
    return w.select("event_id", "word", binary.record_header(F.col("word")).alias("h")).select("event_id", "word", "h.*").withColumn("tag_name", binary.tag_name(F.col("tag_id")))


@query(f"""select id, left(t, 80) || '_sec_3' as section_id, replace(t, chr(92), '/') as path, {rep(strip_sql('t'), ('/+$', ''))} as url, string_split(t, ':')[1] = 'src7' as model, t || ' - name' as label, string_split(t, ' - ')[1] as key
from (select id, t from {values(fx.NAMES, 'id, t')} union all select doc_id * 2 + 1000, source || ':' || lang || ' - ' || text || '//' || chr(10) from documents union all select page_id * 2 + 1001, replace(url, '/', chr(92)) || '/' from pages)""")
def name_functions(spark, sf_dir):
    """Names, paths and labels from documents and pages."""
    t = F.col("t")
    docs = table(spark, sf_dir, "documents").select((F.col("doc_id") * 2 + 1000).alias("id"), F.concat("source", F.lit(":"), "lang", F.lit(" - "), "text", F.lit("//\n")).alias("t"))
    pages = table(spark, sf_dir, "pages").select((F.col("page_id") * 2 + 1001).alias("id"), F.concat(F.translate("url", "/", "\\"), F.lit("/")).alias("t"))
    return spark.createDataFrame(fx.NAMES, "id long, t string").unionByName(docs).unionByName(pages).select(
        "id", text.section_id(t, F.lit(3)).alias("section_id"), text.unix_path(t).alias("path"), text.trim_url(t).alias("url"), text.model_matches(t, "src7:latest").alias("model"), text.project_label(t, F.lit("name")).alias("label"), text.project_key(t).alias("key")
    )


@query(f"""with d as (select doc_id, case when doc_id % 13 <> 0 then text end as text, case when doc_id % 5 = 0 then 'other' else coalesce(source, 'none') end as folder from documents where doc_id % 11 <> 0)
select doc_id || '.md' as source, folder, case when doc_id % 5 = 0 then '/other' else folder end || '/' || doc_id || '.md' as path, coalesce({markdown_sql('text')}, '') as text from d""")
def vault_markdown(spark, sf_dir):
    """Texts and metadata of a vault with a note for each document."""
    rows = inputs.vault(table(spark, sf_dir, "documents"))
    return vault.vault_texts(rows.where(~binary.has_hidden_part(F.col("path"))), "/vault")


@query(CHUNKS + "select doc_id, chunk_pos, n_chars, list_transform(range(16), lambda i: ((('0x' || substr(sha256(left(chunk, 6000)), (2 * i + 1)::int, 2))::int - 127.5::double) / 127.5::double)::float) as embedding, true as dim_ok from chunks")
def embed_sections(spark, sf_dir):
    """Embeddings of the documents' chunks from a deterministic stand-in model."""
    from ..operators import embed

    return embed.embed(chunk.chunk_documents(table(spark, sf_dir, "documents").select("doc_id", "text")), fx.HashEmbedder(), "chunk", 16).drop("chunk")
