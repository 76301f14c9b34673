import json

import pytest
from pyspark.sql import functions as F

from tessera.functions import binary
from tessera.operators import chunk
from tessera.plans import fixtures as fx
from tessera.sources import files, jira, notion, parsers, vault
from tessera.sources.rest import test_connection as probe


def test_hwp():
    doc = parsers.read_hwp(fx.hwp_file())
    assert doc["header"]["version"] == "5.0.0.1" and doc["info"]["sections"] == 1 and doc["info"]["char_pos"] == 5
    assert doc["info"]["binary"][0]["extension"] == "png" and doc["info"]["hangul_fonts"][0]["name"] == "바탕"
    assert [(p["index"], p["text"]) for p in doc["sections"][0]["paragraphs"]] == [(0, "안녕 漢字 hello\t끝"), (2, "둘째 문단")]
    assert parsers.read_hwp(fx.hwp_file(0))["sections"][0]["paragraphs"] == doc["sections"][0]["paragraphs"]
    assert parsers.parse_hwp(fx.hwp_file(5))["text"] == "안녕  hello끝둘째 문단"
    assert parsers.hwp_gate(fx.hwp_file(0x11))["encryption_type"] == "drm" and parsers.hwp_gate(b"x")["error"]


def test_large_records():
    data = fx.record(0x43, b"ab" * 5000) + fx.record(0x42, b"z" * 30)
    assert [(t, n, len(d)) for _, t, _, n, d in parsers.records(data)] == [(0x43, 10_000, 10_000), (0x42, 30, 30)]
    assert list(parsers.records(b"\x00\x00")) == []


def test_hwpx():
    doc = parsers.read_hwpx(fx.hwpx_file())
    assert [p["text"] for p in doc["sections"][0]["paragraphs"]] == ["첫째\t\n안쪽", "안쪽"]
    assert [p["text"] for p in parsers.read_hwpx(fx.hwpx_file(), dedupe_nested=True)["sections"][0]["paragraphs"]] == ["첫째\t\n", "안쪽"]
    assert doc["begin"]["page"] == 2 and doc["fonts"][0]["family_type"] == "F" and doc["styles"][0]["name"] == "본문" and doc["char_properties"][0]["height"] == "1000"
    assert doc["caret"]["char_pos"] == 7 and doc["binary"][0]["is_embedded"] and doc["version"] == {"version": "1.2", "app_version": "9"}
    assert parsers.summary(doc, "hwpx")["sections"][0]["section_order"] == 1 and "안쪽" in parsers.dump(doc)


@pytest.mark.parametrize(("names", "version", "kind"), [(["Contents/EncryptedPackage"], None, "package"), (["Contents/section0.xml"], '<v encrypted="false"/>', "standard"), (["Contents/header.xml"], None, "unknown"), (["Contents/section0.xml"], "<v/>", None)])
def test_hwpx_gate(names, version, kind):
    assert parsers.hwpx_gate(names, version)["encryption_type"] == kind


def test_spreadsheet_and_word():
    x = parsers.parse_xlsx(fx.xlsx_file())
    assert x["text"] == "Sheet: 하나\n이름\t\t42\nab\t1.5\tTrue\n\nSheet: 셋\n끝" and [s["section_order"] for s in x["sections"]] == [1, 3]
    assert parsers.parse_docx(fx.docx_file())["text"] == "첫 문단\n끝 문단\n\n[Table 1]\n가\t나\n"


def test_archive():
    z = parsers.parse_file("e.zip", dict(fx.office_files())["e.zip"])
    assert (z["files_processed"], z["files_skipped"]) == (2, 1)
    assert [(s["section_order"], s["section_title"]) for s in z["sections"]] == [(1, "[c.xlsx] 하나"), (2, "[c.xlsx] 셋"), (3, "[d.docx] Full Document")]
    assert z["text"].startswith(parsers.banner("c.xlsx"))


def test_errors_are_values():
    error = lambda n, d=b"x": parsers.parse_file(n, d)["error"]
    assert error("a.doc") == ".doc format not supported (only .docx)" and error("a.txt") == "Unsupported file type: .txt" and error("a.pdf", None) == "File not found"
    assert error("a.zip") == "Not a valid ZIP file" and error("a.docx") and error("a.hwp") and error("A.PDF")
    assert error("a.zip", fx.zipped({"x.txt": "y"})) == "ZIP contains no supported document types"


def test_extraction_job(spark, tmp_path):
    root = tmp_path / "lake"
    (root / "sub").mkdir(parents=True)
    for name, data in fx.office_files()[:6]:
        (root / "sub" / name).write_bytes(data)
    docs = spark.createDataFrame([(f"d{i}", "b", f"sub\\{n}", False, False, i) for i, (n, _) in enumerate(fx.office_files()[:6])] + [("gone", "b", "sub/none.docx", False, False, 9), ("old", "b", "sub/a.hwp", True, True, 0)], "document_id string, bid_id string, file_path string, text_extracted boolean, is_processed boolean, created_at int")
    sections = spark.createDataFrame([("d0_sec_0", "keep", "d0", "t", "title", "old", "old", "en", None, 0, 1, 3)], "section_id string, bid_id string, document_id string, section_type string, section_title string, text string, cleaned_text string, language string, page_number int, section_order int, word_count int, char_count int")
    out = files.extraction_job(docs, sections, str(root))
    assert out["stats"].first().asDict() == {"extracted": 4, "errors": 3, "total": 7}
    row = out["sections"].where("section_id = 'd0_sec_0'").first()
    assert row["bid_id"] == "keep" and row["language"] == "en" and row["cleaned_text"] == "old" and row["text"].startswith("안녕")
    assert {r["document_id"] for r in out["documents"].where("is_processed").collect()} == {"d0", "d2", "d4", "d5", "old"}


def test_extraction_reads_named_files_only(spark, tmp_path, monkeypatch):
    """Odd names are found, other files are not opened, and the join for many files gives the same."""
    names = ["a b.zip", "x[1]{2}*.zip", "plain.zip", "other.zip"]
    for n in names:
        (tmp_path / n).write_bytes(n.encode())
    wanted = spark.createDataFrame([(f"{tmp_path}/{n}",) for n in [*names[:3], "none.zip"]], "path string")
    few = sorted((r["path"].rpartition("/")[2], bytes(r["content"])) for r in files.contents(spark, str(tmp_path), wanted).collect())
    assert few == sorted((n, n.encode()) for n in names[:3])
    assert "other.zip" not in str(files.contents(spark, str(tmp_path), wanted).inputFiles())
    monkeypatch.setattr(files, "MAX_PATHS", 1)
    assert sorted((r["path"].rpartition("/")[2], bytes(r["content"])) for r in files.contents(spark, str(tmp_path), wanted).collect()) == few
    assert files.contents(spark, str(tmp_path), wanted.where("false")).count() == 0


def test_dates_and_phonetic_runs():
    """Cells with a date format print as dates, times or spans; phonetic runs are no text."""
    styles = b'<styleSheet xmlns="x"><numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm"/><numFmt numFmtId="165" formatCode="[Red]0.0&quot;days&quot;"/><numFmt numFmtId="166" formatCode="[h]:mm"/></numFmts><cellStyleXfs><xf numFmtId="14"/></cellStyleXfs><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/><xf numFmtId="166"/><xf numFmtId="21"/></cellXfs></styleSheet>'
    dates = parsers.date_styles(styles)
    assert dates == {1: False, 2: False, 4: True, 5: False}
    sheet = b'<worksheet xmlns="x"><sheetData><row r="1"><c r="A1" s="1"><v>45292</v></c><c r="B1" s="2"><v>45292.5</v></c><c r="C1" s="3"><v>45292</v></c><c r="D1" s="4"><v>1.5</v></c><c r="E1" s="5"><v>0.25</v></c><c r="F1" s="1"><v>1</v></c><c r="G1" t="s"><v>0</v></c></row></sheetData></worksheet>'
    import xml.etree.ElementTree as ET

    shared = parsers.shared_text(ET.fromstring("<si><r><t>한</t></r><r><t>국</t></r><rPh sb='0' eb='1'><t>PHON</t></rPh></si>"))
    assert list(parsers.sheet_rows(sheet, [shared], dates)) == [["2024-01-01 00:00:00", "2024-01-01 12:00:00", "45292", "1 day, 12:00:00", "06:00:00", "1900-01-01 00:00:00", "한국"]]
    assert parsers.shown_date("0", False, True) == "00:00:00" and parsers.shown_date("1", False, True) == "1904-01-02 00:00:00"


def test_merged_cells_stand_in_every_column():
    import xml.etree.ElementTree as ET

    cell = lambda text, more="": f"<w:tc><w:tcPr>{more}</w:tcPr><w:p><w:r><w:t>{text}</w:t></w:r></w:p></w:tc>"
    xml = f"""<w:tbl xmlns:w="w"><w:tr>{cell("a", '<w:gridSpan w:val="2"/>')}{cell("b", '<w:vMerge w:val="restart"/>')}</w:tr><w:tr>{cell("c")}{cell("d")}{cell("", "<w:vMerge/>")}</w:tr></w:tbl>"""
    assert list(parsers.table_rows(ET.fromstring(xml))) == [["a", "a", "b"], ["c", "d", "b"]]


def test_vault(spark, tmp_path):
    for path, data in {"a.md": "# 가\r\n나", "sub/b.md": "**다**", "sub/deep/c.md": "x", ".git/d.md": "no", "e.txt": "no"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(data, newline="")
    root = str(tmp_path)
    flat, deep = vault.markdown_files(spark, root), vault.markdown_files(spark, root, recursive=True)
    assert flat.count() == 1 and deep.count() == 3
    assert {r["source"]: (r["folder"], r["path"], r["text"]) for r in vault.vault_texts(deep, root).collect()} == {"a.md": (tmp_path.name, "a.md", "가\n나"), "b.md": ("sub", "sub/b.md", "다"), "c.md": ("deep", "sub/deep/c.md", "x")}
    assert vault.vault_stats(deep, root).first().asDict() == {"file_count": 3, "total_size_kb": 0, "subfolders": 1}
    assert [r["folder"].removeprefix(root) for r in vault.folders(deep, root).collect()] == ["", "/sub", "/sub/deep"]


def test_folders_without_files_and_preview(spark, tmp_path):
    for path in ("b/empty", "a", ".git/x", "b/.hid"):
        (tmp_path / path).mkdir(parents=True)
    for i in range(12):
        (tmp_path / "a" / f"n{i:02d}.md").write_text("x")
    root = str(tmp_path)
    assert [f.removeprefix(root) for f in vault.vault_folders(spark, root)] == ["", "/a", "/b", "/b/empty"] and vault.vault_folders(spark, f"{root}/.git") == [f"{root}/.git"] and vault.vault_folders(spark, f"{root}/none") == []
    notes = vault.markdown_files(spark, root, recursive=True)
    assert vault.vault_stats(notes, root, vault.subfolder_count(spark, root)).first()["subfolders"] == 2
    assert vault.file_preview(notes) == [f"n{i:02d}.md" for i in range(10)] + ["... 외 2개"] and vault.file_preview(notes, 12)[-1] == "n11.md"


def test_pdf_pages_through_stand_in_readers(spark, monkeypatch):
    """The first reader that can read a file wins; pages without text are no sections but count as pages."""
    import sys
    import types

    class Page:
        def __init__(self, text):
            self.text = text

        def extract_text(self):
            return self.text

    def broken(f):
        raise ValueError("no")

    monkeypatch.setitem(sys.modules, "pdfplumber", types.SimpleNamespace(open=broken))
    monkeypatch.setitem(sys.modules, "pypdf", types.SimpleNamespace(PdfReader=lambda f: types.SimpleNamespace(pages=[Page("one two"), Page(None), Page("three")])))
    got = parsers.parse_file("x.pdf", b"%PDF")
    assert (got["text"], got["method"], got["page_count"], [(s["section_title"], s["page_number"]) for s in got["sections"]]) == ("one two\n\nthree", "pypdf", 3, [("Page 1", 1), ("Page 3", 3)])
    monkeypatch.setitem(sys.modules, "pypdf", types.SimpleNamespace(PdfReader=broken))
    assert parsers.parse_file("x.pdf", b"%PDF")["error"]
    rows = files.pdf_texts(spark.createDataFrame([("a.pdf", b"x")], "path string, content binary")).collect()
    assert rows[0]["text"] == "" and rows[0]["error"]


def test_issue_corpus(spark):
    raw = spark.createDataFrame([(json.dumps(i),) for i in fx.ISSUES], "value string")
    got = jira.issue_corpus(jira.parse_issues(raw), lambda df: chunk.chunk_documents(df, longer_than=0)).collect()
    assert {r["source"] for r in got} == {"AB-1", "AB-2", "AB-3", "AB-4"} and all(r["type"] == "jira_issue" and len(r["summary"]) <= 100 for r in got)


def test_page_corpus_boundary(spark):
    pages = [{"id": f"p{n}", "object": "database" if n == 60 else "page", "properties": {"title": {"type": "title", "title": [{"plain_text": "x" * (n - 2)}]}}} for n in (49, 50, 51, 60)]
    df = notion.parse_pages(spark.createDataFrame([(json.dumps(p),) for p in pages], "value string"))
    blocks = spark.createDataFrame([], "parent_id string, pos int, block string")
    assert {r["page_id"] for r in notion.page_corpus(df, blocks, lambda d: d).collect()} == {"p50", "p51"}


def test_rest_sources(spark):
    spark.dataSource.register(jira.JiraSource)
    spark.dataSource.register(notion.NotionSource)
    issues = spark.read.format("jira").options(url="https://t/", email="a", token="b", jql="project = AB", opener="tests.fake_rest:jira").load().collect()
    assert [json.loads(r["value"])["key"] for r in issues] == ["AB-1", "AB-2"] and all(r["error"] is None for r in issues)
    blocks = spark.read.format("notion").options(token="t", parent="p1,p2", opener="tests.fake_rest:notion").load()
    assert sorted((r["parent"], r["pos"], json.loads(r["value"])["id"]) for r in blocks.where("error is null").collect()) == [("p1", 0, "p1-a"), ("p1", 1, "p1-b"), ("p2", 0, "p2-a")]
    assert [(r["parent"], r["pos"]) for r in blocks.where("error is not null").collect()] == [("p2", 1)]
    assert probe({"url": "x"}, {}, lambda r, h: (401, "no")) == (False, "401: no")


def test_record_rows(spark):
    df = files.hwp_records(spark.createDataFrame([("s", fx.hwp_section())], "path string, content binary"))
    assert [r["tag_name"] for r in df.withColumn("tag_name", binary.tag_name(F.col("tag_id"))).orderBy("offset").collect()] == ["PARA_HEADER", "PARA_TEXT", "PARA_HEADER", "PARA_HEADER", "PARA_TEXT"]


def test_trees_level_by_level_equal_the_walk(spark):
    """Random trees, deep ones, and odd nodes: as the walk over one tree gives them, without Python in the plan."""
    import random

    r = random.Random(4)

    def tree(depth):
        kind = r.choice(["paragraph", "heading", "bulletList", "listItem", "panel", "text", "mention", "emoji"])
        if kind == "text":
            return {"type": "text", "text": r.choice(["a", "", "두 말", "x\ny"])}
        if kind in ("mention", "emoji"):
            return {"type": kind, "attrs": {"text": "@kim", "shortName": ":ok:"}} if r.random() < 0.8 else {"type": kind}
        inside = [tree(depth - 1) if depth else {"type": "text", "text": "end"} for _ in range(r.randrange(4))]
        return {"type": kind, "content": [*inside, *r.choice([[], ["loose"], [None, 3, []]])]} if r.random() < 0.9 else {"type": kind, "content": "no list"}

    deep = {"type": "text", "text": "bottom"}
    for _ in range(12):
        deep = {"type": "listItem", "content": [deep, {"type": "text", "text": "t"}]}
    rows = [(i, json.dumps({"type": "doc", "content": [tree(3) for _ in range(3)]}, ensure_ascii=False)) for i in range(40)]
    rows += [(100, json.dumps(deep)), (101, "{}"), (102, '{"content": [{"text": "no type"}, "s"]}')]
    out = jira.tree_texts(spark.createDataFrame([*rows, (200, None), (201, "no json"), (202, "[1]"), (203, '"s"')], "id long, tree string"), "id", "tree")
    assert {r["id"]: r["text"] for r in out.collect()} == {i: jira.adf_text(json.loads(t)) for i, t in rows}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_levels_of_trees_are_not_broadcast(spark):
    """A level has a row for each node, so it grows with the table, however small its estimate is."""
    rows = spark.range(2000).select("id", F.concat(F.lit('{"type":"doc","content":[{"type":"paragraph","content":[{"type":"text","text":"t'), "id", F.lit('"}]}]}')).alias("tree"))
    out = jira.tree_texts(rows, "id", "tree")
    assert out.where("text = concat('t', id)").count() == 2000
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def pushing(spark):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(jira.JiraSource)
    yield
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


@pytest.mark.parametrize(("condition", "asked", "left"), [
    ("key = 'AB-3'", 'key = "AB-3"', False), ("project = 'Q\"X' and status = 'Done'", 'project = "Q\\"X"', False), ("status in ('done', 'To Do')", 'status in ("done", "To Do")', False),
    ("updated >= timestamp '2024-03-01 00:00:00'", 'updated >= "2024/02/2', False), ("updated < timestamp '2024-02-15 00:00:00'", 'updated <= "2024/02/1', False), ("summary = 's4' and project = 'AB'", 'project = "AB"', True),
    ("status = 'Done' or key = 'AB-1'", "", True), ("assignee is null", "", True), ("status <> 'Done'", "", True),
])
def test_conditions_are_pushed_into_the_trackers_language(spark, pushing, tmp_path, condition, asked, left):
    """The rows of a read whose condition the tracker selects by are those of a read of everything."""
    log = tmp_path / "asked"
    read = lambda: spark.read.format("jira").options(url=f"file:{log}", email="a", token="b", kind="issues", jql="text ~ x ORDER BY updated DESC", opener="tests.fake_rest:tracker").load()
    every = {r["key"]: r for r in read().collect()}
    assert len(every) == 24
    log.unlink()
    df = read().where(condition)
    got = {r["key"] for r in df.collect()}
    queries = set(log.read_text().splitlines())
    assert len(queries) == 1 and queries.pop().startswith("(text ~ x)" + (" AND " if asked else ""))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert (") Filter " in plan) == left
    table = spark.createDataFrame([tuple(r) for r in every.values()], jira.ISSUE_COLUMNS)
    assert got == {r["key"] for r in table.where(condition).collect()} and 0 < len(got) < 24
    queries = log.read_text().splitlines()
    assert all(asked in x for x in queries) and queries[0].endswith("ORDER BY updated DESC")


def test_edited_pages_as_a_stream(spark, tmp_path):
    """A run reads the pages edited since the last one, and those of its last minute; a restart goes on from the checkpoint."""
    spark.dataSource.register(notion.NotionSource)
    pages, asked = tmp_path / "wiki.json", tmp_path / "wiki.asked"

    def run():
        asked.unlink(missing_ok=True)
        stream = spark.readStream.format("notion").options(token="t", url=f"file:{pages}", opener="tests.fake_rest:wiki", page_size="2").load()
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "point")).trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted(set(asked.read_text().split())) if asked.exists() else []

    at = {f"p{i}": f"2024-01-0{i}T00:00:00.000Z" for i in range(1, 6)}
    pages.write_text(json.dumps(at))
    assert run() == sorted(at)
    assert run() == []
    at |= {"p2": "2024-02-01T00:00:00.000Z", "p9": "2024-02-02T00:00:00.000Z"}
    pages.write_text(json.dumps(at))
    assert run() == ["p2", "p5", "p9"]
    rows = spark.read.parquet(str(tmp_path / "out"))
    last = {(r["parent"], json.loads(r["value"])["at"]) for r in rows.collect()}
    assert {(p, t) for p, t in last if at[p] == t} == set(at.items()) and rows.where("error is not null").isEmpty()
