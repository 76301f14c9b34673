"""Small files, issues and pages of every kind, and the rows they give."""

import json

from pyspark.sql import functions as F

from tessera.functions import binary, text
from tessera.plans import fixtures as fx
from tessera.sources import files, jira, notion, vault

SHEET, DOCX = "이름\t\t42\nab\t1.5\tTrue", "첫 문단\n끝 문단\n\n[Table 1]\n가\t나\n"
XLSX = f"Sheet: 하나\n{SHEET}\n\nSheet: 셋\n끝"
PARA = "03000000000000000000000001000000010007000000"


def office(spark):
    return spark.createDataFrame(fx.office_files(), "path string, content binary")


def banner(name):
    return f"\n{'=' * 60}\n📄 {name}\n{'=' * 60}\n"


def broken(path, error, *kind):
    return path, "", None, 0, 0, error, *(kind or (None, None)), None, None, 0


def test_extracted_rows(spark):
    names = ["path", "text", "method", "word_count", "char_count", "error", "encrypted", "encryption_type", "files_processed", "files_skipped"]
    got = {tuple(r) for r in files.extract(office(spark)).select(*names, F.size("sections")).collect()}
    assert got == {
        ("a.hwp", "안녕  hello끝둘째 문단", "hwp_extraction (proper parser)", 3, 15, None, None, None, None, None, 1),
        broken("locked.hwp", "HWP file is encrypted (password)", True, "password"),
        ("b.hwpx", "첫째안쪽안쪽", "hwpx_extraction (XML parser)", 1, 6, None, None, None, None, None, 1),
        broken("sealed.hwpx", "HWPX file is encrypted (package)", True, "package"),
        ("c.xlsx", XLSX, "xlsx", 10, 40, None, None, None, None, None, 2),
        ("d.docx", DOCX, "docx", 8, 25, None, None, None, None, None, 1),
        ("e.zip", banner("c.xlsx") + XLSX + "\n\n" + banner("d.docx") + DOCX, "zip_extraction", 26, 331, None, None, None, 2, 1, 3),
        broken("f.doc", ".doc format not supported (only .docx)"),
        broken("g.txt", "Unsupported file type: .txt"),
        broken("h.zip", "Not a valid ZIP file"),
        broken("i.hwp", "Not a valid OLE file"),
    }


def test_section_rows(spark):
    found = files.extract(office(spark).withColumn("document_id", F.col("path")).withColumn("bid_id", F.lit("b1")), ("document_id", "bid_id"))
    names = ["section_id", "document_id", "section_type", "section_title", "text", "section_order", "word_count", "char_count"]
    rows = files.section_rows(found)
    section = lambda path, kind, title, body, order, n, m: (f"{path}_sec_{order}", path, kind, title, body, order, n, m)
    assert {tuple(r) for r in rows.select(names).collect()} == {
        section("a.hwp", "bodytext", "Section 0", "안녕 漢字 hello\t끝\n둘째 문단", 0, 6, 19),
        section("b.hwpx", "bodytext", "Section 0", "첫째\t\n안쪽\n안쪽", 0, 3, 9),
        section("c.xlsx", "sheet", "하나", SHEET, 1, 5, 18),
        section("c.xlsx", "sheet", "셋", "끝", 3, 1, 1),
        section("d.docx", "document", "Full Document", DOCX, 1, 8, 25),
        section("e.zip", "sheet", "[c.xlsx] 하나", SHEET, 1, 5, 18),
        section("e.zip", "sheet", "[c.xlsx] 셋", "끝", 2, 1, 1),
        section("e.zip", "document", "[d.docx] Full Document", DOCX, 3, 8, 25),
    }
    assert all((r["bid_id"], r["language"], r["page_number"], r["cleaned_text"]) == ("b1", "ko", None, r["text"]) for r in rows.collect())


def test_record_dump(spark):
    rows = spark.createDataFrame([("DocInfo", fx.hwp_doc_info()), ("Section0", fx.hwp_section())], "path string, content binary")
    got = files.hwp_records(rows).withColumn("tag_name", binary.tag_name(F.col("tag_id"))).withColumn("data", F.hex("data")).select("path", "offset", "tag_id", "level", "size", "data", "tag_name")
    assert {tuple(r) for r in got.collect()} == {
        ("DocInfo", 0, 16, 0, 26, "0100" * 7 + "00000000" * 2 + "05000000", "DOCUMENT_PROPERTIES"),
        ("DocInfo", 30, 17, 0, 72, "01000000" * 2 + "00000000" * 16, "ID_MAPPINGS"),
        ("DocInfo", 106, 18, 0, 12, "010003000300" + "70006E006700", "BIN_DATA"),
        ("DocInfo", 122, 19, 0, 7, "00" + "0200" + "14BCD5D0", "FACE_NAME"),
        ("Section0", 0, 66, 0, 22, PARA, "PARA_HEADER"),
        ("Section0", 26, 67, 1, 48, "48C555B12000226F575B2000" + "680065006C006C006F00" + "0900" + "0B00" + "00" * 14 + "5DB03DD800DE0D00", "PARA_TEXT"),
        ("Section0", 78, 66, 0, 22, PARA, "PARA_HEADER"),
        ("Section0", 104, 66, 0, 22, PARA, "PARA_HEADER"),
        ("Section0", 130, 67, 1, 10, "58B4F8C9200038BBE8B2", "PARA_TEXT"),
    }


def test_issue_texts(spark):
    raw = spark.createDataFrame([(json.dumps(i, ensure_ascii=False),) for i in fx.ISSUES], "value string")
    got = jira.issue_metadata(jira.issue_texts(jira.parse_issues(raw))).select("source", "type", "summary", "status", "project", "text")
    assert [tuple(r) for r in got.orderBy("source").collect()] == [
        ("AB-1", "jira_issue", "로그인 오류", "완료", "AB", "[AB-1] (상태: 완료) 로그인 오류\n\n이슈 상태: 완료 (Done) - 완료된 작업, done task, completed\n\n담당자: Kim\n\nhello @kim :ok:\n 하나\n\nbold site"),
        ("AB-2", "jira_issue", "느림", "진행 중", "Unknown", "[AB-2] (상태: 진행 중) 느림\n\n이슈 상태: 진행 중 - 진행중인 작업, in progress task, working\n\n그냥 글"),
        ("AB-3", "jira_issue", "", "할일", "Unknown", "이슈 상태: 할일 (To Do) - 대기중인 작업, pending task, todo"),
        ("AB-4", "jira_issue", "x" * 100, "Unknown", "Unknown", "[AB-4] " + "x" * 120),
    ]
    trees = spark.createDataFrame(fx.ADF, "id int, t string").select("id", jira.adf_to_text(F.col("t")).alias("text"))
    assert [tuple(r) for r in trees.orderBy("id").collect()] == [(1, "hello @kim :ok:\n 하나"), (2, ""), (3, ""), (4, "")]
    wiki = spark.createDataFrame(fx.WIKI, "id int, t string").select("id", text.clean_jira_markup(F.col("t")).alias("text"))
    assert [tuple(r) for r in wiki.orderBy("id").collect()] == [(1, "bold it site ~user"), (2, "안녕 빨강"), (3, ""), (4, "a\n\nb c"), (5, "x")]


def test_page_texts(spark):
    pages = notion.parse_pages(spark.createDataFrame([(json.dumps(p, ensure_ascii=False),) for p in fx.PAGES], "value string"))
    blocks = spark.createDataFrame([(parent, pos, json.dumps(b, ensure_ascii=False)) for parent, pos, b in fx.BLOCKS], "parent_id string, pos int, block string")
    got = notion.page_metadata(notion.page_texts(notion.only_pages(pages), blocks)).select("source", "type", "page_id", "url", "last_edited", "text")
    assert [tuple(r) for r in got.orderBy("page_id").collect()] == [
        ("회의록", "notion_page", "p1", "https://n/p1", "2024-01-01T00:00:00Z", "# 회의록\n문단\n  인용\n\n머리\n\n- 점\n[Code (python)]: x=1\n[x] 할 일\n[Page: 아래]\n[Database: Untitled]\n[Link: http://x]\n[Pdf: 그림]\n[Image]"),
        ("기타", "notion_page", "p2", "", "", "# 기타\n- 수\n[ ] 남음"),
        ("Untitled", "notion_page", "p3", "", "", "# Untitled"),
    ]


def test_vault_rows(spark):
    rows = spark.createDataFrame(fx.vault_files(), "path string, content binary")
    got = vault.vault_texts(rows.where(~binary.has_hidden_part(F.col("path"))), "/vault").select("source", "folder", "path", "text")
    assert {tuple(r) for r in got.collect()} == {("a.md", "vault", "a.md", "제목\n본문"), ("b.md", "sub", "sub/b.md", "t b"), ("d.md", "other", "/other/d.md", "")}
