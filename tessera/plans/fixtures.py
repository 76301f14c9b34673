"""Small inputs that the generated tables lack: Korean text, markup, tracker and wiki JSON, office files."""

from __future__ import annotations

import io
import json
import struct
import zipfile
import zlib
from collections.abc import Sequence
from hashlib import sha256

KOREAN = [
    (1, "안녕하세요. 반갑습니다.\n오늘은 날씨가 좋네요. 내일은요?"),
    (2, "첫 문장입니다。둘째 문장．셋째，넷째"),
    (3, "본문 - 3 - 끝입니다. 다음 쪽"),
    (4, "12345"),
    (5, "b... c"),
    (6, " \t\n"),
    (7, "값은 3.14 이다. 확인하세요! 정말?"),
]
HAN = [(1, "漢字 한글\nabc\tdef"), (2, "a​b\x07c"), (3, "")]
MARKDOWN = [
    (1, "---\ntitle: x\n---\n# 제목\n\n본문 **굵게** _기울임_ `code` [링크](http://a) #태그 끝"),
    (2, "![alt](u) ![](v) [[page|name]] [[only]]"),
    (3, "> 인용\n\n---\n\n- 항목\n1. 하나\n\n```py\nx = 1\n```\nsnake_case_name"),
    (4, "줄\r\n# 머리\r\n끝"),
    (5, ""),
]
WIKI = [(1, "h1. *bold* _it_ [site|http://x] [~user] {code:java}z{code}"), (2, "{panel:title=x}안녕{panel} {color:red}빨강{color} !img-1.png!"), (3, None), (4, "a\n\n\n\nb  \t c {noformat}raw{noformat}"), (5, "[x]")]
ADF_TREE = {"type": "doc", "content": [
    {"type": "paragraph", "content": [{"type": "text", "text": "hello"}, {"type": "mention", "attrs": {"text": "@kim"}}, {"type": "emoji", "attrs": {"shortName": ":ok:"}}]},
    {"type": "bulletList", "content": [{"type": "listItem", "content": [{"type": "paragraph", "content": [{"type": "text", "text": "하나"}]}]}]},
]}
ADF = [(1, json.dumps(ADF_TREE, ensure_ascii=False)), (2, "[]"), (3, "not json"), (4, None)]
ISSUES = [
    {"key": "AB-1", "fields": {"summary": "로그인 오류", "status": {"name": "완료", "statusCategory": {"name": "Done"}}, "assignee": {"displayName": "Kim"}, "project": {"key": "AB"}, "description": ADF_TREE, "comment": {"comments": [{"body": "h1. *bold* [site|http://x]"}, {"body": ""}]}}},
    {"key": "AB-2", "fields": {"summary": "느림", "status": {"name": "진행 중"}, "assignee": None, "description": "그냥 글"}},
    {"key": "AB-3", "fields": {"summary": "", "status": {"name": "할일", "statusCategory": {"name": "To Do"}}}},
    {"key": "AB-4", "fields": {"summary": "x" * 120}},
]
PAGES = [
    {"id": "p1", "object": "page", "url": "https://n/p1", "last_edited_time": "2024-01-01T00:00:00Z", "properties": {"이름": {"type": "title", "title": [{"plain_text": "회의록"}]}}},
    {"id": "p2", "object": "page", "properties": {"Etc": {"type": "title", "title": [{"plain_text": "기타"}]}, "Name": {"type": "text"}}},
    {"id": "p3", "object": "page", "properties": {}},
    {"id": "d1", "object": "database", "properties": {"Name": {"type": "title", "title": [{"plain_text": "목록"}]}}},
    {"id": "u1", "properties": {}},
]


def _rich(kind: str, text: str, **more) -> dict:
    return {"type": kind, kind: {"rich_text": [{"plain_text": text}], **more}}


BLOCKS = [
    ("p1", 0, {"id": "b0", "has_children": True} | _rich("paragraph", "문단")),
    ("p1", 1, _rich("heading_1", "머리")),
    ("p1", 2, _rich("bulleted_list_item", "점")),
    ("p1", 3, _rich("code", "x=1", language="python")),
    ("p1", 4, _rich("to_do", "할 일", checked=True)),
    ("p1", 5, {"type": "divider", "divider": {}}),
    ("p1", 6, {"type": "child_page", "child_page": {"title": "아래"}}),
    ("p1", 7, {"type": "child_database", "child_database": {}}),
    ("p1", 8, {"type": "bookmark", "bookmark": {"url": "http://x"}}),
    ("p1", 9, {"type": "embed", "embed": {}}),
    ("p1", 10, {"type": "pdf", "pdf": {"caption": [{"plain_text": "그림"}]}}),
    ("p1", 11, {"type": "image", "image": {}}),
    ("p1", 12, {"type": "unknown_kind"}),
    ("b0", 0, {"id": "b1", "has_children": True} | _rich("quote", "인용")),
    ("b1", 0, _rich("paragraph", "손자")),
    ("p2", 0, _rich("numbered_list_item", "수")),
    ("p2", 1, _rich("to_do", "남음")),
]
PROMPTS = [(1, "완료된 작업 목록"), (2, "진행중인 이슈"), (3, "SEND-22에 대해 설명해줘"), (4, "done or in progress"), (5, "small"), (6, "할일 보여줘")]
PATHS = [(1, "/vault/a.md"), (2, "/vault/.hidden/a.md"), (3, "/vault/x/.b.md"), (4, "a.b/c.md")]
NAMES = [(1, "AB - x - y"), (2, "  http://x/y// "), (3, "a\\b\\c"), (4, "bge-m3:v1"), (5, "문서" * 60)]


class HashEmbedder:
    """A deterministic stand-in for a model: vectors from a digest of the text."""

    model = "hash-16"

    def embed(self, texts: Sequence[str]) -> list[list[float] | None]:
        return [[(b - 127.5) / 127.5 for b in sha256(t.encode()).digest()[:16]] for t in texts]


def zipped(members: dict[str, bytes | str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data)
    return out.getvalue()


def record(tag: int, data: bytes, level: int = 0) -> bytes:
    size = min(len(data), 0xFFF)
    return struct.pack("<I", tag | level << 10 | size << 20) + (struct.pack("<I", len(data)) if size == 0xFFF else b"") + data


def hwp_doc_info() -> bytes:
    name = "바탕"
    return record(0x10, struct.pack("<7H3I", 1, 1, 1, 1, 1, 1, 1, 0, 0, 5)) + record(0x11, struct.pack("<18I", 1, 1, *[0] * 16)) + record(0x12, struct.pack("<HHH", 1, 3, 3) + "png".encode("utf-16-le")) + record(0x13, b"\x00" + struct.pack("<H", 2) + name.encode("utf-16-le"))


def hwp_section() -> bytes:
    head = struct.pack("<IIHBBHHHI", 3, 0, 0, 0, 0, 1, 0, 1, 7)
    text = "안녕 漢字 hello".encode("utf-16-le") + struct.pack("<H", 9) + struct.pack("<H", 11) + b"\0" * 14 + "끝😀".encode("utf-16-le") + struct.pack("<H", 13)
    return record(0x42, head) + record(0x43, text, 1) + record(0x42, head) + record(0x42, head) + record(0x43, "둘째 문단".encode("utf-16-le"), 1)


def hwp_file(flags: int = 1) -> bytes:
    header = (b"HWP Document File".ljust(32, b"\0") + bytes([1, 0, 0, 5]) + struct.pack("<I", flags)).ljust(256, b"\0")
    pack = (lambda d: (c := zlib.compressobj(6, zlib.DEFLATED, -15)).compress(d) + c.flush()) if flags & 1 else (lambda d: d)
    return compound({"FileHeader": header, "DocInfo": pack(hwp_doc_info()), "BodyText/Section0": pack(hwp_section())})


def compound(streams: dict[str, bytes]) -> bytes:
    """A small OLE2 file with these streams: all sectors of 512 bytes, no mini stream."""
    end, free, sector = 0xFFFFFFFE, 0xFFFFFFFF, 512
    names = ["Root Entry", *sorted({p.split("/")[0] for p in streams if "/" in p}), *streams]
    body, fat, starts = b"", [], {}
    for path, data in streams.items():
        padded = data.ljust(max(4096, -(-len(data) // sector) * sector), b"\0")
        n = len(padded) // sector
        starts[path] = (len(fat), max(len(data), 4096) if len(data) < 4096 else len(data))
        fat += [*range(len(fat) + 1, len(fat) + n), end]
        body += padded
    index = {n: i for i, n in enumerate(names)}
    top = [n for n in names[1:] if "/" not in n]

    def entry(name: str) -> bytes:
        children = top if name == "Root Entry" else [p for p in streams if p.startswith(name + "/")]
        group = top if "/" not in name else [p for p in streams if p.split("/")[0] == name.split("/")[0] and "/" in p]
        k = group.index(name) if name in group else -1
        right = index[group[k + 1]] if name != "Root Entry" and k + 1 < len(group) else free
        kind = 5 if name == "Root Entry" else 2 if name in streams else 1
        start, size = starts.get(name, (end if kind == 5 else 0, 0))
        label = name.rpartition("/")[2].encode("utf-16-le")
        return label.ljust(64, b"\0") + struct.pack("<HBBIII", len(label) + 2, kind, 1, free, right, index[children[0]] if kind != 2 and children else free) + b"\0" * 36 + struct.pack("<IQ", start, size)

    directory = b"".join(map(entry, names))
    directory = directory.ljust(-(-len(directory) // sector) * sector, b"\0")
    first_dir = len(fat)
    n = len(directory) // sector
    fat += [*range(first_dir + 1, first_dir + n), end]
    n_fat = -(-(len(fat) + 2) // 128)
    first_fat = len(fat)
    fat += [0xFFFFFFFD] * n_fat
    table = b"".join(struct.pack("<I", x) for x in fat).ljust(n_fat * sector, b"\xff")
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 6 + struct.pack("<IIIIIIIII", 0, n_fat, first_dir, 0, 4096, end, 0, end, 0)
    head += b"".join(struct.pack("<I", first_fat + i if i < n_fat else free) for i in range(109))
    return head + body + directory + table


def hwpx_file(**more) -> bytes:
    section = '<s:sec xmlns:s="s" xmlns:p="p"><p:p id="1" styleIDRef="0"><p:run><p:t>첫째<p:tab/>꼬리</p:t></p:run><p:lineBreak/><p:tbl><p:p id="2"><p:t>안쪽</p:t></p:p></p:tbl></p:p><p:p id="3"/></s:sec>'
    header = '<h:head xmlns:h="h" secCnt="1"><h:beginNum page="2"/><h:refList><h:fontfaces><h:fontface lang="HANGUL" fontCnt="1"><h:font face="바탕" type="TTF"><h:typeInfo familyType="F"/></h:font></h:fontface></h:fontfaces><h:charProperties><h:charPr id="0" height="1000"/></h:charProperties><h:styles><h:style id="0" name="본문" type="PARA"/></h:styles></h:refList></h:head>'
    return zipped({"version.xml": '<v version="1.2"><application version="9"/></v>', "Contents/header.xml": header, "Contents/section0.xml": section, "settings.xml": '<a><CaretPosition listIDRef="0" paraIDRef="3" pos="7"/></a>', "Contents/content.hpf": '<p><manifest><item id="i" href="BinData/a.png" media-type="image/png" isEmbeded="1"/></manifest></p>'} | more)


def xlsx_file() -> bytes:
    ns = 'xmlns="m" xmlns:r="r"'
    return zipped({
        "xl/workbook.xml": f'<workbook {ns}><sheets><sheet name="하나" r:id="r1"/><sheet name="빈" r:id="r2"/><sheet name="셋" r:id="r3"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="worksheets/sheet2.xml"/><Relationship Id="r3" Target="/xl/worksheets/sheet3.xml"/></Relationships>',
        "xl/sharedStrings.xml": "<sst><si><t>이름</t></si><si><r><t>a</t></r><r><t>b</t></r></si></sst>",
        "xl/worksheets/sheet1.xml": '<worksheet><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>42</v></c></row><row r="2"/><row r="3"><c r="A3" t="s"><v>1</v></c><c r="B3"><v>1.5</v></c><c r="C3" t="b"><v>1</v></c></row></sheetData></worksheet>',
        "xl/worksheets/sheet2.xml": "<worksheet><sheetData/></worksheet>",
        "xl/worksheets/sheet3.xml": '<worksheet><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>끝</t></is></c></row></sheetData></worksheet>',
    })


def docx_file() -> bytes:
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    return zipped({"word/document.xml": f'<w:document xmlns:w="w"><w:body>{p("첫 문단")}{p(" ")}<w:tbl><w:tr><w:tc>{p("가")}</w:tc><w:tc>{p("나")}</w:tc></w:tr></w:tbl>{p("끝 문단")}</w:body></w:document>'})


def office_files() -> list[tuple[str, bytes]]:
    return [
        ("a.hwp", hwp_file()), ("locked.hwp", hwp_file(3)), ("b.hwpx", hwpx_file()), ("sealed.hwpx", hwpx_file(**{"Contents/EncryptedPackage": "x"})), ("c.xlsx", xlsx_file()), ("d.docx", docx_file()),
        ("e.zip", zipped({"in/d.docx": docx_file(), "c.xlsx": xlsx_file(), "bad.docx": b"x", "readme.txt": "no"})), ("f.doc", b"x"), ("g.txt", b"x"), ("h.zip", b"not a zip"), ("i.hwp", b"not ole"),
    ]


def vault_files() -> list[tuple[str, bytes]]:
    return [("/vault/a.md", "# 제목\n본문 #태그".encode()), ("/vault/sub/b.md", "[t](u) **b**".encode()), ("/vault/.trash/c.md", b"hidden"), ("/other/d.md", b"\xff\xfe")]
