"""Office documents from bytes: each parser maps a file's bytes to a result of one fixed shape.

A result has text, method, page_count, sections, error, encrypted, encryption_type, files_processed
and files_skipped; errors are values, never exceptions. Only the standard library is needed, but for
PDF and XLS, which use an optional reader when there is one.
"""

from __future__ import annotations

import datetime as dt
import io
import re
import struct
import unicodedata
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree as ET

#: Fixed value: character codes that stand with 14 more bytes in paragraph texts.
WIDE = {2, 3, 11, 12, 14, 15, 16, 17, 18, 21, 22, 23}
SHOWN = {10: "\n", 9: "\t", 30: " ", 31: " "}
IN_ARCHIVES = {".pdf", ".hwp", ".hwpx", ".xlsx", ".xls", ".xlsm", ".docx"}


def counts(text: str) -> dict:
    return {"word_count": len(text.split()), "char_count": len(text)}


def section(kind: str, title: str, text: str, order: int, page: int | None = None) -> dict:
    return {"section_type": kind, "section_title": title, "text": text, "section_order": order, "page_number": page, "source_file": None} | counts(text)


def result(text: str = "", method: str | None = None, sections: list[dict] = (), **more) -> dict:
    return {"text": text, "method": method, "page_count": None, "sections": list(sections), "error": None, "encrypted": None, "encryption_type": None, "files_processed": None, "files_skipped": None} | counts(text) | more


def failed(error: str, **more) -> dict:
    return result(error=error, **more)


def guarded(parse, data: bytes, label: str) -> dict:
    """An exception as a result; one that speaks of encryption marks the file as encrypted."""
    try:
        return parse(data)
    except Exception as e:  # noqa: BLE001 - any broken file becomes a row
        if re.search("decrypt|encrypt|password", str(e).lower()):
            return failed(f"{label} file appears to be encrypted: {e}", encrypted=True, encryption_type="unknown")
        return failed(str(e) or type(e).__name__)


def clean_text(text: str, keep_newlines: bool = False) -> str:
    """Without runs of Han ideographs and without characters of categories C (line ends too, unless kept)."""
    return "".join(c for c in text if not 0x4E00 <= ord(c) <= 0x9FFF and (unicodedata.category(c)[0] != "C" or keep_newlines and c in "\n\t"))


def local(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


# Compound files


class CompoundFile:
    """Streams of an OLE2 compound file, by path."""

    FREE = 0xFFFFFFFA

    def __init__(self, data: bytes):
        if data[:8] != b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1":
            raise ValueError("Not a valid OLE file")
        self.data = data
        self.sector, self.mini = 1 << struct.unpack_from("<H", data, 30)[0], 1 << struct.unpack_from("<H", data, 32)[0]
        self.cutoff = struct.unpack_from("<I", data, 56)[0]
        n_fat, first_dir, first_mini, first_difat = (struct.unpack_from("<I", data, k)[0] for k in (44, 48, 60, 68))
        places = [x for x in struct.unpack_from("<109I", data, 76) if x < self.FREE]
        seen = set()
        while first_difat < self.FREE and first_difat not in seen:
            seen.add(first_difat)
            row = struct.unpack_from(f"<{self.sector // 4}I", data, (first_difat + 1) * self.sector)
            places += [x for x in row[:-1] if x < self.FREE]
            first_difat = row[-1]
        self.fat = [x for p in places[:n_fat] for x in struct.unpack_from(f"<{self.sector // 4}I", data, (p + 1) * self.sector)]
        directory = self._chain(first_dir)
        self.entries = [self._entry(directory[k : k + 128]) for k in range(0, len(directory) - 127, 128)]
        self.mini_fat = struct.unpack(f"<{len(t) // 4}I", t) if first_mini < self.FREE and (t := self._chain(first_mini)) else ()
        self.mini_stream = self._chain(self.entries[0]["start"]) if self.entries and self.entries[0]["start"] < self.FREE else b""
        self.paths = dict(self._walk(self.entries[0]["child"], "")) if self.entries else {}

    def _entry(self, raw: bytes) -> dict:
        n, kind = struct.unpack_from("<HB", raw, 64)
        left, right, child = struct.unpack_from("<III", raw, 68)
        start, size = struct.unpack_from("<IQ", raw, 116)
        return {"name": raw[: max(0, n - 2)].decode("utf-16-le", "replace"), "kind": kind, "left": left, "right": right, "child": child, "start": start, "size": size & 0xFFFFFFFF}

    def _chain(self, at: int) -> bytes:
        out, seen = [], set()
        while at < self.FREE and at < len(self.fat) and at not in seen:
            seen.add(at)
            out.append(self.data[(at + 1) * self.sector : (at + 2) * self.sector])
            at = self.fat[at]
        return b"".join(out)

    def _walk(self, first: int, prefix: str) -> Iterator[tuple[str, int]]:
        todo, seen = [(first, prefix)], set()
        while todo:
            i, prefix = todo.pop()
            if i >= len(self.entries) or i in seen:
                continue
            seen.add(i)
            e = self.entries[i]
            todo += [(e["left"], prefix), (e["right"], prefix)]
            if e["kind"] == 1:
                todo.append((e["child"], f"{prefix}{e['name']}/"))
            elif e["kind"] == 2:
                yield f"{prefix}{e['name']}", i

    def read(self, path: str) -> bytes:
        e = self.entries[self.paths[path]]
        if e["size"] >= self.cutoff:
            return self._chain(e["start"])[: e["size"]]
        out, at, seen = [], e["start"], set()
        while at < self.FREE and at < len(self.mini_fat) and at not in seen:
            seen.add(at)
            out.append(self.mini_stream[at * self.mini : (at + 1) * self.mini])
            at = self.mini_fat[at]
        return b"".join(out)[: e["size"]]


# HWP


def records(data: bytes) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(offset, tag, level, size, data) of a stream of tagged records."""
    at = 0
    while at + 4 <= len(data):
        (word,), begin = struct.unpack_from("<I", data, at), at
        tag, level, size, at = word & 0x3FF, word >> 10 & 0x3FF, word >> 20, at + 4
        if size == 0xFFF:
            if at + 4 > len(data):
                return
            size, at = struct.unpack_from("<I", data, at)[0], at + 4
        yield begin, tag, level, size, data[at : at + size]
        at += size


def para_text(data: bytes) -> str:
    """UTF-16 units with control codes; halves of surrogate pairs are left out."""
    out, at = [], 0
    while at + 1 < len(data):
        code = data[at] | data[at + 1] << 8
        if code >= 32:
            out.append("" if 0xD800 <= code < 0xE000 else chr(code))
        else:
            out.append(SHOWN.get(code, ""))
        at += 16 if code in WIDE else 2
    return "".join(out)


def hwp_flags(header: bytes) -> dict:
    from ..functions.binary import HEADER_FLAGS

    if len(header) < 256:
        return {}
    bits = int.from_bytes(header[36:40], "little")
    return {"signature": header[:32].decode("utf-8", "replace").rstrip("\0"), "version": ".".join(str(header[k]) for k in (35, 34, 33, 32))} | {name: bool(bits >> n & 1) for n, name in HEADER_FLAGS.items()}


def hwp_gate(data: bytes) -> dict:
    """encrypted, encryption_type and error, without reading the document."""
    try:
        ole = CompoundFile(data)
    except Exception as e:  # noqa: BLE001
        return {"encrypted": False, "encryption_type": None, "error": str(e)}
    if "FileHeader" not in ole.paths:
        return {"encrypted": False, "encryption_type": None, "error": "No FileHeader stream"}
    header = ole.read("FileHeader")
    bits = int.from_bytes(header[36:40], "little") if len(header) >= 40 else 0
    kind = "password" if bits & 0x102 else "drm" if bits & 0x210 else "distribution" if bits & 0x4 else None
    return {"encrypted": kind in ("password", "drm"), "encryption_type": kind, "error": None}


def _utf16(data: bytes, at: int) -> tuple[str, int]:
    n = struct.unpack_from("<H", data, at)[0]
    return data[at + 2 : at + 2 + 2 * n].decode("utf-16-le", "replace"), at + 2 + 2 * n


def hwp_doc_info(data: bytes) -> dict | None:
    """Numbers, caret, binary items and Hangul fonts; None unless properties and mappings come first, in order."""
    rows = list(records(data))
    if len(rows) < 2 or rows[0][1] != 0x10 or rows[1][1] != 0x11 or len(rows[0][4]) < 26 or len(rows[1][4]) < 12:
        return None
    names = ("sections", "page_start", "footnote_start", "endnote_start", "picture_start", "table_start", "equation_start")
    info = dict(zip(names, struct.unpack_from("<7H", rows[0][4]), strict=True)) | dict(zip(("list_id", "para_id", "char_pos"), struct.unpack_from("<3I", rows[0][4], 14), strict=True))
    n_bin, n_hangul, n_english = struct.unpack_from("<3I", rows[1][4])
    info |= {"n_binary": n_bin, "n_hangul_fonts": n_hangul, "n_english_fonts": n_english, "binary": [], "hangul_fonts": [], "english_fonts": []}
    rest = rows[2:]
    try:
        for i, (_, tag, _, _, d) in enumerate(rest[:n_bin]):
            if tag != 0x12:
                return info
            flags = struct.unpack_from("<H", d)[0]
            item = {"index": i, "flags": flags, "abs_path": "", "rel_path": "", "bin_id": None, "extension": "", "is_embedded": bool(flags & 0xF)}
            if flags & 0xF:
                item["bin_id"] = struct.unpack_from("<H", d, 2)[0]
                item["extension"], _ = _utf16(d, 4)
            else:
                item["abs_path"], at = _utf16(d, 2)
                item["rel_path"], _ = _utf16(d, at)
            info["binary"].append(item)
        for i, (_, tag, _, _, d) in enumerate(rest[n_bin : n_bin + n_hangul]):
            if tag != 0x13:
                return info
            flags, (name, at) = d[0], _utf16(d, 1)
            font = {"index": i, "flags": flags, "name": name, "alt_name": "", "base_name": ""}
            if flags & 0x80:
                font["alt_name"], at = _utf16(d, at + 1)
            at += 10 if flags & 0x40 else 0
            if flags & 0x20:
                font["base_name"], _ = _utf16(d, at)
            info["hangul_fonts"].append(font)
    except (struct.error, IndexError):
        pass
    return info


def hwp_paragraphs(data: bytes) -> list[dict]:
    """Paragraphs of a section's records: a header opens one, its text closes it; headers without text vanish."""
    out, head, n = [], None, -1
    for _, tag, _, _, d in records(data):
        if tag == 0x42 and len(d) >= 22:
            n += 1
            head = dict(zip(("char_count", "control_mask"), struct.unpack_from("<II", d), strict=True)) | dict(zip(("char_shape_count", "range_tag_count", "line_align_count", "instance_id"), struct.unpack_from("<HHHI", d, 12), strict=True))
        elif tag == 0x43 and head is not None:
            out.append({"index": n, "text": para_text(d)} | head)
            head = None
    return out


def read_hwp(data: bytes) -> dict | None:
    """header, info, streams and sections (index, paragraphs, records); None if it is no such document."""
    ole = CompoundFile(data)
    header = hwp_flags(ole.read("FileHeader")) if "FileHeader" in ole.paths else {}
    unpack = (lambda d: zlib.decompress(d, -15)) if header.get("compressed", True) else (lambda d: d)
    if "DocInfo" not in ole.paths or (info := hwp_doc_info(raw := unpack(ole.read("DocInfo")))) is None:
        return None
    sections, i = [], 0
    while f"BodyText/Section{i}" in ole.paths:
        try:
            body = unpack(ole.read(f"BodyText/Section{i}"))
            sections.append({"index": i, "paragraphs": hwp_paragraphs(body), "data": body})
        except zlib.error:
            pass
        i += 1
    return {"header": header, "info": info, "doc_info": raw, "streams": sorted(ole.paths), "sections": sections}


def _sections(parts: list[tuple[int, str]]) -> list[dict]:
    return [section("bodytext", f"Section {i}", text, i) for i, text in parts]


def parse_hwp(data: bytes) -> dict:
    gate = hwp_gate(data)
    if gate["encrypted"]:
        return failed(f"HWP file is encrypted ({gate['encryption_type']})", encrypted=True, encryption_type=gate["encryption_type"])
    doc = read_hwp(data)
    if doc is None:
        return failed("Failed to parse HWP file (may be encrypted or corrupted)")
    parts = [(s["index"], "\n".join(p["text"] for p in s["paragraphs"] if p["text"])) for s in doc["sections"]]
    text, found = clean_text("\n\n".join(t for _, t in parts)), _sections(parts)
    if not text or not found:
        return failed("No text found in HWP file (may be image-based or encrypted)")
    return result(text, "hwp_extraction (proper parser)", found)


# HWPX


def hwpx_gate(names: list[str], version: str | None, strict: bool = False) -> dict:
    """encrypted and encryption_type from an archive's member names and its version.xml.

    The word `encrypt` anywhere there counts; strict asks for encrypted="true"."""
    low = (version or "").lower()
    if "Contents/EncryptedPackage" in names:
        kind = "package"
    elif ('encrypted="true"' if strict else "encrypt") in low:
        kind = "standard"
    elif "Contents/section0.xml" not in names and "Contents/header.xml" in names:
        kind = "unknown"
    else:
        kind = None
    return {"encrypted": kind is not None, "encryption_type": kind}


def hwpx_paragraphs(xml: bytes, dedupe_nested: bool = False) -> list[dict]:
    """Paragraphs in document order: texts of `t`, tabs and line breaks below each `p`.

    A `p` within another one is counted in both, unless dedupe_nested."""
    root, out = ET.fromstring(xml), []

    def below(e: ET.Element) -> Iterator[ET.Element]:
        yield e
        for c in e:
            if not (dedupe_nested and local(c) == "p"):
                yield from below(c)

    for p in root.iter():
        if local(p) == "p":
            text = "".join((e.text or "") if local(e) == "t" else {"tab": "\t", "lineBreak": "\n"}.get(local(e), "") for e in below(p))
            if text or len(p):
                out.append({"index": len(out), "text": text, "style_id": p.get("styleIDRef", ""), "para_id": p.get("id", "")})
    return out


def read_hwpx(data: bytes, dedupe_nested: bool = False) -> dict | None:
    """Everything the archive says: numbers, fonts, styles, binary items, caret, sections; None without a readable header."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()

        def tree(name: str) -> ET.Element | None:
            try:
                return ET.fromstring(z.read(name)) if name in names else None
            except ET.ParseError:
                return None

        head = tree("Contents/header.xml")
        if head is None:
            return None
        doc = {"files": names, "section_count": int(head.get("secCnt", "0")), "fonts": [], "char_properties": [], "styles": [], "binary": [], "caret": None, "version": None, "sections": []}
        begin = next((e for e in head.iter() if "beginNum" in e.tag), None)
        doc["begin"] = {k: int(begin.get(k, "1")) for k in ("page", "footnote", "endnote", "pic", "tbl", "equation")} if begin is not None else {}
        refs = next((e for e in head.iter() if "refList" in e.tag), None)
        for e in refs.iter() if refs is not None else ():
            if local(e) == "fontface":
                doc["fonts"] += [{"index": len(doc["fonts"]) + k, "face": f.get("face", ""), "font_type": f.get("type", ""), "is_embedded": f.get("isEmbedded", "0") == "1", "lang": e.get("lang", ""), "family_type": next((t.get("familyType", "") for t in f if local(t) == "typeInfo"), "")} for k, f in enumerate(c for c in e if local(c) == "font")]
            elif local(e) == "charPr":
                doc["char_properties"].append({"index": len(doc["char_properties"]), "char_id": e.get("id", ""), "height": e.get("height", "")})
            elif local(e) == "style":
                doc["styles"].append({"index": len(doc["styles"]), "style_id": e.get("id", ""), "name": e.get("name", ""), "style_type": e.get("type", "")})
        if (v := tree("version.xml")) is not None:
            doc["version"] = {"version": v.get("version", "N/A"), "app_version": next((c.get("version", "") for c in v if local(c) == "application"), None)}
        if (s := tree("settings.xml")) is not None and (c := next((e for e in s.iter() if "CaretPosition" in e.tag), None)) is not None:
            doc["caret"] = {"list_id": int(c.get("listIDRef", "0")), "para_id": int(c.get("paraIDRef", "0")), "char_pos": int(c.get("pos", "0"))}
        if (m := tree("Contents/content.hpf")) is not None:
            items = [e for e in m.iter() if "item" in e.tag and e.get("href", "").startswith("BinData/")]
            doc["binary"] = [{"index": i, "item_id": e.get("id", ""), "href": e.get("href"), "media_type": e.get("media-type", ""), "is_embedded": e.get("isEmbeded", "0") == "1"} for i, e in enumerate(items)]
        i = 0
        while (name := f"Contents/section{i}.xml") in names:
            try:
                doc["sections"].append({"index": i, "paragraphs": hwpx_paragraphs(z.read(name), dedupe_nested)})
            except ET.ParseError:
                pass
            i += 1
    return doc


def parse_hwpx(data: bytes) -> dict:
    if not zipfile.is_zipfile(io.BytesIO(data)):
        return failed("Not a valid ZIP file")
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        gate = hwpx_gate(z.namelist(), z.read("version.xml").decode("utf-8", "replace") if "version.xml" in z.namelist() else None)
    if gate["encrypted"]:
        return failed(f"HWPX file is encrypted ({gate['encryption_type']})", **gate)
    doc = read_hwpx(data)
    if doc is None:
        return failed("Failed to parse HWPX file (may be encrypted or corrupted)")
    parts = [(s["index"], "\n".join(p["text"] for p in s["paragraphs"] if p["text"])) for s in doc["sections"]]
    text, found = clean_text("\n\n".join(t for _, t in parts)), _sections(parts)
    if not text or not found:
        return failed("No text found in HWPX file (may be image-based or encrypted)")
    return result(text, "hwpx_extraction (XML parser)", found)


# Spreadsheets and word processing


def _number(raw: str) -> str:
    """A stored number as a cell value prints: whole ones without a fraction."""
    x = float(raw)
    return str(int(x)) if x.is_integer() and "." not in raw and "e" not in raw.lower() else repr(x)


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def shared_text(si: ET.Element) -> str:
    """A shared string: its runs without the phonetic ones."""
    return "".join(t.text or "" for e in si if local(e) in ("t", "r") for t in ([e] if local(e) == "t" else e) if local(t) == "t")


#: Numbers of the built-in formats that show a date or a time.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}


def date_styles(xml: bytes) -> dict[int, bool]:
    """Cell styles (by index) whose number format shows a date or time; True for elapsed hours, minutes or seconds."""
    root, out = ET.fromstring(xml), {}
    codes = {int(f.get("numFmtId")): f.get("formatCode", "") for f in root.iter() if local(f) == "numFmt"}
    for i, xf in enumerate(x for part in root if local(part) == "cellXfs" for x in part if local(x) == "xf"):
        number = int(xf.get("numFmtId", "0"))
        code = codes.get(number, "").split(";")[0].lower()
        elapsed = bool(re.search(r"\[(h+|m+|s+)\]", code)) or number == 46
        bare = re.sub(r'"[^"]*"|\\.|_.|\*.|\[(?!h+\]|m+\]|s+\])[^\]]*\]', "", code)
        if number in DATE_FORMATS and number not in codes or re.search("[dmhysaeg]", bare) and bare != "general":
            out[i] = elapsed
    return out


def shown_date(raw: str, elapsed: bool, since_1904: bool) -> str:
    """A stored day number as a date, time or span prints; fractions to the millisecond."""
    x = float(raw)
    days, part = divmod(x, 1)
    span = dt.timedelta(milliseconds=round(part * 86_400_000))
    if elapsed:
        return str(dt.timedelta(days=days) + span)
    if 0 <= x < 1 and not span.days:
        return str((dt.datetime.min + span).time())
    if 0 < x < 60 and not since_1904:
        days += 1  # the day that the calendar of 1900 has too many
    return str(dt.datetime(1904, 1, 1) + dt.timedelta(days=days) + span if since_1904 else dt.datetime(1899, 12, 30) + dt.timedelta(days=days) + span)


def sheet_rows(xml: bytes, shared: list[str], dates: dict[int, bool] | None = None, since_1904: bool = False) -> Iterator[list[str]]:
    width, rows = 0, {}
    for row in (e for e in ET.fromstring(xml).iter() if local(e) == "row"):
        cells = {}
        for i, c in enumerate(e for e in row if local(e) == "c"):
            at = _column(c.get("r")) if c.get("r") else i
            value = next((v.text or "" for v in c if local(v) == "v"), None)
            kind = c.get("t", "n")
            if kind == "inlineStr":
                value = "".join(shared_text(e) for e in c if local(e) == "is")
            elif value and kind == "n" and (style := int(c.get("s", "0"))) in (dates or {}):
                try:
                    value = shown_date(value, dates[style], since_1904)
                except (OverflowError, ValueError):
                    value = "#VALUE!"
            elif value is not None:
                value = shared[int(value)] if kind == "s" else ("True" if value == "1" else "False") if kind == "b" else _number(value) if kind == "n" and value else value
            cells[at] = value or ""
        rows[int(row.get("r", len(rows) + 1))] = cells
        width = max(width, max(cells, default=-1) + 1)
    for r in sorted(rows):
        yield [rows[r].get(k, "") for k in range(width)]


def parse_xlsx(data: bytes) -> dict:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = [shared_text(si) for si in ET.fromstring(z.read("xl/sharedStrings.xml")) if local(si) == "si"] if "xl/sharedStrings.xml" in names else []
        dates = date_styles(z.read("xl/styles.xml")) if "xl/styles.xml" in names else {}
        since_1904 = any(local(e) == "workbookPr" and e.get("date1904") in ("1", "true") for e in ET.fromstring(z.read("xl/workbook.xml")).iter())
        rels = {r.get("Id"): r.get("Target", "") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        found = []
        for order, s in enumerate((e for e in ET.fromstring(z.read("xl/workbook.xml")).iter() if local(e) == "sheet"), 1):
            target = rels.get(next((v for k, v in s.attrib.items() if k.endswith("}id")), ""), "")
            path = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            lines = ["\t".join(r) for r in sheet_rows(z.read(path), shared, dates, since_1904)] if path in names else []
            text = "\n".join(x for x in lines if x.strip())
            if text.strip():
                found.append(section("sheet", s.get("name", ""), text, order))
    if not found:
        return failed("No text content found in Excel file (may be empty or image-based)")
    return result("\n\n".join(f"Sheet: {s['section_title']}\n{s['text']}" for s in found), "xlsx", found)


def parse_xls(data: bytes) -> dict:
    try:
        import xlrd
    except ImportError:
        return failed("XLS library not installed")
    found = []
    for order, sheet in enumerate(xlrd.open_workbook(file_contents=data).sheets(), 1):
        lines = ["\t".join(str(c.value) for c in sheet.row(r)) for r in range(sheet.nrows)]
        text = "\n".join(x for x in lines if x.strip())
        if text.strip():
            found.append(section("sheet", sheet.name, text, order))
    return result("\n\n".join(f"Sheet: {s['section_title']}\n{s['text']}" for s in found), "xlrd", found) if found else failed("No text content found in Excel file (may be empty or image-based)")


def docx_paragraph(p: ET.Element) -> str:
    return "".join((e.text or "") if local(e) == "t" else {"tab": "\t", "br": "\n", "cr": "\n"}.get(local(e), "") for r in p.iter() if local(r) == "r" for e in r)


def table_rows(table: ET.Element) -> Iterator[list[str]]:
    """The texts of a table by grid column: a merged cell stands in each column and row it covers."""
    above: list[str] = []
    for row in (r for r in table if local(r) == "tr"):
        now: list[str] = []
        for cell in (c for c in row if local(c) == "tc"):
            set_ = {local(e): e for p in cell if local(p) == "tcPr" for e in p}
            value = lambda name, s=set_: next((v for k, v in s[name].attrib.items() if k.endswith("}val") or k == "val"), None) if name in s else None
            text = "\n".join(docx_paragraph(p) for p in cell if local(p) == "p")
            if "vMerge" in set_ and value("vMerge") != "restart" and len(now) < len(above):
                text = above[len(now)]
            now += [text] * max(1, int(value("gridSpan") or 1))
        yield now
        above = now


def parse_docx(data: bytes) -> dict:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = next(e for e in ET.fromstring(z.read("word/document.xml")) if local(e) == "body")
    parts = [t for p in body if local(p) == "p" and (t := docx_paragraph(p)).strip()]
    for n, table in enumerate((t for t in body if local(t) == "tbl"), 1):
        rows = ["\t".join(row) for row in table_rows(table)]
        parts.append(f"\n[Table {n}]\n" + "\n".join(rows) + "\n")
    text = "\n".join(parts)
    return result(text, "docx", [section("document", "Full Document", text, 1)])


def pdf_result(pages: list[str], method: str) -> dict:
    found = [section("page", f"Page {n}", t, n, n) for n, t in enumerate(pages, 1) if t]
    return result("\n\n".join(s["text"] for s in found), method, found, page_count=len(pages))


def pdf_pages(data: bytes) -> tuple[list[str], str]:
    """Text of each page, with the first reader there is that can read the file."""
    readers, error = [], None
    try:
        import pdfplumber

        readers.append(("pdfplumber", lambda f: [p.extract_text() or "" for p in pdfplumber.open(f).pages]))
    except ImportError:
        pass
    try:
        import pypdf

        readers.append(("pypdf", lambda f: [p.extract_text() or "" for p in pypdf.PdfReader(f).pages]))
    except ImportError:
        pass
    for method, read in readers:
        try:
            return read(io.BytesIO(data)), method
        except Exception as e:  # noqa: BLE001 - the next reader may do better
            error = e
    raise error or ImportError("PDF libraries not installed")


def parse_pdf(data: bytes) -> dict:
    return pdf_result(*pdf_pages(data))


# Dispatch

PARSERS = {".pdf": (parse_pdf, "PDF"), ".hwp": (parse_hwp, "HWP"), ".hwpx": (parse_hwpx, "HWPX"), ".xlsx": (parse_xlsx, "Excel"), ".xlsm": (parse_xlsx, "Excel"), ".xls": (parse_xls, "Excel"), ".docx": (parse_docx, "Word")}


def extension(name: str) -> str:
    base = name.rpartition("/")[2]
    return "." + base.rpartition(".")[2].lower() if "." in base.lstrip(".") else ""


def parse_single(name: str, data: bytes) -> dict:
    ext = extension(name)
    return guarded(PARSERS[ext][0], data, PARSERS[ext][1]) if ext in PARSERS else failed(f"Unsupported file type: {ext}")


def banner(name: str) -> str:
    return f"\n{'=' * 60}\n📄 {name}\n{'=' * 60}\n"


def parse_zip(data: bytes) -> dict:
    """Supported members in order of name, their sections numbered on; members with neither error nor text count nowhere."""
    if not zipfile.is_zipfile(io.BytesIO(data)):
        return failed("Not a valid ZIP file")
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        infos = [i for i in z.infolist() if not i.is_dir()]
        if any(i.flag_bits & 1 for i in z.infolist()):
            return failed("ZIP file is password-protected", encrypted=True)
        members = sorted((i.filename for i in infos if extension(i.filename) in IN_ARCHIVES))
        if not members:
            return failed("ZIP contains no supported document types")
        parts, found, done, skipped = [], [], 0, 0
        for path in members:
            name = path.rpartition("/")[2]
            r = guarded(lambda _, p=path: parse_single(p, z.read(p)), b"", "ZIP")
            if r["error"]:
                skipped += 1
            elif r["text"]:
                parts.append(banner(name) + r["text"])
                found += [s | {"section_title": f"[{name}] {s['section_title']}", "section_order": len(found) + k, "source_file": name} for k, s in enumerate(r["sections"], 1)]
                done += 1
    text = "\n\n".join(parts)
    if not text.strip():
        return failed(f"No text extracted from {len(members)} files in ZIP")
    return result(text, "zip_extraction", found, files_processed=done, files_skipped=skipped)


def parse_file(name: str, data: bytes | None) -> dict:
    """Any supported file, by its extension."""
    ext = extension(name)
    if data is None:
        return failed("File not found")
    if ext == ".doc":
        return failed(".doc format not supported (only .docx)")
    return guarded(parse_zip, data, "ZIP") if ext == ".zip" else parse_single(name, data)


def summary(doc: dict, kind: str) -> dict:
    """What the document reader alone reports: titles and orders from 1."""
    parts = [(s["index"] + 1, "\n".join(p["text"] for p in s["paragraphs"] if p["text"])) for s in doc["sections"]]
    return result("\n\n".join(t for _, t in parts), "zipfile+xml", [section("section", f"Section {i}", t, i) for i, t in parts]) | {"kind": kind}


def dump(doc: dict) -> str:
    """A readable account of a document that read_hwp or read_hwpx has read."""
    lines = [f"{k}: {v}" for k, v in doc.items() if k not in ("sections", "doc_info")]
    for s in doc["sections"]:
        lines.append(f"[Section {s['index']}] {len(s['paragraphs'])} paragraphs")
        lines += [f"  {p['index']}: {p['text']}" for p in s["paragraphs"]]
    return "\n".join(lines)
