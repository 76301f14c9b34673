"""Fields of binary headers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Header flags by bit, and record tags by number.
HEADER_FLAGS = {0: "compressed", 1: "encrypted", 2: "distributed", 3: "script", 4: "drm", 5: "xml_template", 6: "history", 7: "cert_signed", 8: "cert_encrypted", 9: "cert_drm", 10: "ccl"}
TAGS = {
    0x010: "DOCUMENT_PROPERTIES", 0x011: "ID_MAPPINGS", 0x012: "BIN_DATA", 0x013: "FACE_NAME", 0x014: "BORDER_FILL", 0x015: "CHAR_SHAPE", 0x016: "TAB_DEF", 0x017: "NUMBERING",
    0x018: "BULLET", 0x019: "PARA_SHAPE", 0x01A: "STYLE", 0x01B: "DOC_DATA", 0x01C: "DISTRIBUTE_DOC_DATA", 0x01E: "COMPATIBLE_DOCUMENT", 0x01F: "LAYOUT_COMPATIBILITY",
    0x042: "PARA_HEADER", 0x043: "PARA_TEXT", 0x044: "PARA_CHAR_SHAPE", 0x045: "PARA_LINE_SEG", 0x046: "PARA_RANGE_TAG", 0x047: "CTRL_HEADER", 0x048: "LIST_HEADER", 0x049: "PAGE_DEF",
    0x04A: "FOOTNOTE_SHAPE", 0x04B: "PAGE_BORDER_FILL",
}


def u32(content: Column, at: int) -> Column:
    """Little-endian unsigned 32 bits of a binary column at a byte offset."""
    digits = F.hex(F.substring(content, at + 1, 4))
    return F.conv(F.concat(*[F.substring(digits, 7 - 2 * k, 2) for k in range(4)]), 16, 10).cast("long")


def bit(flags: Column, n: int) -> Column:
    return F.shiftright(flags, n).bitwiseAND(F.lit(1)) == 1


def header_flags(flags: Column) -> Column:
    return F.struct(*[bit(flags, n).alias(name) for n, name in HEADER_FLAGS.items()])


def encryption_type(flags: Column) -> Column:
    """password, drm or distribution (not encrypted, may be read), or null."""
    return F.when(bit(flags, 1) | bit(flags, 8), "password").when(bit(flags, 4) | bit(flags, 9), "drm").when(bit(flags, 2), "distribution")


def is_encrypted(flags: Column) -> Column:
    return encryption_type(flags).isin("password", "drm").eqNullSafe(True)


def record_header(word: Column) -> Column:
    """(tag_id, level, size) of a record's first 32 bits; size 4095 says that the next 32 bits hold it."""
    low = lambda c, n: c.bitwiseAND(F.lit((1 << n) - 1))
    return F.struct(low(word, 10).alias("tag_id"), low(F.shiftright(word, 10), 10).alias("level"), low(F.shiftright(word, 20), 12).alias("size"))


def tag_name(tag_id: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in TAGS.items() for x in kv])
    return F.coalesce(F.try_element_at(names, tag_id.cast("int")), F.format_string("UNKNOWN_0x%03X", tag_id))


def has_hidden_part(path: Column) -> Column:
    return F.exists(F.split(path, "/"), lambda p: F.startswith(p, F.lit(".")))


def version_text(content: Column) -> Column:
    """Four version bytes at offset 32, most significant last."""
    byte = lambda k: F.conv(F.hex(F.substring(content, k + 1, 1)), 16, 10)
    return F.concat_ws(".", byte(35), byte(34), byte(33), byte(32))


def error_means_encrypted(message: Column) -> Column:
    return F.lower(message).rlike("decrypt|encrypt|password")
