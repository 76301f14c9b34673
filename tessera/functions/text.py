"""Text cleaning, splitting and counting as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that count as white space (the body of a character class).
SPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
S = f"[{SPACE}]"
SENTENCE = r"[^.!?。]*+[.!?。] *+|[^.!?。]++\z"
#: Lengths after which a stored snippet, a text to embed, and an id's prefix are cut.
SNIPPET, EMBED_CHARS, ID_PREFIX = 500, 6000, 80


def _chain(c: Column, *steps: tuple[str, str]) -> Column:
    for pattern, by in steps:
        c = F.regexp_replace(c, pattern, by)
    return c


def strip(c: Column) -> Column:
    """Without white space (Unicode's) at either end."""
    return F.regexp_replace(c, rf"\A{S}++|{S}++\z", "")


def clean_korean_text(c: Column) -> Column:
    """White space collapsed; a text of digits only emptied; page footers removed; full-width stops replaced; stripped."""
    # Lone spaces stay as they are, so only other runs of white space cost a replacement.
    c = _chain(c, (f"[{SPACE}&&[^ ]]{S}*+| {S}++", " "), (r"\A\p{Nd}++ ?\z", ""), (r"- \p{Nd}++ -", ""))
    return F.trim(F.translate(c, "．，", ".,"))


def split_sentences(cleaned: Column) -> Column:
    """Array of stripped, non-empty sentences of a text that clean_korean_text() has cleaned."""
    return F.filter(F.transform(F.regexp_extract_all(cleaned, F.lit(SENTENCE), F.lit(0)), lambda s: F.trim(s)), lambda s: s != "")


def strip_han_control(c: Column, keep_newlines: bool = False) -> Column:
    """Without Han ideographs and without characters of the Unicode categories C (line ends and tabs too, unless kept)."""
    return _chain(c, ("[一-鿿]+", ""), (r"[\p{C}&&[^\n\t]]" if keep_newlines else r"\p{C}", ""))


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(f"[^{SPACE}]++"))


def char_count(c: Column) -> Column:
    return F.length(c)


def unix_lines(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


#: Markdown markers, in the order in which they are removed.
MARKDOWN = (
    (r"(?s)\A---\n.*?\n---\n", ""),
    (r"\[([^\]]+)\]\([^)]+\)", "$1"),
    (r"\[\[([^\]|]+)(?:\|[^\]]+)?\]\]", "$1"),
    (r"!\[([^\]]*)\]\([^)]+\)", ""),
    (r"(?s)```.*?```", ""),
    (r"`[^`]+`", ""),
    (rf"(?md)^#{{1,6}}{S}+", ""),
    (r"\*{1,2}([^*]+)\*{1,2}", "$1"),
    (r"_{1,2}([^_]+)_{1,2}", "$1"),
    (rf"(?md)^>{S}*", ""),
    (rf"(?md)^[-*_]{{3,}}{S}*$", ""),
    (rf"(?md)^{S}*[-*+]{S}+", ""),
    (rf"(?md)^{S}*\p{{Nd}}+\.{S}+", ""),
    (r"#[a-zA-Z가-힣][a-zA-Z0-9가-힣_/-]*", ""),
)
#: Issue-tracker markup, in the order in which it is removed.
WIKI = (
    (r"(?s)\{code[^}]*\}.*?\{code\}", ""),
    (r"(?s)\{noformat\}.*?\{noformat\}", ""),
    (r"\{panel[^}]*\}", ""),
    (r"\{color[^}]*\}", ""),
    (rf"(?md)^h[1-6]\.{S}*", ""),
    (r"\*([^*]+)\*", "$1"),
    (r"_([^_]+)_", "$1"),
    (r"\[([^|]+)\|[^\]]+\]", "$1"),
    (r"\[([^\]]+)\]", "$1"),
    (r"![\p{L}\p{N}_\-.]+!", ""),
    (r"\[~[^\]]+\]", ""),
    (r"\n{3,}", "\n\n"),
    (r"[ \t]+", " "),
)


def markdown_to_text(c: Column) -> Column:
    """Markdown without its markers. Image links with a text keep `!text`, as the link rule comes first."""
    return strip(_chain(unix_lines(c), *MARKDOWN))


def clean_jira_markup(c: Column) -> Column:
    """Wiki markup as plain text; null gives an empty text."""
    return strip(_chain(F.coalesce(c, F.lit("")), *WIKI))


def remove_nul(c: Column) -> Column:
    return F.regexp_replace(c, r"\x00", "")


def unix_path(c: Column) -> Column:
    return F.translate(c, "\\", "/")


def section_id(document_id: Column, order: Column) -> Column:
    return F.concat(F.left(document_id, F.lit(ID_PREFIX)), F.lit("_sec_"), order.cast("string"))


def collection_name(session: str, name: Column) -> Column:
    return F.concat(F.lit(f"rag-{session[:8]}-"), F.left(F.md5(name), F.lit(8)))


def snippet(c: Column) -> Column:
    return F.left(c, F.lit(SNIPPET))


def for_embedding(c: Column) -> Column:
    return F.left(c, F.lit(EMBED_CHARS))


def vector_literal(c: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: x.cast("string")), ","), F.lit("]"))


def trim_url(c: Column) -> Column:
    return F.regexp_replace(strip(c), r"/+\z", "")


def model_matches(available: Column, wanted: str) -> Column:
    """Whether two model names agree, tags after the colon aside."""
    return F.split(available, ":")[0] == wanted.split(":")[0]


def project_label(key: Column, name: Column) -> Column:
    return F.concat(key, F.lit(" - "), name)


def project_key(label: Column) -> Column:
    return F.substring_index(label, " - ", 1)
