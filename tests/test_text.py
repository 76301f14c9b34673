import re
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import binary, text
from tessera.operators import chunk
from tessera.sources import jira, parsers


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first()["r"]


def test_space_class_is_pythons(spark):
    chars = [chr(i) for i in range(1, 0x10000) if not 0xD800 <= i < 0xE000]
    got = spark.createDataFrame([(c,) for c in chars], "c string").where(F.col("c").rlike(rf"\A{text.S}\z")).collect()
    assert {r["c"] for r in got} == {c for c in chars if re.fullmatch(r"\s", c)}


def test_clean_korean_text(spark):
    cases = {"  가　나\xa0\x1c다 ": "가 나 다", "123\n": "", "１２": "", "a 12": "a 12", "앞 - 3 - 뒤": "앞  뒤", "끝．그리고，": "끝.그리고,", "": ""}
    assert {k: one(spark, k, text.clean_korean_text) for k in cases} == cases


def test_sentences(spark):
    f = lambda c: text.split_sentences(text.clean_korean_text(c))
    assert one(spark, "안녕하세요. 네! 3.14 끝。다음 ", f) == ["안녕하세요.", "네!", "3.", "14 끝。", "다음"]
    assert one(spark, "b... c", f) == ["b.", ".", ".", "c"] and one(spark, "", f) == []


def test_markdown_rules(spark):
    cases = {"![a](u)": "!a", "![](u)": "", "snake_case_name": "snakecasename", "# 제목\n본문": "제목\n본문", "---\na: 1\n---\n글": "글", "글\n---\n글": "글\n\n글", "```\nx\n```끝": "끝", "- a\n- b": "a\nb", "#태그 뒤": "뒤", "[[a|b]] [[c]]": "a c"}
    assert {k: one(spark, k, text.markdown_to_text) for k in cases} == cases


def test_wiki_rules(spark):
    cases = {"h2. 머리\n글": "머리\n글", "{code:py}x{code}끝": "끝", "[글|http://x] [~kim] [y]": "글 ~kim y", "a\n\n\n\nb": "a\n\nb", "!그림-1.png!": ""}
    assert {k: one(spark, k, text.clean_jira_markup) for k in cases} == cases


def test_category_c_is_removed(spark):
    sample = "a\nb\tc​d\x07e漢字f\U0001f600"
    assert one(spark, sample, text.strip_han_control) == "".join(c for c in sample if unicodedata.category(c)[0] != "C" and not "一" <= c <= "鿿")
    assert parsers.clean_text(sample, keep_newlines=True) == one(spark, sample, lambda c: text.strip_han_control(c, True))


def greedy(lengths, size, overlap):
    """Chunks as lists of sentence places, packed one sentence after the other."""
    joined = lambda rows: sum(lengths[i] for i in rows) + max(0, len(rows) - 1)
    out, now, total = [], [], 0
    for i, n in enumerate(lengths):
        if now and total + n > size:
            out.append(now)
            keep = now
            while keep and joined(keep) > overlap:
                keep = keep[1:]
            now, total = keep, joined(keep)
        now, total = [*now, i], total + n
    return [*out, now] if now else out


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.integers(1, 60), max_size=40), min_size=1, max_size=30), st.integers(20, 120), st.integers(0, 40))
def test_packing_equals_the_fold(spark, docs, size, overlap):
    got = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, l array<int>").select("i", chunk.pack(F.col("l"), size, overlap).alias("c")).collect()
    for r in got:
        assert [list(range(c["s"], c["e"])) for c in r["c"]] == greedy(docs[r["i"]], size, overlap)


def test_chunks_keep_boundaries(spark):
    fifty, more = "가" * 49 + ".", "가" * 50 + "."
    df = spark.createDataFrame([(1, fifty, "x"), (2, more, "y"), (3, None, "z"), (4, "", "z")], "doc_id int, text string, n_chars string")
    assert [(r["doc_id"], r["chunk_pos"], r["n_chars"]) for r in chunk.chunk_documents(df).collect()] == [(2, 0, 51)]


def test_header_flags(spark):
    for flags, kind in ((0, None), (2, "password"), (0x100, "password"), (0x10, "drm"), (0x212, "password"), (4, "distribution")):
        assert one(spark, flags, binary.encryption_type, "long") == kind
    data = bytes(36) + (0x12345678).to_bytes(4, "little")
    assert one(spark, bytearray(data), lambda c: binary.u32(c, 36), "binary") == 0x12345678


def test_deep_tree():
    tree = {"type": "text", "text": "x"}
    for _ in range(50_000):
        tree = {"type": "doc", "content": [tree]}
    assert jira.adf_text(tree) == "x"
