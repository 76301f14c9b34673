import datetime
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.config import Config
from tessera.operators import embed, rag, stats, store, vector
from tessera.plans.fixtures import HashEmbedder
from tessera.plans import ask
from tessera.streaming.incremental import run_incremental


def test_upserts(spark):
    now = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "k string, v int, s string")
    new = spark.createDataFrame([("b", 2, "z"), ("c", 2, "w")], "k string, v int, s string")
    once = store.upsert_latest(now, new, ["k"], [F.col("v")])
    assert sorted(map(tuple, once.collect())) == [("a", 1, "x"), ("b", 2, "z"), ("c", 2, "w")]
    assert sorted(map(tuple, store.upsert_latest(once, new, ["k"], [F.col("v")]).collect())) == sorted(map(tuple, once.collect()))
    assert sorted(map(tuple, store.upsert_partial(now, new, "k", ["v"]).collect())) == [("a", 1, "x"), ("b", 2, "y"), ("c", 2, "w")]


def test_pending_and_its_quirk(spark):
    s = spark.createDataFrame([(f"s{i:02d}", "t" * 60, i) for i in range(20)], "section_id string, text string, extracted_at int")
    done = s.where("extracted_at < 10").select("section_id")
    assert [r["section_id"] for r in store.pending(s, done, limit=3).collect()] == ["s10", "s11", "s12"]
    assert store.pending(s, done, limit=3, compat=True).count() == 0


def test_sync(spark):
    schema = "section_id string, model_name string, text_snippet string, char_count int"
    a, b = spark.createDataFrame([("x", "m", "abc", 900)], schema), spark.createDataFrame([("x", "m", "old", 1), ("y", "m", "k", 1)], schema)
    assert sorted(map(tuple, store.sync(a, b).collect())) == [("x", "m", "abc", 900), ("y", "m", "k", 1)]
    assert store.sync(a, b, preserve_char_count=False).where("section_id = 'x'").first()["char_count"] == 3


def test_vector_store_and_embedding_job(spark, tmp_path):
    s = store.ParquetVectorStore(spark, f"file://{tmp_path}/store")
    s.initialize()
    s.initialize()
    sections = spark.createDataFrame([(f"s{i}", "b1", f"{i} " * 40, datetime.datetime(2024, 1, i + 1)) for i in range(8)] + [("short", "b1", "x", datetime.datetime(2024, 1, 1)), ("blank", "b1", " " * 60, datetime.datetime(2024, 2, 1))], "section_id string, bid_id string, text string, extracted_at timestamp")
    assert embed.embedding_job(sections, s, HashEmbedder(), limit=3) == {"generated": 3, "errors": 0, "total": 3, "backend": "parquet"}
    assert embed.embedding_job(sections, s, HashEmbedder()) == {"generated": 5, "errors": 1, "total": 6, "backend": "parquet"}
    assert s.count() == 8 and s.existing_ids("hash-16").count() == 8 and s.existing_ids("other").count() == 0
    best = embed.search_text(s, HashEmbedder(), "3 " * 40, k=2, min_similarity=None).collect()
    assert best[0]["section_id"] == "s3" and math.isclose(best[0]["similarity"], 1, abs_tol=1e-6)
    assert embed.search_text(s, HashEmbedder(), " ").count() == 0


def test_choose_store():
    broken = lambda: 1 / 0
    assert embed.choose_store([("pg", broken), ("files", lambda: "f")]) == "f"
    with pytest.raises(ZeroDivisionError):
        embed.choose_store([("pg", broken), ("files", lambda: "f")], force="pg")
    with pytest.raises(RuntimeError):
        embed.choose_store([("pg", broken)])


def test_embedding_requests_go_in_groups_and_again(monkeypatch):
    calls, naps = [], []
    e = embed.HttpEmbedder("http://none", concurrency=2, pause=0.5, retries=1)

    class Answer:
        def __enter__(self):
            return self

        def __exit__(self, *_):
            return False

        def read(self):
            return b'{"embedding": [1.0]}'

    def send(request, timeout):
        calls.append(request.data)
        if b"bad" in request.data or calls.count(request.data) == 1 and b"flaky" in request.data:
            raise OSError("refused")
        return Answer()

    monkeypatch.setattr(embed.urllib.request, "urlopen", send)
    monkeypatch.setattr(embed.time, "sleep", naps.append)
    assert e.embed(["a", "flaky", "bad", "b", "c"]) == [[1.0], [1.0], None, [1.0], [1.0]] and len(calls) == 7 and naps == [0.5] * 4


def test_batch_search_of_odd_vectors(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, 0.0, 0.0]), (6, [None, 1.0]), (7, [0.0, 3.0]), (1, [1.0, 0.0])], "vec_id long, embedding array<float>")
    queries = spark.createDataFrame([("a", [3.0, 0.0]), ("b", [0.0, 0.0, 1.0]), ("c", None), ("d", [0.0, 0.0])], "query_id string, query_embedding array<float>")
    got = sorted(map(tuple, vector.top_k_batch(corpus, queries, 3).collect()))
    assert got == [("a", 1, 1, 1.0), ("a", 2, 1, 1.0), ("a", 3, 2, 1.0), ("b", 1, 5, 0.0)]
    assert vector.top_k_batch(corpus.where("false"), queries, 3).count() == 0 and vector.top_k_batch(corpus, queries, 3, 0.5).count() == 3


def test_batch_search_in_blocks(spark, sf, monkeypatch):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    q = e.where("vec_id < 30").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    whole = sorted(map(tuple, vector.top_k_batch(e, q, 3).collect()))
    for name, value in (("QUERY_BYTES", 7 * 64 * 8), ("QUERY_STRIP", 3), ("PAIRS", 5)):
        monkeypatch.setattr(vector, name, value)
    assert sorted(map(tuple, vector.top_k_batch(e, q, 3).collect())) == whole


@pytest.mark.parametrize(("k", "least"), [(1, None), (4, None), (50, None), (4, 0.3), (400, 0.0)])
def test_best_of_batches(monkeypatch, k, least):
    """Batches with copies, zero, short and missing vectors, and many ties, as all scores sorted give them."""
    monkeypatch.setattr(vector, "QUERY_STRIP", 7)
    monkeypatch.setattr(vector, "PAIRS", 40)
    r = np.random.default_rng(k)
    rows = [(f"k{i:03d}", None if i % 29 == 0 else [0.0] * 4 if i % 31 == 0 else [1.0, 2.0] if i % 37 == 0 else [1.0, 1.0, 0.0, 0.0] if i % 3 == 0 else r.normal(size=4).tolist()) for i in range(300)]
    asked = [(i, r.normal(size=4).tolist()) for i in range(19)] + [(20, [1.0, 1.0, 0.0, 0.0]), (21, [2.0, 1.0])]
    batches = (pd.DataFrame(rows[n : n + 40], columns=["key", "e"]).assign(e=lambda d: d["e"].map(lambda e: e if e is None else np.array(e))) for n in range(0, 300, 40))
    got = pd.concat(list(vector.best_of(batches, asked, k, least)))
    for q, e in asked:
        scores = [(-(np.array(x) * np.array(e)).sum() / (np.sqrt((np.array(x) ** 2).sum()) * np.sqrt((np.array(e) ** 2).sum())), key) for key, x in rows if x and len(x) == len(e) and any(x)]
        want = sorted((s, key) for s, key in scores if least is None or -s >= least)[:k]
        mine = got[got["q"] == q]
        assert list(mine["key"]) == [key for _, key in want] and np.allclose(mine["similarity"], [-s for s, _ in want])


def test_routing(spark):
    cases = {"완료된 작업 목록": ("done", True), "진행중인 이슈": ("progress", False), "SEND-22에 대해 설명해줘": (None, False), "done or in progress": ("done", False), "small": (None, True), "할일": ("pending", False)}
    got = spark.createDataFrame([(p,) for p in cases], "p string").select("p", rag.intent(F.col("p")).alias("i"), rag.wants_list(F.col("p")).alias("l"), rag.passages(F.col("p"), 12).alias("k")).collect()
    assert {r["p"]: (r["i"], r["l"]) for r in got} == cases and all(r["k"] == (12 if r["l"] else 5) for r in got)


def test_status_block_goes_first(spark):
    issues = spark.createDataFrame([("AB-1", "로그인", "완료", "Done"), ("AB-2", "느림", "진행", "In Progress")], "key string, summary string, status string, status_category string")
    block = rag.status_context(issues, "done").first()[0]
    assert block == "\n\n[완료 상태 이슈 1개]\n- AB-1: 로그인 (상태: 완료)\n" and rag.status_context(issues, "pending").first()[0] is None
    hits = spark.createDataFrame([(1, 2, None, "둘", block), (1, 1, "s", "하나", block)], "query_id int, rank int, source string, text string, status string")
    assert rag.assemble_context(hits, status="status").first()["context"] == rag.SEPARATOR.join([block, "[출처: s]\n하나", "[출처: unknown]\n둘"])


def test_a_swap_that_broke_off_loses_nothing(spark, tmp_path):
    path = tmp_path / "t"
    assert store.read_version(spark, str(path)) is None
    path.mkdir()
    (path / "NEXT").write_text('{"ver')  # the first pointer, cut off
    assert store.read_version(spark, str(path)) is None
    store.write_version(spark.range(3), str(path))
    (path / ".CURRENT.crc").unlink(missing_ok=True)
    (path / "CURRENT").rename(path / "NEXT")  # a later swap, between delete and rename
    assert store.read_version(spark, str(path)).count() == 3
    store.write_version(spark.range(5), str(path))
    assert store.read_version(spark, str(path)).count() == 5 and not (path / "NEXT").exists()


@pytest.mark.parametrize("most", [4096, 7])
def test_row_numbers_over_many_ranges(spark, monkeypatch, most):
    monkeypatch.setattr(stats, "MAX_RANGES", most)
    df = spark.range(5000).select(((F.col("id") * 7919) % 5003 - 2000).alias("v")).unionByName(spark.sql("select cast(null as long) as v"))
    got = stats.with_row_number(df, "v", range_rows=100).collect()
    want = [None, *sorted((i * 7919) % 5003 - 2000 for i in range(5000))]
    assert [r["v"] for r in sorted(got, key=lambda r: r["row_no"])] == want and sorted(r["row_no"] for r in got) == list(range(5001))
    assert stats.with_row_number(df.where("false"), "v").count() == 0


def test_old_versions_go(spark, tmp_path):
    path = f"{tmp_path}/t"
    names = [store.write_version(spark.range(i), path) for i in range(1, 6)]
    left = {p.name for p in (tmp_path / "t").iterdir() if p.name.startswith("v-")}
    assert len(left) == store.KEPT and names[-1] in left


def test_upserts_write_touched_buckets_only(spark, tmp_path):
    path = f"{tmp_path}/t"
    rows = lambda ids, value, at: spark.createDataFrame([(i, value, at) for i in ids], "id long, value string, at int")
    put = lambda df: store.upsert_version(df, path, ["id"], [F.col("at")], buckets=8)
    got = lambda: {r["id"]: r["value"] for r in store.read_version(spark, path).collect()}
    put(rows(range(100), "a", 1))
    first = store._state(spark, path)["parts"]
    assert len(first) == 8 and got() == dict.fromkeys(range(100), "a")
    put(rows([5, 200], "b", 2))
    second = store._state(spark, path)["parts"]
    assert sum(first[k] != second[k] for k in first) <= 2 and got() == dict.fromkeys(range(100), "a") | {5: "b", 200: "b"}
    put(rows([5], "old", 0))  # an older row does not win
    assert got()[5] == "b" and put(rows([], "x", 1)) is None and len(got()) == 101
    for n in range(4):
        put(rows([5], f"c{n}", 3 + n))
    left = {f"{p.parent.name}/{p.name}" for p in (tmp_path / "t").glob("v-*/_b=*")}
    state = store._state(spark, path)
    live = {*state["parts"].values(), *(f for x in state["before"] for f in x)}
    assert left == live and len(left) < 8 + 2 + 5 and got()[5] == "c3" and len(got()) == 101
    with pytest.raises(ValueError, match="kept by"):
        store.upsert_version(rows([1], "a", 1), path, ["value"], [F.col("at")])


def test_a_whole_table_is_dealt_into_buckets(spark, tmp_path):
    path = f"{tmp_path}/t"
    store.write_version(spark.range(50).withColumn("at", F.lit(1)), path)
    store.upsert_version(spark.range(49, 52).withColumn("at", F.lit(2)), path, ["id"], [F.col("at")], buckets=4)
    assert {r["id"]: r["at"] for r in store.read_version(spark, path).collect()} == dict.fromkeys(range(49), 1) | dict.fromkeys(range(49, 52), 2)
    assert len(store._state(spark, path)["parts"]) == 4


def test_row_numbers_with_ties(spark):
    rows = spark.createDataFrame([(i // 7, i % 7) for i in range(500)], "a long, b int")
    got = stats.with_row_number(rows, "a", range_rows=40, then=("b",)).collect()
    assert all(r["row_no"] == r["a"] * 7 + r["b"] for r in got) and len(got) == 500


def test_row_numbers_over_ranges(spark, monkeypatch):
    df = spark.range(0, 250_000, 1, 4).select((F.col("id") * 7 % 250_000).alias("v"))
    got = stats.with_row_number(df, "v")
    assert got.where("row_no <> v").count() == 0 and got.count() == 250_000


def test_incremental_stream(spark, tmp_path):
    src, target, mark = (f"{tmp_path}/{x}" for x in ("src", "target", "mark"))
    schema = "k string, v int"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    put([("a", 1), ("b", 1)])
    run = lambda: run_incremental(spark, src, schema, target, mark, ["k"], [F.col("v")])
    assert run() == 1 and run() == 0
    put([("b", 5), ("c", 1)])
    assert run() == 1
    assert sorted(map(tuple, store.read_version(spark, target).collect())) == [("a", 1), ("b", 5), ("c", 1)]


def test_index_and_answer(spark, tmp_path):
    chunks = spark.createDataFrame([(i, f"text {i}", f"s{i}") for i in range(40)], "place int, chunk string, source string")
    path, n = ask.index_chunks(chunks, HashEmbedder(), f"file://{tmp_path}/index", "place")
    assert n == 40 and ask.index_chunks(chunks.where("false"), HashEmbedder(), f"file://{tmp_path}/none", "place") == (None, 0)
    index = store.read_version(spark, path)
    assert {r["chunk_id"]: r["place"] for r in index.collect()} == {f"chunk_{i}": i for i in range(40)}
    issues = spark.createDataFrame([("AB-1", "a", "done", "Done")], "key string, summary string, status string, status_category string")
    context = ask.find_context(index, HashEmbedder(), "text 7", issues).first()["context"]
    assert context.startswith("[출처: s7]\ntext 7") and context.count("출처") == 5
    listed = ask.find_context(index, HashEmbedder(), "완료 목록", issues).first()["context"]
    assert listed.startswith("\n\n[완료 상태 이슈 1개]") and listed.count("출처") == 30

    class Echo:
        def chat(self, system, prompt):
            yield from (system[:3], prompt)

    assert list(ask.answer(index, HashEmbedder(), Echo(), "text 7")) == [rag.PROMPT[:3], "text 7"]


def test_config():
    assert Config.from_env({"CHUNK_SIZE": "300", "OTHER": "x"}).chunk_size == 300 and Config().top_k_results == 5


@pytest.mark.parametrize("range_rows", [7, 10_000])
def test_large_containers_are_numbered_in_ranges(spark, range_rows):
    rows = [("big", i * 7 % 101, f"m{i}", None if i % 9 == 0 else f"t{i}") for i in range(101)] + [(None, i, "m", "t") for i in range(5)] + [("small", None, "m", "t"), ("small", 3, "m", "t")]
    out = stats.renumber(spark.createDataFrame(rows, "c string, o int, m string, t string"), "c", ["o"], "t", "m", range_rows).collect()
    got = {(r["c"], r["o"]): (r["section_order"], r["t"]) for r in out}
    for c in ("big", None, "small"):
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1]))
        assert [got[c, r[1]] for r in own] == [(n, f"[{r[2]}] {r[3] or ''}") for n, r in enumerate(own, 1)]
    assert len(out) == len(rows)


def test_batch_search_holds_bounded_strips():
    """Queries travel as matrices, and a batch of Spark's size meets few of them at once."""
    import tracemalloc

    rng = np.random.default_rng(3)
    asked = vector.by_length((i, v.tolist()) for i, v in enumerate(rng.normal(size=(2000, 8))))
    batch = pd.DataFrame({"key": range(10_000), "e": list(rng.normal(size=(10_000, 8)))})
    tracemalloc.start()
    try:
        found = pd.concat(list(vector.best_of(iter([batch]), asked, 5, None)))
        assert tracemalloc.get_traced_memory()[1] < 100e6 and len(found) == 10_000
    finally:
        tracemalloc.stop()


def test_korean_texts_are_cleaned_once(spark, sf):
    from tessera.plans import catalogue

    plan = catalogue.QUERIES["clean_korean_fixture"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("- \\p{Nd}++ -") <= 2  # one for the odd texts, one for the documents
