"""The stored vector index: recall, exactness, and what an upsert writes."""

import duckdb
import numpy as np
import pytest

from tessera.operators import index
from tessera.operators.index import VectorIndex

SCHEMA = "vec_id long, embedding array<float>"


def clustered(n=3000, centres=30, dim=16, seed=2):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dim))
    x = c[rng.integers(0, centres, n)] + 0.15 * rng.normal(size=(n, dim))
    return [(i, v) for i, v in enumerate(x.astype(np.float32).tolist())]


AWKWARD = [(-1, None), (-2, []), (-3, [0.0] * 16), (-4, [float("nan")] + [1.0] * 15), (-5, [1.0] * 15), (None, [1.0] * 16), (-6, [None] + [1.0] * 15)]


def exactly(rows, asked, k, least=None):
    """(query, rank, key) by a full scan in plain numpy."""
    good = {i: np.array(v, float) for i, v in rows if i is not None and v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)}
    keys = sorted(good)
    x = np.stack([good[i] / np.sqrt((good[i] ** 2).sum()) for i in keys])
    out = set()
    for q, v in asked:
        if v is None or len(v) != 16 or None in v or not np.isfinite(v).all() or not any(v):
            continue
        s = x @ (np.array(v, float) / np.sqrt((np.array(v, float) ** 2).sum()))
        order = sorted(range(len(keys)), key=lambda j: (-round(s[j], 12), keys[j]))
        out |= {(q, r, keys[j]) for r, j in enumerate([j for j in order if least is None or s[j] >= least][:k], 1)}
    return out


def ask(spark, rows):
    return spark.createDataFrame([(q, v) for q, v in rows], "query_id long, query_embedding array<float>")


def keyed(df):
    return {(r[0], r[1], r[2]) for r in df.collect()}


@pytest.mark.parametrize(("cell", "queries"), [(16_384, 1024), (50, 7)])
def test_exact_is_a_full_scan_and_skips_lists(spark, tmp_path, monkeypatch, cell, queries):
    monkeypatch.setattr(index, "CELL", cell)
    monkeypatch.setattr(index, "QUERIES", queries)
    rows = clustered()
    rows += [(10_000 + i, rows[0][1]) for i in range(200)]  # many equal vectors, so ties
    ix = VectorIndex(spark, str(tmp_path / "ix"))
    ix.build(spark.createDataFrame(rows + AWKWARD, SCHEMA).repartition(3))
    assert ix.count() == len(rows)
    asked = [r for r in rows if r[0] % 50 == 0] + AWKWARD[:5]
    got = ix.exact(ask(spark, asked), 7)
    assert keyed(got) == exactly(rows, asked, 7)
    lists = len(ix.state()["lists"])
    assert ix.last_visits.count() < 0.25 * lists * (len(asked) - 5)
    assert keyed(ix.exact(ask(spark, asked), 7, 0.97)) == exactly(rows, asked, 7, 0.97)
    assert keyed(ix.exact(ask(spark, asked[:3]), 10_000, 0.5)) == exactly(rows, asked[:3], 10_000, 0.5)


def test_probes_reach_the_recall(spark, tmp_path):
    rows = clustered(seed=4)
    ix = VectorIndex(spark, str(tmp_path / "ix"))
    ix.build(spark.createDataFrame(rows, SCHEMA))
    asked = rows[::40]
    want = {(q, key) for q, _, key in exactly(rows, asked, 10)}
    lists = ix.state()["lists"]
    got = {(q, key) for q, _, key in keyed(ix.top_k(ask(spark, asked), 10, probes=len(lists) // 6))}
    assert len(got & want) >= 0.9 * len(want)


def test_an_upsert_writes_only_what_it_touches(spark, tmp_path):
    rows = clustered(seed=6)
    ix = VectorIndex(spark, str(tmp_path / "ix"))
    ix.build(spark.createDataFrame(rows[:2900], SCHEMA))
    before = ix.state()["parts"]
    new = [*rows[2900:2903], (0, rows[1][1]), (1, None)]  # three new ones, one that moves, one that goes
    touched = ix.upsert(spark.createDataFrame(new, SCHEMA))
    after = ix.state()["parts"]
    assert {x for x in {*before, *after} if before.get(x) != after.get(x)} <= set(touched)
    assert sum(x.startswith("list/") for x in touched) <= 6 < len(before) / 4
    now = [r for r in rows[2:2903]] + [(0, rows[1][1])]
    assert ix.count() == len(now)
    asked = rows[:30] + rows[2890:2903]
    assert keyed(ix.exact(ask(spark, asked), 5)) == exactly(now, asked, 5)
    assert ix.upsert(spark.createDataFrame([], SCHEMA)) == [] and ix.count() == len(now)


def test_the_last_row_of_a_key_stays(spark, tmp_path):
    from pyspark.sql import functions as F

    ix = VectorIndex(spark, str(tmp_path / "ix"))
    table = spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [0.0, 1.0], 2), (2, [1.0, 1.0], 1)], SCHEMA + ", at int")
    ix.build(table, order=[F.col("at")])
    got = ix.exact(spark.createDataFrame([(9, [0.0, 2.0])], "query_id long, query_embedding array<float>"), 2).collect()
    assert [(r["vec_id"], round(r["similarity"], 6)) for r in got] == [(1, 1.0), (2, 0.707107)]


def test_an_empty_index(spark, tmp_path):
    ix = VectorIndex(spark, str(tmp_path / "ix"))
    ix.build(spark.createDataFrame([], SCHEMA))
    q = ask(spark, [(1, [1.0] * 16)])
    assert ix.count() == 0 and ix.exact(q).count() == ix.top_k(q).count() == 0


def test_indexed_topk_recall(spark, sf):
    from tessera.plans import catalogue

    got = {(r["query_id"], r["vec_id"]) for r in catalogue.QUERIES["indexed_topk"](spark, sf).collect()}
    c = duckdb.connect()
    c.sql(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    want = {(r[0], r[1]) for r in c.sql(f"select query_id, vec_id from ({catalogue.TOP})").fetchall()}
    assert len(got) == len(want) and len(got & want) >= 0.9 * len(want)


def test_workers_hold_a_bounded_number_of_scores():
    """Large groups and many lists go through strip by strip, whatever the batch."""
    import tracemalloc

    import pandas as pd

    rng = np.random.default_rng(3)
    frame = lambda name, n: pd.DataFrame({name: range(n), "e": list(rng.normal(size=(n, 8)))})
    rows, asked = frame("key", 16_000), frame("q", 1000)
    tracemalloc.start()
    try:
        got = index.best_in_group(5, None)(rows, asked)
        assert tracemalloc.get_traced_memory()[1] < 40e6
    finally:
        tracemalloc.stop()
    x, y = np.stack(rows["e"].to_numpy()), np.stack(asked["e"].to_numpy()[:50])
    s = (y @ x.T) / np.sqrt((x * x).sum(axis=1)) / np.sqrt((y * y).sum(axis=1))[:, None]
    want = np.argsort(-s, axis=1)[:, :5]
    assert len(got) == 5000 and got["key"].to_numpy().reshape(-1, 5)[:50].tolist() == want.tolist()


def test_visits_leave_vectors_behind(spark, tmp_path, monkeypatch):
    seen = []
    monkeypatch.setattr(index, "written", lambda df, label, real=index.written: (seen.append((label, df.columns)), real(df, label))[1])
    monkeypatch.setattr(index, "PAIRS", 50)
    rows = clustered(400)
    ix = VectorIndex(spark, str(tmp_path / "ix"))
    ix.build(spark.createDataFrame(rows, SCHEMA))
    asked = [(7, rows[0][1]), *rows[:30]]
    assert {x for x in keyed(ix.exact(ask(spark, asked), 5)) if x[0] != 7} == {x for x in exactly(rows, asked[1:], 5) if x[0] != 7}
    tables = {label: columns for label, columns in seen}
    assert "index-others" in tables and all("e" not in tables[x] for x in ("index-nearest", "index-others"))
