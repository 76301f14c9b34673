"""Tables that grow: merged reads, splits, bytes written, commits over several tables, conflicts, feeds."""

import random
from pathlib import Path

import pytest
from pyspark.errors import PySparkException

from tessera.operators import lake
from tessera.operators.lake import Conflict, Lake

SCHEMA = "id long, at int, v string"


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(lake, "BUCKET_ROWS", 100)
    monkeypatch.setattr(lake, "DELTAS", 3)


def rows(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def got(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def files(path):
    return {str(f) for f in Path(path).rglob("*.parquet")}


def size(names):
    return sum(Path(f).stat().st_size for f in names)


def test_random_upserts_and_deletions_equal_a_plain_dict(spark, tmp_path, small):
    t, r, want, gone = Lake(spark, str(tmp_path / "l")), random.Random(3), {}, set()
    t.create("t", SCHEMA, ["id"], ["at"])
    assert got(t.read("t")) == {}
    for turn in range(7):
        new = [(r.randrange(400), r.randrange(5), f"{turn}-{i}") for i in range(150)]
        new = list({x[0]: x for x in new}.values())
        t.upsert("t", rows(spark, new))
        for i, at, v in new:
            if i not in want or at >= want[i][0]:
                want[i] = (at, v)
        if turn % 3 == 1:
            gone = {r.randrange(400) for _ in range(60)}
            t.transact(lambda x, gone=gone: x.delete("t", rows(spark, [(i, None, None) for i in gone])))
            want = {i: x for i, x in want.items() if i not in gone}
        assert got(t.read("t")) == want
    names = t.table("t").buckets
    assert len(names) >= 4 and sum(2.0 ** -len(b) for b in names) == 1  # the prefixes cover every hash once
    t.compact("t")
    assert got(t.read("t")) == want and all(len(f) <= 1 for f in t.table("t").buckets.values())
    plan = t.read("t")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan


def test_an_upsert_of_few_keys_writes_little(spark, tmp_path, small):
    t = Lake(spark, str(tmp_path / "l"))
    t.create("t", SCHEMA, ["id"])
    t.upsert("t", rows(spark, [(i, 0, "x" * 200 + str(i)) for i in range(4000)]))
    t.compact("t")
    assert len(t.table("t").buckets) >= 32
    before, buckets = files(tmp_path), t.table("t").buckets
    t.upsert("t", rows(spark, [(i, 1, "new") for i in (5, 1700, 3999, 9000)]))
    new = files(tmp_path) - before
    assert len(new) <= 4 and size(new) < size(before) / 10
    assert sum(f != buckets[b] for b, f in t.table("t").buckets.items()) <= 4
    now = got(t.read("t"))
    assert len(now) == 4001 and now[1700] == (1, "new") and now[6] == (0, "x" * 200 + "6")


def test_two_tables_appear_together(spark, tmp_path):
    t = Lake(spark, str(tmp_path / "l"))
    t.transact(lambda x: (x.create("sections", SCHEMA, ["id"]), x.create("flags", "id long, done boolean", ["id"])))
    flags = lambda i: spark.createDataFrame([(i, True)], "id long, done boolean")
    broken = t.begin()
    broken.upsert("sections", rows(spark, [(1, 0, "a")]))  # and the writer is lost here
    assert got(t.read("sections")) == got(t.read("flags")) == {}
    x = t.begin()
    x.upsert("sections", rows(spark, [(1, 0, "a")]))
    x.upsert("flags", flags(1))
    assert got(t.read("sections")) == {}
    version = x.commit()
    assert got(t.read("sections")) == {1: (0, "a")} and got(t.read("flags")) == {1: (True,)}
    assert got(t.read("sections", version - 1)) == got(t.read("flags", version - 1)) == {}


def test_interleaved_writers(spark, tmp_path):
    t = Lake(spark, str(tmp_path / "l"))
    t.create("t", SCHEMA, ["id"])
    t.upsert("t", rows(spark, [(1, 1, "one"), (2, 1, "two")]))
    a, b = t.begin(), t.begin()
    for x, name in ((a, "a"), (b, "b")):
        x.upsert("t", x.read("t").where("id = 1").selectExpr("id", "at + 1 as at", f"concat(v, '{name}') as v"))
    a.commit()
    with pytest.raises(Conflict):
        b.commit()
    tries = []

    def again(x):
        tries.append(1)
        x.upsert("t", x.read("t").where("id = 1").selectExpr("id", "at + 1 as at", "concat(v, 'b') as v"))
        if len(tries) == 1:
            t.upsert("t", rows(spark, [(2, 5, "other writer")]))

    t.transact(again)
    assert len(tries) == 2 and got(t.read("t")) == {1: (3, "oneab"), 2: (5, "other writer")}
    # Writers that do not read go one after the other, unless the bucket was rewritten.
    a, b, c = t.begin(), t.begin(), t.begin()
    a.upsert("t", rows(spark, [(3, 0, "a")]))
    b.upsert("t", rows(spark, [(3, 0, "b"), (4, 0, "b")]))
    b.commit()
    a.commit()
    assert got(t.read("t"))[3] == (0, "a") and got(t.read("t"))[4] == (0, "b")
    c.upsert("t", rows(spark, [(5, 0, "c")]))
    t.compact("t")
    c.commit()
    assert got(t.read("t"))[5] == (0, "c")


def test_splits_meet_late_writers(spark, tmp_path, small):
    t = Lake(spark, str(tmp_path / "l"))
    t.create("t", SCHEMA, ["id"])
    late = t.begin()
    late.upsert("t", rows(spark, [(7, 9, "late")]))
    t.upsert("t", rows(spark, [(i, 0, "x") for i in range(500)]))
    t.compact("t")
    with pytest.raises(Conflict, match="split"):
        late.commit()


def test_feed_leads_from_one_version_to_another(spark, tmp_path, small):
    source, target = Lake(spark, str(tmp_path / "a")), Lake(spark, str(tmp_path / "b"))
    for x in (source, target):
        x.create("t", SCHEMA, ["id"])
    source.upsert("t", rows(spark, [(i, 0, f"v{i}") for i in range(1000)]))
    first = source.compact("t")
    target.apply("t", source.changes("t", 0, first))
    assert got(target.read("t")) == got(source.read("t"))
    source.upsert("t", rows(spark, [(3, 0, "v3"), (4, 1, "changed"), (2000, 0, "new")]))
    source.transact(lambda x: x.delete("t", rows(spark, [(5, None, None), (6000, None, None)])))
    feed = source.changes("t", first)
    assert {(r["id"], r["_change"], r["v"]) for r in feed.collect()} == {(4, "update", "changed"), (2000, "insert", "new"), (5, "delete", "v5")}
    read = {f.removeprefix("file://") for f in feed.inputFiles()}
    assert size({x.replace("file:", "") for x in read}) < size(files(tmp_path / "a")) / 2  # buckets that did not change are not read
    target.apply("t", feed)
    assert got(target.read("t")) == got(source.read("t"))
    source.compact("t")
    assert source.changes("t", source.version() - 1).count() == 0


def test_vacuum_keeps_the_last_versions(spark, tmp_path, small):
    t = Lake(spark, str(tmp_path / "l"))
    t.create("t", SCHEMA, ["id"])
    for i in range(6):
        t.upsert("t", rows(spark, [(i, i, "x")]))
    want, before = got(t.read("t")), len(files(tmp_path))
    t.compact("t")
    t.vacuum(1)
    assert got(t.read("t")) == want and len(files(tmp_path)) < before
    with pytest.raises(PySparkException):
        t.read("t", 1).count()


def test_errors(spark, tmp_path):
    t = Lake(spark, str(tmp_path / "l"))
    t.create("t", SCHEMA, ["id"])
    with pytest.raises(PySparkException, match="key is null"):
        t.upsert("t", rows(spark, [(None, 1, "x")]))
    with pytest.raises(ValueError, match="columns"):
        t.upsert("t", spark.createDataFrame([(1,)], "id long"))
    with pytest.raises(ValueError, match="there is a table"):
        t.create("t", SCHEMA, ["id"])
    assert t.upsert("t", rows(spark, [])) and got(t.read("t")) == {}
    t.upsert("t", rows(spark, [(1, 1, "a"), (1, 1, "a")]))
    assert got(t.read("t")) == {1: (1, "a")}


def test_partial_updates_keep_other_columns(spark, tmp_path, small):
    t = Lake(spark, str(tmp_path / "l"))
    t.create("t", SCHEMA, ["id"])
    t.upsert("t", rows(spark, [(i, i, f"v{i}") for i in range(500)]))
    t.compact("t")
    one = spark.createDataFrame([(7, "seven"), (900, "new")], "id long, v string")
    t.transact(lambda x: x.update("t", one, ["v"]))
    now = got(t.read("t"))
    assert now[7] == (7, "seven") and now[900] == (None, "new") and now[8] == (8, "v8") and len(now) == 501
    t.transact(lambda x: x.update("t", rows(spark, [(7, 70, "again"), (901, 1, "x")]), ["at"]))
    now = got(t.read("t"))
    assert now[7] == (70, "seven") and now[901] == (1, "x")
    a, b = t.begin(), t.begin()
    for x in (a, b):
        x.update("t", one, ["v"])
    a.commit()
    with pytest.raises(Conflict):
        b.commit()
