"""The latest rows in a stream's state."""

import random
from datetime import datetime, timedelta

from tessera.operators.lake import Lake
from tessera.streaming.latest import keep_latest

SCHEMA = "id long, at timestamp, n int, v string"


def test_batches_and_restarts_equal_the_whole(spark, tmp_path):
    r, day = random.Random(9), datetime(2024, 1, 1)
    rows = [(r.randrange(40), day + timedelta(hours=r.randrange(30)) if r.random() < 0.9 else None, i, r.choice([None, "x", "y"])) for i in range(600)] + [(None, day, 1000, "no key")]
    source, point = str(tmp_path / "in"), str(tmp_path / "point")
    lake = Lake(spark, str(tmp_path / "lake"))
    lake.create("t", SCHEMA, ["id"], ["at", "n"])
    run = lambda: keep_latest(spark, source, SCHEMA, lake, "t", point, ["id"], ["at", "n"], files=2)

    def want(rows):
        best = {}
        for x in rows:
            if x[0] is not None and (x[0] not in best or (x[1] is not None, x[1] or day, x[2]) >= (best[x[0]][1] is not None, best[x[0]][1] or day, best[x[0]][2])):
                best[x[0]] = x
        return best

    spark.createDataFrame(rows[:400], SCHEMA).repartition(4).write.parquet(source)
    assert run() == 2 and {x["id"]: tuple(x) for x in lake.read("t").collect()} == want(rows[:400])
    version = lake.version()
    assert run() == 0 and lake.version() == version
    spark.createDataFrame(rows[400:], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    assert run() == 1 and {x["id"]: tuple(x) for x in lake.read("t").collect()} == want(rows)
    changed = lake.changes("t", version).count()
    assert 0 < changed < 40  # keys whose latest row did not change are not written
