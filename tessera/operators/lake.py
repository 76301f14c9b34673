"""Tables kept by key that grow, with commits over several of them and a feed of what changed.

A Lake is a folder of tables. A commit is one small file with a number; it names the folders of every table, and
becomes visible as a whole when it gets its name, which a second writer cannot take as well. So what a
transaction wrote to several tables appears together or not at all. A transaction is refused (Conflict) if a
table that it read has changed since it began, or a bucket that it adds to was rewritten; transact() tries again.

Rows lie in buckets by the first bits of their key's hash. An upsert or deletion adds a small folder to the
buckets that it has rows for, so it writes as much as it is given. read() merges them: of each key the row that
is last in the table's order stays, later commits win ties, and a deletion ends what came before it; buckets
that hold one folder are read as they are. compact() merges buckets of more than DELTAS additions and splits
those of more than BUCKET_ROWS rows by further bits, so a table has as many buckets as it needs, and each
version its own (extendible hashing; the names of the buckets are the directory, kept in the commit).

changes() compares two versions: buckets with the same folders in both are not read at all.

Defined results: rows with a null in their key are an error, as are other columns than the table's; repeated rows of one
key in an upsert count as one; an upsert without rows adds nothing; an empty table reads as no rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Collection, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Additions to a bucket before it is merged, and rows before it is split.
DELTAS, BUCKET_ROWS = 8, 1_000_000
MAX_BITS = 24
ATTEMPTS = 10


class Conflict(Exception):
    """What a transaction read or adds to has changed since it began."""


def _fs(spark: SparkSession, path: str):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    to = jvm.org.apache.hadoop.fs.Path
    return to(path).getFileSystem(conf), to


def bucket_of(buckets: Collection[str], keys: Sequence[str]) -> Column:
    """The bucket of a row: that one of the prefixes with which its hash begins."""
    bits = F.lpad(F.bin(F.xxhash64(*keys)), 64, "0")
    by_length: dict[int, list[str]] = {}
    for b in buckets:
        by_length.setdefault(len(b), []).append(b)
    return F.coalesce(*[F.when(F.substring(bits, 1, n).isin(found), F.substring(bits, 1, n)) if n else F.lit("") for n, found in sorted(by_length.items(), reverse=True)])


class Table:
    """One version of a table, as its commit describes it."""

    def __init__(self, spark: SparkSession, path: str, state: dict):
        self.spark, self.path, self.state = spark, path, state
        self.keys, self.order, self.buckets = state["keys"], state["order"], state["buckets"]
        self.schema = T.StructType.fromJson(json.loads(state["schema"]))

    def rows(self, buckets: Collection[str] | None = None) -> DataFrame:
        """The rows of some buckets, or of all."""
        chosen = {b: f for b, f in self.buckets.items() if buckets is None or b in buckets}
        whole = [f[0]["folder"] for f in chosen.values() if len(f) == 1 and f[0]["whole"]]
        mixed = [f for f in chosen.values() if f and not (len(f) == 1 and f[0]["whole"])]
        out = self._folders(whole).drop("_gone")
        if mixed:
            turns = [self._folders([f[i]["folder"] for f in mixed if i < len(f)]).withColumn("_turn", F.lit(i)) for i in range(max(map(len, mixed)))]
            each = turns[0]
            for t in turns[1:]:
                each = each.unionByName(t)
            key = Window.partitionBy(*self.keys)
            each = each.withColumn("_end", F.max(F.when(F.col("_gone"), F.col("_turn"))).over(key)).where("not _gone and _turn > coalesce(_end, -1)")
            each = each.withColumn("_n", F.row_number().over(key.orderBy(*[F.desc(c) for c in self.order], F.desc("_turn")))).where("_n = 1")
            out = out.unionByName(each.select(self.schema.names))
        return out

    def _folders(self, folders: Sequence[str]) -> DataFrame:
        schema = T.StructType([*self.schema.fields, T.StructField("_gone", T.BooleanType())])
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/data/{f}" for f in folders]) if folders else self.spark.createDataFrame([], schema)


class Lake:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _commits(self) -> list[int]:
        fs, to = _fs(self.spark, self.path)
        at = to(f"{self.path}/commits")
        return sorted(int(s.getPath().getName().removesuffix(".json")) for s in fs.listStatus(at) if s.getPath().getName().endswith(".json")) if fs.exists(at) else []

    def version(self) -> int:
        """The number of the last commit, 0 if there is none."""
        return max(self._commits(), default=0)

    def _state(self, version: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/commits/{version:020d}.json").first()[0]) if version else {}

    def table(self, name: str, version: int | None = None) -> Table:
        return Table(self.spark, self.path, self._state(self.version() if version is None else version)[name])

    def read(self, name: str, version: int | None = None) -> DataFrame:
        return self.table(name, version).rows()

    def begin(self) -> Transaction:
        return Transaction(self)

    def transact(self, work: Callable[[Transaction], None], attempts: int = ATTEMPTS) -> int:
        """Runs work in a transaction and commits it, again from the start after a conflict; the commit's number."""
        for left in range(attempts - 1, -1, -1):
            try:
                t = self.begin()
                work(t)
                return t.commit()
            except Conflict:
                if not left:
                    raise
        raise AssertionError

    def create(self, name: str, schema: T.StructType | str, keys: Sequence[str], order: Sequence[str] = ()) -> int:
        return self.transact(lambda t: t.create(name, schema, keys, order))

    def upsert(self, name: str, rows: DataFrame) -> int:
        """One upsert as a transaction; buckets that have had many additions are merged after it."""
        version = self.transact(lambda t: t.upsert(name, rows))
        full = [b for b, f in self.table(name).buckets.items() if len(f) > DELTAS]
        return self.compact(name, full) if full else version

    def compact(self, name: str, buckets: Collection[str] | None = None) -> int:
        """Merges and splits the buckets named, or all that hold more than one folder or too many rows."""

        def work(t: Transaction) -> None:
            table = t.table(name)
            chosen = {b: sum(f["rows"] for f in fs) for b, fs in table.buckets.items() if (b in buckets if buckets is not None else len(fs) > 1 or fs and not fs[0]["whole"] or sum(f["rows"] for f in fs) > BUCKET_ROWS)}
            if not chosen:
                return
            parts = []  # of each bucket the buckets that it becomes
            for b, n in chosen.items():
                bits = min(max(0, -(-n // BUCKET_ROWS) - 1).bit_length(), MAX_BITS - len(b))
                parts += [b + format(i, f"0{bits}b") if bits else b for i in range(1 << bits)]
            added = t._written(table.rows(chosen).withColumn("_gone", F.lit(False)), table, parts, True)
            now = {b: f for b, f in table.buckets.items() if b not in chosen} | {b: [added[b]] if b in added else [] for b in parts}
            t._replace(name, now, set(chosen))

        return self.transact(work)

    def changes(self, name: str, since: int, until: int | None = None) -> DataFrame:
        """Rows with `_change` (insert, update or delete, the last with the old values) that lead from one version to another."""
        new = self.table(name, until)
        old = Table(self.spark, self.path, self._state(since).get(name, new.state | {"buckets": {}}))
        was, now = (x.rows([b for b, f in x.buckets.items() if f != y.buckets.get(b)]) for x, y in ((old, new), (new, old)))
        whole = lambda df, c: df.select(*[F.col(k) for k in new.keys], F.struct(*new.schema.names).alias(c))
        both = whole(was, "_was").join(whole(now, "_now"), new.keys, "full_outer").where(~F.col("_was").eqNullSafe(F.col("_now")))
        change = F.when(F.col("_was").isNull(), "insert").when(F.col("_now").isNull(), "delete").otherwise("update")
        return both.select(F.coalesce("_now", "_was").alias("_row"), change.alias("_change")).select("_row.*", "_change")

    def apply(self, name: str, feed: DataFrame) -> int:
        """Puts a feed of changes() into a table, in one commit."""

        def work(t: Transaction) -> None:
            t.upsert(name, feed.where("_change <> 'delete'").drop("_change"))
            t.delete(name, feed.where("_change = 'delete'"))

        return self.transact(work)

    def vacuum(self, keep: int = 3) -> int:
        """Deletes commits but for the last `keep`, and the folders that only they name."""
        fs, to = _fs(self.spark, self.path)
        commits = self._commits()
        named = lambda vs: {f["folder"] for v in vs for t in self._state(v).values() for fs_ in t["buckets"].values() for f in fs_}
        old = commits[:-keep]
        gone = named(old) - named(commits[-keep:])
        for v in old:
            fs.delete(to(f"{self.path}/commits/{v:020d}.json"), False)
        for f in gone:
            fs.delete(to(f"{self.path}/data/{f}"), True)
        return len(gone)


class Transaction:
    """Changes to tables of a lake that commit() makes visible together."""

    def __init__(self, lake: Lake):
        self.lake, self.base = lake, lake.version()
        self.state = lake._state(self.base)
        self.seen: set[str] = set()
        self.looked: list[tuple[str, set[str]]] = []
        self.added: list[tuple[str, dict[str, dict]]] = []
        self.made: dict[str, dict] = {}
        self.replaced: dict[str, tuple[dict, set[str]]] = {}

    def create(self, name: str, schema: T.StructType | str, keys: Sequence[str], order: Sequence[str] = ()) -> None:
        if name in self.state or name in self.made:
            raise ValueError(f"there is a table {name}")
        schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
        schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])
        self.made[name] = {"schema": schema.json(), "keys": list(keys), "order": list(order), "buckets": {"": []}}

    def table(self, name: str) -> Table:
        return Table(self.lake.spark, self.lake.path, self.made.get(name) or self.state[name])

    def read(self, name: str) -> DataFrame:
        """The table as this transaction began; the commit is refused if it has changed since."""
        self.seen.add(name)
        return self.table(name).rows()

    def upsert(self, name: str, rows: DataFrame) -> None:
        table = self.table(name)
        if set(rows.columns) != set(table.schema.names):
            raise ValueError(f"{name} has the columns {table.schema.names}")
        last = Window.partitionBy(*table.keys).orderBy(*[F.desc(c) for c in table.order], F.desc(F.xxhash64(*table.schema.names)))
        one = rows.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in table.schema]).withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
        self.added.append((name, self._written(one.withColumn("_gone", F.lit(False)), table, table.buckets, False)))

    def update(self, name: str, rows: DataFrame, columns: Sequence[str]) -> None:
        """New keys are inserted; known ones get `columns` of rows and keep all others. Only the buckets that rows fall into are read."""
        table = self.table(name)
        touched = {r[0] for r in rows.select(bucket_of(table.buckets, table.keys)).distinct().collect()}  # a bucket each at most
        if name in self.state:
            self.looked.append((name, touched))
        known, old = F.col("_old").isNotNull(), table.rows(touched).select(*table.keys, F.struct(*table.schema.names).alias("_old"))
        both = rows.select(*table.keys, F.struct(*rows.columns).alias("_new")).join(old, list(table.keys), "left")
        new = lambda c: F.col(f"_new.{c}") if c in rows.columns else F.lit(None)
        put = [c if c in table.keys else (new(c) if c in columns and c in rows.columns else F.when(known, F.col(f"_old.{c}")).otherwise(new(c))).alias(c) for c in table.schema.names]
        self.upsert(name, both.select(*put))

    def delete(self, name: str, keys: DataFrame) -> None:
        """Ends the rows whose keys stand in `keys`."""
        table = self.table(name)
        one = keys.select(*table.keys).distinct()
        blank = [F.col(f.name) if f.name in table.keys else F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema]
        self.added.append((name, self._written(one.select(*blank).withColumn("_gone", F.lit(True)), table, table.buckets, False)))

    def _written(self, rows: DataFrame, table: Table, buckets: Collection[str], whole: bool) -> dict[str, dict]:
        """Writes rows, a folder for each bucket that they fall into."""
        name, at = uuid.uuid4().hex, bucket_of(buckets, table.keys)
        null = F.lit(False)
        for k in table.keys:
            null = null | F.col(k).isNull()
        checked = F.when(null, F.raise_error(F.lit("a key is null"))).otherwise(F.concat(F.lit("b"), at))
        path = f"{self.lake.path}/data/{name}"
        rows.withColumn("_b", checked).hint("rebalance", "_b").write.partitionBy("_b").parquet(path)
        counts = self.lake.spark.read.schema("_b string").parquet(path).groupBy("_b").count().collect()  # a row a bucket
        return {r["_b"][1:]: {"folder": f"{name}/_b={r['_b']}", "rows": r["count"], "whole": whole} for r in counts}

    def _replace(self, name: str, buckets: dict, chosen: set[str]) -> None:
        self.replaced[name] = (buckets, chosen)

    def _merged(self, head: dict) -> dict:
        """The state that this transaction makes of the last commit, if it may."""
        now = dict(head)
        for name in self.seen:
            if head.get(name) != self.state.get(name):
                raise Conflict(f"{name} has changed")
        for name, touched in self.looked:
            if any(head[name]["buckets"].get(b) != self.state[name]["buckets"][b] for b in touched):
                raise Conflict(f"buckets of {name} have changed")
        for name, state in self.made.items():
            if name in head:
                raise Conflict(f"{name} was made meanwhile")
            now[name] = state
        for name, (buckets, chosen) in self.replaced.items():
            if any(head[name]["buckets"].get(b) != self.state[name]["buckets"][b] for b in chosen):
                raise Conflict(f"buckets of {name} have changed")
            kept = {b: f for b, f in head[name]["buckets"].items() if b not in chosen}
            now[name] = head[name] | {"buckets": kept | {b: f for b, f in buckets.items() if b not in self.state[name]["buckets"] or b in chosen}}
        for name, added in self.added:
            have = now[name]["buckets"]
            if not added.keys() <= have.keys():
                raise Conflict(f"buckets of {name} were split")
            now[name] = now[name] | {"buckets": have | {b: [*have[b], f] for b, f in added.items()}}
        return now

    def commit(self) -> int:
        """Makes everything visible; the number of the commit. A later commit that this one does not clash with goes first."""
        if not (self.made or self.replaced or self.added):
            return self.base
        spark, path = self.lake.spark, self.lake.path
        fs, to = _fs(spark, path)
        jvm = spark.sparkContext._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
        no_options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        fs.mkdirs(to(f"{path}/commits"))
        while True:
            version = self.lake.version()
            state = self._merged(self.lake._state(version))
            draft = to(f"{path}/commits/.{uuid.uuid4().hex}")
            out = fs.create(draft, False)
            out.write(bytearray(json.dumps(state).encode()))
            out.close()
            try:  # fails if the name is taken
                context.rename(fs.makeQualified(draft), fs.makeQualified(to(f"{path}/commits/{version + 1:020d}.json")), no_options)
                return version + 1
            except Py4JJavaError as e:
                fs.delete(draft, False)
                if "FileAlreadyExists" not in str(e.java_exception):
                    raise
