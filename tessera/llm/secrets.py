r"""Secret scan with multipart credential linking. DataFrame and SQL functions only.

Base kinds, reported wherever they stand: assign, access, hex. Weak kinds, reported only when a
complementary part stands at most WINDOW code points away in the same scope (the document):
  key       a run of 40 of [A-Za-z0-9/+], beside an access identifier;
  endpoint  an http(s) address, beside an access identifier or an assigned secret.

A text's matches of one pattern are found together with the pieces between them, so that running
sums of lengths give the places. The interval join of the parts is a sweep: with a scope's parts
in order of place, the nearest complementary part on either side is a running maximum of ends and
a running minimum of starts; a scope costs as much as it has parts, and no pairs are made. One
shuffle, by document, carries the parts, never the texts.

Defined results: null and empty texts have no spans; overlapping spans of different kinds are all
reported; equal spans of different kinds go in the order listed; repeated rows are documents of
their own; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import keyed, load, whole_rows, with_key

WINDOW = 400
#: kind: pattern, smallest and largest length of what counts, group whose length that is, cheap test.
KINDS = {
    "assign": (r"""(?i:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, None, 1, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""),
    "access": (r"(AKIA[A-Z0-9]+)", 20, None, 1, "AKIA[A-Z0-9]{16}"),
    "hex": (r"([0-9a-f]{24,})", 24, None, 1, "[0-9a-f]{24}"),
    "key": (r"([A-Za-z0-9/+]{40,})", 40, 40, 1, "[A-Za-z0-9/+]{40}"),
    "endpoint": (r"(https?://[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[A-Za-z0-9._~/%-]*)?)", 10, None, 1, "https?://[A-Za-z0-9]"),
}
BASE = ("assign", "access", "hex")
NAMES = list(KINDS)
COMPLEMENT = {"key": ("access",), "endpoint": ("access", "assign")}
MASK = "[REDACTED]"


def _matches(kind: str, text: Column) -> Column:
    """Array of (kind number, place in the array, code points from the last match's end to this one's start, its length, whether it counts)."""
    pattern, least, most, group, test = KINDS[kind]
    whole, part = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("whole"), part.alias("part"))
    good = lambda n: (n >= least) & (F.lit(True) if most is None else n <= most)
    rows = F.transform(zipped, lambda x, i: F.struct(F.lit(NAMES.index(kind)).alias("kind"), i.alias("i"), F.length(x["gap"]).alias("gap"), F.length(x["whole"]).alias("n"), good(F.length(x["part"])).alias("ok")))
    return F.when(text.rlike(test), F.filter(rows, lambda r: r["n"].isNotNull())).otherwise(F.array().cast("array<struct<kind:int,i:int,gap:int,n:int,ok:boolean>>"))


def spans(docs: DataFrame) -> DataFrame:
    """k, doc_id, kind, start, end of every reported span of docs (k, doc_id, text); a row of nulls for documents with none."""
    parts = docs.select("k", "doc_id", F.explode_outer(F.concat(*[_matches(kind, F.col("text")) for kind in NAMES])).alias("p"))
    parts = parts.select("k", "doc_id", "p.kind", "p.i", "p.gap", "p.n", "p.ok").repartition("k")
    by_kind = Window.partitionBy("k", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = parts.withColumn("end", F.sum(F.col("gap") + F.col("n")).over(by_kind)).withColumn("start", F.col("end") - F.col("n"))
    placed = placed.withColumn("ok", F.col("ok") & F.col("kind").isNotNull())
    in_order = Window.partitionBy("k").orderBy("start", "kind")
    upto, after = in_order.rowsBetween(Window.unboundedPreceding, 0), in_order.rowsBetween(0, Window.unboundedFollowing)
    linked = F.col("kind").isin([NAMES.index(x) for x in BASE])
    for weak, partners in COMPLEMENT.items():
        strong = F.col("ok") & F.col("kind").isin([NAMES.index(x) for x in partners])
        left = F.max(F.when(strong, F.col("end"))).over(upto)
        right = F.min(F.when(strong, F.col("start"))).over(after)
        near = (F.col("start") - left <= WINDOW) | (right - F.col("end") <= WINDOW)
        linked = linked | ((F.col("kind") == NAMES.index(weak)) & F.coalesce(near, F.lit(False)))
    found = placed.withColumn("good", F.coalesce(F.col("ok") & linked, F.lit(False)))
    return found.select("k", "doc_id", *[F.when(F.col("good"), F.col(c)).alias(c) for c in ("kind", "start", "end")])


def _joined(only_base: bool) -> Column:
    kinds = F.array(*[F.lit(x) for x in NAMES])
    wanted = F.col("kind").isNotNull() & ((F.col("kind") < len(BASE)) if only_base else F.lit(True))
    rows = F.array_sort(F.collect_list(F.when(wanted, F.struct("start", "kind", "end"))))
    return F.array_join(F.transform(rows, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_scan(docs: DataFrame) -> DataFrame:
    """A row for each row of docs (doc_id, text): counts of the base kinds, their digest, and all spans."""
    found = spans(with_key(docs.select("doc_id", "text"), "k"))
    count = lambda kind: F.count_if(F.col("kind") == NAMES.index(kind)).alias(f"n_{kind}")
    each = found.groupBy("k").agg(F.first("doc_id").alias("doc_id"), *[count(x) for x in NAMES], F.sha2(_joined(True), 256).alias("base_sha256"), _joined(False).alias("spans"))
    return each.drop("k")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(load(spark, sf_dir, "documents"))


def redact(docs: DataFrame, mask: str = MASK) -> DataFrame:
    """docs with every reported span of text replaced by the mask, and n_chars (where there is one) counted anew.

    Overlapping spans share one mask. Only rows that a cheap test flags are shuffled; the others pass as they are."""
    test = F.coalesce(F.col("text").rlike("|".join(f"(?:{KINDS[x][4]})" for x in BASE)), F.lit(False))
    rows = keyed(whole_rows(docs, "text"), "k").withColumn("flag", test)
    flagged, clean = rows.where("flag"), rows.where("not flag")
    found = spans(flagged.select("k", F.lit(None).cast("long").alias("doc_id"), "text")).where("kind is not null")
    in_order = Window.partitionBy("k").orderBy("start", "end")
    opens = F.coalesce(F.col("start") > F.max("end").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    islands = found.withColumn("opens", opens.cast("int")).withColumn("island", F.sum("opens").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    islands = islands.groupBy("k", "island").agg(F.min("start").alias("a"), F.max("end").alias("b")).groupBy("k").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("cuts"))
    joined = flagged.drop("text").join(islands, "k", "left").withColumn("text", F.col("row.text"))
    before = "if(i = 0, 0, cuts[greatest(i - 1, 0)].b)"
    kept = F.expr(f"transform(cuts, (c, i) -> substring(text, cast({before} as int) + 1, cast(c.a - {before} as int)))")
    rest = F.expr("substring(text, cast(element_at(cuts, -1).b as int) + 1)")
    masked = F.concat(F.array_join(kept, mask), F.lit(mask), rest)
    row = F.col("row").withField("text", masked)
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length(masked).cast(docs.schema["n_chars"].dataType))
    joined = joined.select(F.when(F.col("cuts").isNull(), F.col("row")).otherwise(row).alias("row"))
    return clean.select("row").unionByName(joined).select("row.*")


def oracle() -> str:
    """The same result in DuckDB, for op5's columns."""

    def one(i: int, kind: str) -> str:
        pattern, least, most, group, _ = KINDS[kind]
        p = pattern.replace("(?i:(?:password|passwd|secret|token|api_?key))", "(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])").replace("'", "''")
        return f"""select doc_id, {i} as kind, unnest(string_split_regex(t, '{p}')[1:len(m)]) as gap, unnest(m) as whole, unnest(regexp_extract_all(t, '{p}', {group})) as part, unnest(range(len(m))) as i, {least} as least, {most or 10**9} as most
          from (select *, regexp_extract_all(t, '{p}') as m from d)"""

    weak = " or ".join(
        f"(kind = {NAMES.index(w)} and (a - max(case when kind in ({s}) then b end) over (partition by doc_id order by a, kind rows between unbounded preceding and current row) <= {WINDOW}"
        f" or min(case when kind in ({s}) then a end) over (partition by doc_id order by a, kind rows between current row and unbounded following) - b <= {WINDOW}))"
        for w, partners in COMPLEMENT.items()
        for s in [", ".join(str(NAMES.index(x)) for x in partners)]
    )
    name = "['" + "', '".join(NAMES) + "'][kind + 1]"
    joined = lambda x: f"coalesce(string_agg({name} || ':' || a || ':' || b, ',' order by a, kind){x}, '')"
    return f"""with d as (select doc_id, coalesce(text, '') as t from documents),
    p as ({" union all ".join(one(i, k) for i, k in enumerate(NAMES))}),
    q as (select doc_id, kind, part, least, most, whole, sum(length(gap) + length(whole)) over (partition by doc_id, kind order by i)::bigint as b from p),
    r as (select doc_id, kind, b - length(whole) as a, b from q where length(part) between least and most),
    s as (select *, kind < {len(BASE)} or coalesce({weak}, false) as good from r),
    g as (select doc_id, {", ".join(f"count(*) filter (kind = {i} and good) as n_{k}" for i, k in enumerate(NAMES))}, {joined(f" filter (kind < {len(BASE)})")} as base, {joined(" filter (good)")} as spans from s group by doc_id)
    select d.doc_id, {", ".join(f"coalesce(n_{k}, 0) as n_{k}" for k in NAMES)}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join g using (doc_id)"""


ORACLE = oracle()
