"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Sources, by code point and null last, weigh WEIGHTS repeating; they share `ratio` times all words,
and no target exceeds `cap` times its source's words: the excess is reshared by weight, which is
min(cap_i, level * w_i) for the one level at which the shares add up (found with running sums).

Documents are cut into blocks of block_words words (or are blocks themselves, if that is None). A
source's blocks are permuted by a seeded hash; its draws are whole passes over all its blocks, then
the first blocks of one more permuted pass, up to its target, and their number is the root's quota of
the source. A binary tree splits the quotas among the output shards: a node's left half takes a
multivariate-hypergeometric share of them, source by source, the right half the rest. Running sums of
the leaves give every shard a range of each source's permuted draws, and a block is taken as often as
it stands in such ranges: shards are disjoint, each holds exactly its quotas, and what no quota covers
is not taken. The last draw of a source is cut to meet the target. order_key shuffles locally: sort
by it within a shard. A draw finds its shard by an equi-join on chunks of the ranges, a few shares
wide, so its cost does not grow with the number of shards.

Ranks in a permutation are taken within hash buckets of about BUCKET blocks and shifted by running
sums over buckets, so no source, however large, is ordered in one task. Sources themselves are ordered
in one task and stand in every node of the tree; more than MAX_SOURCES of them is an error. DataFrame
and SQL functions only.

Defined results: null or wordless texts have size 0, no blocks, and take 0; sources without words
have target 0; repeated rows are documents of their own; an empty table gives an empty result; other
columns are ignored, whatever their names. Reruns on the same files agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, keyed, load, whole_rows, written

WEIGHTS = (5, 2, 1)
RATIO = 1.5
CAP = 2.0
BLOCK_WORDS = 256
#: Blocks in a hash bucket, about; words that a shard should have at most, about, and the fewest shards.
BUCKET = 4096
SHARD_WORDS = 8_388_608
MIN_SHARDS = 8
MAX_SOURCES = 100_000
#: Average shares of a source that a chunk of its draws spans; a draw looks its shard up in its chunk.
CHUNK_SHARES = 4
SEED = 17
#: Sources in a group of the tree, values that a draw may look through one by one, deviations from the mean that it looks at, and tries otherwise.
GROUP = 256
SEARCHED = 128
DEVIATIONS = 12
TRIES = 32


def sizes(docs: DataFrame) -> DataFrame:
    """k, doc_id, source, size (words of the whole text) as a written table, for docs (k, doc_id, source, text)."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return written(docs.select("k", "doc_id", "source", size.alias("size")), "mix-sizes")


def _n_blocks(size: Column, block_words: int | None) -> Column:
    """How many blocks a document of this size has."""
    return (F.ceil(size / block_words) if block_words else (size > 0).cast("long")).cast("long")


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, ratio: float = RATIO, cap: float = CAP, block_words: int | None = BLOCK_WORDS, max_sources: int = MAX_SOURCES) -> DataFrame:
    """src (a number from 0), source, source_size, n_blocks, target, and the words to take, one row a source."""
    blocks = F.sum(_n_blocks(F.col("size"), block_words)).alias("n_blocks")
    src = written(rows.groupBy("source").agg(F.sum("size").alias("source_size"), blocks), "mix-source-sizes")
    if (n := src.count()) > max_sources:
        raise ValueError(f"{n} sources; {max_sources} at most can be mixed, group them first")
    every, in_order = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy(F.col("source").isNull(), "source")
    src = src.withColumn("src", F.row_number().over(in_order) - 1)
    src = src.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("src", F.lit(len(weights))) + 1).cast("int")))
    src = src.withColumn("most", cap * F.col("source_size")).withColumn("share", ratio * F.sum("source_size").over(every))
    by_level = Window.partitionBy(F.lit(0)).orderBy(F.col("most") / F.col("w"), "src")
    src = src.withColumn("below", F.coalesce(F.sum("most").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    src = src.withColumn("rest_w", F.sum("w").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
    src = src.withColumn("capped", F.col("most") * F.col("rest_w") <= (F.col("share") - F.col("below")) * F.col("w"))
    capped, open_w = F.sum(F.when(F.col("capped"), F.col("most")).otherwise(0.0)).over(every), F.sum(F.when(~F.col("capped"), F.col("w"))).over(every)
    level = (F.col("share") - capped) / open_w
    src = src.withColumn("target", F.round(F.when(F.col("capped"), F.col("most")).otherwise(level * F.col("w")), 6))
    return src.select("src", "source", "source_size", "n_blocks", "target", F.round("target").cast("long").alias("words"))


def _let(name: str, value: str, body: str) -> str:
    """SQL of body, in which name stands for value, taken once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _ln_factorial(x: str) -> str:
    """ln(x!) as SQL, x a double >= 0: Stirling's series at y = x + 8, brought back by the product between."""
    product = " * ".join(f"(y - {k})" for k in range(8))
    return _let("y", f"({x}) + 8", f"((y + 0.5) * ln(y) - y + 0.9189385332046728 + 1 / (12 * y) - 1 / (360 * power(y, 3)) + 1 / (1260 * power(y, 5)) - ln({product}))")


def hypergeometric(total: str, good: str, draws: str, u: str) -> str:
    """SQL for how many of `draws` out of `total` are among the `good`; u in [0, 1) is the only chance.

    All are doubles. Of the symmetric forms of the distribution that with fewest draws and good ones is taken. Where it is
    narrow, it is inverted at u, value by value within DEVIATIONS of the mean; else by Stadlober's ratio of uniforms, whose
    tries are hashes of u, TRIES at most and 1.4 on average (beyond them, in one of 10^12 cases, the most likely value).
    So the steps are bounded however large the numbers are."""
    few = f"named_struct('t', {total} + 0D, 'g', least({good}, {total} - {good}), 'm', least({draws}, {total} - {draws}))"
    var = "named_struct('m', f.m * f.g / f.t, 's', sqrt(f.m * f.g / f.t * (1 - f.g / f.t) * (f.t - f.m) / greatest(f.t - 1, 1D)))"
    bounds = f"named_struct('lo', greatest(0D, floor(v.m - {DEVIATIONS} * v.s - 3) + 0D), 'hi', least(f.m, f.g, ceil(v.m + {DEVIATIONS} * v.s + 3) + 0D))"
    values = "if(b.hi > b.lo, transform(sequence(cast(b.lo as bigint) + 1, cast(b.hi as bigint)), i -> cast(i as double)), cast(array() as array<double>))"
    # Of each value its weight in units of that of the first one: within the bounds they span some e^72.
    next_weight = "w * ((f.g - x + 1) * (f.m - x + 1)) / (x * (f.t - f.g - f.m + x))"
    weights = f"aggregate(xs, array(1D), (ws, x) -> {_let('w', 'ws[size(ws) - 1]', f'concat(ws, array({next_weight}))')})"
    search = f"aggregate(ws, named_struct('k', b.lo - 1, 'c', 0D), (a, w) -> if(a.k >= b.lo and a.c > goal, a, named_struct('k', a.k + 1, 'c', a.c + w)), a -> a.k)"
    searched = _let("b", bounds, _let("xs", values, _let("ws", weights, _let("goal", f"{u} * aggregate(ws, 0D, (a, w) -> a + w)", search))))
    weight = f"aggregate(array(x, f.g - x, f.m - x, f.t - f.g - f.m + x), 0D, (a, y0) -> a + {_ln_factorial('y0')})"
    mode = "floor((f.m + 1) * (f.g + 1) / (f.t + 2)) + 0D"
    uniform = lambda salt: f"((cast(shiftrightunsigned(xxhash64({u}, i, {salt}), 11) as double) + 0.5D) / 9007199254740992D)"
    # 2 sqrt(2 / e) and 3 - 2 sqrt(3 / e), the constants of the method.
    place = "floor(v.m + 0.5D + (1.7155277699214135D * sqrt(v.s * v.s + 0.5D) + 0.8989161620588988D) * (c.y - 0.5D) / c.x) + 0D"
    fits = f"{_let('r', f'transform(array(top, z), x -> {weight})', '2 * ln(c.x) <= r[0] - r[1]')}"
    tried = _let("c", f"named_struct('x', {uniform(1)}, 'y', {uniform(2)})", _let("z", place, f"if(z >= 0 and z <= least(f.m, f.g) and {fits}, z, cast(null as double))"))
    by_ratio = _let("top", mode, f"aggregate(sequence(1, {TRIES}), cast(null as double), (a, i) -> if(a is not null, a, {tried}), a -> coalesce(a, top))")
    back = _let("k", f"if(v.s * {2 * DEVIATIONS} <= {SEARCHED}, {searched}, {by_ratio})", _let("k2", f"if({good} > f.g, f.m - k, k)", f"if({draws} > f.m, {good} - k2, k2)"))
    return f"(case when {good} <= 0 or {draws} <= 0 then 0D when {draws} >= {total} then {good} else {_let('f', few, _let('v', var, back))} end)"


def split_tree(draws: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """shard and quotas (array of (src, n > 0)) for draws (src, n): exact quotas of each source for each of 2^k shards.

    Sources stand in groups of GROUP. A node's draws are dealt to groups first and then, within each group, to its
    sources, so that what is carried on grows by a group's length only; a node keeps the sources that it draws from."""
    assert shards & (shards - 1) == 0
    pair = F.struct(F.col("src").alias("src"), F.col("n").cast("double").alias("n"))
    groups = draws.where("n > 0").groupBy(F.floor(F.col("src") / GROUP).alias("g")).agg(F.array_sort(F.collect_list(pair)).alias("q"))
    nodes = groups.agg(F.transform(F.array_sort(F.collect_list(F.struct("g", "q"))), lambda x: x["q"]).alias("q")).select(F.lit(0).cast("long").alias("node"), "q")

    def dealt(parts: str, part: str, n: str, number: str, total: str, given: str) -> str:
        """Draws of each of parts, one after the other, when `given` of `total` are drawn."""
        u = f"(cast(shiftrightunsigned(xxhash64({seed}L, level, node, {number}), 11) as double) / 9007199254740992D)"
        share = hypergeometric("acc.total", n, "acc.draws", u)
        step = _let("l", share, f"named_struct('total', acc.total - {n}, 'draws', acc.draws - l, 'out', concat(acc.out, array(l)))")
        return f"aggregate({parts}, named_struct('total', {total}, 'draws', {given}, 'out', cast(array() as array<double>)), (acc, {part}) -> {step}, acc -> acc.out)"

    for level in range(shards.bit_length() - 1):
        if level and level % 6 == 0:
            nodes = nodes.repartition("node")
        sums = "transform(q, g -> named_struct('n', aggregate(g, 0D, (a, s) -> a + s.n), 'first', g[0].src))"
        within = f"transform(q, (g, i) -> {dealt('g', 's', 's.n', 's.src', 't[i].n', 'd[i]')})"
        l = _let("t", sums, _let("total", "aggregate(t, 0D, (a, x) -> a + x.n)", _let("d", dealt("t", "s", "s.n", "-1L - s.first", "total", "floor(total / 2) + 0D"), within)))  # noqa: E741
        nodes = nodes.withColumn("level", F.lit(level)).withColumn("l", F.expr(l))
        half = lambda n: F.expr(f"filter(transform(q, (g, i) -> filter(transform(g, (s, j) -> named_struct('src', s.src, 'n', {n})), s -> s.n > 0)), g -> size(g) > 0)")
        nodes = nodes.select("node", half("l[i][j]").alias("lq"), half("s.n - l[i][j]").alias("rq")).select(F.expr("stack(2, node * 2, lq, node * 2 + 1, rq) as (node, q)"))
    return nodes.select(F.col("node").alias("shard"), F.flatten("q").alias("quotas"))


def shard_count(src: DataFrame) -> int:
    """A power of two, MIN_SHARDS at least, so that shards have about SHARD_WORDS words at most."""
    words = src.agg(F.sum("words")).first()[0] or 0
    return max(MIN_SHARDS, 1 << max(0, -(-words // SHARD_WORDS) - 1).bit_length())


def mix_blocks(rows: DataFrame, src: DataFrame, block_words: int | None = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """The draws of the mix: k, doc_id, src, block, start_word, size, words, pass, shard, order_key.

    rows: what sizes() gives; src: what targets() gives for the same block_words, as written tables."""
    shards = shard_count(src)
    src = src.withColumn("bits", F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.col("n_blocks"), F.lit(1)) / BUCKET))).cast("int"))
    src = src.withColumn("full", F.when(F.col("source_size") > 0, F.expr("words div source_size")).otherwise(0)).withColumn("part", F.col("words") - F.col("full") * F.col("source_size"))
    # There are MAX_SOURCES sources at most, so they go to every task.
    blocks = rows.where("size > 0").join(F.broadcast(src.select(F.col("source").alias("s_source"), "src", "bits", "full", "part")), F.col("source").eqNullSafe(F.col("s_source")))
    width = F.lit(block_words).cast("long") if block_words else F.col("size")
    blocks = blocks.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), _n_blocks(F.col("size"), block_words) - 1)))
    blocks = blocks.withColumn("start_word", F.col("block") * width).withColumn("n", F.least(width, F.col("size") - F.col("start_word")))
    blocks = blocks.withColumn("perm", F.xxhash64(F.lit(seed), "src", "doc_id", "size", "block"))
    # Unsigned order of the hash, so that its highest bits number the buckets.
    blocks = blocks.withColumn("bucket", F.when(F.col("bits") > 0, F.expr("shiftrightunsigned(perm, 64 - bits)")).otherwise(F.lit(0).cast("long")))
    buckets = blocks.groupBy("src", "bucket").agg(F.sum("n").alias("b_words"), F.count(F.lit(1)).alias("b_blocks"))
    before = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select("src", "bucket", F.coalesce(F.sum("b_words").over(before), F.lit(0)).alias("w0"), F.coalesce(F.sum("b_blocks").over(before), F.lit(0)).alias("r0"))
    inside = Window.partitionBy("src", "bucket").orderBy("perm", "k", "block")
    ranked = blocks.withColumn("rank", F.row_number().over(inside) - 1).withColumn("w_end", F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    ranked = ranked.join(buckets, ["src", "bucket"]).withColumn("rank", F.col("rank") + F.col("r0")).withColumn("w_start", F.col("w_end") + F.col("w0") - F.col("n"))
    partial = F.greatest(F.lit(0).cast("long"), F.least(F.col("n"), F.col("part") - F.col("w_start")))
    ranked = written(ranked.select("k", "doc_id", "src", "block", "start_word", "size", "n", "full", partial.alias("partial"), "rank"), "mix-ranks")
    totals = ranked.groupBy("src").agg(F.sum(F.expr("full + if(partial > 0, 1, 0)")).alias("n")).join(src.select("src", "n_blocks"), "src")
    totals = written(totals.withColumn("width", F.expr(f"greatest(1L, {CHUNK_SHARES} * n div {shards})")), "mix-totals")
    quota = split_tree(totals.select("src", "n"), shards, seed)
    per = quota.select("shard", F.explode("quotas").alias("q")).select("shard", "q.src", F.col("q.n").cast("long").alias("n"))
    upto = Window.partitionBy("src").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    ranges = per.withColumn("end", F.sum("n").over(upto)).where("n > 0").join(F.broadcast(totals.select("src", "width")), "src")
    chunks = ranges.select("src", "shard", "end", F.explode(F.sequence(F.expr("(end - n) div width"), F.expr("(end - 1) div width"))).alias("chunk"))
    lookup = written(chunks.groupBy("src", "chunk").agg(F.array_sort(F.collect_list(F.struct("end", "shard"))).alias("ends")), "mix-quotas")
    # Every block stands once in each pass; the quotas decide which of these draws are made.
    out = ranked.join(F.broadcast(totals.select("src", "n_blocks", "width")), "src").withColumn("pass", F.explode(F.sequence(F.lit(1).cast("long"), F.col("full") + 1)))
    out = out.withColumn("idx", (F.col("pass") - 1) * F.col("n_blocks") + F.col("rank")).withColumn("chunk", F.expr("idx div width")).join(lookup, ["src", "chunk"])
    return out.select(
        "k", "doc_id", "src", "block", "start_word", "size", F.when(F.col("pass") <= F.col("full"), F.col("n")).otherwise(F.col("partial")).alias("words"), "pass",
        F.expr("get(filter(ends, e -> e.end > idx), 0).shard").alias("shard"), F.xxhash64(F.lit(seed + 1), "src", "idx").alias("order_key"),
    ).where("shard is not null")


def mix(docs: DataFrame, block_words: int | None = BLOCK_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables of documents (sizes), sources (targets) and draws (mix_blocks) for docs (k, doc_id, source, text)."""
    rows = sizes(docs)
    src = written(targets(rows, block_words=block_words), "mix-sources")
    return rows, src, mix_blocks(rows, src, block_words)


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, src, draws = mix(keyed(load(spark, sf_dir, "documents").select("doc_id", "source", "text"), "k"))
    taken = draws.groupBy("k").agg(F.sum("words").alias("taken"), F.min("shard").alias("first_shard"), F.count(F.lit(1)).alias("n_draws"))
    named = rows.join(F.broadcast(src.select(F.col("source").alias("s_source"), "source_size", "target")), F.col("source").eqNullSafe(F.col("s_source")))
    return named.join(taken, "k", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), "first_shard", F.coalesce("n_draws", F.lit(0)).alias("n_draws"))


def assemble(docs: DataFrame) -> DataFrame:
    """docs as the mix takes them: a row for each document and pass, with its columns; a partition for each output shard, shuffled.

    Documents are the blocks, so texts stay whole and a shard holds exactly the documents that its quotas
    drew. Only the last document of a source can be taken in part: it keeps its first words, with single
    spaces, and n_chars (where there is one) is counted anew."""
    table = keyed(whole_rows(docs, "doc_id", "source", "text"), "k")  # the text is in the row alone when it is shuffled
    _, src, draws = mix(table, None)
    joined = table.select("row", "k").join(draws.select("k", "size", "words", "shard", "order_key"), "k")
    cut = F.array_join(F.slice(F.regexp_extract_all("row.text", F.lit(WORD), F.lit(0)), F.lit(1), F.col("words").cast("int")), " ")
    row = F.col("row").withField("text", cut)
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length(cut).cast(docs.schema["n_chars"].dataType))
    out = joined.select(F.when(F.col("words") == F.col("size"), F.col("row")).otherwise(row).alias("row"), "shard", "order_key")
    return out.repartitionById(shard_count(src), F.col("shard").cast("int")).sortWithinPartitions("order_key").select("row.*")
