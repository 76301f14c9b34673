"""URL filter: host-suffix and path-prefix expressions, joined to rules on short hash prefixes.

Each url is expanded into every (host suffix, path prefix) pair whose shape occurs among the
rules. The pairs meet the rules by an equi-join on the first PREFIX_HEX digits of their digest alone;
the full digests are confirmed afterwards, so that a pair that only shares the digits with a rule
falls away, and of the rules that fit the one with the most characters wins (ties: block before
allow, then the longer host, then the smaller text). Rules of more than MAX_SHAPES combinations of
label count and path length would expand a url too far and are an error. Up to BROADCAST_RULES rules go to
every task; more meet the distinct expressions, by the short prefix as well, and what these fit goes back to
the urls in a join in which very frequent expressions (such as a large host's) do not move.

Defined results: null urls and urls without "://" have an empty host and path and get the default
verdict; hosts of any number of labels expand into no more suffixes than rules have label counts;
repeated rows are judged one by one; an empty table or no rules give no matches; other columns of
the input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hot_keys, join_one, load, with_key, written

PREFIX_HEX = 8
#: Rules are broadcast up to this many; more are joined by shuffling distinct expressions.
BROADCAST_RULES = 100_000
#: Combinations of label count and path length that rules may have; more would expand a url too far, and is an error.
MAX_SHAPES = 10_000
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path, as the contract cuts them."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def rule_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "rule_host string, rule_path string, verdict string")


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict and n_fits (rules that fit) for each row of pages (page_id, url)."""
    rules = rules.select(
        F.translate("rule_host", UPPER, LOWER).alias("r_host"), F.col("rule_path").alias("r_path"), F.col("verdict").alias("r_verdict")
    ).dropDuplicates()
    shapes = rules.select(F.size(F.split("r_host", r"\.")).alias("n"), F.length("r_path").alias("m")).distinct().collect()
    if len(shapes) > MAX_SHAPES:
        raise ValueError(f"rules have {len(shapes)} combinations of label count and path length; {MAX_SHAPES} at most")
    n_rules = rules.count()
    host, path = url_parts(F.col("url"))
    rows = with_key(pages.select("page_id", "url"), "k").withColumn("host", host).withColumn("path", path).drop("url")
    labels = F.size(F.split("host", r"\.", -1))
    shape = F.array(*[F.struct(F.lit(r["n"]).alias("n"), F.lit(r["m"]).alias("m")) for r in shapes]) if shapes else F.expr("array_remove(array(named_struct('n', 0, 'm', 0)), named_struct('n', 0, 'm', 0))")
    fitting = F.filter(shape, lambda s: (s["n"] <= labels) & (s["m"] <= F.length("path")))
    expanded = rows.select("k", "page_id", "host", "path", F.explode_outer(fitting).alias("s")).select(
        "k", "page_id", "host", "path", _digest(F.expr("substring_index(host, '.', -s.n)"), F.expr("substring(path, 1, s.m)")).alias("digest")
    )
    expanded = expanded.withColumn("short", F.substring("digest", 1, PREFIX_HEX))
    r = rules.withColumn("r_digest", _digest(F.col("r_host"), F.col("r_path"))).withColumn("r_short", F.substring("r_digest", 1, PREFIX_HEX))
    rank = F.struct(
        (F.length("r_host") + F.length("r_path")).alias("a"), (F.col("r_verdict") == "block").alias("b"), F.length("r_host").alias("c"),
        F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict"),
    )
    confirmed = F.col("digest") == F.col("r_digest")
    if n_rules <= BROADCAST_RULES:
        joined = expanded.join(F.broadcast(r), F.col("short") == F.col("r_short"), "left").select("k", "page_id", "host", "path", F.when(confirmed, rank).alias("fit"), F.when(confirmed, 1).otherwise(0).alias("n"))
    else:  # a frequent host must not meet many rules in one task: only distinct expressions meet the rules
        counts = written(expanded.groupBy("short", "digest").agg(F.count(F.lit(1)).alias("n")), "url-expressions")
        met = counts.select("short", "digest").join(r, F.col("short") == F.col("r_short"))
        hits = met.groupBy("digest").agg(F.max(F.when(confirmed, rank)).alias("fit"), F.sum(confirmed.cast("long")).alias("n"))
        hot = hot_keys(counts, "digest", counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
        joined = join_one(expanded, hits, "digest", hot, "left").select("k", "page_id", "host", "path", "fit", F.coalesce("n", F.lit(0)).alias("n"))
    best = joined.groupBy("k").agg(F.first("page_id").alias("page_id"), F.first("host").alias("host"), F.first("path").alias("path"), F.max("fit").alias("best"), F.sum("n").alias("n_fits"))
    return best.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"), "n_fits")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(load(spark, sf_dir, "pages"), rule_frame(spark, RULES)).drop("n_fits")


_fits = "(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')"
_by_length = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
ORACLE = f"""
with a as (select page_id, case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end as rest from pages),
b as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from a)
select page_id, host, path,
  case {" ".join(f"when {_fits.format(h=h, p=p)} then '{h}{p}'" for h, p, _ in _by_length)} end as rule,
  case {" ".join(f"when {_fits.format(h=h, p=p)} then '{v}'" for h, p, v in _by_length)} else 'allow' end as verdict
from b"""
