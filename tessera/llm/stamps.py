"""Mixed timestamp normalisation: times as text, of many forms, as microseconds since 1970 in UTC.

Two passes of mapInPandas, both with one compiled regex of named groups and datetime. The first reads the
stamps with slashes that are possible in one order only; each is a vote for that order (day or month first) in its
source. Votes are summed up in the tasks and then by source, and the order that has over MARGIN times the
other's votes decides the stamps of the source that are possible in both orders; without such an order
the day stands first. The second pass parses everything with these orders at hand. They are broadcast
up to BROADCAST_SOURCES sources, which is checked; if there are more, stamps and orders meet in a join on
the source, in which Spark can split a source that holds many stamps.

Wall times without offset are in the row's zone. zoneinfo is asked for both folds: fold=1 is the offset
after a change of the clocks, fold=0 the one before. A time is skipped if it is not itself after a round
trip through UTC, and repeated if both folds come back to it; either is flagged and takes the offset after.

Defined results: null stamps, other forms and impossible dates or times are bad (no time) and never vote;
a wall time whose zone is null or unknown is bad, and does not vote either; a stamp with an offset does not
need a zone; rows with a null source are one source of their own; both orders give the same date if day
and month are equal, which is plain; repeated rows are parsed and vote one by one; an empty table gives
an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from datetime import date, datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, ship, written

#: The order with over MARGIN times the other's votes wins.
MARGIN = 1
#: Orders of so many sources at most are sent to every task.
BROADCAST_SOURCES = 100_000
MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()
STAMP = re.compile(
    r"(?:(?P<seconds>[0-9]{10})|(?P<millis>[0-9]{13})|(?:"
    r"(?P<y1>20[0-9]{2})-(?P<m1>[0-9]{2})-(?P<d1>[0-9]{2})|(?P<y2>20[0-9]{2})(?P<m2>[0-9]{2})(?P<d2>[0-9]{2})|(?P<d3>[0-9]{2})\.(?P<m3>[0-9]{2})\.(?P<y3>20[0-9]{2})"
    rf"|(?P<d4>[0-9]{{2}})\x20(?P<b4>{'|'.join(MONTHS)})\x20(?P<y4>20[0-9]{{2}})|(?P<p5>[0-9]{{2}})/(?P<q5>[0-9]{{2}})/(?P<y5>20[0-9]{{2}}))"
    r"(?:[T\x20](?P<h>[0-9]{2}):(?P<mi>[0-9]{2})(?::(?P<s>[0-9]{2}))?(?:\x20?(?P<half>[AP]M))?(?:\x20?(?P<off>Z|(?P<sign>[+-])(?P<oh>[0-9]{2}):?(?P<om>[0-9]{2})))?)?)"
)
BLANK = " \t\n\v\f\r"
EPOCH = datetime(1970, 1, 1)
DAY, MONTH = "day", "month"
PARSED = "stamp_id long, no_id boolean, utc_us long, rule string, ambiguous boolean"


@lru_cache(maxsize=1024)
def zone_of(name: str | None) -> ZoneInfo | None:
    try:
        return ZoneInfo(name) if name else None
    except (KeyError, ValueError, OSError):  # unknown, or no name of a zone at all
        return None


def day_of(y: str, m: str | int, d: str) -> date | None:
    try:
        return date(int(y), int(m), int(d))
    except ValueError:
        return None


def parts_of(raw: str | None) -> tuple | None:
    """("epoch", us), or ("wall", (days possible: day first, month first or one), seconds of the day, offset in minutes or None); None if bad."""
    g = STAMP.fullmatch(raw.strip(BLANK)) if raw is not None else None
    if g is None:
        return None
    if g["seconds"] or g["millis"]:
        return "epoch", int(g["seconds"]) * 1_000_000 if g["seconds"] else int(g["millis"]) * 1000
    h, mi, s = (int(g[x] or 0) for x in ("h", "mi", "s"))
    if g["half"]:
        if not 1 <= h <= 12:
            return None
        h = h % 12 + 12 * (g["half"] == "PM")
    offset = None
    if g["off"]:
        oh, om = int(g["oh"] or 0), int(g["om"] or 0)
        if oh > 14 or om > 59:
            return None
        offset = (60 * oh + om) * (-1 if g["sign"] == "-" else 1)
    if h > 23 or mi > 59 or s > 59:
        return None
    if g["y5"]:
        days = day_of(g["y5"], g["q5"], g["p5"]), day_of(g["y5"], g["p5"], g["q5"])
    elif g["b4"]:
        days = (day_of(g["y4"], MONTHS.index(g["b4"]) + 1, g["d4"]),)
    else:
        k = next(k for k in "123" if g[f"y{k}"])
        days = (day_of(g[f"y{k}"], g[f"m{k}"], g[f"d{k}"]),)
    return ("wall", days, 3600 * h + 60 * mi + s, offset) if any(days) else None


def micros(t: datetime) -> int:
    return (t - EPOCH) // timedelta(microseconds=1)


def in_utc(wall: datetime, zone: ZoneInfo) -> tuple[int, bool]:
    """The time in UTC by the offset after any change of the clocks, and whether the wall time is skipped or repeated."""
    utc = [wall.replace(tzinfo=zone, fold=f).astimezone(timezone.utc) for f in (0, 1)]
    same = [u.astimezone(zone).replace(tzinfo=None, fold=0) == wall for u in utc]
    return micros(utc[1].replace(tzinfo=None)), not all(same) or utc[0] != utc[1]


def vote_of(raw: str | None, zone: str | None) -> str | None:
    """The order for which a stamp votes: the only one in which it is possible."""
    if raw is None or "/" not in raw:
        return None
    p = parts_of(raw)
    if p is None or p[0] == "epoch" or len(p[1]) == 1 or all(p[1]) or p[3] is None and zone_of(zone) is None:
        return None
    return DAY if p[1][0] else MONTH


def normalise(raw: str | None, zone: str | None, order: str | None) -> tuple[int | None, str, bool]:
    """utc_us, rule and ambiguous of a stamp; order: what the votes of its source decide, if anything."""
    p = parts_of(raw)
    if p is None:
        return None, "bad", False
    if p[0] == "epoch":
        return p[1], "epoch", False
    _, days, seconds, offset = p
    rule, day = "plain", next(filter(None, days))
    if len(days) == 2 and all(days) and days[0] != days[1]:
        rule, day = ("votes" if order else "default"), days[order == MONTH]
    wall = datetime(day.year, day.month, day.day) + timedelta(seconds=seconds)
    if offset is not None:
        return micros(wall) - offset * 60_000_000, rule, rule != "plain"
    if (at := zone_of(zone)) is None:
        return None, "bad", False
    us, odd = in_utc(wall, at)
    return us, rule, odd or rule != "plain"


def orders(stamps: DataFrame, margin: float = MARGIN) -> DataFrame:
    """source and vote_order ('day' or 'month') of the sources whose votes decide one, as a written table."""

    def run(batches):
        seen: Counter = Counter()
        for p in batches:
            seen.update((s, v) for s, r, z in zip(p["source"], p["raw"], p["zone"], strict=True) if (v := vote_of(r, z)))
            if len(seen) > 100_000:
                yield pd.DataFrame([(s, v, n) for (s, v), n in seen.items()], columns=["source", "vote", "n"])
                seen = Counter()
        yield pd.DataFrame([(s, v, n) for (s, v), n in seen.items()], columns=["source", "vote", "n"])

    ship(stamps.sparkSession)
    slashed = stamps.where(F.col("raw").contains("/")).select("source", "raw", "zone")
    votes = slashed.mapInPandas(run, "source string, vote string, n long").groupBy("source").agg(*[F.coalesce(F.sum(F.when(F.col("vote") == v, F.col("n"))), F.lit(0)).alias(v) for v in (DAY, MONTH)])
    decided = F.when(F.col(DAY) > margin * F.col(MONTH), DAY).when(F.col(MONTH) > margin * F.col(DAY), MONTH)
    return written(votes.select("source", decided.alias("vote_order")).where("vote_order is not null"), "stamp-orders")


def normalised(stamps: DataFrame, margin: float = MARGIN, broadcast_sources: int = BROADCAST_SOURCES) -> DataFrame:
    """stamp_id, utc_us, rule, ambiguous for each row of stamps (stamp_id, source, zone, raw)."""
    decided = orders(stamps, margin)
    # pandas has no null among whole numbers, so whether there is an id goes beside it.
    rows = stamps.select(F.coalesce("stamp_id", F.lit(0)).cast("long").alias("stamp_id"), F.col("stamp_id").isNull().alias("no_id"), "source", "zone", "raw")
    shared = None
    if decided.count() <= broadcast_sources:
        shared = rows.sparkSession.sparkContext.broadcast({r["source"]: r["vote_order"] for r in decided.collect()})
    else:  # a source is known by its text, or by having none
        key = lambda c: F.coalesce(F.concat(F.lit("s"), c), F.lit("-"))
        rows = rows.withColumn("s", key(F.col("source"))).join(decided.select(key(F.col("source")).alias("s"), "vote_order"), "s", "left").select("stamp_id", "no_id", "vote_order", "zone", "raw")

    def run(batches):
        for p in batches:
            order = p["vote_order"] if shared is None else [shared.value.get(s) for s in p["source"]]
            got = [normalise(r, z, o) for r, z, o in zip(p["raw"], p["zone"], order, strict=True)]
            out = p[["stamp_id", "no_id"]]
            yield out.assign(utc_us=pd.array([x[0] for x in got], "Int64"), rule=[x[1] for x in got], ambiguous=[x[2] for x in got])

    return rows.mapInPandas(run, PARSED).select(F.when(~F.col("no_id"), F.col("stamp_id")).alias("stamp_id"), "utc_us", "rule", "ambiguous")


def op12_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalised(load(spark, sf_dir, "stamps"))


#: The forms of a day and of a time as the contract has them, written anew for SQL.
_forms = r"(20[0-9][0-9]-[0-9][0-9]-[0-9][0-9]|20[0-9][0-9][0-9][0-9][0-9][0-9]|[0-9][0-9][.][0-9][0-9][.]20[0-9][0-9]|[0-9][0-9] (Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) 20[0-9][0-9]|[0-9][0-9]/[0-9][0-9]/20[0-9][0-9])"
_clock = r"([T ]([0-9][0-9]):([0-9][0-9])(:([0-9][0-9]))?( ?([AP]M))?( ?(Z|[+-][0-9][0-9]:?[0-9][0-9]))?)?"
_at = lambda k: f"regexp_extract(clock, '^{_clock}$', {k})"
_date = lambda y, m, d: f"try_cast({y} || '-' || {m} || '-' || {d} as date)"
_cut = lambda *places: tuple(f"substr(d, {a}, {n})" for a, n in places)
ORACLE = f"""
with a as (select stamp_id, source, zone, regexp_replace(regexp_replace(raw, '^[\\x20\\x09-\\x0D]+', ''), '[\\x20\\x09-\\x0D]+$', '') as t from stamps),
b0 as (select stamp_id, source, zone, t, regexp_full_match(t, '[0-9]{{10}}|[0-9]{{13}}') as epoch, regexp_full_match(t, '{_forms}{_clock}') as fits, regexp_extract(t, '^{_forms}') as d from a),
b1 as (select *, substr(t, length(d) + 1) as clock from b0),
b as (select *, {_at(2)} as g16, {_at(3)} as g17, {_at(5)} as g18, {_at(7)} as g19, {_at(9)} as g20 from b1),
c as (select *, case when g16 = '' then 0 else cast(g16 as int) end as h, case when g17 = '' then 0 else cast(g17 as int) end as mi, case when g18 = '' then 0 else cast(g18 as int) end as s,
  case when g20 in ('', 'Z') then 0 else cast(substr(g20, 2, 2) as int) end as oh, case when g20 in ('', 'Z') then 0 else cast(right(g20, 2) as int) end as om,
  case when d like '%-%' then {_date(*_cut((1, 4), (6, 2), (9, 2)))} when length(d) = 8 then {_date(*_cut((1, 4), (5, 2), (7, 2)))} when d like '%.%' then {_date(*_cut((7, 4), (4, 2), (1, 2)))}
    when d like '% %' then {_date("substr(d, 8, 4)", "lpad(cast((position(substr(d, 4, 3) in 'JanFebMarAprMayJunJulAugSepOctNovDec') + 2) // 3 as varchar), 2, '0')", "substr(d, 1, 2)")} end as one,
  case when d like '%/%' then {_date(*_cut((7, 4), (4, 2), (1, 2)))} end as dmy, case when d like '%/%' then {_date(*_cut((7, 4), (1, 2), (4, 2)))} end as mdy from b where fits and not epoch),
d as (select *, case when g19 = '' then h when g19 = 'AM' then h % 12 else h % 12 + 12 end as hour from c
  where mi <= 59 and s <= 59 and (case when g19 = '' then h <= 23 else h between 1 and 12 end) and oh <= 14 and om <= 59 and coalesce(one, dmy, mdy) is not null and (g20 <> '' or zone is not null)),
v as (select source, count(*) filter (dmy is not null and mdy is null) as day, count(*) filter (dmy is null and mdy is not null) as month from d group by source),
e as (select d.*, case when one is not null or dmy is null or mdy is null or dmy = mdy then 'plain' when v.day > {MARGIN} * v.month or v.month > {MARGIN} * v.day then 'votes' else 'default' end as rule,
  case when one is not null then one when dmy is null then mdy when mdy is null then dmy when v.month > {MARGIN} * v.day then mdy else dmy end as day
  from d join v on d.source is not distinct from v.source),
w as (select *, cast(day as timestamp) + to_seconds(3600 * hour + 60 * mi + s) as wall from e),
z as (select *, epoch_us(wall) as wall_us,
  cast(oh * 60 + om as bigint) * 60000000 * (case when g20[1:1] = '-' then -1 else 1 end) as off_us,
  epoch_us(timezone(zone, make_timestamptz(epoch_us(wall) - 86400000000))) - (epoch_us(wall) - 86400000000) as off_before,
  epoch_us(timezone(zone, make_timestamptz(epoch_us(wall) + 86400000000))) - (epoch_us(wall) + 86400000000) as off_after from w),
y as (select *, epoch_us(timezone(zone, make_timestamptz(wall_us - off_before))) = wall_us as fits_before, epoch_us(timezone(zone, make_timestamptz(wall_us - off_after))) = wall_us as fits_after from z),
good as (select stamp_id, rule, case when g20 <> '' then wall_us - off_us when fits_before and not fits_after then wall_us - off_before else wall_us - off_after end as utc_us,
  rule <> 'plain' or g20 = '' and off_before <> off_after and fits_before = fits_after as ambiguous from y)
select a.stamp_id,
  case when b.epoch then case when length(b.t) = 10 then cast(b.t as bigint) * 1000000 else cast(b.t as bigint) * 1000 end else good.utc_us end as utc_us,
  case when b.epoch then 'epoch' else coalesce(good.rule, 'bad') end as rule, coalesce(good.ambiguous, false) as ambiguous
from a join b on a.stamp_id = b.stamp_id left join good on a.stamp_id = good.stamp_id
"""
