"""Spelling variants, timestamps and repeated substrings, each against a plain version of its rule."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import spelling, stamps, suffixes
from tessera.llm.common import keyed

from . import helpers as h


@pytest.fixture(scope="module")
def docs(spark):
    return h.clashing(h.documents(spark)).cache()


# Spelling variants


def brute_words(rows, least=7, count=2, damage=31):
    seen = Counter()
    for i, t in rows:
        low = re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
        for w in re.findall("[A-Za-zÀ-ÿ]+", low):
            x = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if damage and x % damage == 0:
                w = w[: x % len(w)] + w[x % len(w) + 1 :]
            seen[w] += 1
    return {w: n for w, n in seen.items() if len(w) >= least and n >= count}


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows, ratio=10, **other):
    n = brute_words(rows, **other)
    near = {w: [x for x in n if x != w and one_apart(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= ratio * n[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n[w], len(near[w]), n.get(form.get(w))) for w in n}


def spelled(df):
    return {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_variants_on_awkward_texts(docs):
    got = spelling.variants(docs, damage=31)
    rows = [(r[0], r[1]) for r in h.awkward()]
    assert spelled(got) == brute_variants(rows) and got.count() == len(brute_variants(rows))
    assert spelled(spelling.variants(docs, min_length=3, min_count=1, ratio=3)) == brute_variants(rows, least=3, count=1, ratio=3, damage=None)


def test_variants_of_few_letters(spark):
    """Many near words: chains of forms, runs of one letter, long words, ties."""
    r = random.Random(5)
    words = ["".join(r.choice("ab") for _ in range(r.randrange(2, 8))) for _ in range(3000)] + ["abababab"] * 900 + ["abababa"] * 80 + ["ababababb"] * 90 + ["bababababb"] * 8
    words += ["a" * 3000, "a" * 3001, "a" * 3000 + "b", "a" * 1500 + "b" + "a" * 1499, "Ünïcödé", "ünïcödé", "unïcödé", "×÷×÷×÷×"] * 2
    r.shuffle(words)
    rows = [(i, " ".join(words[i : i + 40])) for i in range(0, len(words), 40)]
    for least, ratio in ((2, 2), (7, 10)):
        want = brute_variants(rows, least=least, ratio=ratio, damage=31)
        assert spelled(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"), min_length=least, ratio=ratio, damage=31)) == want
    assert any(r[1] and r[1] != r[2] for r in brute_variants(rows, least=2, ratio=2))


def test_keys_that_agree_by_chance_link_nothing(spark, monkeypatch):
    monkeypatch.setattr(spelling, "mixed", lambda x: x & np.uint64(7))
    rows = [(i, t) for i, t in enumerate(["alphabet alphabeta betamax", "alphabet alphabete", "gammaray gammarai"] * 3)]
    real = spelling.deletion_keys(["alphabet"])
    assert len(set(real[0].tolist())) < 9
    assert spelled(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"))) == brute_variants(rows, damage=None)


def test_deletion_keys_are_those_of_the_shorter_strings():
    words = ["abcd", "aabbb", "é" * 5 + "x", "z"]
    key, word, lo, hi = spelling.deletion_keys(words)
    own = {w: k for k, w, a in zip(key.tolist(), word.tolist(), lo.tolist(), strict=True) if a < 0}
    assert (lo <= hi).all() and len(own) == 4
    for k, w, a, z in zip(key.tolist(), word.tolist(), lo.tolist(), hi.tolist(), strict=True):
        if a >= 0:
            left = {words[w][:p] + words[w][p + 1 :] for p in range(a, z + 1)}
            assert len(left) == 1 and (not min(left) or spelling.deletion_keys([min(left)])[0][0] == k)


def test_no_words(spark):
    assert spelling.variants(h.empty(spark)).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, "short words only, or one alone: solitary")], "doc_id long, text string")).count() == 0


# Timestamps

SCHEMA = "stamp_id long, source string, zone string, raw string"


def utc(*parts, zone="UTC", fold=1):
    return int(datetime(*parts, tzinfo=ZoneInfo(zone), fold=fold).astimezone(timezone.utc).timestamp()) * 1_000_000


CASES = [
    ("2024-02-29T12:30:15Z", "UTC", (utc(2024, 2, 29, 12, 30, 15), "plain", False)), (" \t2024-02-29\r\n", "UTC", (utc(2024, 2, 29), "plain", False)), ("20240229 0100", "UTC", None), ("20240229 01:00", "UTC", (utc(2024, 2, 29, 1), "plain", False)),
    ("2023-02-29", "UTC", None), ("29.02.2024 23:59:59", "Asia/Kolkata", (utc(2024, 2, 29, 23, 59, 59, zone="Asia/Kolkata"), "plain", False)), ("05 Nov 2024 02:48", "UTC", (utc(2024, 11, 5, 2, 48), "plain", False)), ("05 nov 2024", "UTC", None), ("5 Nov 2024", "UTC", None),
    ("2024-01-01 24:00", "UTC", None), ("2024-01-01 12:60", "UTC", None), ("2024-01-01 12:00:60", "UTC", None), ("2024-01-01 00:10 AM", "UTC", None), ("2024-01-01 13:10PM", "UTC", None), ("2024-01-01 12:10AM", "UTC", (utc(2024, 1, 1, 0, 10), "plain", False)),
    ("2024-01-01 12:10 PM +05:30", None, (utc(2024, 1, 1, 6, 40), "plain", False)), ("2024-01-01T00:00-0800", "nowhere", (utc(2024, 1, 1, 8), "plain", False)), ("2024-01-01T00:00+15:00", "UTC", None), ("2024-01-01T00:00+14:60", "UTC", None), ("2024-01-01T00:00+14:59", "UTC", (utc(2024, 1, 1) - 899 * 60_000_000, "plain", False)),
    ("1733025832", None, (1733025832_000_000, "epoch", False)), ("1733942329007", "UTC", (1733942329007_000, "epoch", False)), ("173302583", "UTC", None), ("17339423290071", "UTC", None), ("１７33025832", "UTC", None), ("\xa02024-01-01", "UTC", None), ("2024-01-01T", "UTC", None),
    (None, "UTC", None), ("", "UTC", None), ("n/a", "UTC", None), ("2024-01-01", None, None), ("2024-01-01", "Not/AZone", None), ("2024-01-01", "../etc", None), ("1999-01-01", "UTC", None), ("2024-00-10", "UTC", None), ("31/04/2024", "UTC", None),
    ("2024-03-31 02:30", "Europe/Berlin", (utc(2024, 3, 31, 0, 30), "plain", True)), ("2024-10-27 02:30", "Europe/Berlin", (utc(2024, 10, 27, 1, 30), "plain", True)), ("2024-10-27 03:00", "Europe/Berlin", (utc(2024, 10, 27, 2), "plain", False)), ("2024-10-27 02:00", "Europe/Berlin", (utc(2024, 10, 27, 1), "plain", True)),
    ("2024-03-10 02:00", "America/New_York", (utc(2024, 3, 10, 6), "plain", True)), ("2024-11-03 01:59:59", "America/New_York", (utc(2024, 11, 3, 6, 59, 59), "plain", True)), ("2024-03-31 02:30Z", "Europe/Berlin", (utc(2024, 3, 31, 2, 30), "plain", False)),
    ("07/07/2024", "UTC", (utc(2024, 7, 7), "plain", False)), ("13/02/2024", "UTC", (utc(2024, 2, 13), "plain", False)), ("02/13/2024", "UTC", (utc(2024, 2, 13), "plain", False)), ("x" * 100_000, "UTC", None),
]


@pytest.mark.parametrize("bound", [0, 100])
def test_stamps(spark, bound):
    rows = [(i, "one", z, r) for i, (r, z, _) in enumerate(CASES)]
    want = {i: w or (None, "bad", False) for i, (_, _, w) in enumerate(CASES)}
    # Votes: source "d" two to one for the day, "m" for the month, "e" even, null for the month; bad stamps do not vote.
    day, month, both = "25/01/2024", "01/25/2024", "03/04/2024 10:00"
    votes = {"d": [day, day, month], "m": [month, month, day, day + " 24:00", day + " 24:00"], "e": [day, month], None: [month], "n": []}
    rows += [(None, s, "UTC", v) for s, all_of in votes.items() for v in all_of]
    expect = {"d": (utc(2024, 4, 3, 10), "votes"), "m": (utc(2024, 3, 4, 10), "votes"), "e": (utc(2024, 4, 3, 10), "default"), None: (utc(2024, 3, 4, 10), "votes"), "n": (utc(2024, 4, 3, 10), "default")}
    for k, (s, w) in enumerate(expect.items()):
        rows += [(2**60 + k, s, "UTC", both)] * 2
        want[2**60 + k] = (*w, True)
    table = h.clashing(spark.createDataFrame(rows, SCHEMA))
    out = stamps.normalised(table, broadcast_sources=bound)
    assert out.columns == ["stamp_id", "utc_us", "rule", "ambiguous"]
    got = out.collect()
    assert len(got) == len(rows) and {r[0]: tuple(r)[1:] for r in got if r[0] is not None} == want
    assert sum(r[0] is None for r in got) == 11 and sum(r[0] is not None and r[0] >= 2**60 for r in got) == 10


def test_every_hour_of_a_year(spark):
    rows = [(i, "s", z, t.strftime("%Y-%m-%d %H:%M")) for i, (z, t) in enumerate((z, datetime(2024, 1, 1, 0, 30) + timedelta(hours=k)) for z in ("Europe/Berlin", "America/New_York", "Australia/Lord_Howe") for k in range(0, 8784))]
    got = {r[0]: (r[1], r[3]) for r in stamps.normalised(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, _, z, t in rows:
        wall = datetime.strptime(t, "%Y-%m-%d %H:%M")
        both = [wall.replace(tzinfo=ZoneInfo(z), fold=f).utcoffset() for f in (0, 1)]
        assert got[i] == (int((wall - both[1] - datetime(1970, 1, 1)).total_seconds()) * 1_000_000, both[0] != both[1])


def test_no_stamps(spark):
    assert stamps.normalised(spark.createDataFrame([], SCHEMA)).count() == 0


def test_stamps_as_sql(spark, sf):
    c = duckdb.connect()
    c.sql(f"create view stamps as select * from '{sf}/stamps.parquet'")
    want = c.sql(f"select stamp_id, utc_us, rule, ambiguous from ({stamps.ORACLE})").fetchall()
    got = [tuple(r) for r in stamps.op12_stamps(spark, sf).collect()]
    assert Counter(got) == Counter(want) and len({r[2] for r in got}) == 5


# Repeated substrings


def brute_repeats(texts, span):
    at = defaultdict(list)
    for i, t in enumerate(texts):
        for p in range(len(t) - span + 1):
            at[t[p : p + span]].append((i, p))
    covered = [bytearray(len(t)) for t in texts]
    for places in at.values():
        if len(places) > 1:
            for i, p in places:
                covered[i][p : p + span] = b"\1" * span
    return [(len(t), sum(c), len(re.findall(b"\1+", bytes(c))), bytes(b for b, gone in zip(t, c, strict=True) if not gone)) for t, c in zip(texts, covered, strict=True)]


def as_bytes(rows):
    return [(r[1] or "").encode() for r in rows]


def check_repeats(df, rows, **how):
    got = suffixes.without_repeats(df, **how).collect()
    want = brute_repeats(as_bytes(rows), how.get("span", 200))
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got) == Counter((r[0], *w) for r, w in zip(rows, want, strict=True))


def test_repeats_in_awkward_texts(docs):
    check_repeats(docs, [r if len(r[1] or "") < 10**5 else r for r in h.awkward()])


def pieces(seed, n=60):
    """Texts that share passages of many lengths, some by parts, with few letters in some and runs in others."""
    r = random.Random(seed)
    passages = ["".join(r.choice("abcdé ") for _ in range(r.randrange(150, 700))) for _ in range(8)] + ["ab" * 180, "x" * 450]
    rows = []
    for i in range(n):
        t = ""
        for _ in range(r.randrange(1, 6)):
            p = r.choice(passages)
            a = r.randrange(len(p) // 2)
            t += p[a : a + r.randrange(100, 700)] + "".join(r.choice("abcd ") for _ in range(r.randrange(0, 80)))
        rows.append((i if i % 7 else None, t))
    return rows + rows[:3] + [(900 + i, passages[0][:230] + str(i) * 50) for i in range(40)] + [(1000, None), (1001, ""), (1002, passages[1][:199]), (1003, passages[1][:200])]


@pytest.mark.parametrize(("seed", "how"), [(1, {}), (2, {"hot": 3}), (3, {"block": 7}), (4, {"span": 100, "gram": 20, "hot": 0}), (5, {"span": 60, "gram": 60, "block": 50})])
def test_repeats_of_shared_passages(spark, seed, how):
    rows = pieces(seed)
    check_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), rows, **how)


def test_repeats_across_chunks(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "CHUNK", 512)
    monkeypatch.setattr(suffixes, "PLACE", np.uint64(511))
    rows = pieces(6, 30)
    anchors = suffixes.Anchors(200, 64)
    t = rows[1][1].encode() * 3
    assert sum((hi - lo + 1).sum() for _, lo, hi, _ in anchors.of(t)) == len(t) - 199
    check_repeats(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), rows)


def test_queue_gives_whole_keys_in_order():
    rng = np.random.default_rng(3)
    rows = [(int(k), bytes(rng.integers(97, 100, 5).tolist())) for k in rng.integers(-50, 50, 5000)] + [(7, b"hot")] * 3000
    order = rng.permutation(len(rows))
    with suffixes.SuffixQueue(500) as q:
        for i in range(0, len(rows), 170):
            part = [rows[j] for j in order[i : i + 170]]
            q.put(pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.binary())], names=["key", "suffix"]))
        assert len(q.runs) > 10
        blocks = [list(zip(b["key"].to_pylist(), b["suffix"].to_pylist(), strict=True)) for b in q.blocks()]
    assert sum(blocks, []) == sorted(rows) and len(blocks) > 5
    assert not set.intersection(*({k for k, _ in b} for b in blocks[:2]))


def test_induced_prefixes_by_brute_force():
    """Every window of sorted segments with one anchor, by comparing all of them."""
    r = random.Random(8)
    for _ in range(40):
        span = 12
        bodies = sorted({(g, "".join(r.choice("ab") for _ in range(r.randrange(0, 7))), "".join(r.choice("ab") for _ in range(12))) for g in range(3) for _ in range(9)}, key=lambda x: (x[0], x[2]))
        group = np.array([b[0] for b in bodies])
        same = np.r_[False, group[1:] == group[:-1]]
        suffix, left = [b[2].encode() for b in bodies], [b[1].encode() for b in bodies]
        common = suffixes.common_prefixes(suffix, same)
        got = {(int(a), int(b)) for rows, d in suffixes.induced(group, left, np.zeros(len(bodies), int), np.ones(len(bodies), int), common, span) for a, b in zip(rows, d, strict=True)}
        windows = defaultdict(list)
        for i, (x, s) in enumerate(zip(left, suffix, strict=True)):
            for d in range(len(x) + 1):
                windows[group[i], d, (x[len(x) - d :] + s)[:span]].append((i, d))
        assert got == {w for ws in windows.values() if len(ws) > 1 for w in ws}


def test_nothing_repeats(spark):
    assert suffixes.without_repeats(h.empty(spark)).count() == 0
    assert suffixes.repeated(keyed(spark.createDataFrame([(1, "short")], "doc_id long, text string"), "k")).count() == 0


def test_repeats_query(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = {(r[0], n, gone, spans, hashlib.sha256(kept).hexdigest()) for r, (n, gone, spans, kept) in zip(rows, brute_repeats(as_bytes(rows), 200), strict=True)}
    assert {tuple(r) for r in suffixes.op13_suffix_dedup(spark, sf).collect()} == want
