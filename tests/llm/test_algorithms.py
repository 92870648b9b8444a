"""The llm operators on small inputs, against plain models."""

import base64
import random
import struct
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tapewright.llm import components as comp
from tapewright.llm import formatting, near_duplicates, survivors

PATHS = [
    (1, "/Vol/Über Door_01.wav"), (2, "vol\\über   DOOR 01 WAV"), (3, "01 Wav Door über (Vol)"), (4, "/Vol/Uber Door_01.wav"), (5, "/Vol/Über Door Door_01.wav"),
    (6, None), (7, ""), (8, " -- "), (9, "﻿/Vol/Über Door_01.wav​"), (10, "solo"), (10, "solo"), (11, "A " * 5000 + "b"), (12, "b/" + "a/" * 5000),
]


def catalog(spark, rows):
    return spark.createDataFrame([(*r, "clash", 7) for r in rows], "rowid bigint, filepath string, copies string, _text int")


def test_formatting(spark):
    got = sorted((r["rowid"], r["copies"]) for r in formatting.formatting_groups(catalog(spark, PATHS)).collect())
    assert got == [(1, 4), (4, 1), (5, 1), (10, 2), (11, 2)]
    members = sorted(tuple(r) for r in formatting.formatting_members(catalog(spark, PATHS)).collect())
    assert [(a, b) for a, b, _ in members] == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (9, 1), (10, 10), (10, 10), (11, 11), (12, 11)]
    assert formatting.formatting_groups(catalog(spark, PATHS).limit(0)).collect() == []


def test_formatting_separates_equal_hashes(spark, monkeypatch):
    """With a hash that is the same for all, the comparison of words alone must keep the groups apart."""
    zero = F.struct(*(F.lit(0).cast("bigint").alias(x) for x in "abcdn"))
    monkeypatch.setattr(formatting, "_multiset_hash", lambda words, field="": F.when(F.size(words) >= 0, zero))
    got = sorted((r["rowid"], r["copies"]) for r in formatting.formatting_groups(catalog(spark, PATHS)).collect())
    assert got == [(1, 4), (4, 1), (5, 1), (10, 2), (11, 2)]


def test_multiset_hash_takes_the_field_name(spark):
    d = spark.createDataFrame([(["a", "b", "b"], ["b", "a", "b"], ["a", "b"])], "x array<string>, y array<string>, z array<string>")
    h = formatting._multiset_hash
    x, y, z, other = d.select(h(F.col("x"), "f"), h(F.col("y"), "f"), h(F.col("z"), "f"), h(F.col("x"), "g")).first()
    assert x == y != z and x != other and x["n"] == other["n"] == 3


def test_formatting_of_several_fields(spark):
    d = spark.createDataFrame([(1, "a b", "c"), (2, "B a", "C"), (3, "a", "b c"), (4, None, "c a")], "rowid bigint, x string, y string")
    got = sorted(tuple(r) for r in formatting.formatting_groups(d, fields=("x", "y")).collect())
    assert got == [(1, 2), (3, 1), (4, 1)]


def groups(pairs):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(up)}


def found(df):
    return {r["node"]: r["component"] for r in df.collect()}


def test_components(spark):
    rng = random.Random(4)
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(7, i) for i in range(200, 260)]
    loose = [(rng.randrange(1000, 1300), rng.randrange(1000, 1300)) for _ in range(200)]
    pairs = chain + star + loose + chain[:5] + [(b, a) for a, b in star[:9]] + [(5, 5)]
    df = spark.createDataFrame([*pairs, (None, 3), (4, None)], "a bigint, b bigint")
    assert found(comp.components(df)) == groups(pairs)
    assert comp.components(df.limit(0)).collect() == []


def matching(rows, t=4):
    sets = defaultdict(set)
    for f, h in rows:
        if f is not None and h is not None:
            sets[f].add(h)
    return groups((a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= t)


def grouped(spark, rows, **how):
    return found(comp.shared_value_groups(spark.createDataFrame(rows, "file_id bigint, hash bigint"), "file_id", "hash", 4, **how))


@pytest.mark.parametrize(("pairwise", "giant", "listed"), [(1, 10**5, 4096), (2, 6, 2), (64, 10**5, 4096), (4, 10**5, 0)])
def test_shared_values(spark, monkeypatch, pairwise, giant, listed):
    monkeypatch.setattr(comp, "LISTED", listed)
    rng = random.Random(pairwise)
    rows = [(f, 1) for f in range(120)] + [(f, 2) for f in range(0, 120, 2)]
    for f in range(120):
        rows += [(f, rng.choice([3, 4, 5, 6, 7, rng.randrange(10, 200)])) for _ in range(rng.randrange(9))]
    rows += rows[:50] + [(None, 1), (3, None)]
    assert grouped(spark, rows, pairwise=pairwise, giant=giant) == matching(rows)
    assert grouped(spark, rows[:0]) == {}


def test_shared_values_all_common(spark):
    """Several hundred values a file, each in more than PAIRWISE files: two families that share three values, and strangers
    that have three values of a family each."""
    rng = random.Random(9)
    rows = [(f, h) for f in range(80) for h in rng.sample(range(600), 500)] + [(f, h) for f in range(100, 180) for h in [0, 1, 2, *rng.sample(range(1000, 1600), 500)]]
    rows += [(1000 + k, h) for k in range(100) for h in [*rng.sample(range(3, 600), 3), 1000 + k, 1100 + k, 1200 + k]]
    assert grouped(spark, rows) == matching(rows)


def fp(words, extra=b""):
    return base64.b64encode(struct.pack(f"<{len(words)}I", *words) + extra).decode()


@pytest.mark.parametrize("bucket", [1, 64])
def test_near_duplicates(spark, monkeypatch, bucket):
    monkeypatch.setattr(near_duplicates, "BUCKET", bucket)
    rng = random.Random(1)
    rows, words = [], {}
    for g in range(12):
        base = [rng.randrange(1 << 32) for _ in range(rng.randrange(1, 40))] + [5] * 3
        for _ in range(4):
            w = list(base)
            rng.shuffle(w)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = rng.randrange(1 << 32)
            i = len(rows)
            words[i] = Counter(w)
            rows.append((i, fp(w, b"xy" if i % 3 == 0 else b""), ["0:10.000", "10.5", "11000 ms", "0:12"][rng.randrange(4)]))
    rows += [(90, None, "0:10"), (91, "FAILED", "0:10"), (92, "PCM:abcd", "0:10"), (93, "", "0:10"), (94, "abc", "0:10"), (95, "QR==", "0:10"), (96, fp([1]), None), (97, fp([1]), "0:00"), (98, fp([9] * 3000), "1:00"), (99, fp([9] * 3001), "1:00,5"), (100, "\n" + fp([9]), "1:00")]
    words |= {98: Counter({9: 3000}), 99: Counter({9: 3001})}
    sec = {"0:10.000": 10, "10.5": 10.5, "11000 ms": 11, "0:12": 12, "1:00": 60, "1:00,5": 60.5}
    want = set()
    for a in words:
        for b in words:
            if a < b:
                i, u = sum((words[a] & words[b]).values()), sum((words[a] | words[b]).values())
                s, t = (sec[dict((r[0], r[2]) for r in rows)[x]] for x in (a, b))
                if 10 * i >= 7 * u and abs(s - t) * 10 <= max(s, t):
                    want.add((a, b))
    df = spark.createDataFrame([(*r, 1) for r in rows], "rowid bigint, _fingerprint string, duration string, cid int")
    got = [tuple(r) for r in near_duplicates.near_duplicates(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20
    assert near_duplicates.near_duplicates(df.limit(0)).collect() == []


def test_survivors(spark):
    rows = [
        (1, "a b", None, "2018-01-01 00:00:00", "n/a", "2018-01-01 10:00", "Deep rumble of the...", " "),
        (2, "B/a", "L1", "2017-01-01 00:00:00", "0:01", "unknown", "Deep rumble of the sea", "/x"),
        (3, "a-b", "L2", "2019-01-01 00:00:00", "0:02", "2018-01-01 10:00", "xxx", "/y"),
        (4, "A_B", "L2", None, "0:03", "2018-01-01 10:00Z", "deep rumble", None),
        (5, "b a", "L2", "2019-01-01 00:00:00", "0:04", "", None, "/z"),
        (6, "single", "L1", None, "0:04", "", "x", "/z"),
        (7, None, "L1", None, "0:04", "", "x", "/z"), (8, None, "L1", None, "0:04", "", "x", "/z"),
        (9, "q", "L1", None, "-", "", "?", "null"), (10, "Q", "L1", None, None, None, None, None),
    ]
    d = spark.createDataFrame(rows, "rowid bigint, filepath string, library string, modificationdate string, duration string, bwdate string, description string, pathname string")
    d = d.withColumn("modificationdate", F.col("modificationdate").cast("timestamp_ntz")).withColumn("trust_rank", F.lit(0))
    libs = spark.createDataFrame([("L1", "UTC", "DMY", 2), ("L2", "UTC", "DMY", 1)], "library string, tz_name string, date_order string, trust_rank int")
    got = sorted(tuple(r) for r in survivors.survivors(d, libs).collect())
    assert got == [(1, "bwdate", 3), (1, "description", 4), (1, "duration", 3), (1, "pathname", 3)]
    assert survivors.survivors(d.limit(0), libs).collect() == []
    assert len(survivors.survivors(d, libs.limit(0)).collect()) == 4
