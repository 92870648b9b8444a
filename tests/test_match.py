"""Matches of fingerprints against all pairs, with flipped bits up to the threshold."""

import base64
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapewright.functions import fingerprints as fp
from tapewright.operators import match
from tapewright.operators.stage import Stage


def flipped(rng, w, share):
    """``w`` with that share of its bits flipped, rounded down."""
    bits = np.unpackbits(w.view(np.uint8))
    bits[rng.choice(len(bits), int(len(bits) * share), replace=False)] ^= 1
    return np.packbits(bits).view(np.uint32)


def random_words(rng, n):
    return rng.integers(1 << 32, size=n, dtype=np.uint64).astype(np.uint32)


def catalog(spark, words):
    rows = [(i, base64.b64encode(w.astype("<u4").tobytes()).decode(), f"0:{len(w) // 8:02}", 1 + i % 2) for i, w in enumerate(words)]
    rows += [(900, "FAILED", None, None), (901, "", None, None), (902, None, None, None), (903, "PCM:x", None, None), (904, "AAA=", None, None)]
    return spark.createDataFrame(rows, "id bigint, fingerprint string, duration string, channels int")


def likeness(a, b):
    n = min(len(a), len(b))
    return sum(32 - (int(x) ^ int(y)).bit_count() for x, y in zip(a[:n], b[:n], strict=True)) / (32 * n)


@pytest.mark.parametrize("group", [4, 1024])
@pytest.mark.parametrize("threshold", [0.6, 0.8])
def test_similar_pairs_are_all_pairs(spark, monkeypatch, group, threshold):
    monkeypatch.setattr(match, "GROUP", group)
    rng, words = np.random.default_rng(4), []
    for n in (1, 2, 3, 7, 20, 30, 70):
        base = random_words(rng, n)
        words += [base, base.copy(), *(flipped(rng, base, f) for f in (0.05, 0.1, 0.15, 0.2, 0.4)), flipped(rng, base, 0.1)[: n // 2 + 1]]
    want = {(i, j): s for j in range(len(words)) for i in range(j) if (s := likeness(words[i], words[j])) >= threshold}
    got = match.similar_pairs(catalog(spark, words), threshold).collect()
    assert {(r["a"], r["b"]): r["similarity"] for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("long_pieces", [0, 1 << 30])
@pytest.mark.parametrize("threshold", [0.75, 0.8, 0.95])
def test_similar_pairs_by_pieces_are_all_pairs(spark, monkeypatch, long_pieces, threshold):
    for name, value in (("INDEXED", 9), ("LONG_PIECES", long_pieces), ("COMMON", 6)):
        monkeypatch.setattr(match, name, value)
    rng, words = np.random.default_rng(12), []
    common = random_words(rng, 2)
    for n in (1, 2, 3, 5, 9, 16, 17, 24, 33, 50):
        base = random_words(rng, n)
        for lead, k in ((0, 0), (0, 1), (0, 2), (1, 1), (0, min(n, 7))):
            b = base.copy()
            b[:k] = common[lead]
            words += [b, b.copy(), *(flipped(rng, b, f) for f in (1 - threshold, 0.1, 0.02)), flipped(rng, b, 0.04)[: n // 2 + 1]]
            b = np.concatenate((random_words(rng, n), b[-3:]))
            b[:k] = common[lead]
            words.append(b)
            for at in (0, len(b) * 24):  # all that may differ, at one end
                bits = np.unpackbits(b.view(np.uint8))
                bits[at : at + int(32 * len(b) * (1 - threshold) + 1e-9)] ^= 1
                words.append(np.packbits(bits).view(np.uint32))
    want = {(i, j): s for j in range(len(words)) for i in range(j) if (s := likeness(words[i], words[j])) >= threshold}
    got = match.similar_pairs(catalog(spark, words), threshold).collect()
    assert {(r["a"], r["b"]): r["similarity"] for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("group", [4, 1024])
def test_subset_pairs_are_all_pairs(spark, monkeypatch, group):
    monkeypatch.setattr(match, "GROUP", group)
    rng, words = np.random.default_rng(6), []
    for n in (20, 64, 90):
        long = random_words(rng, n)
        words += [long, long[3:11], np.delete(long[2:40], 5), *(flipped(rng, long[4 : 4 + k], f) for k in (9, 16, 35, 62) if k < n - 4 for f in (0.1, 0.2)), long[:1]]
    order = lambda i: (-(len(words[i]) // 8), -(1 + i % 2), i)
    want = {(i, j) for i in range(len(words)) for j in range(len(words)) if order(j) < order(i) and fp.is_subset(words[i], words[j], 0.72)}
    got = match.subset_pairs(catalog(spark, words), 80, Stage(spark, "t")).collect()
    assert {(r["child"], r["parent"]) for r in got} == want and len(got) == len(want)
    assert all((r["po"]["s"], r["po"]["c"], r["po"]["i"]) < (r["co"]["s"], r["co"]["c"], r["co"]["i"]) for r in got)


def test_subset_pairs_copy_rows_by_tasks(spark, monkeypatch):
    """The copies of a row that are shuffled grow with the tasks, not with the rows."""
    monkeypatch.setattr(match, "GROUP", 1)
    rng = np.random.default_rng(15)
    long = random_words(rng, 40)
    words = [long[k % 9 : k % 9 + 18] if k % 3 else random_words(rng, 20) for k in range(149)] + [long]
    pairs = match.subset_pairs(catalog(spark, words), 80, Stage(spark, "t"), places=False)
    order = lambda i: (-(len(words[i]) // 8), -(1 + i % 2), i)
    want = {(i, j) for i in range(150) for j in range(150) if order(j) < order(i) and fp.is_subset(words[i], words[j], 0.72)}
    got = pairs.collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    most = int(np.ceil(np.sqrt(4 * match._tasks(spark))))
    assert pairs.rdd.getNumPartitions() == most * (most + 1) // 2


def test_subset_pairs_are_written_as_they_are_found(spark):
    """Neither joined nor shuffled, as they are many; their places on demand only."""
    rng, words = np.random.default_rng(11), []
    for n in (20, 40, 64):
        long = random_words(rng, n)
        words += [long, long[2:18], long[:1], random_words(rng, 16)]
    whole = match.subset_pairs(catalog(spark, words), 80, Stage(spark, "t"))
    bare = match.subset_pairs(catalog(spark, words), 80, Stage(spark, "t"), places=False)
    assert bare.columns == ["child", "parent"] and len(bare.collect()) > 3
    assert sorted(bare.collect()) == sorted(whole.select("child", "parent").collect())
    for pairs in (whole, bare):
        assert "Join" not in pairs._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("batch", [1, 3, 128])
def test_subset_families_are_the_walk(spark, monkeypatch, batch):
    monkeypatch.setattr(match, "BATCH", batch)
    rng, words = np.random.default_rng(8), []
    for n in (20, 40, 64):
        long = random_words(rng, n)
        words += [long, long.copy(), long[3:11], long[1 : n - 3], long[5 : n - 5], flipped(rng, long[4:14], 0.1)]
    words += [random_words(rng, n) for n in (5, 18, 33)]
    order = lambda i: (-(len(words[i]) // 8), -(1 + i % 2), i)
    want, parents = {}, []
    for i in sorted(range(len(words)), key=order):
        p = next((p for p in parents if fp.is_subset(words[i], words[p], 0.72)), None)
        if p is None:
            parents.append(i)
        else:
            want[i] = p
    got = match.subset_families(catalog(spark, words), 80, Stage(spark, "t")).collect()
    assert {r["child"]: r["parent"] for r in got} == want and len(got) == len(want) > 6
    assert match.subset_families(catalog(spark, words).limit(0), 80, Stage(spark, "t")).collect() == []


@pytest.mark.parametrize("group", [4, 1024])
def test_subset_families_without_many_rounds(spark, monkeypatch, group):
    """What no batch takes is settled at once; copies of a row follow it, and the work is not one round for each batch."""
    monkeypatch.setattr(match, "GROUP", group)
    monkeypatch.setattr(match, "BATCH", 2)
    rng, words = np.random.default_rng(9), []
    for n in (95, 70, 40, 33):
        long = random_words(rng, n)
        words += [long, flipped(rng, long[2:-2], 0.1), long[1:32], random_words(rng, n), long.copy(), long[1:32].copy(), long[3:12], long[:1]]
    words += [random_words(rng, 60) for _ in range(30)]
    order = lambda i: (-(len(words[i]) // 8), -(1 + i % 2), i)
    want, parents = {}, []
    for i in sorted(range(len(words)), key=order):
        p = next((p for p in parents if fp.is_subset(words[i], words[p], 0.72)), None)
        if p is None:
            parents.append(i)
        else:
            want[i] = p
    rounds = []
    first_parent = match._first_parent
    monkeypatch.setattr(match, "_first_parent", lambda *x: rounds.append(1) or first_parent(*x))
    got = match.subset_families(catalog(spark, words), 80, Stage(spark, "t")).collect()
    assert {r["child"]: r["parent"] for r in got} == want and len(got) == len(want) > 8
    assert len(rounds) < 6


def test_windows_are_counted_two_at_once():
    """Where single precision has room for two sums and where it has not, and at extremes of both."""
    rng = np.random.default_rng(10)
    for n in (15, 16, 63, 64, 89, 90, 130):
        longs = [random_words(rng, n + k) for k in (0, 1, 2, 7, 40, 790)] + [np.full(n + k, x, np.uint32) for k in (0, 1, 4) for x in (0, 0xFFFFFFFF)]
        longs.sort(key=len)
        own = np.stack([longs[-1][3 : 3 + n], random_words(rng, n), np.zeros(n, np.uint32), np.full(n, 0xFFFFFFFF, np.uint32)])
        got = fp._best_bits(own, fp._signs(np.concatenate(longs)[:, None]), np.array([len(x) for x in longs]), 0)
        for i, short in enumerate(own):
            for j, long in enumerate(longs):
                starts = range(0, len(long) - n + 1, max(1, len(long) // (200 if len(long) > 1000 else 400)))
                assert got[i, j] == max(32 * n - int(np.bitwise_count(short ^ long[s : s + n]).sum()) for s in starts)


@pytest.mark.parametrize("pairs", [1, 7, 1 << 20])
def test_copies_are_compared_once(monkeypatch, pairs):
    """All pairs of rows are listed, each once, however many have the same words."""
    monkeypatch.setattr(match, "PAIRS", pairs)
    rng, compared = np.random.default_rng(13), []
    long, short = random_words(rng, 40), random_words(rng, 16)
    kinds = [long, long[3:25], long[2:12], short, flipped(rng, long[5:35], 0.1)]
    words = [kinds[k] for k in rng.integers(0, len(kinds), 60)]
    after, before = rng.permutation(60), rng.permutation(60)
    all_subsets = match.all_subsets
    monkeypatch.setattr(match, "all_subsets", lambda x, y, *rest: compared.append((len(x), len(y))) or all_subsets(x, y, *rest))
    w = pd.Series([x.tobytes() for x in words])
    got = [(i, j) for a, b in match._of_kinds(w, w, after, before, 0.72) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
    want = {(i, j) for i in range(60) for j in range(60) if after[i] > before[j] and fp.is_subset(words[i], words[j], 0.72)}
    assert compared == [(5, 5)] and set(got) == want and len(got) == len(want) > 100


def test_common_subsequences_of_common_items(monkeypatch):
    """Only items that both have are looked at, and no more windows than one that is enough."""
    rng, looked = np.random.default_rng(14), []
    common_length = fp._common_length
    monkeypatch.setattr(fp, "_common_length", lambda at, n, items: looked.append((at, items)) or common_length(at, n, items))
    short = random_words(rng, 40)
    long = np.concatenate([random_words(rng, 100), np.delete(short, [13, 26]), random_words(rng, 100)])
    assert fp.is_subset(short, long, 0.9) and len(looked) == 1
    assert all(y in at for at, items in looked for y in items)


def test_similar_classes(spark):
    rng = np.random.default_rng(5)
    base = random_words(rng, 20)
    words = [base, base.copy(), flipped(rng, base, 0.1), random_words(rng, 20), base.copy()]
    got = {r["id"]: (r["class"], r["similar_classes"]) for r in match.similar_links(catalog(spark, words), 0.8).collect()}
    assert got == {0: (0, 1), 1: (0, 1), 2: (2, 1), 3: (3, 0), 4: (0, 1)}


def test_strict_base64(spark):
    plain = re.compile(r"\A(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/][AQgw]==|[A-Za-z0-9+/]{2}[AEIMQUYcgkosw048]=)?\Z")
    rng = random.Random(2)
    texts = ["".join(rng.choice("AQgwE5+/=b=") for _ in range(rng.randrange(10))) for _ in range(3000)] + ["AAAA\n", "", "A===", "====", "QR==", "QQ==", "AAB=", "AAE=", "AAAA=", "é" * 4]
    d = spark.createDataFrame([(t,) for t in texts], "t string").select("t", fp.is_base64(F.col("t")).alias("ok"))
    assert all(r["ok"] == bool(plain.match(r["t"])) for r in d.collect())
    long = spark.createDataFrame([("A" * 4_000_000,), ("A" * 3_999_999 + "?",)], "t string")
    assert [r[0] for r in long.select(fp.is_base64(F.col("t"))).collect()] == [True, False]


def test_common_subsequence_at_its_limit(monkeypatch):
    a, b = np.array([1, 2, 3, 4, 5], np.uint32), np.array([5, 1, 2, 9, 4, 1], np.uint32)
    assert fp.lcs_length(a, b) == 3
    monkeypatch.setattr(fp, "LCS_CELLS", 29)
    assert fp.lcs_length(a, b) == int(5 * 0.8) and fp.lcs_length(a, b, exact=True) == 3
