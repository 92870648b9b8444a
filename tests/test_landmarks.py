from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapewright.functions import alignments
from tapewright.operators import landmarks
from tapewright.operators.stage import Stage


def model(q, x, share):
    """Every two equal landmarks vote."""
    by, votes = defaultdict(list), defaultdict(Counter)
    for f, h, t in x:
        by[h].append((f, t))
    for f, h, t in q:
        for g, u in by[h]:
            if g != f:
                votes[f, g][u - t] += 1
    size, out = Counter(f for f, _, _ in q), {}
    for pair, v in votes.items():
        hits = max(v.values())
        if hits >= (max(1, size[pair[0]] // share) if share else 1):
            out[pair] = min(d for d, n in v.items() if n == hits), hits
    return out


def some(seed, wide=1):
    """Landmarks with a hash that most files have, rows repeated up to seven times and shifted copies."""
    r = np.random.default_rng(seed)
    rows = []
    for f in range(60):
        n = int(r.integers(1, 25))
        hashes = np.where(r.random(n) < 0.3, 0, r.integers(1, 40, n))
        own = [(f, int(h), int(t) * wide) for h, t in zip(hashes, r.integers(0, 30, n), strict=True)]
        if f % 3 == 2:
            own = [(f, h, t + 5 * wide) for _, h, t in rows[-8:]] + own[:4]
        for row in own:
            rows += [row] * int(r.choice([1, 1, 1, 1, 2, 7]))
    return rows


@pytest.mark.parametrize("share", [None, 4, 3])
@pytest.mark.parametrize("seed", range(6))
def test_alignments_are_those_of_all_votes(seed, share, monkeypatch):
    rows = some(seed, 1 if seed % 2 else 2**56)
    if seed > 2:
        monkeypatch.setattr(alignments, "VOTES", 64)
        monkeypatch.setattr(alignments, "REPEATS", 1)
    q = [x for x in rows if x[0] % 2 == 0]
    side = lambda d: tuple(np.array(c, np.int64) for c in zip(*d, strict=True))
    got = {}
    for found in alignments.align(side(q), side(rows), share):
        for a, b, delta, hits, size, lm in zip(*(c.tolist() for c in found), strict=True):
            assert (a, b) not in got and size == sum(x[0] == a for x in rows) and lm == sum(x[0] == b for x in rows)
            got[a, b] = delta, hits
    assert got == model(q, rows, share) and got


def test_a_frequent_hash_casts_no_votes_where_it_cannot_decide(monkeypatch):
    n = 2000
    index = [(f, 0, 10 * f) for f in range(n)] + [(f, 100 + f, 3) for f in range(n)]
    own = [(n + f, 0, 0) for f in range(50)] + [(n + f, 100 + 8 * f + k, k) for f in range(50) for k in range(8)]
    counted, spread = [], alignments._spread
    monkeypatch.setattr(alignments, "_spread", lambda low, k: (counted.append(int(k.sum())), spread(low, k))[1])
    side = lambda d: tuple(np.array(c, np.int64) for c in zip(*d, strict=True))
    assert list(alignments.align(side(own), side(index + own), 4)) == [] and sum(counted) < n


def test_spanning():
    r = np.random.default_rng(1)
    a, b = r.integers(0, 300, 150) * 7, r.integers(0, 300, 150) * 7
    a, b = a[a != b], b[a != b]
    group = {x: x for x in [*a.tolist(), *b.tolist()]}
    while True:
        new = group | {}
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            new[x] = new[y] = min(new[x], new[y])
        if new == group:
            break
        group = new
    low, other = alignments.spanning(a, b)
    assert {x: y for x, y in group.items() if x != y} == dict(zip(other.tolist(), low.tolist(), strict=True))
    assert alignments.spanning(a[:0], b[:0]).shape == (2, 0)


def test_landmark_queries_in_cells(spark, monkeypatch):
    monkeypatch.setattr(landmarks, "FEW", 1 << 8)
    monkeypatch.setattr(landmarks, "BLOCK", 400)
    monkeypatch.setattr(landmarks, "LINKS", 4)
    rows = some(9)
    x = spark.createDataFrame([*rows, (None, 1, 2), (3, None, 2), (3, 1, None)], "file_id bigint, hash bigint, time_offset bigint")
    q = x.filter("file_id % 2 = 0")
    asked = [r for r in rows if r[0] % 2 == 0]
    best = landmarks.best_alignments(q, x)
    assert {(r["query_id"], r["file_id"]): (r["delta"], r["hits"]) for r in best.collect()} == model(asked, rows, None)
    sizes = x.dropna().groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))
    few = landmarks.best_alignments(q, x, share=4)
    for kind in ("Exact", "Similar", "Subset"):
        want = sorted(map(tuple, landmarks.matches(best, sizes, kind).collect()))
        assert sorted(map(tuple, landmarks.matches(few, None, kind).collect())) == want and want
        assert sorted(tuple(r)[1:] for r in landmarks.matches_by_kind(few).filter(F.col("kind") == kind).collect()) == want
    group = landmarks.match_groups(landmarks.matches(few, None, "Similar"), Stage(spark, "groups"))
    links = {k for k, v in model(asked, rows, 4).items()}
    label = {f: f for k in links for f in k}
    for _ in range(60):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    assert {r["file_id"]: r["group_id"] for r in group.collect()} == label


def families(seed, short):
    """Files of twelve families, each with hashes of its own and one that all share, of which some copy another's landmarks, shifted; ids are not in the
    order of the families. With ``short``, two families also have files of a few landmarks; if it is 2, one of these has the common hash."""
    r = np.random.default_rng(seed)
    ids, rows = r.permutation(150).tolist(), []
    for f in range(120):
        family, n = f % 12, int(r.integers(8, 30))
        own = [(ids[f], int(h) + 1000 * family, int(t)) for h, t in zip(r.integers(1, 400, n), r.integers(0, 50, n), strict=True)]
        if f > 24 and f % 3:
            own = [(ids[f], h, t + 7) for g, h, t in rows if g == ids[f - 12] and h][: int(r.integers(1, 9))] + own[:12]
        for row in own:
            rows += [row] * int(r.choice([1, 1, 1, 1, 1, 3]))
        rows += [(ids[f], 0, 60 * f + int(t)) for t in r.integers(0, 50, int(r.integers(0, 3)))]
    if short:
        for f in range(120, 126):
            rows += [(ids[f], int(h) + 1000 * (f % 2), 3) for h in r.integers(1, 400, 3)] + ([(ids[f], 0, 1)] if f == 120 and short > 1 else [])
    return rows


@pytest.mark.parametrize("short", [0, 1, 2])
def test_groups_of_all_files(spark, monkeypatch, short):
    monkeypatch.setattr(landmarks, "FEW", 1 << 8)
    monkeypatch.setattr(landmarks, "BLOCK", 900)
    rows = families(short, short)
    x = spark.createDataFrame([*rows, (None, 1, 2), (3, None, 2), (3, 1, None)], "file_id bigint, hash bigint, time_offset bigint")
    links = list(model(rows, rows, 4))
    label = {f: f for k in links for f in k}
    while any(label[a] != label[b] for a, b in links):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    assert {r["file_id"]: r["group_id"] for r in landmarks.groups(x, Stage(spark, "groups")).collect()} == label
    assert len(label) < len({f for f, _, _ in rows}) and len(set(label.values())) > (9 if short < 2 else 1)


def test_no_groups(spark):
    x = spark.createDataFrame([(f, f, 0) for f in range(9)], "file_id bigint, hash bigint, time_offset bigint")
    assert landmarks.groups(x, Stage(spark, "groups")).isEmpty() and landmarks.groups(x.limit(0), Stage(spark, "groups")).isEmpty()


def test_landmark_groups_asks_for_every_file(spark, tmp_path):
    import duckdb

    from tapewright.plans import catalogue

    rows = [(f, 100 * (f // 3) + k, k + f) for f in range(1, 20) for k in range(12)]
    path = str(tmp_path / "fingerprints.parquet")
    spark.createDataFrame(rows, "file_id bigint, hash bigint, time_offset bigint").coalesce(1).write.parquet(path)
    want = {f: max(1, f // 3 * 3) for f in range(1, 20)}
    con = duckdb.connect()
    con.execute(f"create view fingerprints as select * from '{path}/*.parquet'")
    assert dict(con.execute(catalogue.SQL["landmark_groups"]).fetchall()) == want
    assert {r["file_id"]: r["group_id"] for r in catalogue.QUERIES["landmark_groups"](spark, str(tmp_path)).collect()} == want
