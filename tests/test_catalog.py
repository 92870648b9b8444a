"""Scalar rules on golden rows, and marking against a plain replay of the rules."""

import os
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapewright.functions import fingerprints as fp
from tapewright.functions import paths
from tapewright.functions.durations import readable_seconds, split_seconds
from tapewright.functions.text import is_placeholder
from tapewright.functions.values import rank_value
from tapewright.operators import catalog_rows, dedupe, edit, landmarks, match, model, views
from tapewright.operators.model import Enabled, Preferences, Rule
from tapewright.operators.search import search
from tapewright.operators.stage import Stage, skew_join

SCHEMA = "rowid bigint, filepath string, filename string, pathname string, duration string, description string, channels int, bitdepth int, samplerate int, _fingerprint string, _dualmono string, _dirty int, bwdate string, scanneddate string, root string, flags string"


def cat(spark, rows):
    full = [dict.fromkeys(c.split()[0] for c in SCHEMA.split(", ")) | {"root": "clash", "flags": "clash"} | r for r in rows]
    return spark.createDataFrame([tuple(r.values()) for r in full], SCHEMA)


def values(spark, column, items):
    d = spark.createDataFrame(list(enumerate(items)), "i int, x string")
    return [r[1] for r in sorted(d.select("i", column(F.col("x"))).collect())]


def test_roots(spark):
    golden = {
        "Boom.wav": "Boom", "Boom.1.4.M.wav": "Boom", "Boom copy.wav": "Boom copy", "Boom copy.1.wav": "Boom", "Boom-RVRS_01.wav": "Boom", "Boom-NORM_1-RVRS_2.wav": "Boom-NORM_1",
        "a.M.b.2.wav": "a.M.b", ".1.wav": ".1", "Boom.M.1x.wav": "Boom.M.1x", "noext": "noext",
    }
    d = spark.createDataFrame([(k,) for k in golden], "p string")
    tags = ("-RVRS_", "-NORM_")
    assert {r["p"]: r["root"] for r in paths.with_names(d, "p", tags, True).collect()} == golden
    with_type = {r["p"]: r["root"] for r in paths.with_names(d, "p", tags).collect()}
    assert with_type["noext"] == "noext.Invalid Extension" and with_type["Boom.1.4.M.wav"] == "Boom.wav"


def test_path_parts(spark):
    golden = {
        "/a/b.wav": ("/a", "b.wav", "b", "wav"), "b": ("", "b", "b", "Invalid Extension"), "/a/.hidden": ("/a", ".hidden", ".hidden", "Invalid Extension"), "x.": ("", "x.", "x", ""),
        "/": ("Invalid Path", "Invalid Filename", "Invalid Filestem", "Invalid Extension"), "": ("Invalid Path", "Invalid Filename", "Invalid Filestem", "Invalid Extension"),
        "/a/..": ("/a", "Invalid Filename", "Invalid Filestem", "Invalid Extension"), "/a/b.x/": ("/a", "b.x", "b", "x"), "/f": ("/", "f", "f", "Invalid Extension"), "a/b\nc.d.e": ("a", "b\nc.d.e", "b\nc.d", "e"),
    }
    d = paths.with_names(spark.createDataFrame([(k,) for k in golden], "p string"), "p")
    assert {r["p"]: (r["q"], r["file_name"], r["stem"], r["ext"]) for r in d.select("*", paths.parent(F.col("p")).alias("q")).collect()} == golden


def test_durations(spark):
    assert values(spark, split_seconds, ["0:01.500", "0:01.5", "1:02:03", "42", None, "1:", "a:1", "2:30"]) == [1.5, 1.5, None, None, None, None, None, 150.0]
    got = values(spark, lambda c: readable_seconds(c).cast("double"), ["0:05.650", "00:00:06.271", "0:03,317", "8.732", "2.181 s", "2139 ms", "0:00", "--:--", None, "", "1:60", "1:00:00", "61:00", "1:61:00", "2 min", "x" * 9999])
    assert got == [5.65, 6.271, 3.317, 8.732, 2.181, 2.139, None, None, None, None, None, 3600.0, 3660.0, None, 120.0, None]


def test_rank_values(spark):
    rank = lambda c: F.struct(*rank_value(c))
    got = [tuple(x) for x in values(spark, rank, ["0:01.500", "0:01.5", "1:02:03", "01:00:00.250", "42", "48000.5", " 5", None, "2018-01-01 00:00:01", "9" * 30])]
    assert got == [(1, 1500), (1, 1005), (1, 62003), (1, 3600250), (0, 42), (0, 0), (0, 0), (0, 0), (2, 1514764801), (0, 0)]
    scaled = lambda c: F.struct(*rank_value(c, scaled_ms=True))
    assert tuple(values(spark, scaled, ["0:01.5"])[0]) == (1, 1500)


def test_placeholders_and_find(spark):
    assert values(spark, is_placeholder, [None, "", "  ", "N/A", "(none)", "--", "TBD.", "tbd soon", "Rain"]) == [True] * 7 + [False] * 2
    assert values(spark, lambda c: catalog_rows.like_fold(c, "B_m%X"), ["aBOMzx", "bmx", None, "ÄBümx"]) == [True, False, False, True]
    assert values(spark, lambda c: catalog_rows.glob(c, "B[o-q]?[^x]"), ["aBoom", "aBoox", "Bam", None, "boom"]) == [True, False, False, False, False]
    assert values(spark, lambda c: catalog_rows.glob(c, "a.b"), ["xa.by", "xaxby"]) == [True, False]
    assert values(spark, lambda c: catalog_rows.glob(c, "a[b"), ["a[b"]) == [False]


def replay(rows, prefs, en):
    """The marking of groups, row by row."""
    groups = {}
    for r in rows:
        key = tuple(r["root"] if c == "filename" and (en.filename or en.audiosuite) else r["c_" + c] for c in prefs.match_criteria)
        if None not in key:
            groups.setdefault(key, []).append(r)
    for g in groups.values():
        if len(g) < 2:
            continue
        name = "stem" if prefs.ignore_filetype else "file_name"
        tagged = lambda r: any(t in r["stem"] for t in prefs.tags)
        g.sort(key=lambda r: (0 if "Keep" in r["f"] else 1, 0 if r["root"] == r[name] else 1, tagged(r), r["c_description"] == "", r["id"]))
        for i, r in enumerate(g):
            pure = r["root"] in (r["file_name"].strip(), r["stem"].strip())
            flag = "Basic" if not (en.filename or en.audiosuite) or pure else ("Tags" if en.audiosuite else None) if tagged(r) else "SimilarFilename" if en.filename else None
            if flag:
                r["f"].add(flag)
                if i:
                    r["f"].discard("Keep")
        if all("Keep" in r["f"] for r in g):
            for r in g:
                r["f"] = {"Keep"}
    return {r["id"]: frozenset(r["f"]) for r in rows}


@pytest.mark.parametrize(("filename", "audiosuite"), [(False, False), (True, False), (False, True), (True, True)])
def test_marking_against_replay(spark, filename, audiosuite):
    rng = random.Random(5)
    names = ["Boom", "Boom.1", "Boom-RVRS_2", "Boom copy.2", "Zap", "Zap.M"]
    rows = [
        {"rowid": i, "filepath": f"/l/{rng.choice(names)}{rng.choice(['.wav', '.aif'])}", "channels": rng.choice([1, 2, None]), "description": rng.choice(["", None, "d"]), "duration": rng.choice(["0:00.1", "0:09.1", None])}
        for i in range(60)
    ]
    for r in rows:
        r["filename"] = rng.choice([r["filepath"][3:], None])
    prefs = Preferences(match_criteria=("filename", "channels"), preservation_order=(Rule("description", "IsNotEmpty"),), ignore_filetype=True)
    en = Enabled(basic=True, filename=filename, audiosuite=audiosuite, duration=True)
    start = catalog_rows.working_rows(cat(spark, rows), prefs, en)
    got = {r["id"]: frozenset(r["f"]) for r in dedupe.mark_duplicates(start, prefs, en).select("id", model.shown(F.col("flags")).alias("f")).collect()}
    plain = [r.asDict() | {"f": set(r["f"])} for r in start.withColumn("f", model.shown(F.col("flags"))).collect()]
    assert got == replay(plain, prefs, en)
    again = dedupe.mark_duplicates(start.repartition(7), prefs, en)
    assert {r["id"]: frozenset(r["f"]) for r in again.select("id", model.shown(F.col("flags")).alias("f")).collect()} == got


def test_search_on_empty_and_all_kinds(spark):
    rows = cat(spark, [{"rowid": 1}, {"rowid": 2, "filepath": "/a/x.wav", "_dualmono": "1"}])
    every = Enabled(**dict.fromkeys(model.SEARCHES, True))
    for kind in ("Exact", "Similar", "Subset"):
        prefs = Preferences(waveform_search_type=kind)
        there = spark.createDataFrame([("/a/x.wav",)], "file_path string")
        got = {r["id"]: r["algorithm"] for r in views.result_rows(search(rows, every, prefs, rows, there)).collect()}
        assert got == {1: "InvalidPath", 2: "Keep,DualMono"}
        assert search(rows.limit(0), every, prefs, rows, there).collect() == []


def test_preferences():
    rules = (model.Rule("pathname", "Contains", "KEEP THIS"), model.Rule("duration", "Largest"))
    p = Preferences(match_criteria=("filename",), ignore_filetype=True, autoselects=(".new.",), preservation_order=rules, similarity_threshold=70)
    every = {"mine": (Enabled(basic=True, filename=True, min_dur=2.5), p), "plain": (Enabled(), Preferences())}
    assert model.load_presets(model.save_presets(every)) == every
    assert model.load_presets('{"a": {"preferences": {"ignore_filetype": true}}}') == {"a": (Enabled(), Preferences(ignore_filetype=True))}
    assert Preferences.from_json(p.to_json()) == p and Preferences.from_json('{"odd": 1}') == Preferences()
    assert not Enabled.of([{"id": "audiosuite", "enabled": True}]).audiosuite and Enabled.of({"basic": True, "audiosuite": True}).audiosuite
    assert model.move_tags(("a",), ("a", "b"), ("c",)) == (("b",), ("c", "a"))
    assert len(model.TAGS) == 42 and p.columns()[0] == "filename"


def words(spark, *arrays):
    return spark.createDataFrame([arrays], ", ".join(f"w{i} array<bigint>" for i in range(len(arrays))))


def test_similarity(spark):
    d = words(spark, [1, 2, 4294967295], [1, 3, 4294967294, 9])
    got = d.select(fp.similarity(F.col("w0"), F.col("w1")), fp.similarity(F.col("w1"), F.col("w0")), fp.similarity(F.col("w0"), F.array().cast("array<bigint>")), fp.similarity_shifted(F.array(F.lit(2), F.lit(4294967295)), F.col("w0"))).first()
    assert round(got[0], 6) == round(got[1], 6) == 0.979167 and got[2] == 0 and got[3] == 1


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_lcs_and_features(spark):
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = (rng.integers(6, size=rng.integers(0, 30)).astype(np.uint32) for _ in range(2))
        assert fp.lcs_length(a, b) == lcs(a.tolist(), b.tolist())
    assert fp.lcs_length(np.zeros(2000, np.uint32), np.zeros(1000, np.uint32)) == 1600
    w = rng.integers(1 << 32, size=9, dtype=np.uint64).astype(np.uint32)
    for n in (0, 1, 2, 3, 4, 9):
        got = words(spark, [int(x) for x in w[:n]]).select(fp.features(F.col("w0"))).first()[0]
        assert got == fp.np_features(w[:n]).tolist()


def test_subset(spark):
    rng = np.random.default_rng(2)
    long = rng.integers(1 << 32, size=200, dtype=np.uint64).astype(np.uint32)
    for n in (8, 20, 40, 62):
        assert fp.is_subset(long[30 : 30 + n], long, 0.72)
    assert not fp.is_subset(long[:1], long, 0.72) and not fp.is_subset(long, long[:50], 0.72) and not fp.is_subset(long[:0], long, 0.72)
    assert not fp.is_subset(rng.integers(1 << 32, size=40, dtype=np.uint64).astype(np.uint32), long, 0.9)
    assert words(spark, [5, 7, 9], [5, 7, 9, 1]).select(fp.feature_ratio(F.col("w0"), F.col("w1")), fp.feature_ratio(F.array(F.lit(1)), F.col("w1"))).first()[0] >= 1


def plain_subset(short, long, threshold):
    """The rule, window by window."""
    n, m = len(short), len(long)
    if not n or n > m:
        return False
    least = threshold * (0.75 if n < 30 else 0.8 if n < 60 else 0.85)
    if n < 15:
        return n > 1 and sum((x & y) in {a & b for a, b in zip(short, short[1:], strict=False)} for x, y in zip(long, long[1:], strict=False)) / (n - 1) >= least
    best = 0.0
    for size in (n, int(n * 1.1), int(n * 0.9), int(n * 1.2), int(n * 0.8)):
        for start in range(0, m - size + 1, max(1, m // (200 if m > 1000 else 400))):
            w = long[start : start + size]
            if size == n:
                sim = sum(32 - (int(x) ^ int(y)).bit_count() for x, y in zip(short, w, strict=True)) / (32 * n)
            else:
                a, b = fp.np_features(short).tolist(), fp.np_features(w).tolist()
                sim = lcs(a, b) / min(len(a), len(b))
            best = max(best, sim)
    return best > 0.9 or best >= least


def test_subset_against_the_rule():
    rng, seen = np.random.default_rng(7), set()
    for k in range(40):
        long = rng.integers(1 << 32, size=rng.integers(10, 70), dtype=np.uint64).astype(np.uint32)
        short = long[3 : 3 + rng.integers(5, 45)].copy()
        short[rng.random(len(short)) < k / 45] = 3
        short = np.delete(short, rng.integers(len(short), size=k % 4)) if len(short) > 6 else short
        got = fp.is_subset(short, long, 0.72)
        assert got == plain_subset(short, long, 0.72)
        seen.add(got)
    assert seen == {True, False}


def encoded(w):
    import base64

    return base64.b64encode(np.asarray(w, "<u4").tobytes()).decode()


@pytest.mark.parametrize("group", [2, 64])
def test_similar_recall_and_clusters(spark, monkeypatch, group):
    monkeypatch.setattr(match, "GROUP", group)
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(15):
        base = rng.integers(1 << 32, size=rng.integers(1, 30), dtype=np.uint64).astype(np.uint32)
        for _ in range(4):
            w = base.copy()
            w[rng.integers(len(w), size=rng.integers(0, max(1, len(w) // 5)))] ^= np.uint32(1 << rng.integers(32))
            rows.append({"rowid": len(rows), "_fingerprint": encoded(w), "w": w})
    rows += [{"rowid": 900, "_fingerprint": "FAILED"}, {"rowid": 901, "_fingerprint": ""}, {"rowid": 902}, {"rowid": 903, "_fingerprint": "PCM:x"}]
    sim = lambda a, b: fp._bits(a[: min(len(a), len(b))], b[: min(len(a), len(b))]).sum() / (32 * min(len(a), len(b)))
    want = {(a["rowid"], b["rowid"]) for a in rows if "w" in a for b in rows if "w" in b and a["rowid"] < b["rowid"] and sim(a["w"], b["w"]) >= 0.8}
    start = catalog_rows.working_rows(cat(spark, [{k: v for k, v in r.items() if k != "w"} for r in rows]), Preferences(), Enabled())
    got = {(r["a"], r["b"]) for r in match.similar_pairs(start, 0.8).collect()}
    assert got <= want and len(got) >= 0.9 * len(want)
    c = {r["id"]: r["cluster"] for r in match.clusters(match.similar_pairs(start, 0.8), Stage(spark, "t")).collect()}
    assert all(c[a] == c[b] for a, b in got) and all(v <= k for k, v in c.items())
    kept = match.mark_similar(start, Preferences()).filter(F.col("flags") == model.BIT["Keep"] | model.BIT["SimilarAudio"]).count()
    assert kept == len(set(c.values()))


def test_ranges_and_order(spark):
    d = spark.createDataFrame([(3, "b"), (1, "c"), (2, "b"), (4, "a")], "id bigint, root string")
    assert [r["id"] for r in views.ordered(d).collect()] == [4, 2, 3, 1]
    ids = lambda x: sorted(r["id"] for r in x.collect())
    assert ids(views.ranged(d, 3, 4)) == [2, 3, 4] and ids(views.ranged(d, 3, 3)) == [3] and ids(views.ranged(d, 3, 99)) == [] and ids(views.ranged(d, None, 1)) == []
    some = spark.createDataFrame([(7,)], "id bigint")
    assert ids(views.all_or_none(d, some)) == [] and ids(views.all_or_none(d, some.limit(0))) == [1, 2, 3, 4]


def test_rows_without_a_key_and_hot_keys(spark):
    """A third of the rows under one key, and many under none, stay as a plain model has them."""
    rows = [{"rowid": i, "filename": "hot.wav" if i % 3 == 0 else None if i % 3 == 1 else f"n{i // 6}.wav", "filepath": f"/x/{i}.wav"} for i in range(300)]
    prefs = Preferences(match_criteria=("filename",))
    out = dedupe.mark_duplicates(catalog_rows.working_rows(cat(spark, rows), prefs, Enabled(basic=True)), prefs, Enabled(basic=True))
    got = {r["id"]: r["flags"] for r in out.select("id", "flags").collect()}
    keep, basic = model.BIT["Keep"], model.BIT["Basic"]
    seen: dict = {}
    for r in rows:
        seen.setdefault(r["filename"], []).append(r["rowid"])
    for name, ids in seen.items():
        for k, i in enumerate(ids):
            assert got[i] == (keep if name is None or len(ids) == 1 else basic | keep if k == 0 else basic), (name, i)


def test_landmarks(spark):
    x = spark.createDataFrame([(1, 10, 0), (1, 11, 5), (2, 10, 7), (2, 11, 12), (2, 10, 9), (3, None, 1), (None, 10, 1), (1, 10, 0)], "file_id bigint, hash bigint, time_offset bigint")
    best = landmarks.best_alignments(x, x)
    assert sorted(tuple(r) for r in best.collect()) == [(1, 2, 7, 3), (2, 1, -7, 3)]
    sizes = x.groupBy("file_id").agg(F.count("hash").alias("n"))
    assert landmarks.matches(best, sizes, "Exact").count() == 2 and landmarks.matches(best, sizes, "Subset").count() == 2
    assert landmarks.remove_files(x, x.filter("file_id = 1")).filter("file_id is not null").count() == 4 and landmarks.add_files(x, x.filter("file_id = 2")).count() == x.count()
    peaks = spark.createDataFrame([(1, 0.0, 5), (1, 0.2, 6), (1, 0.9, 7)], "file_id bigint, t double, f bigint")
    assert landmarks.pair_peaks(peaks).count() == 1 and landmarks.pair_peaks(peaks, within=1.0).count() == 3 and landmarks.pair_peaks(peaks, 1, 1.0).count() == 2


def test_edits(spark):
    d = cat(spark, [{"rowid": 1, "filename": "Foo", "filepath": "/foo/Foo", "pathname": "/Foo", "_dirty": 0, "channels": 2}, {"rowid": 2, "_dirty": 0}])
    got = edit.replace_text(d, "pathname", "Foo", "Bar", False, True).filter("rowid = 1").first()
    assert (got["filename"], got["filepath"], got["pathname"], got["_dirty"]) == ("Bar", "/foo/Bar", "/Bar", 1)
    assert edit.replace_text(d, "filename", "Foo", "Bar", True, legacy_filepath=True).filter("rowid = 1").first()["filepath"] == "Bar"
    one = spark.createDataFrame([(1,), (None,), (1,)], "rowid bigint")
    assert edit.delete_ids(d, one).count() == 1 and {r["channels"] for r in edit.mark_mono(d, one).collect()} == {1, None}
    up = spark.createDataFrame([(1, "a"), (1, "b"), (7, "c"), (None, "d")], "rowid bigint, value string")
    assert {r["rowid"]: r["_dualmono"] for r in edit.upsert(d, up, "_dualmono").collect()} == {1: "b", 2: None}


def test_skew_join(spark):
    left = spark.createDataFrame([(1, "a")] * 50 + [(2, "b"), (3, "c"), (None, "d")], "k int, x string")
    right = spark.createDataFrame([(1, 10), (2, 20), (4, 40)], "k int, y int")
    for most in (1, 256):
        assert skew_join(left, right, "k", most=most).count() == 51 and skew_join(left, right, "k", "left", most).count() == 53


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_queries_match_their_sql(spark):
    import duckdb

    import __spark_entry__ as e

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    queries, sql = e.queries(), e.oracle_sql()
    for name in ("path_parts", "roots", "rank_values", "dedupe_basic", "dedupe_names_and_tags", "compare_mark", "similar_links", "similar_clusters", "landmark_matches", "pending_analysis", "dual_mono", "ixml_tags", "version_order", "selection_range", "filter_waveform", "landmark_match", "search_pipeline"):
        df, r = queries[name](spark, SF), con.execute(sql[name])
        names = [c[0] for c in r.description]
        assert sorted(map(repr, (tuple(x[n] for n in names) for x in df.collect()))) == sorted(map(repr, r.fetchall())), name
