import os
import sqlite3
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapewright.functions.values import compare_versions
from tapewright.operators.model import Enabled, Preferences
from tapewright.operators.stage import Stage, shared_folder
from tapewright.sources import audio, sqlite
from tapewright.sources.catalog import Catalog
from tapewright.streaming import incremental


@pytest.fixture
def db(tmp_path):
    path = str(tmp_path / "a.sqlite")
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE justinmetadata (FilePath TEXT, Filename TEXT, Duration TEXT, Description TEXT, Channels INTEGER, BitDepth INTEGER, SampleRate REAL, Odd TEXT, _Dirty INTEGER, B BLOB)")
        c.executemany("INSERT INTO justinmetadata VALUES (?,?,?,?,?,?,?,?,?,?)", [(f"/a/x{i % 3}.wav", f"x{i % 3}.wav", "0:01.500", None, 2, 24, 48000.0, 7.0 if i else None, 0, b"\x00\x01") for i in range(10)])
    return path


def test_read(spark, db):
    df = sqlite.read_catalog(spark, db, partitions=3)
    assert df.count() == 10 and sorted(r[0] for r in df.select("rowid").collect()) == list(range(1, 11))
    assert dict(df.dtypes)["Channels"] == "bigint" and df.filter("Odd = '7.0'").count() == 9 and df.filter("Odd is null").count() == 1
    assert df.filter("rowid >= 4 and Channels = 2").count() == 7
    assert sqlite.read_catalog(spark, db, columns=("Filename",)).columns == ["rowid", "Filename"]


def test_write_back(spark, db, tmp_path):
    ids = spark.createDataFrame([(1,), (2,), (99,)], "rowid bigint")
    assert sqlite.delete_rows(db, ids) == 2
    up = spark.createDataFrame([(3, "a"), (1, "b")], "rowid bigint, value string")
    assert sqlite.set_column(db, up, "_DualMono") == 1
    assert {r["rowid"]: r["_DualMono"] for r in sqlite.read_catalog(spark, db).filter("_DualMono is not null").collect()} == {3: "a"}
    out = str(tmp_path / "b.sqlite")
    sqlite.write_catalog(sqlite.read_catalog(spark, db), out)
    a, b = (sorted(map(str, sqlite.read_catalog(spark, p).collect())) for p in (db, out))
    assert a == b


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "e.sqlite")
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE justinmetadata (FilePath TEXT)")
    assert sqlite.read_catalog(spark, path).collect() == []


def test_catalog(spark, db):
    c = Catalog(spark, db)
    assert c.size() == 10 and c.name == "a.sqlite" and "_Dirty" not in c.describe()["columns"]
    rows = c.search(Enabled(basic=True), Preferences(match_criteria=("filename",)))
    assert rows.filter(F.col("flags").bitwiseAND(F.lit(2)) != 0).count() == 3
    copy = c.clone("thinned")
    sqlite.delete_rows(copy.uri, spark.createDataFrame([(1,)], "rowid bigint"))
    assert (c.size(), copy.size()) == (10, 9)
    with c.running():
        assert c.size() == 10
    assert len(c.find("Filename", "X1")) == 3 and c.find("Filename", "X1", True) == [] and c.progress() == []
    assert c.within(60, c.size) == 10
    slow = F.udf(lambda x: __import__("time").sleep(20) or x, "bigint")
    with pytest.raises(TimeoutError):
        c.within(1, lambda: spark.range(2).select(slow("id")).collect())
    c.close()


@pytest.mark.parametrize("bits", [16, 24])
def test_wav_round_trip_and_dual_mono(spark, tmp_path, bits):
    x = np.sin(np.arange(800) / 9) * 0.5
    same, other = np.repeat(x, 2), np.stack([x, -x], 1).ravel()
    for name, s, ch in (("same", same, 2), ("other", other, 2), ("mono", x, 1), ("none", np.empty(0), 2)):
        (tmp_path / f"{name}.wav").write_bytes(audio.encode_wav(s, 48000, ch, bits))
    (tmp_path / "bad.wav").write_bytes(b"RIFFnothing")
    rate, ch, y = audio.pcm((tmp_path / "other.wav").read_bytes())
    assert (rate, ch) == (48000, 2) and np.abs(y - other).max() < 2 / (1 << (bits - 1))
    files = spark.read.format("binaryFile").load(str(tmp_path))
    d = audio.decode(files)
    got = {r[0].rsplit("/", 1)[-1]: r[1] for r in d.select("path", audio.channels_identical(F.col("samples"), F.col("channels"), F.col("path"))).collect()}
    assert got == {"same.wav": True, "other.wav": False, "mono.wav": False, "none.wav": True}
    one = d.filter("path like '%other%'")
    chans = one.select(audio.deinterleave(F.col("samples"), F.col("channels")).alias("c"), audio.mixed_down(F.col("samples"), F.col("channels")).alias("m"), audio.resampled(F.col("samples"), F.col("samplerate"), 24000).alias("r")).first()
    assert np.allclose(chans["c"][0], y[::2]) and np.allclose(chans["m"], 0, atol=1e-4) and len(chans["r"]) == 800
    assert audio.listing(spark, str(tmp_path), "*.wav").count() == 5
    first = {r["path"].rsplit("/", 1)[-1]: audio.pcm(bytes(r["content"])) for r in audio.first_channel(files).collect()}
    assert set(first) == {"same.wav", "other.wav", "none.wav"} and first["other.wav"][1] == 1 and np.abs(first["other.wav"][2] - x).max() < 2 / (1 << (bits - 1))
    raw = {r["path"].rsplit("/", 1)[-1]: np.frombuffer(r["pcm"], "<f4") for r in audio.raw_pcm(d, 48000, 100).collect()}
    assert np.allclose(raw["other.wav"], y[:100]) and len(raw["none.wav"]) == 0


def test_sinc_and_statistics(spark):
    x = np.sin(2 * np.pi * 1000 * np.arange(4800) / 48000)
    y = audio.sinc_resampled(x, 48000, 44100)
    assert len(y) == 4410 and np.abs(y - np.sin(2 * np.pi * 1000 * np.arange(4410) / 44100))[300:-300].max() < 1e-3
    assert len(audio.sinc_resampled(np.empty(0), 8000, 48000)) == 0
    d = spark.createDataFrame([([1.0, 2.0, 6.0],), ([],)], "s array<double>")
    got = [r[0] for r in d.select(audio.statistics(F.col("s"))).collect()]
    assert got[0] == (3.0, 14 / 3, 6.0) and got[1] == (None, 0.0, None)
    assert d.select(audio.as_integers(F.array(F.lit(-2.0), F.lit(0.5)))).first()[0] == [-32767, 16383]
    assert audio.stft_peaks(np.concatenate([x, x]), 48000, per_second=20)[0][1] in (21, 22) and audio.stft_peaks(np.empty(0), 48000, per_second=20) == []


def test_flac_tags():
    def block(kind, data, last=False):
        return bytes([kind | (128 if last else 0)]) + len(data).to_bytes(3, "big") + data

    text = lambda t: len(t.encode()).to_bytes(4, "little") + t.encode()
    comments = text("maker") + (3).to_bytes(4, "little") + text("TITLE=Sea = blue") + text("nothing") + text("ARTIST=é")
    flac = b"fLaC" + block(0, b"\0" * 34) + block(4, comments, True)
    assert list(audio.flac_tags(flac)) == [("TITLE", "Sea = blue"), ("ARTIST", "é")]
    assert list(audio.flac_tags(b"RIFF")) == [] and list(audio.flac_tags(flac[:70])) == []


def test_versions(spark):
    d = spark.createDataFrame([("1.2", "1.2.0"), ("1.10", "1.9"), ("2", "10.0"), ("x.1", "0"), (None, "1")], "a string, b string")
    assert [r[0] for r in d.select(compare_versions(F.col("a"), F.col("b"))).collect()] == [0, 1, -1, 1, None]


def test_metadata(spark, tmp_path):
    def chunk(n, d):
        return n + struct.pack("<I", len(d)) + d + b"\0" * (len(d) % 2)

    body = chunk(b"fmt ", b"\0" * 16) + chunk(b"bext", b"abc") + chunk(b"iXML", b"A = 1=2\nnothing\nB=x\n") + chunk(b"zzzz", b"q")
    (tmp_path / "m.wav").write_bytes(b"RIFF" + struct.pack("<I", len(body) + 4) + b"WAVE" + body)
    rows = audio.metadata_chunks(spark.read.format("binaryFile").load(str(tmp_path))).collect()
    assert [(r["chunk_id"], r["kind"], r["key"], r["value"]) for r in rows] == [("bext", "Bext", None, None), ("iXML", "IXml", None, None), ("iXML", "TextTag", "A", "1=2"), ("iXML", "TextTag", "B", "x"), ("zzzz", "Unknown", None, None)]
    t = spark.createDataFrame([("CHANNELS=2 x CHANNELS=24",)], "t string")
    assert t.select(audio.mono_channel_text(F.col("t"))).first()[0] == "CHANNELS=1 x CHANNELS=24"


def test_peaks(spark):
    tone = np.sin(2 * np.pi * 3000 * np.arange(4096) / 48000).tolist()
    d = spark.createDataFrame([("a", 48000, tone)], "path string, samplerate int, samples array<float>")
    assert {r["f"] for r in audio.peaks(d).collect()} == {64}


def test_incremental(spark, tmp_path):
    cat = spark.createDataFrame([(1, "/a"), (2, "/b"), (3, "/c")], "rowid bigint, filepath string")
    path, seen = str(tmp_path / "cache"), []

    def producer(df):
        seen.append(sorted(r["rowid"] for r in df.collect()))
        return df.select("rowid", F.when(F.col("rowid") != 2, F.lit("ok")).alias("value"))

    there = spark.createDataFrame([("/a",), ("/b",)], "file_path string")
    out = incremental.analyse(cat, path, producer, there)
    assert {r[0]: r[1] for r in out.collect()} == {1: "ok", 2: "FAILED"}
    incremental.analyse(cat, path, producer)
    assert seen == [[1, 2], [2, 3]]
    cat.write.parquet(str(tmp_path / "in"))
    q = incremental.follow(spark, str(tmp_path / "in"), cat.schema, str(tmp_path / "cache2"), str(tmp_path / "cp"), producer)
    q.awaitTermination(60)
    assert incremental.read_cache(spark, str(tmp_path / "cache2")).count() == 3


class Conf(dict):
    @property
    def conf(self):
        return self


def test_shared_folder():
    """A cluster must name its folder; only a single process may do without."""
    assert shared_folder(Conf({"spark.checkpoint.dir": "hdfs://x/y/", "spark.master": "yarn"})) == "hdfs://x/y"
    for master in ("local", "local[4]", "local[*]"):
        assert shared_folder(Conf({"spark.master": master})).startswith("file://")
    for master in ("yarn", "spark://a:7077", "local-cluster[3,2,1000]", "k8s://x"):
        with pytest.raises(ValueError, match="checkpoint"):
            shared_folder(Conf({"spark.master": master}))


def test_stage_owns_its_tables(spark):
    with Stage(spark, "own") as stage:
        folder = stage.root.removeprefix("file://")
        a, b = stage.put(spark.range(3)), stage.put(spark.range(4))
        stage.drop(a)
        assert sorted(os.listdir(folder)) == ["1"] and b.count() == 4
        out = stage.finish(b.filter("id > 1"))
        assert sorted(os.listdir(folder)) == ["2"] and out.count() == 2
    assert not os.path.exists(folder)
