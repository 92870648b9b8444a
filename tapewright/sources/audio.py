"""Audio files as rows: PCM from WAV, AIFF and FLAC, embedded metadata, and whether all channels are the same."""

from __future__ import annotations

import io
import struct
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.sources import flac

# How far channels may differ, by file type; RIFF chunks that hold no metadata.
TOLERANCE, TOLERANCE_AIFF = 1e-6, 1e-4
DATA_CHUNKS = ("fmt ", "data")

#: One row a file. Sample values are within -1 and 1.
DECODED = "path string, samplerate int, channels int, samples array<float>"
CHUNKS = "path string, chunk_id string, kind string, key string, value string, data binary"


def listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """file_path of every file below ``folder``, without reading contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return files.select(F.regexp_replace("path", "^file:/*", "/").alias("file_path"))


def _integers(raw: bytes, width: int, order: str) -> np.ndarray:
    """Samples of signed integers of 1 to 4 bytes; what is left over at the end is dropped."""
    b = np.frombuffer(raw[: len(raw) // width * width], np.uint8).reshape(-1, width)
    if order == ">":
        b = b[:, ::-1]
    full = np.zeros((len(b), 4), np.uint8)
    full[:, 4 - width :] = b
    return (full.view("<i4").ravel() / float(1 << 31)).astype(np.float32)


def _pieces(content: bytes, order: str) -> dict[bytes, bytes]:
    """The first chunk of each name in a RIFF or FORM file."""
    out, at = {}, 12
    while at + 8 <= len(content):
        (n,) = struct.unpack_from(order + "I", content, at + 4)
        out.setdefault(content[at : at + 4], content[at + 8 : at + 8 + n])
        at += 8 + n + n % 2
    return out


def _float_wav(content: bytes) -> tuple[int, int, np.ndarray] | None:
    c = _pieces(content, "<")
    f = c.get(b"fmt ", b"")
    if content[:4] != b"RIFF" or content[8:12] != b"WAVE" or len(f) < 16 or b"data" not in c:
        return None
    tag, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", f)
    tag = struct.unpack_from("<H", f, 24)[0] if tag == 0xFFFE and len(f) >= 40 else tag
    if tag != 3 or bits not in (32, 64) or not channels:
        return None
    return rate, channels, np.frombuffer(c[b"data"][: len(c[b"data"]) // (bits // 8) * (bits // 8)], f"<f{bits // 8}").astype(np.float32)


def _aiff(content: bytes) -> tuple[int, int, np.ndarray] | None:
    c = _pieces(content, ">")
    f, data = c.get(b"COMM", b""), c.get(b"SSND", b"")
    if content[:4] != b"FORM" or content[8:12] not in (b"AIFF", b"AIFC") or len(f) < 18:
        return None
    channels, frames, bits, exponent, mantissa = struct.unpack_from(">hIhHQ", f)
    kind = f[18:22] if content[8:12] == b"AIFC" else b"NONE"
    rate = round(mantissa * 2.0 ** ((exponent & 0x7FFF) - 16383 - 63)) if (exponent & 0x7FFF) < 16447 else 0
    if channels < 1 or rate < 1 or rate >= 1 << 31 or not 1 <= bits <= 64 or len(data) < 8 and frames:
        return None
    width = (bits + 7) // 8
    if kind in (b"fl32", b"FL32", b"fl64", b"FL64"):
        width = int(kind[2:]) // 8
    elif kind not in (b"NONE", b"twos", b"sowt") or width > 4:
        return None
    start = 8 + (struct.unpack_from(">I", data)[0] if len(data) >= 8 else 0)
    raw = data[start : start + frames * channels * width]
    if kind[:2].lower() == b"fl":
        return rate, channels, np.frombuffer(raw[: len(raw) // width * width], f">f{width}").astype(np.float32)
    return rate, channels, _integers(raw, width, "<" if kind == b"sowt" else ">")


def pcm(content: bytes) -> tuple[int, int, np.ndarray] | None:
    """Rate, channels and interleaved samples of a WAV file of 8, 16, 24 or 32 bits or of floating-point numbers, of an
    uncompressed AIFF or AIFF-C file, or of a FLAC file; None for anything else."""
    if content[:4] == b"FORM":
        return _aiff(content)
    if content[:4] == b"fLaC":
        return flac.decode(content)
    try:
        with wave.open(io.BytesIO(content)) as w:
            width, channels, raw = w.getsampwidth(), w.getnchannels(), w.readframes(w.getnframes())
            rate = w.getframerate()
    except (wave.Error, EOFError, struct.error):
        return _float_wav(content)
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw[: len(raw) // 3 * 3], np.uint8).reshape(-1, 3).astype(np.int32)
        x = (((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / (1 << 23)).astype(np.float32)
    else:
        x = (np.frombuffer(raw, "<i2" if width == 2 else "<i4") / float(1 << (8 * width - 1))).astype(np.float32)
    return rate, channels, x


def encode_wav(samples: np.ndarray, rate: int, channels: int, bits: int = 16) -> bytes:
    """PCM WAV of interleaved samples, of 16 or 24 bits."""
    out, x = io.BytesIO(), np.clip(np.asarray(samples, np.float64), -1, 1)
    q = np.round(x * ((1 << (bits - 1)) - 1)).astype("<i4")
    raw = q.astype("<i2").tobytes() if bits == 16 else q.view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(bits // 8)
        w.setframerate(rate)
        w.writeframes(raw)
    return out.getvalue()


def decode(files: DataFrame) -> DataFrame:
    """``DECODED`` for each readable file; files: path, content."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [(p, *d) for p, c in zip(b["path"], b["content"], strict=True) if c is not None and (d := pcm(c))]
            yield pd.DataFrame(got, columns=["path", "samplerate", "channels", "samples"])

    return files.select("path", "content").mapInPandas(run, DECODED)


def channels_identical(samples: Column, channels: Column, path: Column) -> Column:
    """Every frame has the same value, within the file type's tolerance, in all channels. False for mono and null; true
    for several channels without a frame."""
    eps = F.when(F.lower(path).rlike(r"\.aiff?$"), TOLERANCE_AIFF).otherwise(TOLERANCE)
    n = (F.floor(F.size(samples) / channels) * channels).cast("int")
    same = F.forall(F.transform(F.slice(samples, F.lit(1), n), lambda x, i: F.abs(x - F.element_at(samples, (F.floor(i / channels) * channels + 1).cast("int"))) <= eps), lambda ok: ok)
    return F.coalesce((channels > 1) & same, F.lit(False))


def deinterleave(samples: Column, channels: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), channels - 1), lambda c: F.filter(samples, lambda _, i: i % channels == c))


def mixed_down(samples: Column, channels: Column) -> Column:
    """Mean of the channels of each frame."""
    n = F.floor(F.size(samples) / channels).cast("int")
    frame = lambda i: F.aggregate(F.slice(samples, i * channels + 1, channels), F.lit(0.0), lambda s, x: s + x) / channels
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), frame)).otherwise(F.array().cast("array<double>"))


def statistics(samples: Column) -> Column:
    """Struct of mean, variance (of the population) and maximum; nulls for no samples, and a variance of 0 as for silence."""
    n, x = F.size(samples), F.transform(samples, lambda x: x.cast("double"))
    mean = F.when(n > 0, F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / n)
    square = F.aggregate(x, F.lit(0.0), lambda s, v: s + (v - mean) * (v - mean))
    return F.struct(mean.alias("mean"), F.when(n > 0, square / n).otherwise(0.0).alias("variance"), F.array_max(x).alias("maximum"))


def first_channel(files: DataFrame, bits: int = 24) -> DataFrame:
    """path, content: a WAV file of the first channel alone for each readable file of several channels; the files themselves
    stay as they are. files: path, content."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [(p, encode_wav(d[2][:: d[1]], d[0], 1, bits)) for p, c in zip(b["path"], b["content"], strict=True) if c is not None and (d := pcm(c)) and d[1] > 1]
            yield pd.DataFrame(got, columns=["path", "content"])

    return files.select("path", "content").mapInPandas(run, "path string, content binary")


def sinc_resampled(x: np.ndarray, rate: int, to: int, half: int = 128, cutoff: float = 0.95) -> np.ndarray:
    """One channel at another rate, by a sinc of ``half`` zero crossings to each side in a Blackman-Harris window (squared)."""
    if rate == to or not len(x):
        return np.asarray(x, np.float32)
    n, scale = int(len(x) * to / rate), min(1.0, to / rate) * cutoff
    width = int(np.ceil(half / min(1.0, to / rate)))
    padded = np.concatenate([np.zeros(width), np.asarray(x, np.float64), np.zeros(width + 1)])
    out, steps = np.empty(n, np.float32), np.arange(-width + 1, width + 1)
    for start in range(0, n, 4096):
        at = np.arange(start, min(n, start + 4096)) * (rate / to)
        whole = np.floor(at).astype(np.int64)
        d = steps - (at - whole)[:, None]
        u = np.clip(d / width, -1, 1) * np.pi
        window = (0.35875 + 0.48829 * np.cos(u) + 0.14128 * np.cos(2 * u) + 0.01168 * np.cos(3 * u)) ** 2
        out[start : start + len(at)] = (padded[whole[:, None] + steps + width] * np.sinc(d * scale) * window).sum(1) * scale
    return out


def raw_pcm(decoded: DataFrame, to: int = 48_000, most: int = 10 * 60 * 48_000) -> DataFrame:
    """path, pcm: little-endian 32-bit floats, interleaved, at ``to`` samples a second; what lies beyond ``most`` samples, counted
    over all channels, is cut off. decoded: ``DECODED``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = []
            for p, r, ch, s in zip(b["path"], b["samplerate"], b["channels"], b["samples"], strict=True):
                s = np.asarray(s, np.float32)
                s = s[: len(s) // ch * ch].reshape(-1, ch)
                s = s[: int(most // ch * (r / to)) + 1]
                got.append((p, np.stack([sinc_resampled(s[:, k], r, to) for k in range(ch)], 1).ravel()[:most].astype("<f4").tobytes()))
            yield pd.DataFrame(got, columns=["path", "pcm"])

    return decoded.mapInPandas(run, "path string, pcm binary")


def as_integers(samples: Column) -> Column:
    """Samples as 16-bit whole numbers, cut towards zero."""
    return F.transform(samples, lambda x: (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)) * 32767).cast("smallint"))


def resampled(samples: Column, rate: Column, to: int) -> Column:
    """By linear interpolation."""

    @F.pandas_udf("array<float>")
    def run(s: pd.Series, r: pd.Series) -> pd.Series:
        def one(x, f):
            n = int(len(x) * to / f)
            return np.interp(np.arange(n) * (f / to), np.arange(len(x)), x).astype(np.float32) if len(x) else np.empty(0, np.float32)

        return pd.Series([one(x, f) for x, f in zip(s, r, strict=True)])

    return run(samples, rate)


def content_hash(content: Column) -> Column:
    """``PCM:`` and the SHA-256 of the bytes in base64."""
    return F.concat(F.lit("PCM:"), F.base64(F.unhex(F.sha2(content, 256))))


def text_tags(text: str) -> list[tuple[str, str]]:
    """key=value lines, split at the first ``=``, trimmed."""
    return [(k.strip(), v.strip()) for line in text.splitlines() if "=" in line for k, v in [line.split("=", 1)]]


def tag_lines(text: Column) -> Column:
    """``text_tags`` as an expression: an array of structs of key and value."""
    lines = F.filter(F.split(text, r"\r\n|[\n\r]", -1), lambda x: x.contains("="))
    edge = r"\A[ \t]+|[ \t]+\z"
    part = lambda x, i: F.regexp_replace(F.regexp_extract(x, r"(?s)\A([^=]*)=(.*)\z", i), edge, "")
    return F.transform(lines, lambda x: F.struct(part(x, 1).alias("key"), part(x, 2).alias("value")))


def flac_tags(content: bytes) -> Iterator[tuple[str, str]]:
    """Names and values of the Vorbis comments of a FLAC file."""
    at, last = 4, content[:4] != b"fLaC"
    while not last and at + 4 <= len(content):
        last, kind, size = content[at] >> 7, content[at] & 127, int.from_bytes(content[at + 1 : at + 4], "big")
        block, at = content[at + 4 : at + 4 + size], at + 4 + size
        if kind == 4 and len(block) >= 8:
            p = 8 + int.from_bytes(block[:4], "little")
            for _ in range(int.from_bytes(block[p - 4 : p], "little")):
                n = int.from_bytes(block[p : p + 4], "little")
                if p + 4 + n > len(block):
                    return
                name, eq, value = block[p + 4 : p + 4 + n].decode("utf-8", "replace").partition("=")
                if eq:
                    yield name, value
                p += 4 + n


def riff_chunks(content: bytes) -> Iterator[tuple[str, str, str | None, str | None, bytes]]:
    """(chunk_id, kind, key, value, data) of each chunk of a RIFF file that is not sound; sizes are padded to even."""
    if content[:4] != b"RIFF" or len(content) < 12:
        return
    kinds = {"bext": "Bext", "iXML": "IXml", "SMED": "Soundminer", "id3 ": "ID3", "ID3 ": "ID3", "APE ": "APE"}
    at = 12
    while at + 8 <= len(content):
        name, size = content[at : at + 4].decode("latin-1"), struct.unpack("<I", content[at + 4 : at + 8])[0]
        data = content[at + 8 : at + 8 + size]
        if name not in DATA_CHUNKS:
            kind = kinds.get(name, "Unknown")
            yield name, kind, None, None, data
            if kind == "IXml":
                for k, v in text_tags(data.decode("utf-8", "replace")):
                    yield name, "TextTag", k, v, b""
        at += 8 + size + size % 2


def metadata_chunks(files: DataFrame) -> DataFrame:
    """``CHUNKS`` of each file; files: path, content."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [(p, *x) for p, c in zip(b["path"], b["content"], strict=True) if c is not None for x in riff_chunks(c)]
            got += [(p, "VORBIS_COMMENT", "TextTag", k, v, b"") for p, c in zip(b["path"], b["content"], strict=True) if c is not None for k, v in flac_tags(c)]
            yield pd.DataFrame(got, columns=["path", "chunk_id", "kind", "key", "value", "data"])

    return files.select("path", "content").mapInPandas(run, CHUNKS)


def mono_channel_text(text: Column) -> Column:
    """Channel counts of two as one, in embedded text."""
    return F.regexp_replace(text, r"(?i)\b(CHANNELS\s*=\s*|<TRACK_COUNT>\s*)2\b", "$1" + "1")


def stft_peaks(samples: np.ndarray, rate: int, window: int = 1024, hop: int = 512, per_frame: int = 5, per_second: int = 0) -> list[tuple[float, int]]:
    """(seconds, frequency bin) of the strongest local maxima of each frame of a Hann-windowed spectrogram, or, if
    ``per_second`` is given, of the strongest of the whole sound, so many for a second."""
    out = []
    if per_second:
        a = np.abs(np.array([np.fft.rfft(samples[k : k + window] * np.hanning(window)) for k in range(0, len(samples) - window + 1, hop)])).reshape(-1, window // 2 + 1)
        near = np.lib.stride_tricks.sliding_window_view(np.pad(a, 3, constant_values=-1), (7, 7)).max((2, 3)) if a.size else a
        t, f = np.nonzero((a == near) & (a > 0))
        top = np.argsort(-a[t, f], kind="stable")[: int(len(a) * per_second * hop / rate)]
        return sorted((t[i] * hop / rate, int(f[i])) for i in top)
    for k in range(0, len(samples) - window + 1, hop):
        a = np.abs(np.fft.rfft(samples[k : k + window] * np.hanning(window)))
        top = np.flatnonzero((a[1:-1] > a[:-2]) & (a[1:-1] > a[2:]) & (a[1:-1] > a.mean())) + 1
        out += [(k / rate, int(f)) for f in sorted(top[np.argsort(-a[top], kind="stable")[:per_frame]])]
    return out


def peaks(decoded: DataFrame, file_id: str = "path") -> DataFrame:
    """file_id, t, f of the landmarks' peaks; decoded: ``DECODED`` rows of one channel."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [(i, t, f) for i, s, r in zip(b[file_id], b["samples"], b["samplerate"], strict=True) for t, f in stft_peaks(np.asarray(s), int(r))]
            yield pd.DataFrame(got, columns=["file_id", "t", "f"])

    kind = dict(decoded.dtypes)[file_id]
    return decoded.select(file_id, "samples", "samplerate").mapInPandas(run, f"file_id {kind}, t double, f bigint")
