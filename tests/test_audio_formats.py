"""AIFF and floating-point WAV beside integer WAV."""

import struct

import numpy as np
import pytest

from tapewright.sources import audio

X = np.array([0.0, 0.5, -0.5, 0.25, -1.0, 0.125], np.float32)


def chunk(name, data, order):
    return name + struct.pack(order + "I", len(data)) + data + b"\0" * (len(data) % 2)


def aiff(raw, bits, kind=None, offset=0):
    comm = struct.pack(">hIhHQ", 2, 3, bits, 16383 + 15, 44100 << 48) + (kind + b"\0\0" if kind else b"")
    body = (b"AIFC" if kind else b"AIFF") + chunk(b"COMM", comm, ">") + chunk(b"SSND", struct.pack(">II", offset, 0) + b"x" * offset + raw, ">")
    return b"FORM" + struct.pack(">I", len(body)) + body


def float_wav(bits, extensible=False):
    f = struct.pack("<HHIIHH", 0xFFFE if extensible else 3, 2, 44100, 44100 * bits // 4, bits // 4, bits)
    f += struct.pack("<HHIH", 22, bits, 3, 3) + b"\0" * 14 if extensible else b""
    body = b"WAVE" + chunk(b"fmt ", f, "<") + chunk(b"data", X.astype(f"<f{bits // 8}").tobytes(), "<")
    return b"RIFF" + struct.pack("<I", len(body)) + body


def whole(bits, order):
    q = np.round(X.astype(np.float64) * (1 << (bits - 1))).astype(np.int64)
    return b"".join(int(v).to_bytes(bits // 8, order, signed=True) for v in q)


@pytest.mark.parametrize(
    "content",
    [aiff(whole(b, "big"), b) for b in (8, 16, 24, 32)]
    + [aiff(whole(16, "little"), 16, b"sowt", 4), aiff(X.astype(">f4").tobytes(), 32, b"fl32"), float_wav(32), float_wav(64), float_wav(32, True)],
)
def test_formats(content):
    rate, channels, x = audio.pcm(content)
    assert (rate, channels) == (44100, 2) and x.dtype == np.float32 and x.tolist() == X.tolist()


def test_unreadable():
    assert audio.pcm(aiff(b"", 16, b"ima4")) is None and audio.pcm(b"FORM") is None and audio.pcm(b"RIFFxxxxWAVE") is None and audio.pcm(b"") is None
