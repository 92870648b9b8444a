"""FLAC files made here, subframe by subframe, and read back."""

import numpy as np
import pytest

from tapewright.sources import audio, flac


class Bits(list):
    def put(self, x, n):
        self.extend(x >> i & 1 for i in range(n - 1, -1, -1))

    def done(self):
        return np.packbits(np.array(self, np.uint8)).tobytes()


def rice(out, r, k, parts, order):
    out.put(0, 2)
    out.put(parts, 4)
    size, at = (len(r) + order) >> parts, 0
    for i in range(1 << parts):
        n = size - (order if i == 0 else 0)
        escape = i == 1
        out.put(15 if escape else k, 4)
        if escape:
            out.put(20, 5)
        for v in r[at : at + n]:
            if escape:
                out.put(int(v) & (1 << 20) - 1, 20)
                continue
            u = int(v) * 2 if v >= 0 else -int(v) * 2 - 1
            out.extend([0] * (u >> k) + [1])
            out.put(u & (1 << k) - 1, k)
        at += n


def subframe(out, x, bits, kind, k=5, parts=1):
    wasted = 3 if kind == "wasted" else 0
    code = {"constant": 0, "verbatim": 1, "wasted": 1, "lpc": 32 + 1}.get(kind, 8 + kind if isinstance(kind, int) else 0)
    out.put(0, 1)
    out.put(code, 6)
    out.put(1 if wasted else 0, 1)
    if wasted:
        out.put(1, wasted)
        x, bits = x >> wasted, bits - wasted
    signed = lambda v: out.put(int(v) & (1 << bits) - 1, bits)
    if kind == "constant":
        signed(x[0])
    elif code == 1:
        for v in x:
            signed(v)
    elif kind == "lpc":
        weights, shift = (7, -3), 2
        for v in x[:2]:
            signed(v)
        out.put(4 - 1, 4)
        out.put(shift, 5)
        for c in weights:
            out.put(c & 15, 4)
        guess = np.array([(weights[0] * int(x[i - 1]) + weights[1] * int(x[i - 2])) >> shift for i in range(2, len(x))])
        rice(out, x[2:] - guess, k, parts, 2)
    else:
        for v in x[:kind]:
            signed(v)
        rice(out, np.diff(x, kind), k, parts, kind)


def flac_file(blocks, bits, channels, total):
    info = (4096).to_bytes(2, "big") * 2 + b"\0" * 6 + (48000 << 44 | (channels - 1) << 41 | (bits - 1) << 36 | total).to_bytes(8, "big") + b"\0" * 16
    content = b"fLaC" + b"\0" + len(info).to_bytes(3, "big") + info + b"\x81" + (3).to_bytes(3, "big") + b"\0\0\0"
    for number, (assignment, parts) in enumerate(blocks):
        out = Bits()
        out.put(0xFFF8, 16)
        out.put(7, 4)
        out.put(13, 4)
        out.put(assignment, 4)
        out.put({16: 4, 24: 6}[bits], 3)
        out.put(0, 1)
        out.put(0xC480 + number, 16)  # a number of two bytes
        out.put(len(parts[0][0]) - 1, 16)
        out.put(48000, 16)
        out.put(0, 8)
        for x, b, kind in parts:
            subframe(out, x, b, kind)
        content += out.done() + b"\0\0"
    return content


def tone(n, seed, size):
    rng = np.random.default_rng(seed)
    return (np.sin(np.arange(n) / 11) * size + rng.integers(-40, 40, n)).astype(np.int64)


@pytest.mark.parametrize("bits", [16, 24])
def test_subframes_and_stereo(bits):
    n, size = 64, (1 << (bits - 1)) // 3 if bits == 16 else 20_000
    a, b = tone(n, 1, size), tone(n, 2, size)
    side, mid = a - b, (a + b) >> 1
    blocks = [(1, [(a, bits, k), (b, bits, m)]) for k, m in ((0, 1), (2, 3), (4, "lpc"), ("verbatim", 2))]
    blocks += [(8, [(a, bits, 2), (side, bits + 1, 1)]), (9, [(side, bits + 1, "lpc"), (b, bits, 2)]), (10, [(mid, bits, 2), (side, bits + 1, 2)])]
    content = flac_file(blocks, bits, 2, 7 * n)
    rate, channels, x = audio.pcm(content)
    want = np.tile(np.stack([a, b], 1), (7, 1)).ravel() / (1 << (bits - 1))
    assert (rate, channels) == (48000, 2) and np.array_equal(x, want.astype(np.float32))
    cut = audio.pcm(content[: len(content) - 30])
    assert np.array_equal(cut[2], want[: 6 * 2 * n].astype(np.float32))


def test_constant_and_wasted_bits():
    a = np.full(32, -77, np.int64)
    b = tone(32, 3, 900) << 3
    x = audio.pcm(flac_file([(0, [(a, 16, "constant")]), (0, [(b, 16, "wasted")])], 16, 1, 64))[2]
    assert np.array_equal(x, (np.concatenate([a, b]) / 32768).astype(np.float32))


def test_no_flac():
    assert flac.decode(b"") is None and flac.decode(b"fLaC") is None and flac.decode(b"RIFF" * 20) is None
    empty = flac_file([], 16, 2, 0)
    assert flac.decode(empty)[1:][0] == 2 and len(flac.decode(empty)[2]) == 0
    assert flac.decode(flac_file([], 16, 2, 5) + b"\xff\xff" * 9) is None
