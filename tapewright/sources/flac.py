"""Samples of FLAC files, read by the published format (RFC 9639). Codes of a frame are found one after the other, everything
that does not depend on order is computed for whole frames."""

from __future__ import annotations

from operator import mul

import numpy as np

# Fixed values of the format: bits a sample, and block sizes, by their codes.
BITS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}
BLOCKS = {1: 192} | {c: 576 << (c - 2) for c in range(2, 6)} | {c: 256 << (c - 8) for c in range(8, 16)}
LEFT_SIDE, SIDE_RIGHT, MID_SIDE = 8, 9, 10


class _Frame:
    """A reader of bits from a byte on; ``most`` bytes belong to the frame at most."""

    def __init__(self, data: bytes, most: int):
        self.data, self.at = data[:most], 0
        self._ones = self._bits = None

    def take(self, n: int) -> int:
        end = self.at + n
        if end > 8 * len(self.data):
            raise ValueError("frame ends early")
        x = int.from_bytes(self.data[self.at >> 3 : (end + 7) >> 3], "big") >> (-end & 7)
        self.at = end
        return x & ((1 << n) - 1)

    def signed(self, n: int) -> int:
        x = self.take(n)
        return x - (x >> (n - 1) << n) if n else 0

    def unary(self) -> int:
        n = 0
        while not self.take(1):
            n += 1
        return n

    def numbers(self, count: int, n: int) -> np.ndarray:
        """Signed numbers of ``n`` bits each."""
        return np.array([self.signed(n) for _ in range(count)], np.int64)

    def rice(self, count: int, k: int) -> np.ndarray:
        if self._bits is None:
            self._bits = np.unpackbits(np.frombuffer(self.data, np.uint8))
            place = np.where(self._bits, np.arange(len(self._bits)), len(self._bits))
            self._ones = np.minimum.accumulate(place[::-1])[::-1].tolist()
        ones, at, stops = self._ones, self.at, []
        for _ in range(count):
            stop = ones[at]
            stops.append(stop)
            at = stop + 1 + k
        if count and (stops[-1] >= len(ones) or at > len(ones)):
            raise ValueError("frame ends early")
        end = np.array(stops, np.int64)
        high = end - np.concatenate(([self.at], end[:-1] + 1 + k))[:count]
        low = self._bits[end[:, None] + 1 + np.arange(k)].astype(np.int64) @ (1 << np.arange(k - 1, -1, -1, dtype=np.int64)) if k else 0
        v = (high << k) | low
        self.at = at
        return (v >> 1) ^ -(v & 1)

    def residual(self, block: int, order: int) -> np.ndarray:
        width = 4 + self.take(2)
        parts = 1 << self.take(4)
        out = []
        for i in range(parts):
            k, n = self.take(width), block // parts - (order if i == 0 else 0)
            out.append(self.numbers(n, self.take(5)) if k == (1 << width) - 1 else self.rice(n, k))
        return np.concatenate(out)

    def channel(self, block: int, bits: int) -> np.ndarray:
        self.take(1)
        kind = self.take(6)
        wasted = 1 + self.unary() if self.take(1) else 0
        bits -= wasted
        if kind == 0:
            x = np.full(block, self.signed(bits), np.int64)
        elif kind == 1:
            x = self.numbers(block, bits)
        elif 8 <= kind <= 12:
            order = kind & 7
            first = self.numbers(order, bits)
            x = self.residual(block, order)
            for k in range(order, 0, -1):  # the k-th differences are summed up from their first value
                x = np.cumsum(np.concatenate((np.diff(first, k - 1)[:1], x)))
        elif kind >= 32:
            order = (kind & 31) + 1
            s = self.numbers(order, bits).tolist()
            precision, shift = self.take(4) + 1, self.signed(5)
            weights = self.numbers(order, precision).tolist()[::-1]
            for r in self.residual(block, order).tolist():
                s.append(r + (sum(map(mul, weights, s[-order:])) >> shift))
            x = np.array(s, np.int64)
        else:
            raise ValueError("reserved kind of subframe")
        return x << wasted


def _frame(data: bytes, most: int, channels: int, bits: int) -> tuple[np.ndarray, int]:
    """Samples of a frame, a column for each channel, and its bytes."""
    f = _Frame(data, most)
    if f.take(15) != 0x7FFC:
        raise ValueError("no frame")
    f.take(1)
    size, rate, kind, depth = f.take(4), f.take(4), f.take(4), f.take(3)
    f.take(1)
    lead = f.take(8)
    while lead & 0xC0 == 0xC0:  # as many further bytes as the first has ones beyond its first
        f.take(8)
        lead = lead << 1 & 0xFF
    block = f.take(8) + 1 if size == 6 else f.take(16) + 1 if size == 7 else BLOCKS[size]
    f.take({12: 8, 13: 16, 14: 16}.get(rate, 0))
    f.take(8)
    bits = BITS.get(depth, bits)
    n = 2 if kind >= LEFT_SIDE else kind + 1
    if n != channels or kind > MID_SIDE:
        raise ValueError("other channels")
    wide = {LEFT_SIDE: (0, 1), SIDE_RIGHT: (1, 0), MID_SIDE: (0, 1)}.get(kind, (0,) * n)
    x = [f.channel(block, bits + w) for w in wide]
    if kind == LEFT_SIDE:
        x[1] = x[0] - x[1]
    elif kind == SIDE_RIGHT:
        x[0] = x[0] + x[1]
    elif kind == MID_SIDE:
        mid = x[0] << 1 | (x[1] & 1)
        x = [(mid + x[1]) >> 1, (mid - x[1]) >> 1]
    return np.stack(x, 1) / float(1 << (bits - 1)), (f.at + 7) // 8 + 2


def decode(content: bytes) -> tuple[int, int, np.ndarray] | None:
    """Rate, channels and interleaved samples; of a damaged file the frames before the damage. None for anything that is no
    FLAC file, and where no frame can be read of a file that should have some. Check sums are not looked at."""
    if content[:4] != b"fLaC":
        return None
    at, last, info = 4, False, b""
    while not last and at + 4 <= len(content):
        last, size = bool(content[at] >> 7), int.from_bytes(content[at + 1 : at + 4], "big")
        if content[at] & 127 == 0:
            info = content[at + 4 : at + 4 + size]
        at += 4 + size
    if len(info) < 18:
        return None
    packed = int.from_bytes(info[10:18], "big")
    rate, channels, bits, total = packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1
    most = 64 + (int.from_bytes(info[2:4], "big") + 16) * channels * (bits // 8 + 2)
    frames = []
    while at < len(content):
        try:
            x, size = _frame(content[at : at + most], most, channels, bits)
        except (ValueError, KeyError, IndexError):
            break
        frames.append(x)
        at += size
    if not frames and total:
        return None
    x = np.concatenate(frames) if frames else np.empty((0, channels))
    return rate, channels, (x[:total] if total else x).ravel().astype(np.float32)
