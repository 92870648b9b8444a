"""Fingerprints as words, and how alike two of them are."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapewright.functions.bind import bind

# Factors and limits of subset matching.
SUBSET_FACTORS = ((30, 0.75), (60, 0.8))
SUBSET_FACTOR_LONG, SURE = 0.85, 0.9
WINDOWS = (1.0, 1.1, 0.9, 1.2, 0.8)
LCS_CELLS, LCS_SHARE = 1_000_000, 0.8

# Sizes of the matrices in which all pairs are compared; they bound memory and decide no result.
ROWS, DEPTH, CHECKED, FLOATS = 1024, 128, 1 << 15, 1 << 23

# Bits of the first test of pairs whose pieces are alike; pairs in a tile, of so many on one side; tiles with more left than a pair
# in so many are tested as a whole. They decide no result.
WINDOW, TILE, SIDE, DENSE = 60, 1 << 15, 4096, 32


def is_base64(c: Column) -> Column:
    """Strict standard base64: padded, and with the unused bits of the last character zero. One pass over the text, of any length."""
    padded = F.substring(c, -3, 3)
    rest = ~c.endswith("=") | padded.rlike(r"\A(?:[AQgw]==|[A-Za-z0-9+/][AEIMQUYcgkosw048]=)\z")
    return (F.length(c) % 4 == 0) & rest & c.rlike(r"\A[A-Za-z0-9+/]*+={0,2}\z")


def word_bytes(c: Column) -> Column:
    """The bytes of the words of strict base64, to be read by ``words_of``; null as in ``with_words``."""
    return F.unbase64(F.when(is_base64(c), c))


def is_fingerprint(c: Column) -> Column:
    """Neither null, empty nor FAILED."""
    return F.coalesce((c != "") & (c != "FAILED"), F.lit(False))


def with_words(df: DataFrame, fingerprint: str, name: str) -> DataFrame:
    """Adds ``name``: array of unsigned 32-bit little-endian words as bigint; left-over bytes are dropped. Null for null,
    ``PCM:``, FAILED and anything that is no strict base64; the empty text has no words."""
    c, h = F.col(fingerprint), F.col("_h")
    d = bind(df, _h=F.hex(F.unbase64(F.when(is_base64(c), c))))
    byte = lambda i, k: F.substring(h, i * 8 + 2 * k + 1, F.lit(2))
    word = lambda i: F.conv(F.concat(*(byte(i, k) for k in (3, 2, 1, 0))), 16, 10).cast("bigint")
    n = (F.length(h) / 8).cast("int")
    w = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), word)).when(n == 0, F.array().cast("array<bigint>"))
    return bind(d, **{name: w}).drop("_h")


def similarity(a: Column, b: Column, shift: int = 0) -> Column:
    """Equal bits over the words that both have, from ``shift`` words on in ``b``; 0 if there are none."""
    b = F.slice(b, shift + 1, 2147483647 // 2) if shift else b
    n = F.least(F.size(a), F.size(b))
    same = F.aggregate(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: 32 - F.bit_count(x.bitwiseXOR(y))), F.lit(0).cast("bigint"), lambda s, x: s + x)
    return F.when(n > 0, same / (32 * n)).otherwise(F.lit(0.0))


def similarity_shifted(a: Column, b: Column, most: int = 3) -> Column:
    """The best similarity with either side shifted by up to ``most`` words."""
    return F.greatest(*(similarity(x, y, k) for k in range(most + 1) for x, y in ((a, b), (b, a))))


def features(w: Column) -> Column:
    """16-bit features of neighbouring words, then of words three apart; none of fewer than two words."""
    n = F.size(w)
    two = lambda i: F.element_at(w, i).bitwiseAND(F.lit(65535)).bitwiseXOR(F.shiftright(F.element_at(w, i + 1), 16)).bitwiseAND(F.lit(65535))
    four = lambda i: F.element_at(w, i).bitwiseAND(F.lit(255)).bitwiseOR(F.shiftleft(F.element_at(w, i + 3).bitwiseAND(F.lit(255)), 8))
    none = F.array().cast("array<bigint>")
    return F.concat(F.when(n >= 2, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), two)).otherwise(none), F.when(n >= 4, F.transform(F.sequence(F.lit(1), F.greatest(n - 3, F.lit(1))), four)).otherwise(none))


def _patterns(w: Column) -> Column:
    n = F.size(w)
    return F.when(n >= 2, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.element_at(w, i).bitwiseAND(F.element_at(w, i + 1)))).otherwise(F.array().cast("array<bigint>"))


def feature_ratio(short: Column, long: Column) -> Column:
    """Patterns of neighbours in ``long`` that occur in ``short``, with repeats, over the patterns of ``short``; null if it has none."""
    p = _patterns(short)
    return F.when(F.size(p) > 0, F.size(F.filter(_patterns(long), lambda x: F.array_contains(p, x))) / F.size(p))


# the same for pairs of word arrays in Arrow batches, with what has no built-in expression


def _bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 32 - np.bitwise_count(a ^ b)


def np_features(w: np.ndarray) -> np.ndarray:
    """Of one array, or of each row of a matrix."""
    if w.shape[-1] < 2:
        return np.empty((*w.shape[:-1], 0), np.uint32)
    out = ((w[..., :-1] & 0xFFFF) ^ (w[..., 1:] >> 16)) & 0xFFFF
    return np.concatenate((out, (w[..., :-3] & 0xFF) | ((w[..., 3:] & 0xFF) << 8)), axis=-1) if w.shape[-1] >= 4 else out


def lcs_length(a: np.ndarray, b: np.ndarray, exact: bool = False) -> int:
    """Longest common subsequence, bit-parallel over the longer sequence; beyond ``LCS_CELLS``, unless ``exact``, the number of
    the longer sequence's items that occur in the shorter one, times ``LCS_SHARE``, as the subset rule has it."""
    if not len(a) or not len(b):
        return 0
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if len(a) * len(b) > LCS_CELLS and not exact:
        return int(np.isin(long, short).sum() * LCS_SHARE)
    return _common_length(_positions(short), len(short), long.tolist())


def _positions(a: np.ndarray) -> dict[int, int]:
    """Of each item the places in ``a`` that have it, as bits."""
    at: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        at[x] = at.get(x, 0) | 1 << i
    return at


def _common_length(at: dict[int, int], n: int, items: list[int]) -> int:
    """Longest common subsequence of ``items`` and the ``n`` items of which ``at`` has the places."""
    full = (1 << n) - 1
    v = full
    for y in items:
        u = v & at.get(y, 0)
        v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def flexible_similarity(a: np.ndarray, b: np.ndarray) -> float:
    x, y = np_features(a), np_features(b)
    return lcs_length(x, y) / min(len(x), len(y)) if len(x) and len(y) else 0.0


def is_subset(short: np.ndarray, long: np.ndarray, threshold: float) -> bool:
    """Whether ``short`` occurs in ``long``: by patterns below 15 words, else by windows of five sizes at spaced starts."""
    n, m = len(short), len(long)
    if not n or not m or n > m:
        return False
    least = threshold * next((f for below, f in SUBSET_FACTORS if n < below), SUBSET_FACTOR_LONG)
    if n < 15:
        p = short[:-1] & short[1:]
        return bool(len(p)) and float(np.isin(long[:-1] & long[1:], p).sum()) / len(p) >= least
    step = max(1, m // (200 if m > 1000 else 400))
    mine, whole = np_features(short), np_features(long)
    theirs = np.isin(whole, mine)
    two, four = (np.concatenate(([0], np.cumsum(x))) for x in (theirs[: m - 1], theirs[m - 1 :]))
    common = whole[theirs].tolist()  # all that a common subsequence can have, those of neighbours first
    at: dict[int, int] = {}
    best = 0.0
    for size in dict.fromkeys(int(n * f) if f != 1 else n for f in WINDOWS):
        if size > m or not size:
            continue
        if size == n:
            windows = np.lib.stride_tricks.sliding_window_view(long, n)[::step]
            best = max(best, float(_bits(windows, short).sum(1, dtype=np.int64).max()) / (32 * n))
            if best > SURE or best >= least:
                return True
            continue
        starts = np.arange(0, m - size + 1, step)
        # items of a window that occur in ``short`` at all bound the common subsequence
        (a, b), (c, d) = (two[starts], two[starts + size - 1]), (four[starts], four[starts + size - 3])
        most = b - a + d - c
        items = 2 * size - 4
        room = min(len(mine), items)
        for k in np.flatnonzero(most >= least * room) if room else ():
            if len(mine) * items > LCS_CELLS:
                length = lcs_length(mine, np_features(long[starts[k] : starts[k] + size]))
            else:
                at = at or _positions(mine)
                length = _common_length(at, len(mine), common[a[k] : b[k]] + common[two[-1] + c[k] : two[-1] + d[k]])
            best = max(best, length / room)
            if best > SURE or best >= least:
                return True
    return best >= least


# all pairs of two sets at once: bits as 1 and -1, so that a matrix product counts equal minus unequal bits


def words_of(b: bytes) -> np.ndarray:
    return np.frombuffer(b, "<u4", len(b) // 4)


def _signs(w: np.ndarray) -> np.ndarray:
    """A row of 32 signs for each word, along the last axis."""
    bits = np.unpackbits(np.ascontiguousarray(w).view(np.uint8), axis=-1).astype(np.float32)
    bits *= 2
    bits -= 1
    return bits


def _padded_signs(w: np.ndarray, n: np.ndarray, start: int, end: int) -> np.ndarray:
    """Signs of the words from ``start`` to ``end``; 0 where a row of ``n`` words has none."""
    s = _signs(w[:, start:end])
    if n.min() < end:
        s.reshape(len(w), -1, 32)[np.arange(start, start + s.shape[1] // 32) >= n[:, None]] = 0
    return s


def _padded(words: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of at most ``ROWS`` rows, shortest first: their indexes, lengths, and words in a matrix padded with zeros."""
    n = np.array([len(x) for x in words], np.int64)
    order, out = np.argsort(n, kind="stable"), []
    for at in range(0, len(order), ROWS):
        rows = order[at : at + ROWS]
        w = np.zeros((len(rows), n[rows[-1]]), np.uint32)
        for k, r in enumerate(rows):
            w[k, : n[r]] = words[r]
        out.append((rows, n[rows], w))
    return out


def all_similar(a: list[np.ndarray], b: list[np.ndarray] | None, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Indexes in ``a`` and in ``b``, and similarity, of all pairs that reach ``threshold``; without ``b`` each two of ``a`` once.
    No array is empty of words.

    The first words decide most pairs: what the others could add at most is granted before a pair is left out. The rest
    are counted on all words that both have.
    """
    mine = _padded(a)
    others = mine if b is None else _padded(b)
    for x, (ra, na, wa) in enumerate(mine):
        signs: dict[tuple[int, int], np.ndarray] = {}
        for rb, nb, wb in others[x:] if b is None else others:
            most = int(min(na[-1], nb[-1]))
            decisive = max(0.0, 2 - 2 * threshold) * most
            k = min(most, max(1, ceil(decisive + 0.6 * sqrt(decisive) + 0.5)))
            dot = np.zeros((len(ra), len(rb)), np.float32)
            for start in range(0, k, DEPTH):
                span = start, min(k, start + DEPTH)
                if span not in signs:
                    if len(signs) > 3:
                        signs.clear()
                    signs[span] = _padded_signs(wa, na, *span)
                dot += signs[span] @ _padded_signs(wb, nb, *span).T
            n = na[:, None] if na[-1] <= nb[0] else nb[None, :] if nb[-1] <= na[0] else np.minimum(na[:, None], nb[None, :])
            least = 32 * n * (2 * threshold - 1) - 32 * np.maximum(0, n - k) - 1  # -1 for rounding
            found = np.flatnonzero(dot >= least.astype(np.float32))
            for at in range(0, len(found), CHECKED):
                i, j = np.divmod(found[at : at + CHECKED], len(rb))
                if rb is ra:
                    i, j = i[i < j], j[i < j]
                n = np.minimum(na[i], nb[j])
                if not len(n):
                    continue
                same = np.zeros(len(n), np.int64)
                for start in range(0, int(n.max()), DEPTH):
                    end = min(start + DEPTH, int(n.max()))
                    same += np.where(np.arange(start, end) < n[:, None], _bits(wa[i, start:end], wb[j, start:end]), 0).sum(1, dtype=np.int64)
                s = same / (32 * n)
                ok = s >= threshold
                if ok.any():
                    yield ra[i[ok]], rb[j[ok]], s[ok]


def most_bits(threshold: float, longest: int) -> np.ndarray:
    """How many bits may differ in a pair that has 0, 1, ... ``longest`` words in common; the largest number whose similarity
    reaches ``threshold`` as it is computed."""
    n = 32 * np.arange(1, longest + 1)
    d = np.minimum(np.floor((1 - threshold) * n).astype(np.int64) + 1, n)
    for _ in range(2):
        d -= (n - d) / n < threshold
    return np.concatenate(([0], d))


def piece_limits(threshold: float, longest: int, piece: int, skipped: int, least: int) -> np.ndarray:
    """Running totals of a limit for each piece of ``piece`` bits from word ``skipped`` on. In a pair of ``least`` or more common words, the
    first ``skipped`` of them equal, that reaches ``threshold`` the whole pieces differ in fewer bits than their limits add up to."""
    most = most_bits(threshold, longest)
    whole = 32 * np.maximum(0, np.arange(longest + 1) - skipped) // piece
    each = np.diff(np.floor(((1 - threshold) * piece + 1e-9) * np.arange(max(int(whole[-1]), 1) + 1))).astype(np.int64)
    each[0] = 0  # no pair is found by the first piece, as no other is there to test it by
    for n in range(max(least, skipped + 1), longest + 1):
        while each[: whole[n]].sum() <= most[n]:
            at = np.arange(min(1, whole[n] - 1), whole[n])
            each[at[np.argmin(each[at] + 0.5 * (at * piece < WINDOW))]] += 1
    return np.concatenate(([0], np.cumsum(each)))


def _piece(flat: np.ndarray, at: np.ndarray, start: int, bits: int) -> np.ndarray:
    """``bits`` bits (64 less 4 at most) from bit ``start`` of the rows that begin ``at``; ``flat`` has two words behind them."""
    q, by = start >> 5, start & 31
    x = flat[at + q].astype(np.uint64) | flat[at + (q + 1)].astype(np.uint64) << np.uint64(32)
    if by:
        x = x >> np.uint64(by) | flat[at + (q + 2)].astype(np.uint64) << np.uint64(64 - by)
    return x & np.uint64((1 << bits) - 1)


def similar_by_piece(flat: np.ndarray, begin: np.ndarray, n: np.ndarray, kind: np.ndarray, threshold: float, limits: np.ndarray, c: int, piece: int, skipped: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Indexes and similarity of the pairs that reach ``threshold``, are not of one kind (negative: of none), and are found by
    piece ``c``; over all pieces, that is each such pair once, given what ``piece_limits`` presumes. Row k has the ``n[k]`` words of ``flat``
    from ``begin[k]`` on; three words follow the last.

    Let S be the running total of differing bits minus limits. It is 0 before the first piece and below 0 after the last one
    of such a pair; the pair is found by the piece after which S is least for the first time. So that piece, and it with
    those before it, differ in fewer bits than their limits, and the next piece, if both have one, does not.
    """
    whole = 32 * np.maximum(0, n - skipped) // piece
    rows = np.flatnonzero(whole > c)
    radius = int(limits[c + 1] - limits[c]) - 1
    if radius < 0 or len(rows) < 2:
        return
    first = max(0, c + 1 - WINDOW // piece)
    width = piece * (c + 1 - first)
    near = int(limits[c + 1] - limits[first]) - 1
    most = most_bits(threshold, int(n.max())).astype(np.uint16 if n.max() < 2000 else np.int64)
    window = _piece(flat, begin[rows] + skipped, piece * first, width)
    nxt = (1 << piece) + np.arange(len(rows), dtype=np.uint64)
    if limits[min(c + 2, len(limits) - 1)] > limits[c + 1]:
        more = np.flatnonzero(whole[rows] > c + 1)
        nxt[more] = _piece(flat, begin[rows[more]] + skipped, piece * (c + 1), piece)
    alike = kind[rows] >= 0
    nxt[alike] = (1 << 39) + kind[rows[alike]].astype(np.uint64)
    both = (window >> np.uint64(width - piece)) << np.uint64(40) | nxt
    order = np.argsort(both, kind="stable")
    rows, window, both = rows[order], window[order], both[order]
    after = np.flatnonzero(np.concatenate((both[1:] != both[:-1], [True]))) + 1
    group_end = np.repeat(after, np.diff(np.concatenate(([0], after))))  # rows of a group are of one kind or have the next piece in common, too
    starts = np.concatenate(([0], np.cumsum(np.bincount((both >> np.uint64(40)).astype(np.int64), minlength=1 << piece))))
    masks = np.arange(1, 1 << piece)
    masks = masks[np.bitwise_count(masks) <= radius]
    begin, size, kind, allowed = begin[rows], n[rows], kind[rows], most[n[rows]]
    word = skipped + (piece * (c + 1) >> 5)

    def columns(k: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
        """The two words from ``p`` on of the rows ``k``, and which bits of them a row has."""
        has = np.clip(size[k] - p, 0, 2)
        at = np.minimum(begin[k] + p, len(flat) - 2)
        mask = np.array([0, 0xFFFFFFFF, 0xFFFFFFFFFFFFFFFF], np.uint64)[has]
        return (flat[at].astype(np.uint64) | flat[at + 1].astype(np.uint64) << np.uint64(32)) & mask, mask

    def check(i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for at in range(0, len(i), CHECKED):
            a, b = i[at : at + CHECKED], j[at : at + CHECKED]
            other = (kind[a] != kind[b]) | (kind[a] < 0)
            a, b = a[other], b[other]
            if not len(a):
                continue
            common = np.minimum(size[a], size[b])
            d = np.zeros(len(a), np.int64)
            for p in range(0, int(common.max()), DEPTH // 4):
                k = np.flatnonzero((common > p) & (d <= allowed[a].astype(np.int64)))
                w = p + np.arange(min(DEPTH // 4, int(common.max()) - p))
                x = flat[np.minimum(begin[a[k], None] + w, len(flat) - 1)] ^ flat[np.minimum(begin[b[k], None] + w, len(flat) - 1)]
                d[k] += np.where(w < common[k, None], np.bitwise_count(x), 0).sum(1, dtype=np.int64)
            s = (32 * common - d) / (32 * common)
            ok = np.flatnonzero(s >= threshold)
            for at_ in range(0, len(ok), ROWS):
                k = ok[at_ : at_ + ROWS]
                pieces = 32 * (common[k] - skipped) // piece
                w = skipped + np.arange(-(-piece * int(pieces.max()) // 32))
                x = flat[np.minimum(begin[a[k], None] + w, len(flat) - 1)] ^ flat[np.minimum(begin[b[k], None] + w, len(flat) - 1)]
                bits = np.unpackbits(np.ascontiguousarray(x).astype("<u4").view(np.uint8), axis=1, bitorder="little")[:, : piece * int(pieces.max())]
                total = np.cumsum(bits.reshape(len(k), -1, piece).sum(2, dtype=np.int64), axis=1) - limits[1 : int(pieces.max()) + 1]
                total[np.arange(total.shape[1]) >= pieces[:, None]] = np.iinfo(np.int64).max
                k = k[np.argmin(total, axis=1) == c]
                if len(k):
                    yield rows[a[k]], rows[b[k]], s[k]

    bits, count, okay = np.empty(TILE, np.uint64), np.empty(TILE, np.uint8), np.empty(TILE, bool)
    kept, waiting = [], 0
    for key in np.flatnonzero(np.diff(starts)).tolist():
        low, high = int(starts[key]), int(starts[key + 1])
        others = key ^ masks
        others = others[others > key]
        m = starts[others + 1] - starts[others]
        to = np.cumsum(m)
        there = np.repeat(starts[others] - to + m, m) + np.arange(to[-1] if len(to) else 0)
        there = np.concatenate((np.arange(low, high), there))
        theirs = window[there]
        for j in range(0, len(there), SIDE):
            tile, side = theirs[j : j + SIDE], there[j : j + SIDE]
            pairs: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            step = TILE // len(tile)
            last = high if side[-1] >= high else int(np.searchsorted(group_end[low:high], side[-1], "right")) + low
            for i in range(low, last, step):
                e = min(i + step, last)
                # rows of the same key come first and in order: those of the first row's group are passed over
                skip = min(max(0, int(group_end[i]) - low - j), len(tile))
                a, b = window[i:e], tile[skip:]
                shape = len(a), len(b)
                total = shape[0] * shape[1]
                if not total:
                    continue
                x, y, ok = (z[:total].reshape(shape) for z in (bits, count, okay))
                np.bitwise_xor(a[:, None], b, out=x)
                np.bitwise_count(x, out=y)
                np.less_equal(y, near, out=ok)
                left = np.count_nonzero(ok)
                if left * DENSE > total:
                    ok &= (kind[i:e, None] != kind[side[skip:]]) | (kind[i:e, None] < 0)
                    left = np.count_nonzero(ok)
                if left * DENSE > total:
                    d = np.zeros(shape, most.dtype)
                    limit = np.minimum(allowed[i:e, None], allowed[side[skip:]])
                    mine = np.arange(i, e)
                    for p in range(word, int(size[i:e].max()), 2):
                        if p not in pairs:
                            pairs[p] = columns(side, p)
                        (u, um), (v, vm) = columns(mine, p), pairs[p]
                        np.bitwise_xor(u[:, None], v[skip:], out=x)
                        x &= um[:, None]
                        x &= vm[skip:]
                        d += np.bitwise_count(x)
                        ok &= d <= limit
                        left = np.count_nonzero(ok)
                        if left * DENSE <= total:
                            break
                if left:
                    f, g = np.divmod(np.flatnonzero(ok.ravel()), shape[1])
                    f, g = f + i, side[g + skip]
                    fits = g >= group_end[f]
                    kept.append((f[fits], g[fits]))
                    waiting += len(kept[-1][0])
            if waiting >= CHECKED:
                yield from check(*(np.concatenate(z) for z in zip(*kept, strict=True)))
                kept, waiting = [], 0
    if waiting:
        yield from check(*(np.concatenate(z) for z in zip(*kept, strict=True)))


def _hits(items: tuple[np.ndarray, np.ndarray], own: np.ndarray, longs: int, start: int) -> Iterator[tuple[slice, np.ndarray]]:
    """A range of the rows of ``own`` at a time, and for each of them how many of the items (their values in order, and whose
    they are) it has of each of the ``longs`` from number ``start`` on, repeats counted."""
    values, owner = items
    own = np.sort(own, axis=1)
    new = np.ones(own.shape, bool)
    new[:, 1:] = own[:, 1:] != own[:, :-1]
    flat, ends = own[new], np.concatenate(([0], np.cumsum(new.sum(1))))
    low = np.searchsorted(values, flat, "left")
    each = np.searchsorted(values, flat, "right") - low
    total = np.concatenate(([0], np.cumsum(each)))
    i = 0
    while i < len(own):
        j = i + 1
        while j < len(own) and max((j + 1 - i) * (longs - start), total[ends[j + 1]] - total[ends[i]]) <= FLOATS // 4:
            j += 1
        n = each[ends[i] : ends[j]]
        at = np.arange(n.sum()) + np.repeat(low[ends[i] : ends[j]] - (total[ends[i] : ends[j]] - total[ends[i]]), n)
        row = np.repeat(np.repeat(np.arange(j - i), np.diff(ends[i : j + 1])), n)
        whose = owner[at] - start
        there = whose >= 0
        yield slice(i, j), np.bincount(row[there] * (longs - start) + whose[there], minlength=(j - i) * (longs - start)).reshape(j - i, -1)
        i = j


def all_subsets(shorts: list[np.ndarray], longs: list[np.ndarray], after: np.ndarray, before: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indexes in ``shorts`` and ``longs`` of all pairs that ``is_subset`` accepts, of those with a greater number in ``after``
    than in ``before``.

    Windows of the same size are counted by matrix products. The other sizes can only reach the threshold if enough
    features of the longer array occur in the shorter one at all; those pairs are given to ``is_subset``.
    """
    by_length: dict[int, list[int]] = {}
    for i, w in enumerate(shorts):
        by_length.setdefault(len(w), []).append(i)
    order = np.array(sorted(range(len(longs)), key=lambda j: len(longs[j])), np.int64)
    total = np.cumsum([len(longs[j]) for j in order])
    at = 0
    while at < len(order):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + FLOATS // 32, "right")))
        yield from _subsets(shorts, by_length, [longs[j] for j in order[at:to]], order[at:to], after, before, threshold)
        at = to


def _subsets(shorts: list[np.ndarray], by_length: dict[int, list[int]], theirs: list[np.ndarray], order: np.ndarray, after: np.ndarray, before: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``all_subsets`` of those of the longer arrays that ``order`` names, the shortest first."""
    m = np.array([len(w) for w in theirs], np.int64)
    signs = _signs(np.concatenate(theirs)[:, None])
    items = {}
    for name, of in (("features", np_features), ("patterns", lambda w: w[:-1] & w[1:])):
        parts = [np.asarray(of(w), np.uint32) for w in theirs]
        values, owner = np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(x) for x in parts])
        sort = np.argsort(values, kind="stable")
        items[name] = values[sort], owner[sort]
    for n, whole in by_length.items():
        start = int(np.searchsorted(m, n))
        if n < 2 or start == len(m):
            continue
        least = threshold * next((f for below, f in SUBSET_FACTORS if n < below), SUBSET_FACTOR_LONG)
        rows = max(1, min(ROWS, FLOATS // (32 * n), FLOATS // 4 // (len(m) - start)))
        for cut in range(0, len(whole), rows):
            group = whole[cut : cut + rows]
            ok = after[group][:, None] > before[order[start:]][None, :]
            if not ok.any():
                continue
            own = np.stack([shorts[i] for i in group])
            if n < 15:
                for part, count in _hits(items["patterns"], own[:, :-1] & own[:, 1:], len(m), start):
                    ok[part] &= count / (n - 1) >= least
            else:
                by_bits = _best_bits(own, signs, m, start) / (32 * n)
                by_bits = (by_bits > SURE) | (by_bits >= least)
                room = min(2 * n - 4, 2 * int(n * min(WINDOWS)) - 4)
                for part, count in _hits(items["features"], np_features(own), len(m), start):
                    for k, j in zip(*np.nonzero(ok[part] & ~by_bits[part] & (count >= least * room)), strict=True):
                        by_bits[part.start + k, j] = is_subset(shorts[group[part.start + k]], theirs[start + j], threshold)
                ok &= by_bits
            i, j = np.nonzero(ok)
            if len(i):
                yield np.array(group, np.int64)[i], order[start + j]


def _ranges(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each of ``begins`` on, as many as ``sizes`` says."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1]) + np.repeat(begins - (ends - sizes), sizes)


def _best_bits(own: np.ndarray, signs: np.ndarray, m: np.ndarray, start: int) -> np.ndarray:
    """Equal bits of each row of words with the window, of its size, of each longer array from number ``start`` on that has most of
    them. ``signs`` are those of all longer arrays, ``m`` their sizes.

    Two windows are counted by one product where single precision has room for both: the sum of equal less unequal bits is
    whole and at most 32 n, so that of the second, ``by`` times as much, is told apart from the first. No sum exceeds 2**24.
    """
    n = own.shape[1]
    by = np.float32(64 * (n + 1))
    two = 32 * n * (64 * (n + 1) + 1) <= 1 << 24
    mine = _signs(own).reshape(len(own), -1)
    base = np.cumsum(m) - m
    step = np.maximum(1, m // np.where(m > 1000, 200, 400))
    windows = (m - n) // step + 1
    half = (windows + 1) // 2 if two else windows
    order = start + np.argsort(half[start:], kind="stable")
    count = np.cumsum(half[order])
    best = np.empty((len(own), len(m) - start), np.float64)
    at = 0
    while at < len(order):
        to = max(at + 1, int(np.searchsorted(count, (count[at - 1] if at else 0) + FLOATS // 4 // (32 * n), "right")))
        js = order[at:to]
        h, by_step = half[js], step[js]
        reach = (h - 1) * by_step + n  # words that the first half of the windows has
        words = _ranges(base[js], reach)
        text = signs[words]
        if two:
            text += by * signs[words + np.repeat((windows[js] - h) * by_step, reach)]
        # the first windows of all arrays, then the second ones of those that have more, ...
        more = np.searchsorted(h, np.arange(h[-1]), "right")
        first = np.cumsum(reach) - reach
        begins = np.concatenate([first[x:] + k * by_step[x:] for k, x in enumerate(more)])
        dot = mine @ text[begins[:, None] + np.arange(n)].reshape(-1, 32 * n).T

        def top(dot: np.ndarray) -> np.ndarray:
            out, column = dot[:, : len(js)].copy(), len(js)  # noqa: B023
            for x in more[1:]:  # noqa: B023
                np.maximum(out[:, x:], dot[:, column : column + len(js) - x], out=out[:, x:])  # noqa: B023
                column += len(js) - x  # noqa: B023
            return out

        most = top(dot)
        if two:
            high = dot / by
            np.rint(high, out=high)
            high *= by
            dot -= high
            most = np.maximum(np.rint(most / by), top(dot))
        best[:, js - start] = most
        at = to
    return (best + 32 * n) / 2


@F.pandas_udf(T.DoubleType())
def flexible(a: pd.Series, b: pd.Series) -> pd.Series:
    words = lambda x: np.asarray(x, np.int64).astype(np.uint32)
    return pd.Series([flexible_similarity(words(x), words(y)) if x is not None and y is not None else 0.0 for x, y in zip(a, b, strict=True)], dtype="float64")
