"""Shifts in time that landmarks agree on, and links that hold groups together."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

#: Votes that are counted at once; a query with more is counted by itself.
VOTES = 1 << 17
#: Beyond this, equal votes are added up instead of repeated.
REPEATS = 4

Landmarks = tuple[np.ndarray, np.ndarray, np.ndarray]


def _added_up(side: Landmarks) -> tuple[np.ndarray, ...]:
    """Files, hashes, times and how often each three occur, in the order of files, hashes, times."""
    order = np.lexsort(side[::-1])
    file, h, t = (x[order] for x in side)
    new = np.flatnonzero(np.r_[True, (file[1:] != file[:-1]) | (h[1:] != h[:-1]) | (t[1:] != t[:-1])])
    return file[new], h[new], t[new], np.diff(np.r_[new, len(order)])


def _spread(low: np.ndarray, n: np.ndarray) -> np.ndarray:
    """low, low + 1, ..., ``n`` numbers for each item."""
    return np.arange(n.sum()) + np.repeat(low - (np.cumsum(n) - n), n)


def _place(of: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each value stands in the ordered, non-empty array ``of``, and whether it does."""
    at = np.minimum(np.searchsorted(of, value), len(of) - 1)
    return at, of[at] == value


def _lookup(h: np.ndarray, f: np.ndarray, t: np.ndarray, n: np.ndarray, n_files: int) -> tuple[Callable[..., np.ndarray], Callable[..., np.ndarray]]:
    """(maybe, count) of (hash, file, time + delta): whether a table of bits has it, and how often it is among the rows given."""
    pairs, pair = np.unique(h * n_files + f, return_inverse=True)
    times, time_code = np.unique(t, return_inverse=True)
    rows = pair * len(times) + time_code
    order = np.argsort(rows)
    rows, n = rows[order], n[order]
    bits = min(25, max(10, int(len(h) * 32).bit_length()))
    mixed = lambda h, f, t: (((h * n_files + f) * 0x1E3779B97F4A7C15 ^ t).view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - bits)
    marked = np.zeros(1 << bits, bool)
    marked[mixed(h, f, t)] = True

    def maybe(h: np.ndarray, f: np.ndarray, time: np.ndarray, delta: np.ndarray) -> np.ndarray:
        return marked[mixed(h, f, time + delta)]

    def count(h: np.ndarray, f: np.ndarray, time: np.ndarray, delta: np.ndarray) -> np.ndarray:
        at = time + delta
        i = np.flatnonzero(marked[mixed(h, f, at)] & (((time ^ at) & (delta ^ at)) >= 0))
        p, ok = _place(pairs, h[i] * n_files + f[i])
        k, ok_time = _place(times, at[i])
        r, ok_row = _place(rows, p * len(times) + k)
        out = np.zeros(len(h), np.int64)
        out[i] = np.where(ok & ok_time & ok_row, n[r], 0)
        return out

    return maybe, count


def align(queries: Landmarks, index: Landmarks, share: int | None = None, sizes: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """Query, file, delta, hits, landmarks of the query and of the file: ``operators.landmarks.best_alignments``. With ``sizes`` (of the file
    of each row), ``queries`` need not have the landmarks that are not in ``index``.

    All votes of a query that one hit is enough for are counted. If it needs ``k`` hits, a shift that reaches them either has a row
    in common that the file repeats, or is first met at the query's rarest landmark of those in common, and the more frequent
    ones make up the rest. So the most frequent landmarks that count for less than ``k`` together cast no votes, and a vote
    of another one is followed up only while enough of those more frequent are there.
    """
    if not len(queries[0]) or not len(index[0]):
        return
    xf, xh, xt, xn = _added_up(index)
    files, fc = np.unique(xf, return_inverse=True)
    lm = np.bincount(fc, xn).astype(np.int64)
    order = np.lexsort((xt, fc, xn > 1, xh))
    xh, xt, xn, fc = xh[order], xt[order], xn[order], fc[order]
    hashes, begin, xc = np.unique(xh, return_index=True, return_inverse=True)
    end = np.r_[begin[1:], len(xh)]
    repeated = end - np.add.reduceat(xn > 1, begin, dtype=np.int64)  # from here on, rows that the file repeats

    qf, qh, qt, qn = _added_up(queries)
    ids, qc = np.unique(qf, return_inverse=True)
    size = np.bincount(qc, qn).astype(np.int64) if sizes is None else sizes[np.unique(queries[0], return_index=True)[1]]
    least = np.maximum(1, size // share) if share else np.ones(len(ids), np.int64)
    at, there = _place(hashes, qh)
    qc, qt, qn, at = qc[there], qt[there], qn[there], at[there]
    if not len(qc):
        return
    order = np.lexsort((begin[at] - end[at], qc))  # most frequent first
    qc, qt, qn, at = qc[order], qt[order], qn[order], at[order]
    first = np.flatnonzero(np.r_[True, qc[1:] != qc[:-1]])
    last = np.r_[first[1:], len(qc)]
    own, own_there = _place(files, ids)
    own = np.where(own_there, own, -1)
    wide = int(xt.max()) - int(qt.min()) > 2**62 or int(qt.max()) - int(xt.min()) > 2**62
    starts, ends = np.repeat(first, last - first), np.repeat(last, last - first)
    most_repeated = int(xn.max())
    frequent = np.cumsum(qn) - np.repeat((np.cumsum(qn) - qn)[first], last - first)  # what a row and those more frequent count for
    low = np.where(frequent < least[qc], repeated[at], begin[at])
    n = end[at] - low
    maybe, count = _lookup(xc, fc, xt, xn, len(files)) if (least > 1).any() else (None, None)

    def cast(r: np.ndarray) -> tuple[np.ndarray, ...]:
        row = np.repeat(r, n[r])
        x = _spread(low[r], n[r])
        keep = np.flatnonzero(fc[x] != own[qc[row]])
        if len(keep) < len(row):
            row, x = row[keep], x[keep]
        delta = xt[x] - qt[row]
        if wide and (((xt[x] ^ qt[row]) & (xt[x] ^ delta)) < 0).any():
            raise OverflowError("times are too far apart")
        return row, x, delta

    def pack(q: np.ndarray, f: np.ndarray, delta: np.ndarray) -> tuple[np.ndarray, Callable[..., tuple[np.ndarray, ...]]]:
        """Numbers in the order of queries, files and shifts, and the way back."""
        base, first_q = int(delta.min()), int(q.min())
        span, deltas = int(delta.max()) - base + 1, None
        if (int(q.max()) - first_q + 1) * len(files) * span < 2**63:
            code = delta - base
        else:
            deltas, code = np.unique(delta, return_inverse=True)
            span = len(deltas)

        def back(key: np.ndarray) -> tuple[np.ndarray, ...]:
            pair = key // span
            d = key - pair * span
            return pair, pair // len(files) + first_q, pair % len(files), deltas[d] if deltas is not None else d + base

        return ((q - first_q) * len(files) + f) * span + code, back

    def best(pair: np.ndarray, q: np.ndarray, f: np.ndarray, delta: np.ndarray, hits: np.ndarray) -> tuple[np.ndarray, ...]:
        group = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
        most = np.flatnonzero(hits == np.repeat(np.maximum.reduceat(hits, group), np.diff(np.r_[group, len(hits)])))
        i = most[np.r_[True, pair[most[1:]] != pair[most[:-1]]]]  # of each pair, the smallest delta
        return ids[q[i]], files[f[i]], delta[i], hits[i], size[q[i]], lm[f[i]]

    def counted(row: np.ndarray, x: np.ndarray, delta: np.ndarray) -> tuple[np.ndarray, ...]:
        key, back = pack(qc[row], fc[x], delta)
        weight = qn[row] * xn[x]
        if weight.max() <= REPEATS:
            key = np.repeat(key, weight) if weight.max() > 1 else key
            key.sort()
            new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            hits = np.diff(np.r_[new, len(key)])
        else:
            order = np.argsort(key)
            key = key[order]
            new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            hits = np.add.reduceat(weight[order], new)
        return best(*back(key[new]), hits)

    def in_repeated(row: np.ndarray, f: np.ndarray, delta: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, ...]:
        """Votes of rows that the file repeats, if all other rows that may be there, repeated as often as any, are enough."""
        lacks, at_row, stop = least[qc[row]] - qn[row] * times, starts[row], ends[row]
        i = np.flatnonzero((lacks > 0) & (at_row < stop))
        at_row = at_row[i]
        while len(i):
            lacks[i] -= np.where(maybe(at[at_row], f[i], qt[at_row], delta[i]) & (at_row != row[i]), qn[at_row] * most_repeated, 0)
            at_row = at_row + 1
            go = np.flatnonzero((lacks[i] > 0) & (at_row < stop[i]))
            i, at_row = i[go], at_row[go]
        keep = lacks <= 0
        return row[keep], f[keep], delta[keep]

    def followed_up(row: np.ndarray, x: np.ndarray, delta: np.ndarray) -> tuple[np.ndarray, ...] | None:
        f, single = fc[x], xn[x] == 1
        found = [in_repeated(row[~single], f[~single], delta[~single], xn[x[~single]])]
        row, f, delta = row[single], f[single], delta[single]
        lacks = least[qc[row]] - qn[row]
        before, coming, stop = row - 1, frequent[row] - qn[row], starts[row]
        while len(row):
            done = lacks <= 0
            if done.any():
                found.append((row[done], f[done], delta[done]))
            go = np.flatnonzero(~done & (before >= stop) & (coming >= lacks))
            row, f, delta, lacks, before, coming, stop = (c[go] for c in (row, f, delta, lacks, before, coming, stop))
            now = qn[before]
            lacks -= np.where(maybe(at[before], f, qt[before], delta), now, 0)
            coming -= now
            before -= 1
        row, f, delta = (np.concatenate(c) for c in zip(*found, strict=True))
        if not len(row):
            return None
        key, back = pack(qc[row], f, delta)
        pair, q, f, delta = back(np.unique(key))
        hits = np.zeros(len(q), np.int64)
        place = np.zeros(len(ids), np.int64)
        place[qc[first]] = np.arange(len(first))
        row, stop = first[place[q]], last[place[q]]
        while (go := np.flatnonzero(row < stop)).size:
            r = row[go]
            hits[go] += qn[r] * count(at[r], f[go], qt[r], delta[go])
            row[go] += 1
        keep = np.flatnonzero(hits >= least[q])
        return best(pair[keep], q[keep], f[keep], delta[keep], hits[keep]) if len(keep) else None

    for one in (True, False):
        of = np.flatnonzero((least[qc[first]] == 1) == one)
        votes, start = np.cumsum(np.add.reduceat(n, first)[of]), 0
        while start < len(of):
            stop = max(start + 1, int(np.searchsorted(votes, (votes[start - 1] if start else 0) + VOTES, side="right")))
            k = of[start:stop]
            row, x, delta = cast(_spread(first[k], last[k] - first[k]))
            start = stop
            if len(row) and (found := (counted if one else followed_up)(row, x, delta)) is not None:
                yield found


def spanning(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Two rows: links of the smallest member of each group with every other one."""
    ids, code = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = code[: len(a)], code[len(a) :]
    label = np.arange(len(ids))
    while len(x):
        low, high = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
        apart = low < high
        if not apart.any():
            break
        x, y, low, high = x[apart], y[apart], low[apart], high[apart]
        np.minimum.at(label, high, low)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
    other = np.flatnonzero(label != np.arange(len(ids)))
    return np.stack((ids[label[other]], ids[other]))
