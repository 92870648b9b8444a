"""Problem 6: texts of varying length into containers of fixed capacity.

Sizes are whole numbers up to the capacity, and items of one size are interchangeable. So the problem the solver sees
is a histogram of at most ``capacity`` rows whatever the number of texts: bin completion decides which sizes share a
container and how often, and the texts of each size then take their places by rank, in parallel.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.llm.ranks import RUN, running
from tapewright.llm.tokens import RANKS, token_count
from tapewright.operators.stage import Stage

CAPACITY = 4096
#: Containers that the search may try beyond its first descent.
NODES = 2_000
#: Fillings of one container that are looked at, and branches that are kept of them.
LOOKED_AT, BRANCHES = 256, 4

Pattern = tuple[tuple[int, ...], int]  # sizes in a container, number of such containers


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Containers that any packing needs (Martello and Toth's L2)."""
    total = sum(s * n for s, n in counts.items())
    best = -(-total // capacity)
    for k in sorted({s for s in counts if 2 * s <= capacity} | {0}):
        large = sum(n for s, n in counts.items() if s > capacity - k)
        mid = sum(n for s, n in counts.items() if capacity - k >= s > capacity / 2)
        room = mid * capacity - sum(s * n for s, n in counts.items() if capacity - k >= s > capacity / 2)
        small = sum(s * n for s, n in counts.items() if k <= s <= capacity / 2)
        best = max(best, large + mid + max(0, -(-(small - room) // capacity)))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing on the histogram: alike containers with alike room are handled as one."""
    rooms: dict[int, dict[tuple[int, ...], int]] = {}
    keys: list[int] = []

    def put(room: int, content: tuple[int, ...], n: int) -> None:
        if room not in rooms:
            rooms[room] = {}
            keys.insert(bisect_left(keys, room), room)
        rooms[room][content] = rooms[room].get(content, 0) + n

    for s in sorted(counts, reverse=True):
        n = counts[s]
        while n:
            i = bisect_left(keys, s)
            if i == len(keys):
                fits = capacity // s
                if n >= fits:
                    put(capacity - fits * s, (s,) * fits, n // fits)
                    n %= fits
                if n:
                    put(capacity - n * s, (s,) * n, 1)
                n = 0
                break
            room = keys[i]
            content, have = next(iter(rooms[room].items()))
            take = min(n, have)
            if take == have:
                del rooms[room][content]
                if not rooms[room]:
                    del rooms[room]
                    keys.pop(i)
            else:
                rooms[room][content] = have - take
            put(room - s, (*content, s), take)
            n -= take
    return [(c, n) for by in rooms.values() for c, n in by.items()]


def completions(counts: dict[int, int], sizes: list[int], room: int, waste: int) -> Iterator[tuple[int, ...]]:
    """Undominated fillings of ``room`` that leave at most ``waste``, the least waste and the largest items first.

    ``sizes``: available sizes, descending. A filling is dominated if some of its items could give place to one larger
    or equal item that is left out: what it frees is then easier to place elsewhere.
    """
    if counts.get(room):
        yield (room,)  # dominates every other filling
        return
    fit = sizes[bisect_left(sizes, -room, key=lambda s: -s) :]
    for s in fit:  # two items that leave nothing: undominated, and soon found while many sizes are left
        if 2 * s < room:
            break
        if counts.get(room - s, 0) > (2 * s == room):
            yield (s, room - s)
    # reach[i]: bit t is set if sizes fit[i:] can sum to t
    mask = (1 << (room + 1)) - 1
    reach = [1] * (len(fit) + 1)
    for i in range(len(fit) - 1, -1, -1):
        s, r = fit[i], reach[i + 1]
        for _ in range(min(counts[s], room // s)):
            more = (r | r << s) & mask
            if more == r:
                break
            r = more
        reach[i] = r

    def sums(total: int) -> Iterator[tuple[int, ...]]:
        """Every filling of exactly ``total``, largest items first; dead ends are not entered."""
        stack = [(0, total, ())]
        while stack:
            i, t, chosen = stack.pop()
            if not t:
                yield chosen
                continue
            s = fit[i]
            for m in range(min(counts[s], t // s) + 1):
                if reach[i + 1] >> (t - m * s) & 1:
                    stack.append((i + 1, t - m * s, chosen + (s,) * m))

    there = 0
    for s in fit:
        there |= 1 << s

    def dominated(items: tuple[int, ...], slack: int) -> bool:
        """Sums are bits of a number, so that all subsets are looked at whatever their number."""
        free = there
        for x in set(items):
            if counts[x] <= items.count(x):
                free &= ~(1 << x)
        one = some = more = 0  # sums of single items, of one or more, of two or more
        for x in items:
            more |= some << x
            some |= some << x | 1 << x
            one |= 1 << x
        return bool((_up_to(more, slack) | _up_to(one << 1, slack - 1) if slack else more) & free)

    seen, given = 0, False
    for t in range(room, max(-1, room - waste - 1), -1):
        if reach[0] >> t & 1:
            for items in sums(t):
                seen += 1
                if t == room and len(items) == 2:
                    given = True
                    continue
                if not dominated(items, room - t):
                    given = True
                    yield items
                if seen >= LOOKED_AT and given:
                    return


def _up_to(bits: int, more: int) -> int:
    """``bits`` and every bit at most ``more`` above one of them."""
    if more < 0:
        return 0
    width = 1
    while 2 * width <= more + 1:
        bits |= bits << width
        width *= 2
    return bits | bits << (more + 1 - width)


def bin_completion(counts: dict[int, int], capacity: int, nodes: int = NODES) -> tuple[list[Pattern], str]:
    """Patterns that place every item of the histogram, each size at most ``capacity``, and how the search ended.

    Branch and bound: the largest item left gets a container; its undominated fillings are the branches, tried by least
    waste; a filling is repeated while its sizes last. A branch is cut when its waste alone excludes a packing with fewer
    containers than the incumbent, first the best-fit decreasing one. The search ends at the ``lower bound`` (nothing can be
    better), when no branch is left (``exhausted``, of the ``BRANCHES`` kept of each filling), or at a ``limit``: after the
    first descent and ``nodes`` further containers, or before the first descent is through after ``nodes`` and four for each
    token of capacity. Then the incumbent stands; every item is placed in any case.
    """
    counts = {s: n for s, n in counts.items() if n > 0}
    best = best_fit(counts, capacity)
    used, low, total = sum(n for _, n in best), lower_bound(counts, capacity), sum(s * n for s, n in counts.items())
    left, path, tried, descended = dict(counts), [], 0, False
    levels: list[Iterator[tuple[int, ...]]] = []
    sizes = descending = sorted(left, reverse=True)
    waste = bins = 0

    def open_level() -> Iterator[tuple[int, ...]]:
        own, top = {s: left[s] for s in sizes}, sizes[0]
        own[top] -= 1
        spare = max(0, (used - 1) * capacity - total - waste)
        inner = completions(own, sizes[own[top] == 0 :], capacity - top, min(spare, capacity - top))
        return ((top, *x) for x in islice(inner, BRANCHES))

    while used > low:
        if not any(left.values()):
            if bins < used:
                best, used = list(path), bins
            descended = True
        elif len(levels) == len(path):
            sizes = [s for s in descending if left[s]]
            levels.append(open_level())
        # next branch of the deepest level, or back
        while levels:
            if len(levels) == len(path):  # its current branch is done
                items, k = path.pop()
                for s in items:
                    left[s] += k
                bins, waste = bins - k, waste - k * (capacity - sum(items))
            items = next(levels[-1], None)
            if items is None:
                levels.pop()
                continue
            k = min(left[s] // items.count(s) for s in set(items))
            spare = (used - 1) * capacity - total - waste
            loss = capacity - sum(items)
            if loss * k > spare:
                k = spare // loss if loss and spare >= loss else 0
            if k == 0:
                continue
            for s in items:
                left[s] -= k
            path.append((items, k))
            bins, waste = bins + k, waste + k * loss
            break
        tried += 1
        if not levels:
            return best, "exhausted"
        if tried > nodes and (descended or tried > 4 * capacity + nodes):
            return best, "limit"
    return best, "lower bound"


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer: str = RANKS, nodes: int = NODES, stage: Stage | None = None) -> DataFrame:
    """``key``, piece, n_tokens, container: every text's place.

    A text of at most ``capacity`` tokens is one piece (0). A longer one is cut into full pieces and a rest. The pieces of
    a container sum to at most ``capacity``. Null and empty texts have no tokens and are put, as one piece, into container
    0. Repeated rows and keys are items each. No documents give no rows. Columns other than the two named are not read.
    """
    return _packed(docs, key, text, capacity, tokenizer, nodes, stage or Stage(docs.sparkSession, "packing"))[0]


def _packed(docs: DataFrame, key: str, text: str, capacity: int, tokenizer: str, nodes: int, stage: Stage) -> tuple[DataFrame, int, str]:
    """What ``pack`` returns, the fewest containers possible, and how the search ended."""
    n = F.col("n")
    pieces = docs.select(F.col(key).alias("_key"), token_count(F.col(text), tokenizer).alias("n"))
    pieces = pieces.select("_key", "n", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(n / capacity), F.lit(1)).cast("int") - 1)).alias("piece"))
    pieces = stage.put(pieces.select("_key", "piece", F.least(F.lit(capacity), n - F.col("piece") * capacity).cast("int").alias("size")))
    # at most capacity + 1 rows, whatever the number of texts
    counts = {r["size"]: r["n"] for r in pieces.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts.pop(0, None)
    plan, ended = bin_completion(counts, capacity, nodes)
    starts, first, each = [], [], []  # places of each size: from where, into which containers, how many in each
    used, at = dict.fromkeys(counts, 0), 0
    for items, k in plan:
        for s in dict.fromkeys(items):
            m = items.count(s)
            starts.append((s << 48) + used[s])
            first.append(at)
            each.append(m)
            used[s] += m * k
        at += k
    order = np.argsort(np.array(starts, np.int64))
    starts, first, each = (np.array(x, np.int64)[order] for x in (starts, first, each))

    @F.pandas_udf("bigint")
    def container(size: pd.Series, rank: pd.Series) -> pd.Series:
        if not len(starts):
            return pd.Series(np.zeros(len(size), np.int64))
        place = (size.to_numpy(np.int64) << 48) + rank.to_numpy(np.int64)
        i = np.maximum(np.searchsorted(starts, place, "right") - 1, 0)
        return pd.Series(np.where(size == 0, 0, first[i] + (place - starts[i]) // each[i]))

    most = max(counts.values(), default=1)
    run = F.pmod(F.xxhash64("_key", "piece"), F.lit(-(-most // RUN))).cast("int")
    ranked = running(pieces, ["size"], ["_key", "piece"], run, F.lit(1), "rank")
    return ranked.select(F.col("_key").alias(key), "piece", F.col("size").alias("n_tokens"), container("size", "rank").alias("container")), lower_bound(counts, capacity), ended


def p6_containers(spark, sf_dir: str) -> DataFrame:
    stage = Stage(spark, "p6")
    return stage.finish(pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), stage=stage))


def p6_report(spark, sf_dir: str) -> DataFrame:
    """Containers used, the fewest possible by the lower bound, the share of room left, and how the search ended."""
    stage = Stage(spark, "p6")
    packed, low, ended = _packed(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", CAPACITY, RANKS, NODES, stage)
    fill = packed.groupBy("container").agg(F.sum("n_tokens").alias("t"))
    out = fill.agg(F.count(F.lit(1)).alias("containers"), F.sum("t").alias("tokens"), F.max("t").alias("fullest"))
    out = out.withColumns({"at_least": F.lit(low), "search_ended": F.lit(ended)})
    return stage.finish(out.withColumn("unused_share", F.round(1 - F.col("tokens") / (F.col("containers") * CAPACITY), 6)))
