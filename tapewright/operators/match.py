"""Fingerprints that are alike, and fingerprints that are part of others."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.functions.bind import bind
from tapewright.functions.durations import split_seconds
from tapewright.functions.fingerprints import all_similar, all_subsets, is_fingerprint, piece_limits, similar_by_piece, word_bytes, words_of
from tapewright.operators.dedupe import mark_groups, preservation_keys
from tapewright.operators.model import BIT, Preferences, add, drop
from tapewright.operators.stage import Stage

#: Fingerprints are cut into sets of about so many at least, and of so many bytes at most; each two sets are compared in one task.
GROUP, SET_BYTES = 1024, 1 << 26
#: Pairs of rows with found words that are listed at once. It decides no result.
PAIRS = 1 << 20
#: From so many rows on, up to so many bytes of words, alike fingerprints are looked up by pieces if no more than this share of their bits may
#: differ; pieces are long from ``LONG_PIECES`` rows on. Beginnings that so many rows (and
#: one in 64) share, of so many words at most, are compared apart.
INDEXED, INDEXED_BYTES, INDEXED_SHARE, LONG_PIECES, COMMON, COMMON_WORDS = 400_000, 1 << 29, 0.25, 400_000, 1 << 14, 16
#: Rows of the first and of the largest batch that ``subset_families`` settles by itself, and bytes of their words. Once a batch takes less
#: than one in ``FEW`` of the rows behind it, all pairs of the rest are compared at once. They decide no result.
BATCH, LAST_BATCH, BATCH_BYTES, FEW = 128, 1024, 1 << 24, 10


def word_rows(rows: DataFrame, stage: Stage) -> DataFrame:
    """id, w (bytes of the words, at least one) of decodable fingerprints."""
    d = bind(rows.filter(is_fingerprint(F.col("fingerprint"))).select("id", "fingerprint"), b=word_bytes(F.col("fingerprint")))
    d = d.select("id", F.substring("b", F.lit(1), F.length("b") - F.length("b") % 4).alias("w"))
    return stage.put(d.filter(F.col("id").isNotNull() & (F.length("w") >= 4)))


def _tasks(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _meetings(w: DataFrame, compare: Callable[[pd.DataFrame, pd.DataFrame | None], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """What ``compare`` yields for each two of the sets that the rows (with ``id`` and bytes ``w``) are cut into, and for each
    set with itself (second argument None). So each pair of rows meets once, in work of equal shares."""
    spark = w.sparkSession
    tasks = _tasks(spark)
    n, size = w.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("w")), F.lit(0))).first()
    sets = max(1, min(ceil(sqrt(4 * tasks)), ceil(n / GROUP)), ceil(size / SET_BYTES))
    own = F.pmod(F.xxhash64("id"), F.lit(sets)).cast("int")
    d = w.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(sets - 1))))
    d = d.select("*", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")).drop("other")
    d = d.withColumn("cell", (F.col("high") * (F.col("high") + 1) / 2 + F.col("low")).cast("int"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = list(batches)
        if got:
            for (a, b), cell in pd.concat(got, ignore_index=True).groupby(["low", "high"]):
                yield from compare(cell[cell["own"] == a], None if a == b else cell[cell["own"] == b])

    return d.repartitionById(sets * (sets + 1) // 2, F.col("cell")).drop("cell").mapInPandas(run, schema)


def _similar(w: DataFrame, threshold: float) -> DataFrame:
    n, size, longest = w.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("w")), F.lit(0)), F.coalesce(F.max(F.length("w")), F.lit(0))).first()
    if n >= INDEXED and size <= INDEXED_BYTES and 1 - threshold <= INDEXED_SHARE + 1e-9:
        return _similar_by_pieces(w, threshold, n, longest // 4)

    def compare(x: pd.DataFrame, y: pd.DataFrame | None) -> Iterator[pd.DataFrame]:
        words = lambda d: [words_of(b) for b in d["w"]]
        ids = x["id"].to_numpy(), (x if y is None else y)["id"].to_numpy()
        for i, j, s in all_similar(words(x), None if y is None else words(y), threshold):
            a, b = ids[0][i], ids[1][j]
            yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "similarity": s})

    return _meetings(w, compare, "a bigint, b bigint, similarity double")


def _common_beginnings(w: DataFrame, n: int) -> list[bytes]:
    """Beginnings of one or more words that many of the ``n`` rows share, the shorter first; with each, those that it begins with."""
    least = max(COMMON, n // 64)
    found, last = [], [b""]
    for k in range(1, COMMON_WORDS + 1):
        start = F.substring("w", 1, 4 * k)
        d = w.filter(F.length("w") > 4 * k)
        if k > 1:
            d = d.filter(F.substring("w", 1, 4 * k - 4).isin(last))
        last = [bytes(r["p"]) for r in d.groupBy(start.alias("p")).count().filter(F.col("count") >= least).orderBy(F.col("count").desc(), "p").limit(64).collect()]
        found += last
        if not last:
            break
    return found


def _similar_by_pieces(w: DataFrame, threshold: float, n: int, longest: int) -> DataFrame:
    """The pairs of ``_similar``. All rows meet by the pieces of their words (see ``similar_by_piece``), a range of pieces in a task; pairs that share a
    common beginning meet apart, by the pieces behind it, as there each piece of the beginning would bring them together."""
    tasks = w.sparkSession.sparkContext.defaultParallelism
    counts = dict(w.groupBy(F.expr("length(w) div 4").cast("int").alias("n")).count().collect())
    commons = _common_beginnings(w, n)
    sets = []  # of each: its beginning, those that go on from it, piece, least words, limits
    for start in [b"", *commons]:
        k = len(start) // 4
        piece = 15 if not k and n >= LONG_PIECES else 10
        least = max(8 if k else 5, 3 * k + 1)
        sets.append((start, [c for c in commons if len(c) == 4 * k + 4 and c.startswith(start)], piece, least, piece_limits(threshold, longest, piece, k, least)))
    # ranges of pieces that take about as long, as the work of a piece grows with the square of the rows that have it
    piece, limits = sets[0][2], sets[0][4]
    masks = np.bincount(np.bitwise_count(np.arange(1 << piece)), minlength=piece + 1).cumsum()
    have = np.array([sum(x for words, x in counts.items() if 32 * words // piece > c) for c in range(len(limits) - 1)], float)
    work = np.cumsum([h * h * (masks[min(t, piece + 1) - 1] if t else 0) / 2**piece + 30_000 * h for h, t in zip(have, np.diff(limits), strict=True)])
    cuts = [0, *sorted({int(np.searchsorted(work, work[-1] * t / tasks)) + 1 for t in range(1, tasks)} - {len(limits) - 1}), len(limits) - 1]
    cells = [(0, x, y) for x, y in zip(cuts, cuts[1:], strict=False) if x < y] + [(s, 0, len(sets[s][4]) - 1) for s in range(1, len(sets))]

    whole = F.expr(f"(length(w) div 4) * 32 div {piece}")
    into = [F.when((whole > x) if x else F.lit(True) if not s else F.substring("w", 1, len(sets[s][0])) == F.lit(sets[s][0]), F.lit(c)) for c, (s, x, _) in enumerate(cells)]
    d = w.select("id", "w", F.explode(F.array_compact(F.array(*into))).alias("cell"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        (cell,) = {v for b in got for v in b.column("cell").unique().to_pylist()}
        s, x, y = cells[cell]
        start, behind, piece, least, limits = sets[s]
        skipped = len(start) // 4
        ids = np.concatenate([b.column("id").to_numpy(zero_copy_only=False) for b in got])
        sizes, words = [], []
        for b in got:
            col = b.column("w").cast(pa.binary())
            at = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1]
            sizes.append(np.diff(at) // 4)
            words.append(np.frombuffer(col.buffers()[2], np.uint8)[at[0] : at[-1]].view("<u4"))
        del got
        size = np.concatenate(sizes).astype(np.int64)
        flat = np.concatenate([*words, np.zeros(3, "<u4")])
        del words
        begin = np.cumsum(size) - size
        kind = np.full(len(size), -1, np.int32)
        if behind:
            more = np.flatnonzero(size > skipped)
            here, next_ = flat[begin[more] + skipped], np.array([words_of(c)[-1] for c in behind])
            order = np.argsort(next_)
            place = np.minimum(np.searchsorted(next_[order], here), len(next_) - 1)
            goes_on = next_[order][place] == here
            kind[more[goes_on]] = order[place[goes_on]]

        def out(i: np.ndarray, j: np.ndarray, same: np.ndarray) -> pa.RecordBatch:
            a, b = ids[i], ids[j]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(same)], ["a", "b", "similarity"])

        long = np.flatnonzero(size >= least)
        for c in range(x, y):
            for i, j, same in similar_by_piece(flat, begin[long], size[long], kind[long], threshold, limits, c, piece, skipped):
                yield out(long[i], long[j], same)
        if x:
            return
        short, of = np.flatnonzero(size < least), lambda r: [flat[p : p + k] for p, k in zip(begin[r].tolist(), size[r].tolist(), strict=True)]
        for one in range(0, len(short), INDEXED):
            mine = short[one : one + INDEXED]
            for rest in [None, *(r[at : at + INDEXED] for r in (short[one + INDEXED :], long) for at in range(0, len(r), INDEXED))]:
                for i, j, same in all_similar(of(mine), None if rest is None else of(rest), threshold):
                    i, j = mine[i], (mine if rest is None else rest)[j]
                    ok = (kind[i] != kind[j]) | (kind[i] < 0)
                    if ok.any():
                        yield out(i[ok], j[ok], same[ok])

    return d.repartitionById(len(cells), F.col("cell")).mapInArrow(run, "a bigint, b bigint, similarity double")


def similar_pairs(rows: DataFrame, threshold: float, stage: Stage | None = None) -> DataFrame:
    """a, b (a < b), similarity: decodable fingerprints that are alike by at least ``threshold`` in bits over the words
    that both have.

    All pairs are compared, in blocks: a rule on bits leaves no key that alike fingerprints must share. At 0.8 a part of
    18 bits, as many as tell 300,000 fingerprints apart, may differ in 3; to look up all such parts takes about as much
    as to compare all. Copies of a fingerprint are a pair each, as every row is one here; see ``similar_classes``.
    """
    return _similar(word_rows(rows, stage or Stage(rows.sparkSession, "similar")), threshold)


def similar_classes(rows: DataFrame, threshold: float, stage: Stage) -> tuple[DataFrame, DataFrame]:
    """(members, pairs), both stored: id and its class (smallest id with the same words) for each decodable fingerprint, and
    ``similar_pairs`` of the classes. Copies are compared once, however many there are."""
    w = word_rows(rows, stage)
    classes = stage.put(w.groupBy("w").agg(F.min("id").alias("id")))
    members = stage.put(w.join(classes.withColumnRenamed("id", "class"), "w").select("id", "class"))
    return members, stage.put(_similar(classes, threshold))


def similar_links(rows: DataFrame, threshold: float, stage: Stage | None = None) -> DataFrame:
    """id, class, similar_classes (how many other classes are alike): a row for each decodable fingerprint."""
    stage = stage or Stage(rows.sparkSession, "similar")
    members, pairs = similar_classes(rows, threshold, stage)
    n = pairs.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    return members.join(n, "class", "left").select("id", "class", F.coalesce("n", F.lit(0)).alias("similar_classes"))


def clusters(pairs: DataFrame, stage: Stage) -> DataFrame:
    """id, cluster (smallest linked id): labels shrink along links and jump along labels until none changes."""
    links = stage.put(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = stage.put(links.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.min("a")).alias("c")))
    while True:
        near = links.join(label.select(F.col("id").alias("b"), "c"), "b").groupBy(F.col("a").alias("id")).agg(F.min("c").alias("n"))
        step = label.join(near, "id").select("id", F.col("c").alias("old"), F.least("c", "n").alias("c"))
        jump = label.select(F.col("id").alias("c"), F.col("c").alias("up"))
        new = stage.put(step.join(jump, "c").select("id", "old", F.least("c", "up").alias("c")))
        stage.drop(label)
        label = new
        if label.filter("c != old").isEmpty():
            return label.select("id", F.col("c").alias("cluster"))
        label = label.select("id", "c")
        label._stage_path = new._stage_path


def mark_similar(rows: DataFrame, prefs: Preferences, stage: Stage | None = None) -> DataFrame:
    """SimilarAudio on every row of a cluster of alike fingerprints, Keep on the first alone. Clusters are the closure of
    the links, so that no order of the rows matters; they have no cap."""
    stage = stage or Stage(rows.sparkSession, "similar")
    rows = stage.put(rows)
    members, pairs = similar_classes(rows, prefs.similarity_threshold / 100, stage)
    c = clusters(pairs, stage).withColumnRenamed("id", "class")
    c = members.join(c, "class", "left").select("id", F.coalesce("cluster", "class").alias("cluster"))
    own = rows.columns
    return mark_groups(stage.put(rows.join(c, "id", "left")), [F.col("cluster")], F.lit(BIT["SimilarAudio"]), preservation_keys(prefs), reset=False).select(*own)


def _places(rows: DataFrame, stage: Stage) -> DataFrame:
    """id, w as in ``word_rows``, and s, c: rows stand in the order of (s, c, id)."""
    order = rows.select("id", (-F.coalesce(split_seconds(F.col("duration")), F.lit(0.0))).alias("s"), (-F.coalesce("channels", F.lit(0))).alias("c"))
    return word_rows(rows, stage).filter(F.length("w") > 4).join(order, "id").select("id", "s", "c", "w")  # one word occurs in none by the rules


def _of_kinds(shorts: pd.Series, longs: pd.Series, after: np.ndarray, before: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``all_subsets`` of these words (bytes), where equal ones are compared once only, by their last place in ``after`` and their first in ``before``."""
    (x, words), (y, theirs) = pd.factorize(shorts), pd.factorize(longs)
    last, first = np.full(len(words), after.min()), np.full(len(theirs), before.max())
    np.maximum.at(last, x, after)
    np.minimum.at(first, y, before)
    (rows, many, begin), (cols, more, start) = ((np.argsort(k, kind="stable"), n := np.bincount(k), np.cumsum(n) - n) for k in (x, y))
    for i, j in all_subsets([words_of(b) for b in words], [words_of(b) for b in theirs], last, first, least):
        n, end = more[j], np.cumsum(many[i] * more[j])
        for low in range(0, int(end[-1]), PAIRS):
            high = min(low + PAIRS, int(end[-1]))
            p, q = np.searchsorted(end, low, "right"), np.searchsorted(end, high)
            upto = np.minimum(end[p : q + 1], high)
            of = p + np.repeat(np.arange(q + 1 - p), np.diff(upto, prepend=low))
            at = np.arange(low, high) - np.where(of, end[of - 1], 0)
            a, b = rows[begin[i[of]] + at // n[of]], cols[start[j[of]] + at % n[of]]
            ok = after[a] > before[b]
            yield a[ok], b[ok]


def _contained(w: DataFrame, least: float, places: bool) -> DataFrame:
    """child, parent of all rows (id, s, c, w) that occur in one that stands before them; with ``places``, s and c of both.

    Rows are cut into ranges of their order, and runs of ranges make a chunk. A task compares the rows of a range, as parents, with those of a chunk
    that do not stand in a range before it; so no pair meets twice, and many rows meet a few, which suits the matrix products. Rows of a task with
    the same words are compared once.
    """
    n, size = w.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("w")), F.lit(0))).first()
    tasks = _tasks(w.sparkSession)
    most = ceil(sqrt(4 * tasks))  # about as many copies of each row are shuffled as there are chunks
    chunks = max(1, min(most, ceil(n / (8 * GROUP))), ceil(size / SET_BYTES))
    each = 1 if chunks >= most else max(1, min(ceil(8 * tasks / chunks**2), ceil(4 * n / (GROUP * chunks))))
    own, chunk = F.col("own"), F.floor(F.col("own") / each)
    cell = lambda c, p: (c * (c + 1) / 2 * each + p).cast("int")
    into = lambda cells, child: F.transform(cells, lambda x: F.struct(x.alias("cell"), F.lit(child).alias("child")))
    as_child = into(F.transform(F.sequence(F.lit(0), own), lambda p: cell(chunk, p)), True)
    as_parent = into(F.transform(F.sequence(chunk, F.lit(chunks - 1).cast("bigint")), lambda c: cell(c, own)), False)
    d = w.repartitionByRange(chunks * each, "s", "c", "id").withColumn("own", F.spark_partition_id())
    d = d.withColumn("_to", F.explode(F.concat(as_child, as_parent))).select("id", "s", "c", "w", "own", "_to.*")
    schema = "child bigint, parent bigint" + (f", s double, c {w.schema['c'].dataType.simpleString()}, parent_s double, parent_c {w.schema['c'].dataType.simpleString()}" if places else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        for _, rows in pa.Table.from_batches(got).to_pandas().groupby("cell"):
            x, y = rows[rows["child"]], rows[~rows["child"]]
            if not len(x) or not len(y):
                continue
            within = y["own"].iloc[0]
            x, y = x.sort_values(["own", "s", "c", "id"]), y.sort_values(["s", "c", "id"])
            # in the parents' own range all stand in the same order on both sides; all others stand behind every parent, however many there are
            rank = np.where(x["own"] == within, np.arange(len(x)), len(x) + len(y)), np.arange(len(y))
            columns = [(d[k].to_numpy(), side) for k, d, side in [("id", x, 0), ("id", y, 1)] + [("s", x, 0), ("c", x, 0), ("s", y, 1), ("c", y, 1)] * places]
            for at in _of_kinds(x["w"], y["w"], *rank, least):
                yield pa.RecordBatch.from_arrays([pa.array(v[at[side]]) for v, side in columns], names)

    names = ["child", "parent"] + ["s", "c", "parent_s", "parent_c"] * places
    return d.repartitionById(each * chunks * (chunks + 1) // 2, F.col("cell")).mapInArrow(run, schema)


def subset_pairs(rows: DataFrame, threshold: float, stage: Stage | None = None, places: bool = True) -> DataFrame:
    """child, parent: fingerprints that occur in one that stands before them (longer duration, then more channels, then
    smaller id; an unreadable duration is 0); with ``places`` co and po, by which they stand so.

    All pairs in that order are compared, in blocks; one-word fingerprints are in no other by the rules.
    """
    stage = stage or Stage(rows.sparkSession, "subset")
    pairs = _contained(stage.put(_places(rows, stage)), threshold / 100 * 0.9, places)
    place = lambda before, i: F.struct(F.col(f"{before}s").alias("s"), F.col(f"{before}c").alias("c"), F.col(i).alias("i"))
    return pairs.select("child", "parent", place("", "child").alias("co"), place("parent_", "parent").alias("po")) if places else pairs


def subset_families(rows: DataFrame, threshold: float, stage: Stage) -> DataFrame:
    """child, parent: a row that occurs in a parent that stands before it is a child of the earliest such one; all others are
    parents, and children are none. Order and rule are those of ``subset_pairs``.

    Of rows with the same words only the first is walked: the others, which occur in it, are its children or those of its parent. The first
    rows are walked in order, a batch at a time: the batch is settled by itself, then its parents take their children from all rows behind it,
    in parallel, and those leave. When few leave, all pairs of the rest are compared in one job and walked in a single stream.
    """
    least, spark = threshold / 100 * 0.9, rows.sparkSession
    every = stage.put(_places(rows, stage).select("id", F.struct("s", "c", F.col("id").alias("i")).alias("o"), "w"))
    same = stage.put(every.groupBy("w").agg(F.min("o").alias("o"), F.count(F.lit(1)).alias("n")).repartition(_tasks(spark)))
    stored = left = same.select(F.col("o.i").alias("id"), "o", "w")
    found = stage.append(spark.createDataFrame([], "child bigint, parent bigint"), "found")
    behind_it, most = left.count(), BATCH
    while True:
        batch, size = [], 0
        for r in left.orderBy("o").limit(most).collect():
            size += len(r["w"])
            if batch and size > BATCH_BYTES:
                break
            batch.append((r["id"], words_of(bytes(r["w"])), r["o"]))
        if not batch:
            break
        words, place_ = [w for _, w, _ in batch], np.arange(len(batch))
        within: dict[int, list[int]] = {}
        for i, j in all_subsets(words, words, place_, place_, least):
            for x, y in zip(i.tolist(), j.tolist(), strict=True):
                within.setdefault(x, []).append(y)
        first: dict[int, int] = {}  # of each child in the batch its parent, by place
        for i in range(len(batch)):
            own = [j for j in within.get(i, ()) if j not in first]
            if own:
                first[i] = min(own)
        settled = [(batch[i][0], batch[j][0]) for i, j in first.items()]
        parents = [(x, w) for i, (x, w, _) in enumerate(batch) if i not in first]
        last = batch[-1][2]
        behind = left.filter(F.col("o") > F.struct(F.lit(last["s"]).alias("s"), F.lit(last["c"]).alias("c"), F.lit(last["i"]).alias("i")))
        # rows of like length in a task, as those of the same length are compared by one matrix product
        tested = stage.put(behind.repartitionByRange(2 * _tasks(spark), F.length("w"), "id").withColumn("parent", _first_parent(parents, least)("w")))
        stage.drop(stored)
        stored, left = tested, tested.filter("parent is null").drop("parent")
        taken = tested.filter("parent is not null").select(F.col("id").alias("child"), "parent")
        found = stage.append(taken.unionByName(spark.createDataFrame(settled, "child bigint, parent bigint")), "found")
        before, behind_it = behind_it - len(batch), left.count()
        if (before - behind_it) * FEW < before:
            found = stage.append(_walk(left, least, stage), "found")
            break
        most = min(2 * most, LAST_BATCH)
    heads = same.filter("n > 1").select("w", F.col("o.i").alias("head"))
    copies = every.join(heads, "w").filter("id != head").select(F.col("id").alias("child"), "head")
    copies = copies.join(found.select(F.col("child").alias("head"), "parent"), "head", "left")
    return stage.append(stage.put(copies.select("child", F.coalesce("parent", "head").alias("parent"))), "found")


def _walk(left: DataFrame, least: float, stage: Stage) -> DataFrame:
    """child, parent of the walk over ``left`` alone (id, o, w): all pairs, then in order the first of each row whose parent is no child."""

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        children: set[int] = set()
        for b in batches:
            out = []
            for child, parent in zip(b["child"].tolist(), b["parent"].tolist(), strict=True):
                if child not in children and parent not in children:
                    children.add(child)
                    out.append((child, parent))
            yield pd.DataFrame(out, columns=["child", "parent"])

    pairs = stage.put(_contained(left.select("id", "o.s", "o.c", "w"), least, True))
    return pairs.repartition(1).sortWithinPartitions("s", "c", "child", "parent_s", "parent_c", "parent").mapInPandas(settle, "child bigint, parent bigint")


def _first_parent(parents: list[tuple[int, np.ndarray]], least: float):
    ids, words = np.array([i for i, _ in parents], np.int64), [w for _, w in parents]

    @F.pandas_udf("bigint")
    def run(w: pd.Series) -> pd.Series:
        own, best = [words_of(b) for b in w], np.full(len(w), len(words), np.int64)
        for i, j in all_subsets(own, words, np.ones(len(own), np.int64), np.zeros(len(words), np.int64), least):
            np.minimum.at(best, i, j)
        return pd.Series([int(ids[k]) if k < len(words) else None for k in best], dtype="Int64")

    return run


def mark_subsets(rows: DataFrame, prefs: Preferences, stage: Stage | None = None) -> DataFrame:
    """Waveforms on parents and children; parents regain Keep, children lose it."""
    stage = stage or Stage(rows.sparkSession, "subset")
    rows = stage.put(rows)
    fam = stage.put(subset_families(rows, prefs.similarity_threshold, stage))
    roles = fam.select(F.col("child").alias("id"), F.lit(False).alias("_up")).unionByName(fam.select(F.col("parent").alias("id"), F.lit(True).alias("_up")).distinct())
    f, own = F.col("flags"), rows.columns
    new = F.when(F.col("_up"), add(f, "Waveforms", "Keep")).when(~F.col("_up"), add(drop(f, "Keep"), "Waveforms")).otherwise(f)
    return rows.join(roles, "id", "left").select(*(new.alias("flags") if c == "flags" else F.col(c) for c in own))
