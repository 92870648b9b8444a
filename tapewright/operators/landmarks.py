"""Search in an index of landmarks (hash, file_id, time_offset)."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.functions.alignments import align, spanning
from tapewright.operators.match import clusters
from tapewright.operators.stage import Stage

#: Landmarks of a part of the index (and of the queries) that are compared in one task, and so few that more tasks gain nothing.
BLOCK, FEW = 1 << 19, 1 << 12
#: Links of a task that are held before they are cut down to those that connect its files.
LINKS = 1 << 20


def landmark_hash(f1: Column, f2: Column, seconds: Column) -> Column:
    """Hash of two frequencies and their distance in hundredths of a second."""
    return F.xxhash64(f1, f2, F.round(seconds * 100).cast("bigint"))


def pair_peaks(peaks: DataFrame, most: int = 5, within: float = 0.5) -> DataFrame:
    """file_id, hash, time_offset: each peak (file_id, t, f) with its next ``most`` peaks not later than ``within`` seconds. A
    file's peaks pass by in order; they are never gathered."""
    order = Window.partitionBy("file_id").orderBy("t", "f")
    later = F.array_compact(F.array(*(F.lead(F.struct("t", "f"), k).over(order) for k in range(1, most + 1))))
    d = peaks.select("file_id", "t", "f", later.alias("later")).withColumn("x", F.explode("later")).filter(F.col("x.t") - F.col("t") <= within)
    return d.select("file_id", landmark_hash(F.col("f"), F.col("x.f"), F.col("x.t") - F.col("t")).alias("hash"), F.col("t").alias("time_offset"))


def add_files(index: DataFrame, new: DataFrame) -> DataFrame:
    """The index with the landmarks of ``new``, which replace those of files already in it."""
    return remove_files(index, new.select("file_id")).unionByName(new.select(*index.columns))


def remove_files(index: DataFrame, ids: DataFrame) -> DataFrame:
    return index.join(ids.select("file_id").distinct(), "file_id", "left_anti").select(*index.columns)


def _blocks(queries: DataFrame, index: DataFrame, *more: str) -> tuple[DataFrame, int]:
    """(rows, cells): the landmarks that are not null of both sides, with the columns ``more``, so that each part of the queries
    meets each part of the index in one cell. All rows of a file are in one part."""
    n, m = index.count(), queries.count()
    parts = max(min(index.sparkSession.sparkContext.defaultParallelism, ceil(n / FEW)), ceil(n / BLOCK), 1)
    groups = max(ceil(m / BLOCK), 1)
    own = lambda d, count: d.select("file_id", "hash", "time_offset", *more).dropna().withColumn("own", F.pmod(F.xxhash64("file_id"), F.lit(count)).cast("int"))
    each = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    x = own(index, parts).withColumn("other", each(groups)).select("*", (F.col("other") * parts + F.col("own")).alias("cell"), F.lit(False).alias("asked"))
    q = own(queries, groups).withColumn("other", each(parts)).select("*", (F.col("own") * parts + F.col("other")).alias("cell"), F.lit(True).alias("asked"))
    return x.unionByName(q).drop("own", "other"), parts * groups


def best_alignments(queries: DataFrame, index: DataFrame, share: int | None = None) -> DataFrame:
    """query_id, file_id, delta, hits: of each query and each other file, the shift in time that most common landmarks
    agree on (of several, the smallest). Equal landmarks of a file count as often as they occur on either side; they are
    added up before they meet, so a common hash meets once for each different time. Nulls do not match.

    With ``share``, only pairs with at least a ``share``-th of the query's landmarks (rounded down), and their sizes: q of the
    query and lm of the file. Votes stay in the task of a part of the files and are never shuffled. Queries are the smaller side.
    """
    rows, cells = _blocks(queries, index)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = list(batches)
        if got:
            for _, cell in pd.concat(got, ignore_index=True).groupby("cell"):
                side = lambda asked: tuple(cell.loc[cell["asked"] == asked, c].to_numpy(np.int64) for c in ("file_id", "hash", "time_offset"))
                for found in align(side(True), side(False), share):
                    yield pd.DataFrame(dict(zip(columns, found)))  # noqa: B905

    columns = ("query_id", "file_id", "delta", "hits") + (("q", "lm") if share else ())
    return rows.repartitionById(cells, F.col("cell")).mapInPandas(run, ", ".join(f"{c} bigint" for c in columns))


def _sized(best: DataFrame, sizes: DataFrame | None) -> DataFrame:
    if sizes is None:
        return best
    return best.join(sizes.select(F.col("file_id").alias("query_id"), F.col("n").alias("q")), "query_id").join(sizes.select("file_id", F.col("n").alias("lm")), "file_id")


def matches(best: DataFrame, sizes: DataFrame | None, kind: str) -> DataFrame:
    """Alignments with enough hits for the kind of search; sizes: file_id, n (landmarks), or None if ``best`` has q and lm. Exact: a seventh of the file's
    landmarks (20 at least) and two fifths of the query's; Similar: a quarter, Subset: a third of the query's. Whole
    numbers, rounded down."""
    d = _sized(best, sizes)
    h, q = F.col("hits"), F.col("q")
    test = {"Exact": (h >= F.floor(F.greatest("lm", F.lit(20)) / 7)) & (h >= F.floor(q * 2 / 5)), "Similar": h >= F.floor(q / 4), "Subset": h >= F.floor(q / 3)}[kind]
    return d.filter(test).select("query_id", "file_id", "delta", "hits")


def matches_by_kind(best: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """``matches`` of all kinds, under their ``kind``, from one pass over the alignments."""
    d = _sized(best, sizes)
    h, q = F.col("hits"), F.col("q")
    exact = (h >= F.floor(F.greatest("lm", F.lit(20)) / 7)) & (h >= F.floor(q * 2 / 5))
    kinds = F.array_compact(F.array(F.when(exact, "Exact"), F.when(h >= F.floor(q / 4), "Similar"), F.when(h >= F.floor(q / 3), "Subset")))
    return d.select(F.explode(kinds).alias("kind"), "query_id", "file_id", "delta", "hits")


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links that connect the same files as those given, fewer than there are files."""
    kept, held = [], 0
    for links in batches:
        kept.append(np.stack([links["a"].to_numpy(np.int64), links["b"].to_numpy(np.int64)]))
        held += len(links)
        if held > LINKS:
            kept, held = [spanning(*np.concatenate(kept, axis=1))], 0
    if kept:
        a, b = spanning(*np.concatenate(kept, axis=1))
        yield pd.DataFrame({"a": a, "b": b})


def match_groups(found: DataFrame, stage: Stage) -> DataFrame:
    """file_id, group_id (smallest file of the group): files linked by ``matches``, directly or through others. Each task keeps
    only as many of its links as hold its files together."""
    links = found.select(F.least("query_id", "file_id").alias("a"), F.greatest("query_id", "file_id").alias("b")).filter("a is not null and b is not null")
    return clusters(links.mapInPandas(_forest, "a bigint, b bigint").distinct(), stage).select(F.col("id").alias("file_id"), F.col("cluster").alias("group_id"))


def _links_both_ways(some: DataFrame, others: DataFrame, share: int) -> DataFrame:
    """query_id, file_id: pairs of ``best_alignments`` with ``share`` where one file is of ``some`` and one of ``others``, whichever is
    the query. Both have n, the landmarks of the file, and need not have those that the other side lacks."""
    rows, cells = _blocks(some, others, "n")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = list(batches)
        if got:
            for _, cell in pd.concat(got, ignore_index=True).groupby("cell"):
                a, b = (tuple(cell.loc[cell["asked"] == asked, c].to_numpy(np.int64) for c in ("file_id", "hash", "time_offset", "n")) for asked in (True, False))
                for (*queries, n), (*index, _) in ((a, b), (b, a)):
                    for found in align(tuple(queries), tuple(index), share, n):
                        yield pd.DataFrame({"query_id": found[0], "file_id": found[1]})

    return rows.repartitionById(cells, F.col("cell")).mapInPandas(run, "query_id bigint, file_id bigint")


def groups(index: DataFrame, stage: Stage, share: int = 4) -> DataFrame:
    """``match_groups`` of the matches with a ``share``-th of the query's landmarks (Similar: 4), where every file is a query.

    A query that one hit is enough for matches every file with one of its hashes, so these hashes link their files without a vote.
    Two files of one group need no further link, so only files outside the largest group are aligned, each with all others and
    both ways.
    """
    x = index.select("file_id", "hash", "time_offset").dropna()
    sizes = stage.put(x.groupBy("file_id").agg(F.count(F.lit(1)).alias("n")))
    short = stage.put(sizes.filter(F.col("n") < 2 * share).select("file_id"))
    held = stage.put(x.join(short, "file_id", "left_semi").groupBy("hash").agg(F.min("file_id").alias("query_id")))
    near = match_groups(x.join(held, "hash").filter("query_id != file_id").select("query_id", "file_id"), stage)

    largest = near.groupBy("group_id").count().orderBy(F.col("count").desc(), "group_id").limit(1)
    outside = stage.put(sizes.join(near.join(F.broadcast(largest), "group_id"), "file_id", "left_anti"))
    own = stage.put(x.join(outside, "file_id"))
    hashes = stage.put(own.select("hash").distinct())
    met = stage.put(x.join(hashes, "hash", "left_semi"))
    shared = stage.put(met.groupBy("hash").agg(F.min("file_id").alias("low"), F.max("file_id").alias("high")).filter("low < high").select("hash"))
    some, others = stage.put(own.join(shared, "hash", "left_semi")), stage.put(met.join(shared, "hash", "left_semi").join(sizes, "file_id"))
    found = _links_both_ways(some, others, share)
    of = lambda c: near.select(F.col("file_id").alias(c), F.col("group_id").alias(f"{c}_group"))
    found = found.join(of("query_id"), "query_id", "left").join(of("file_id"), "file_id", "left")
    found = found.select(F.coalesce("query_id_group", "query_id").alias("query_id"), F.coalesce("file_id_group", "file_id").alias("file_id"))
    more = match_groups(found.filter("query_id != file_id"), stage)
    stage.drop(sizes, short, held, outside, own, hashes, met, shared, some, others)

    joined = near.join(more.select(F.col("file_id").alias("group_id"), F.col("group_id").alias("joined")), "group_id", "left")
    return joined.select("file_id", F.coalesce("joined", "group_id").alias("group_id")).unionByName(more.join(near, "file_id", "left_anti"))
