"""Problem 4: near-duplicates among multisets of 32-bit words, by MinHash banding with full verification."""

from __future__ import annotations

import base64
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapewright.functions.bind import bind
from tapewright.functions.durations import readable_seconds
from tapewright.functions.fingerprints import is_base64
from tapewright.operators.stage import Stage

#: 32 bands of 4 rows miss a pair of similarity 0.7 with a chance of (1 - 0.7^4)^32 = 1.5e-4, one of 0.8 with 4e-8.
BANDS, ROWS = 32, 4
#: Buckets of more contents than this are refined by rare words before pairs are made.
BUCKET = 64
_SEED = 20_240_607


@F.pandas_udf(T.BinaryType())
def sorted_words(s: pd.Series) -> pd.Series:
    """Little-endian words of base64 texts, sorted; left-over bytes are dropped. Null if there is no word."""

    def one(x: str | None) -> bytes | None:
        if x is None:
            return None
        b = base64.b64decode(x)
        w = np.frombuffer(b, "<u4", count=len(b) // 4)
        return np.sort(w).tobytes() if len(w) else None

    return s.map(one)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _flat(s: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """All words of a batch, and how many each row has."""
    sizes = np.fromiter((len(x) // 4 for x in s), np.int64, len(s))
    return np.frombuffer(b"".join(s), "<u4").astype(np.uint64), sizes


def _elements(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hash of (word, how many equal ones precede it in its row): a multiset as a set."""
    at = np.arange(len(words))
    row = np.repeat(np.arange(len(sizes)), sizes)
    start = np.ones(len(words), bool)
    start[1:] = (words[1:] != words[:-1]) | (row[1:] != row[:-1])
    occurrence = (at - np.maximum.accumulate(np.where(start, at, 0))).astype(np.uint64)
    return _mix(words + (occurrence << np.uint64(32)) + np.uint64(_SEED))


@F.pandas_udf(T.ArrayType(T.LongType()))
def band_hashes(s: pd.Series) -> pd.Series:
    """One hash for each band of MinHashes; rows are sorted words and never empty."""
    if not len(s):
        return pd.Series([], dtype=object)
    words, sizes = _flat(s)
    e, starts = _elements(words, sizes), np.concatenate(([0], np.cumsum(sizes)[:-1]))
    rng = np.random.default_rng(_SEED)
    out = np.empty((len(s), BANDS), np.uint64)
    for band in range(BANDS):
        h = np.full(len(s), band, np.uint64)
        for _ in range(ROWS):
            a, b = rng.integers(1 << 63, size=2, dtype=np.uint64)
            low = np.minimum.reduceat(e * (a | np.uint64(1)) + b, starts)
            h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + low)
        out[:, band] = h
    return pd.Series(list(out.view(np.int64)))


@F.pandas_udf(T.BooleanType())
def similar(a: pd.Series, b: pd.Series, tenths: pd.Series) -> pd.Series:
    """Multiset intersection / union at least ``tenths``/10, in whole numbers."""
    if not len(a):
        return pd.Series([], dtype=bool)

    def runs(s: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words, sizes = _flat(s)
        keys = words + (np.repeat(np.arange(len(s), dtype=np.uint64), sizes) << np.uint64(32))
        return *np.unique(keys, return_counts=True), sizes

    (ka, na, sa), (kb, nb, sb) = runs(a), runs(b)
    common, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    inter = np.bincount((common >> np.uint64(32)).astype(np.int64), np.minimum(na[ia], nb[ib]), len(a)).astype(np.int64)
    return pd.Series(10 * inter >= tenths.to_numpy() * (sa + sb - inter))


@F.pandas_udf(T.ArrayType(T.LongType()))
def elements(s: pd.Series) -> pd.Series:
    if not len(s):
        return pd.Series([], dtype=object)
    words, sizes = _flat(s)
    return pd.Series(np.split(_elements(words, sizes).view(np.int64), np.cumsum(sizes)[:-1]))


def _pairs_in(groups: DataFrame, group: str) -> DataFrame:
    """a < b for the members ``cid`` of each group of at most ``BUCKET``."""
    g = groups.groupBy(group).agg(F.array_sort(F.collect_list("cid")).alias("m")).filter(F.size("m") > 1)
    each = F.transform("m", lambda a, i: F.transform(F.slice("m", i + 2, F.lit(BUCKET)), lambda b: F.struct(a.alias("a"), b.alias("b"))))
    return g.select(F.explode(F.flatten(each)).alias("p")).select("p.*")


def _blocks(groups: DataFrame, sizes: DataFrame, group: str) -> DataFrame:
    """a < b of groups of any size, in square blocks of BUCKET/2 by BUCKET/2, each a group of its own."""
    half = max(1, BUCKET // 2)
    g = groups.join(sizes.withColumn("_g", F.ceil(F.col("_k") / half).cast("int")), group)
    g = g.withColumn("_c", F.pmod(F.xxhash64("cid"), F.col("_g")).cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.col("_g") - 1), lambda o: F.struct(F.least("_c", o).alias("i"), F.greatest("_c", o).alias("j")))
    return g.select(group, "cid", "_c", F.explode(cells).alias("_ij"))


def candidate_pairs(contents: DataFrame, cid: str, words: str, tenths: int, stage: Stage) -> DataFrame:
    """a, b (a < b): contents that share a band. ``contents``: distinct ``cid``, non-empty sorted ``words``."""
    c = contents.select(F.col(cid).alias("cid"), F.col(words).alias("w"))
    keys = stage.put(c.select("cid", F.explode(band_hashes("w")).alias("band")))
    sizes = keys.groupBy("band").agg(F.count(F.lit(1)).alias("_k")).filter(F.col("_k") > 1)
    met = stage.put(keys.join(sizes, "band"))
    stage.drop(keys)
    pairs = _pairs_in(met.filter(F.col("_k") <= BUCKET).select("band", "cid"), "band")
    large = met.filter(F.col("_k") > BUCKET).select("band", "cid")
    if not large.isEmpty():
        # exact for the threshold: similar members of a bucket share an element among the rarest of each
        own = c.join(large.select("cid").distinct(), "cid").select("cid", F.explode(elements("w")).alias("e"))
        own = stage.put(own)
        rare = own.join(own.groupBy("e").agg(F.count(F.lit(1)).alias("n")), "e")
        order = rare.groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("n", "e"))).alias("s"))
        prefix = F.slice("s", F.lit(1), F.size("s") - F.ceil(F.size("s") * tenths / 10).cast("int") + 1)
        heads = stage.put(order.select("cid", F.explode(prefix).alias("x")).select("cid", F.col("x.e").alias("e")))
        fine = stage.put(large.join(heads, "cid").select(F.xxhash64("band", "e").alias("band"), "cid").distinct())
        k = stage.put(fine.groupBy("band").agg(F.count(F.lit(1)).alias("_k")).filter(F.col("_k") > 1))
        pairs = pairs.unionByName(_pairs_in(fine.join(k.filter(F.col("_k") <= BUCKET).select("band"), "band"), "band"))
        blocks = _blocks(fine, k.filter(F.col("_k") > BUCKET), "band")
        x, y = (blocks.select("band", "_ij", F.col("cid").alias(n), F.col("_c").alias(f"c{n}")) for n in ("a", "b"))
        across = x.join(y, ["band", "_ij"]).filter((F.col("a") < F.col("b")) & ((F.col("_ij.i") != F.col("_ij.j")) == (F.col("ca") != F.col("cb"))))
        pairs = pairs.unionByName(across.select("a", "b"))
    return pairs.distinct()


def near_duplicate_classes(df: DataFrame, stage: Stage, key: str = "rowid", fingerprint: str = "_fingerprint", duration: str = "duration", tenths: int = 7, longer_by: int = 10) -> tuple[DataFrame, DataFrame]:
    """(members, links), both stored: members has id, s (seconds), cell (class of durations) and cid, the smallest id with the
    same words, for every row with a readable duration and words; links has a < b for all cids whose words have at least
    ``tenths``/10 in common. Copies are never paired here, so this is the form that any number of copies allows."""
    rows = df.select(F.col(key).cast("bigint").alias("id"), F.col(fingerprint).alias("fp"), F.col(duration).alias("d"))
    rows = bind(rows.filter(is_base64(F.col("fp"))), s=readable_seconds(F.col("d"))).filter(F.col("s").isNotNull())
    rows = rows.select("id", "s", sorted_words("fp").alias("w")).filter(F.col("w").isNotNull())
    width = -math.log(1 - 1 / longer_by) * 1.001
    rows = rows.select("id", "s", "w", F.xxhash64("w").alias("k1"), F.xxhash64(F.lit("second"), "w").alias("k2"), F.floor(F.log(F.col("s").cast("double")) / width).alias("cell"))
    rows = stage.put(rows)
    contents = stage.put(rows.groupBy("k1", "k2").agg(F.min("id").alias("cid"), F.any_value("w").alias("w")))
    members = stage.put(rows.join(contents.select("k1", "k2", "cid"), ["k1", "k2"]).select("cid", "cell", "id", "s"))
    stage.drop(rows)
    pairs = candidate_pairs(contents, "cid", "w", tenths, stage)
    w = contents.select("cid", "w")
    found = pairs.join(w.select(F.col("cid").alias("a"), F.col("w").alias("wa")), "a").join(w.select(F.col("cid").alias("b"), F.col("w").alias("wb")), "b")
    links = stage.put(found.filter(similar("wa", "wb", F.lit(tenths))).select("a", "b"))
    stage.keep(members, links)
    return members, links


def near_duplicates(df: DataFrame, key: str = "rowid", fingerprint: str = "_fingerprint", duration: str = "duration", tenths: int = 7, longer_by: int = 10, stage: Stage | None = None) -> DataFrame:
    """``{key}_a``, ``{key}_b`` (smaller first): every pair of rows whose readable durations differ by at most a
    ``longer_by``-th of the longer and whose fingerprint words have at least ``tenths``/10 in common (multisets).

    Rows without a readable duration or without words (null, empty, ``PCM:``, ``FAILED``, damaged base64) are in no pair.
    Equal word multisets are one content (told by 128 bits of hash); contents meet by MinHash bands, pairs of contents are
    verified on all their words, and only then expanded to rows, by content and neighbouring duration classes: k copies
    of like duration are k (k - 1) / 2 pairs by definition (``near_duplicate_classes`` says the same without them). ``key``
    must be unique; repeated keys pair as rows of their own but not with themselves. No rows give none. Other columns
    are not read.
    """
    stage = stage or Stage(df.sparkSession, "near")
    members, found = near_duplicate_classes(df, stage, key, fingerprint, duration, tenths, longer_by)
    repeated = members.groupBy("cid").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    links = found.unionByName(repeated.select(F.col("cid").alias("a"), F.col("cid").alias("b")))
    x = links.join(members.select(F.col("cid").alias("a"), F.col("id").alias("ida"), F.col("s").alias("sa"), F.col("cell").alias("ca")), "a")
    x = x.withColumn("cell", F.explode(F.array(F.col("ca") - 1, F.col("ca"), F.col("ca") + 1)))
    y = members.select(F.col("cid").alias("b"), "cell", F.col("id").alias("idb"), F.col("s").alias("sb"))
    z = x.join(y, ["b", "cell"]).filter((F.col("a") != F.col("b")) | (F.col("ida") < F.col("idb")))
    z = z.filter(F.abs(F.col("sa") - F.col("sb")) * longer_by <= F.greatest("sa", "sb"))
    return z.select(F.least("ida", "idb").alias(f"{key}_a"), F.greatest("ida", "idb").alias(f"{key}_b"))


def p4_found(spark, sf_dir: str) -> DataFrame:
    stage = Stage(spark, "p4")
    return stage.finish(near_duplicates(spark.read.parquet(f"{sf_dir}/justinmetadata.parquet"), stage=stage))


def p4_classes(spark, sf_dir: str) -> DataFrame:
    """Each row with words and a readable duration: its class (smallest row with the same words), and how many other classes
    are similar to it."""
    stage = Stage(spark, "p4")
    members, links = near_duplicate_classes(spark.read.parquet(f"{sf_dir}/justinmetadata.parquet"), stage)
    n = links.select(F.explode(F.array("a", "b")).alias("cid")).groupBy("cid").agg(F.count(F.lit(1)).alias("n"))
    return stage.finish(members.join(n, "cid", "left").select(F.col("id").alias("rowid"), F.col("cid").alias("class_rowid"), F.coalesce("n", F.lit(0)).alias("similar_classes")))
