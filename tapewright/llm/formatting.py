"""Problem 1: records that differ only in white space, letter case, punctuation or the order of their parts.

A record is the multiset of its (field, word) pairs. Every pair is hashed, the hashes are combined by addition, which
does not depend on order (a multiset hash in the manner of MSet-Add-Hash, Clarke et al. 2003), records are grouped by
the sum, and the words of each group are compared, as counts, with those of its representative: nothing is sorted.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.functions.bind import bind
from tapewright.operators.stage import Stage

_WORD_GAPS = r"[^\p{L}\p{M}\p{N}]+"
_LOW32 = 0xFFFFFFFF


def _composed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda x: None if x is None else unicodedata.normalize("NFC", unicodedata.normalize("NFC", x).lower()))


def _with_words(df: DataFrame, fields: list[str]) -> DataFrame:
    """Adds ``_words``: array of words, of several fields as ``field\\u0000word``.

    Text up to U+02AF is in composed form already and stays in the JVM; only texts with other characters, such as
    combining marks, are handed to Python to be composed (of all others, it sees a null)."""
    compose = F.pandas_udf(_composed, "string")
    own = df.columns
    beyond = lambda f: F.coalesce(F.col(f).rlike(r"[^\x{0}-\x{2AF}]"), F.lit(False))
    df = df.withColumns({f"_t_{f}": compose(F.when(beyond(f), F.col(f))) for f in fields})

    def words(f: str) -> Column:
        text = F.when(beyond(f), F.col(f"_t_{f}")).otherwise(F.lower(F.col(f)))
        cut = F.filter(F.split(F.coalesce(text, F.lit("")), _WORD_GAPS), lambda w: w != "")
        return F.transform(cut, lambda w: F.concat(F.lit(f + "\0"), w)) if len(fields) > 1 else cut

    return df.select(*own, F.concat(*map(words, fields)).alias("_words"))


def _multiset_hash(words: Column, field: str = "") -> Column:
    """Sums of the four 32-bit quarters of two 64-bit hashes of each pair of field name and word, as a struct of bigint.
    ``field``: the name that all words belong to, if they do not carry it themselves."""

    def add(acc: Column, w: Column) -> Column:
        h, g = F.xxhash64(F.lit(field), w), F.xxhash64(F.lit("second"), F.lit(field), w)
        half = lambda x, up: F.shiftrightunsigned(x, 32) if up else x.bitwiseAND(F.lit(_LOW32))
        return F.struct(
            (acc["a"] + half(h, False)).alias("a"), (acc["b"] + half(h, True)).alias("b"),
            (acc["c"] + half(g, False)).alias("c"), (acc["d"] + half(g, True)).alias("d"), (acc["n"] + 1).alias("n"),
        )

    zero = F.struct(*(F.lit(0).cast("bigint").alias(x) for x in "abcdn"))
    return F.aggregate(words, zero, add)


def _variants(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row for each distinct sequence of words: _text (the words), first, n. Copies in the same order, the usual case,
    are added up before any shuffle."""
    rows = _with_words(df.select(F.col(key).cast("bigint").alias("_id"), *fields), fields).filter(F.size("_words") > 0)
    rows = bind(rows.select("_id", "_words"), _text=F.array_join("_words", " "))
    return rows.groupBy("_text").agg(F.min("_id").alias("first"), F.count(F.lit(1)).alias("n"))


def _grouped(variants: DataFrame, fields: list[str], stage: Stage) -> DataFrame:
    """_text, first, n, and ``rep``: the smallest ``first`` among the variants with the same words."""
    words = lambda c: F.split(c, " ")
    field = fields[0] if len(fields) == 1 else ""
    left = stage.put(bind(variants, _fp=_multiset_hash(words(F.col("_text")), field)))
    done = None
    while True:
        reps = left.groupBy("_fp").agg(F.min(F.struct("first", "_text")).alias("_r"), F.count(F.lit(1)).alias("_k"))
        # equal fields: each word's count among the variant's words less its count among the representative's is zero
        many = reps.filter(F.col("_k") > 1).select("_fp", F.col("_r.first").alias("rep"), F.col("_r._text").alias("_rep_text"))
        pairs = left.join(many, "_fp").filter(F.col("_text") != F.col("_rep_text"))
        tally = F.concat(
            F.transform(words(F.col("_text")), lambda w: F.struct(w.alias("w"), F.lit(1).alias("x"))),
            F.transform(words(F.col("_rep_text")), lambda w: F.struct(w.alias("w"), F.lit(-1).alias("x"))),
        )
        # a row of the tally is told by its text: keys may be repeated
        off = pairs.select("_fp", "_text", F.inline(tally)).groupBy("_fp", "_text", "w").agg(F.sum("x").alias("x")).filter(F.col("x") != 0)
        off = stage.put(off.select("_text").distinct())
        named = left.join(reps.select("_fp", F.col("_r.first").alias("rep")), "_fp")
        none = off.isEmpty()
        same = (named if none else named.join(off, "_text", "left_anti")).select("_text", "first", "n", "rep")
        done = same if done is None else done.unionByName(same)
        if none:
            return done
        # other words under the same hash (not to be expected): they find a representative among themselves
        left = stage.put(left.join(off, "_text", "left_semi"))


def formatting_groups(df: DataFrame, key: str = "rowid", fields: tuple[str, ...] = ("filepath",), stage: Stage | None = None) -> DataFrame:
    """``key`` (smallest of the group), ``copies``: a row for each set of records with the same words in each field.

    Words are longest runs of letters and digits (marks that combine with a letter belong to it), without regard to
    case, to order, or to composed or decomposed spelling of accents. Records whose fields are all null or have no word
    are left out; a null field among others has no words. A record of its own is a group of one. Repeated keys count as
    records each. Columns other than ``key`` and ``fields`` are never read, so their names cannot clash. An empty table
    gives no rows. Texts of any length are read whole.
    """
    stage = stage or Stage(df.sparkSession, "formatting")
    g = _grouped(_variants(df, key, list(fields)), list(fields), stage)
    return g.groupBy("rep").agg(F.sum("n").alias("copies")).select(F.col("rep").alias(key), "copies")


def formatting_members(
    df: DataFrame, key: str = "rowid", fields: tuple[str, ...] = ("filepath",), keep: tuple[str, ...] = (), least: int = 1, stage: Stage | None = None
) -> DataFrame:
    """``key``, ``group_key``, ``copies`` and the columns ``keep`` for every record of ``formatting_groups`` in a group of
    at least ``least`` copies. A word sequence that very many rows share is a hot key of the last join, which AQE splits.
    What the result is made from belongs to ``stage``.
    """
    stage = stage or Stage(df.sparkSession, "formatting")
    fields = list(fields)
    payload = F.struct(*keep).alias("_keep") if keep else F.lit(None).alias("_keep")
    rows = _with_words(df.select(F.col(key).cast("bigint").alias("_id"), *fields, payload), fields).filter(F.size("_words") > 0)
    rows = stage.put(rows.select("_id", F.array_join("_words", " ").alias("_text"), *(["_keep"] if keep else [])))
    variants = rows.groupBy("_text").agg(F.min("_id").alias("first"), F.count(F.lit(1)).alias("n"))
    g = stage.put(_grouped(variants, fields, stage))
    sizes = g.groupBy("rep").agg(F.sum("n").alias("copies"))
    lookup = g.join(sizes, "rep").select("_text", "rep", "copies")
    out = rows.join(lookup.filter(F.col("copies") >= least), "_text")
    return out.select(F.col("_id").alias(key), F.col("rep").alias("group_key"), "copies", *(["_keep.*"] if keep else []))


def p1_found(spark, sf_dir: str) -> DataFrame:
    stage = Stage(spark, "p1")
    catalog = spark.read.parquet(f"{sf_dir}/justinmetadata.parquet")
    return stage.finish(formatting_groups(catalog, stage=stage).filter(F.col("copies") > 1))
