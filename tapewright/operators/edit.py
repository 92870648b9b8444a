"""Changes to a catalog as new DataFrames; the source stays as it is until a sink writes the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.operators.catalog_rows import glob, like_fold
from tapewright.operators.model import BIT

PATH_COLUMNS = ("filename", "filepath", "pathname")


def delete_ids(df: DataFrame, ids: DataFrame, key: str = "rowid") -> DataFrame:
    return df.join(ids.select(key).dropna(), key, "left_anti").select(*df.columns)


def _picked(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key).dropna().distinct().withColumn("_picked", F.lit(True)), key, "left")


def mark_mono(df: DataFrame, ids: DataFrame, key: str = "rowid") -> DataFrame:
    """One channel, and dirty, on the given rows."""
    d = _picked(df, ids, key)
    new = {"channels": F.when(F.col("_picked"), 1).otherwise(F.col("channels")), "_dirty": F.when(F.col("_picked"), 1).otherwise(F.col("_dirty"))}
    return d.select(*(new[c].alias(c) if c in new else F.col(c) for c in df.columns))


def upsert(df: DataFrame, updates: DataFrame, column: str, key: str = "rowid") -> DataFrame:
    """``column`` from ``updates`` (key, value) where the key occurs there, also if the value is null. Of several updates of
    one key the greatest value holds; keys that the catalog lacks change nothing."""
    u = updates.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max("value").alias("_new")).withColumn("_hit", F.lit(True))
    d = df.join(u, key, "left")
    return d.select(*(F.when(F.col("_hit"), F.col("_new")).otherwise(F.col(c)).alias(c) if c == column else F.col(c) for c in df.columns))


def unmatched_updates(df: DataFrame, updates: DataFrame, key: str = "rowid") -> DataFrame:
    """Updates whose key the catalog lacks."""
    return updates.join(df.select(key), key, "left_anti")


def drop_column(df: DataFrame, column: str) -> DataFrame:
    return df.drop(column)


def find_predicate(column: Column, text: str, case_sensitive: bool) -> Column:
    return glob(column, text) if case_sensitive else like_fold(column, text)


def find(rows: DataFrame, column: Column, text: str, case_sensitive: bool) -> DataFrame:
    """Working rows whose column matches, flagged Replace alone."""
    return rows.filter(find_predicate(column, text, case_sensitive)).withColumn("flags", F.lit(BIT["Replace"]))


def replace_text(df: DataFrame, column: str, find_: str, new: str, case_sensitive: bool, mark_dirty: bool = False, legacy_filepath: bool = False) -> DataFrame:
    """``find_`` becomes ``new``, in its exact case, wherever the row matches. For the three path columns, ``filename`` and
    ``filepath`` and ``pathname`` change together, each on its own match, and changed rows may be marked dirty.
    ``legacy_filepath`` writes the replaced file name into ``filepath``."""
    one = lambda source, tested: F.when(find_predicate(F.col(tested), find_, case_sensitive), F.replace(F.col(source), F.lit(find_), F.lit(new))).otherwise(F.col(tested))
    if column.lower() not in PATH_COLUMNS:
        return df.withColumn(column, one(column, column))
    new_values = {"filepath": one("filename" if legacy_filepath else "filepath", "filepath")} | {c: one(c, c) for c in ("filename", "pathname")}
    if mark_dirty:
        hit = F.lit(False)
        for c in PATH_COLUMNS:
            hit = hit | find_predicate(F.col(c), find_, case_sensitive)
        new_values["_dirty"] = F.when(hit, 1).otherwise(F.col("_dirty"))
    return df.withColumns({k: v for k, v in new_values.items() if k in df.columns})
