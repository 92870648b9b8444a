"""Results: filters, counts, selections, hand-made flag edits, work lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.functions import paths
from tapewright.operators.model import BIT, FILTER_ALIASES, FLAGS, add, drop, has, shown_text


def result_rows(rows: DataFrame) -> DataFrame:
    """What a search returns: id, path (parent folder), filename, algorithm, channels, bitdepth, samplerate, duration, description."""
    p = F.col("file_path")
    return rows.select(
        "id", paths.parent(p).alias("path"), "root", F.col("file_name").alias("filename"), shown_text(F.col("flags")).alias("algorithm"),
        "channels", "bitdepth", "samplerate", "duration", "description",
    )


def filtered(rows: DataFrame, name: str) -> DataFrame:
    """Rows under a result filter: All, Keep, Remove, Relevant (without Keep or with more flags; all rows if there are none
    such), or a search's name."""
    f = F.col("flags")
    match name:
        case "All":
            return rows
        case "Keep":
            return rows.filter(has(f, "Keep"))
        case "Remove":
            return rows.filter(~has(f, "Keep"))
        case "Relevant":
            relevant = ~has(f, "Keep") | (F.bit_count(f) > 1)
            some = rows.agg(F.coalesce(F.bool_or(relevant), F.lit(False)).alias("_some"))
            return rows.join(F.broadcast(some)).filter(~F.col("_some") | relevant).drop("_some")
    bits = sum(BIT[x] for x in FILTER_ALIASES.get(name, [x for x in FLAGS if x.lower() == name.lower()]))
    return rows.filter(f.bitwiseAND(F.lit(bits)) != 0)


def where_equal(rows: DataFrame, key: str | None, value: object) -> DataFrame:
    """Rows with that value; all rows when key or value is not given."""
    return rows if not key or value is None else rows.filter(F.col(key) == F.lit(value))


def removal_counts(rows: DataFrame, selection: DataFrame) -> DataFrame:
    """to_remove: rows without Keep; selected_to_remove: those among the selected ids."""
    d = rows.join(selection.select("id").distinct().withColumn("_s", F.lit(True)), "id", "left")
    gone = ~has(F.col("flags"), "Keep")
    return d.agg(F.count_if(gone).alias("to_remove"), F.count_if(gone & F.col("_s")).alias("selected_to_remove"))


def toggled(selection: DataFrame, ids: DataFrame) -> DataFrame:
    """Selected ids after toggling ``ids``."""
    return selection.select("id").distinct().unionByName(ids.select("id").distinct()).groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select("id")


def inverted(shown: DataFrame, selection: DataFrame) -> DataFrame:
    """Ids of the shown rows that are not selected."""
    return shown.select("id").join(selection.select("id"), "id", "left_anti")


def ordered(rows: DataFrame) -> DataFrame:
    """Rows in the order in which results show them: by root (bytes), then id."""
    return rows.orderBy("root", "id")


def ranged(shown: DataFrame, one: int | None, other: int | None) -> DataFrame:
    """Ids of the shown rows between two of them, both included, in the order of results; none if one is not shown."""
    place = F.struct("root", "id")
    ends = shown.filter(F.col("id").isin([x for x in (one, other) if x is not None])).agg(F.min(place).alias("_a"), F.max(place).alias("_b"), F.count_distinct("id").alias("_n"))
    both = F.lit(1 if one == other else 2)
    return shown.join(F.broadcast(ends)).filter((F.col("_n") == both) & place.between(F.col("_a"), F.col("_b"))).select("id")


def all_or_none(shown: DataFrame, selection: DataFrame) -> DataFrame:
    """Nothing if something is selected, else the ids of all shown rows."""
    some = selection.select("id").limit(1).agg(F.count(F.lit(1)).alias("_n"))
    return shown.select("id").join(F.broadcast(some)).filter("_n = 0").select("id")


def edited(rows: DataFrame, selection: DataFrame, how: str) -> DataFrame:
    """check drops Keep from the selected rows, uncheck adds it, toggle changes it."""
    f = F.col("flags")
    new: Column = {"check": drop(f, "Keep"), "uncheck": add(f, "Keep"), "toggle": f.bitwiseXOR(F.lit(BIT["Keep"]))}[how]
    own = rows.columns
    d = rows.join(selection.select("id").distinct().withColumn("_s", F.lit(True)), "id", "left")
    return d.select(*((F.when(F.col("_s"), new).otherwise(f).alias("flags")) if c == "flags" else F.col(c) for c in own))


def work_list(rows: DataFrame, selection: DataFrame | None = None) -> DataFrame:
    """id, file_path, action of rows to remove (without Keep) or to strip to one channel (DualMono), within the selection
    if there is one."""
    if selection is not None:
        rows = rows.join(selection.select("id"), "id", "left_semi")
    f = F.col("flags")
    actions = F.array_compact(F.array(F.when(~has(f, "Keep"), F.lit("remove")), F.when(has(f, "DualMono"), F.lit("strip"))))
    return rows.select("id", "file_path", F.explode(actions).alias("action"))
