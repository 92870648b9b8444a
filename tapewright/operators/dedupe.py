"""Preservation order, and marking of duplicates.

A group is decided by aggregates that combine before the shuffle: its first row in preservation order is the minimum of a
struct of sort keys, and whether it is reset follows from counts. The decision then meets the rows by a join on the group
key, one row a group, so that a group may hold any share of the catalog.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.functions import paths
from tapewright.functions.values import rank_value
from tapewright.operators.model import BIT, Enabled, Preferences, Rule, add, drop, has

#: Parts into which rows without a key are spread in a join.
SPREAD = 4096


def rule_keys(rule: Rule, text: Column, strict_smallest: bool = False, scaled_ms: bool = False) -> list[Column]:
    """Sort keys of a rule, the smallest first. ``Smallest`` orders nothing unless ``strict_smallest``. Missing values: read
    as the number 0 by Largest and Smallest; do not match by Is, IsNot, Contains and DoesNotContain; are not empty."""
    x = rule.variable.lower()
    test = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    match rule.operator:
        case "Largest":
            kind, value = rank_value(text, scaled_ms)
            return [-kind, -value]
        case "Smallest":
            return list(rank_value(text, scaled_ms)) if strict_smallest else []
        case "Is":
            return [-test(F.lower(text) == x)]
        case "IsNot":
            return [test(F.lower(text) == x)]
        case "IsEmpty":
            return [-test(text == "")]
        case "IsNotEmpty":
            return [test(text == "")]
        case "Contains":
            return [-test(F.lower(text).contains(x))]
        case "DoesNotContain":
            return [test(F.lower(text).contains(x))]
    raise ValueError(f"unknown operator {rule.operator}")


def preservation_keys(prefs: Preferences, flags: Column = None, prefix: str = "c_") -> list[Column]:
    """Sort keys of a working row, the one to keep first; ties go to the smallest id."""
    flags = F.col("flags") if flags is None else flags
    name = F.col("stem") if prefs.ignore_filetype else F.col("file_name")
    keys = [-has(flags, "Keep").cast("int"), -(F.col("root") == name).cast("int"), paths.contains_any(F.col("stem"), prefs.tags).cast("int")]
    for r in prefs.preservation_order:
        keys += rule_keys(r, F.col(prefix + r.column), prefs.strict_smallest, prefs.scaled_ms)
    return [*keys, F.col("id")]


def _struct(keys: list[Column]) -> Column:
    return F.struct(*(k.alias(f"k{i}") for i, k in enumerate(keys)))


def mark_groups(rows: DataFrame, keys: list[Column], branch: Column, order: list[Column], reset: bool) -> DataFrame:
    """Flags of rows that share ``keys`` with others: a row's ``branch`` (bits, 0 for none) is added, and Keep is dropped
    from all but the first in ``order`` if they have a branch. If ``reset`` and all rows of a group still have Keep, their
    flags become Keep alone. Rows with a null key are in no group.

    ``rows`` is read twice: pass a stored table. A hot key has one row on the right side of the join; rows with a null key
    are spread over all tasks."""
    own = rows.columns
    known = F.lit(True)
    for k in keys:
        known = known & k.isNotNull()
    d = rows.select(*own, F.when(known, F.struct(*(k.alias(f"g{i}") for i, k in enumerate(keys)))).alias("_g"), branch.alias("_b"), _struct(order).alias("_o"))
    last = f"_first.o.k{len(order) - 1}"
    groups = d.filter(F.col("_g").isNotNull()).groupBy("_g").agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.struct(F.col("_o").alias("o"), F.col("_b").alias("b"))).alias("_first"),
        F.bool_and(has(F.col("flags"), "Keep")).alias("_keep"), F.count_if(F.col("_b") != 0).alias("_branched"),
    ).filter("_n > 1")
    groups = groups.select("_g", F.col(last).alias("_first_id"), (F.col("_keep") & (F.col("_branched") - (F.col("_first.b") != 0).cast("int") == 0)).alias("_reset"))
    spread = F.when(F.col("_g").isNull(), F.pmod(F.xxhash64("id"), F.lit(SPREAD)))
    d = d.withColumn("_salt", F.coalesce(spread, F.lit(0).cast("bigint"))).join(groups.withColumn("_salt", F.lit(0).cast("bigint")), ["_g", "_salt"], "left")
    f, grouped = F.col("flags"), F.col("_first_id").isNotNull() & (F.col("_b") != 0)
    marked = F.when(grouped, F.when(F.col("id") == F.col("_first_id"), f).otherwise(drop(f, "Keep")).bitwiseOR(F.col("_b"))).otherwise(f)
    if reset:
        marked = F.when(F.col("_reset"), F.lit(BIT["Keep"])).otherwise(marked)
    return d.select(*(marked.alias("flags") if c == "flags" else F.col(c) for c in own))


def mark_duplicates(rows: DataFrame, prefs: Preferences, enabled: Enabled) -> DataFrame:
    """Working rows with Basic, Tags and SimilarFilename marks. Rows group by the match criteria, of which ``filename``
    means ``root`` when similar filenames or tags are searched. Rows with a null criterion stay as they are."""
    by_root = enabled.filename or enabled.audiosuite
    keys = [F.col("root") if c.lower() == "filename" and by_root else F.col(f"c_{c}") for c in prefs.match_criteria]
    pure = F.col("root").isin(paths.trimmed_name(F.col("file_name")), paths.trimmed_name(F.col("stem")))
    tagged = paths.contains_any(F.col("stem"), prefs.tags)
    none = F.lit(0)
    branch = F.when(pure if by_root else F.lit(True), BIT["Basic"]).when(tagged, BIT["Tags"] if enabled.audiosuite else none).otherwise(BIT["SimilarFilename"] if enabled.filename else none)
    return mark_groups(rows, keys, branch, preservation_keys(prefs), reset=True)


def mark_exact_content(rows: DataFrame, prefs: Preferences, only_hashes: bool = False) -> DataFrame:
    """Rows with one and the same fingerprint (not null, empty or FAILED): Waveforms on all, Keep on the first alone."""
    fp = F.col("fingerprint")
    usable = (fp != "FAILED") & (fp != "")
    if only_hashes:
        usable = usable & fp.startswith("PCM:")
    return mark_groups(rows, [F.when(usable, fp)], F.lit(BIT["Waveforms"]), preservation_keys(prefs), reset=False)


def mark_compared(rows: DataFrame, other: DataFrame) -> DataFrame:
    """Compare, without Keep, on rows whose file name occurs in the ``filename`` of the other catalog; case counts."""
    names = other.select(F.col("filename").alias("file_name")).dropna().distinct().withColumn("_in", F.lit(True))
    own = rows.columns
    f = F.when(F.col("_in"), add(drop(F.col("flags"), "Keep"), "Compare")).otherwise(F.col("flags"))
    return rows.join(names, "file_name", "left").select(*(f.alias("flags") if c == "flags" else F.col(c) for c in own))


def best_of_groups(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """``key``, ``id`` of the first row of each group in ``order`` (whose last key is id)."""
    o = _struct(order)
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(o).alias("o")).select(key, F.col(f"o.k{len(order) - 1}").alias("id"))
