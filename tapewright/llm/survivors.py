"""Problem 5: one surviving record for each group of copies, field by field.

Every field of a group is decided in one aggregation by the maximum of a struct: usable first, then the most trusted
source, the latest change, the smallest key. Maxima combine before the shuffle, so a group may hold any share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.functions.durations import readable_seconds
from tapewright.functions.instants import parse_instants, zone_abbreviations
from tapewright.functions.text import is_placeholder, trimmed
from tapewright.llm.formatting import formatting_members
from tapewright.operators.stage import Stage

FIELDS = ("duration", "bwdate", "description", "pathname")
LAST = 2147483647


def best_by_field(rows: DataFrame, group: str, key: str, usable: dict[str, Column], trust: Column, changed: Column) -> DataFrame:
    """``group``, ``field_name``, ``source_key``: for each group and field, the row whose usable value is the best.

    Best: smallest ``trust`` (null last), then latest ``changed`` (null last), then smallest ``key``. A field without a
    usable value in the group gives no row; so does a null group. A null ``usable`` counts as unusable. Repeated rows and
    ties change nothing. Columns not named are not read.
    """
    # a null is the smallest member of a struct
    rank = [(-F.coalesce(trust, F.lit(LAST))).alias("t"), changed.alias("c"), (-F.col(key)).alias("k")]
    best = [F.max(F.struct(F.coalesce(u, F.lit(False)).alias("u"), *rank)).alias(f) for f, u in usable.items()]
    wide = rows.filter(F.col(group).isNotNull()).groupBy(group).agg(*best)
    long = wide.select(group, F.explode(F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f).alias("b")) for f in usable))).alias("x"))
    return long.filter("x.b.u").select(group, "x.field_name", (-F.col("x.b.k")).alias("source_key"))


def beginnings(texts: DataFrame, group: str, text: str) -> DataFrame:
    """Distinct (``group``, ``text``) that are the beginning of a longer text of their group.

    A longer text is cut to each length that occurs in the group, and the cuts meet the texts by equality; no pairs, no
    sort, and no group in one task. Null groups and texts are left out.
    """
    d = texts.select(group, text).dropna().distinct()
    lengths = d.groupBy(group).agg(F.collect_set(F.length(text)).alias("_lens")).filter(F.size("_lens") > 1)
    cuts = d.join(lengths, group).select(group, text, F.explode(F.filter("_lens", lambda n: n < F.length(text))).alias("_n"))
    cuts = cuts.select(group, F.substring(F.col(text), F.lit(1), F.col("_n")).alias(text))
    return d.join(cuts, [group, text], "left_semi")


def survivors(catalog: DataFrame, libraries: DataFrame, stage: Stage | None = None) -> DataFrame:
    """group_rowid, field_name, source_rowid: the best copy for each of ``FIELDS`` in every group of two or more records
    that ``formatting_groups`` finds by ``filepath``.

    Usable: a readable duration; a bwdate that is exactly one instant; a description or pathname that is not null,
    blank or a placeholder, the description moreover not only the beginning of a longer usable one of the group (outer
    white space and final dots aside). Trust is the library's ``trust_rank``; rows of null or unlisted libraries come
    last. Groups without any usable value give no rows, and empty tables none.
    """
    spark = catalog.sparkSession
    stage = stage or Stage(spark, "survivors")
    made_of = Stage(spark, "formatting")
    rows = formatting_members(catalog, keep=("library", "modificationdate", *FIELDS), least=2, stage=made_of)
    lookup = libraries.filter(F.col("library").isNotNull()).groupBy("library").agg(F.min(F.struct("tz_name", "date_order", "trust_rank")).alias("_l"))
    lookup = lookup.select("library", "_l.*").join(zone_abbreviations(spark), "tz_name", "left")
    rows = rows.join(lookup, "library", "left")
    rows = parse_instants(rows, "bwdate", "tz_name", "date_order", "abbreviations")
    core = F.regexp_replace(trimmed(F.col("description")), r"[\s.\x{2026}\x{A0}]+$", "")
    rows = rows.select(
        "rowid", F.col("group_key").alias("group_rowid"), "trust_rank", "modificationdate",
        readable_seconds(F.col("duration")).isNotNull().alias("_duration"),
        (F.col("status") == "ok").alias("_bwdate"),
        F.when(~is_placeholder(F.col("description")), core).alias("_core"),
        (~is_placeholder(F.col("pathname"))).alias("_pathname"),
    )
    rows = stage.put(rows)
    made_of.clear()
    short = beginnings(rows, "group_rowid", "_core").withColumn("_short", F.lit(True))
    rows = rows.join(short, ["group_rowid", "_core"], "left")
    usable = {
        "duration": F.col("_duration"),
        "bwdate": F.col("_bwdate"),
        "description": F.col("_core").isNotNull() & F.col("_short").isNull(),
        "pathname": F.col("_pathname"),
    }
    out = best_by_field(rows, "group_rowid", "rowid", usable, F.col("trust_rank"), F.col("modificationdate"))
    return out.withColumnRenamed("source_key", "source_rowid")


def p5_found(spark, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    stage = Stage(spark, "p5")
    return stage.finish(survivors(read("justinmetadata"), read("libraries"), stage))
