"""One UTC instant for each dated field of the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.functions.instants import parse_instants, zone_abbreviations

FIELDS = ("bwdate", "scanneddate")


def catalog_instants(catalog: DataFrame, libraries: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """rowid, field_name, utc_us, status: a row for each row of ``catalog`` and each of ``fields``.

    The row's ``library`` gives zone and date order where the value names none; a null or unlisted library gives none.
    ``libraries`` has one row a library (of repeated ones, the smallest row counts) and zones unknown to the tz database
    count as none. Statuses: see ``parse_instants``. Other columns, whatever their names, are ignored. Empty tables give
    no rows; with no libraries, only values that name their zone are read.
    """
    spark = catalog.sparkSession
    lookup = libraries.filter(F.col("library").isNotNull()).groupBy("library").agg(F.min(F.struct("tz_name", "date_order")).alias("_l"))
    lookup = lookup.select("library", F.col("_l.tz_name").alias("tz_name"), F.col("_l.date_order").alias("date_order"))
    lookup = lookup.join(zone_abbreviations(spark), "tz_name", "left")
    long = catalog.select(
        "rowid", "library",
        F.explode(F.array(*(F.struct(F.lit(x).alias("field_name"), F.col(x).alias("value")) for x in fields))).alias("_x"),
    ).select("rowid", "library", "_x.*")
    parsed = parse_instants(long.join(lookup, "library", "left"), "value", "tz_name", "date_order", "abbreviations")
    return parsed.select("rowid", "field_name", "utc_us", "status")


def p3_found(spark, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    out = catalog_instants(read("justinmetadata"), read("libraries"))
    return out.filter(F.col("status") == "ok").select("rowid", "field_name", "utc_us")


def p3_status_report(spark, sf_dir: str) -> DataFrame:
    """How many values of each field were read, and why the others were not."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    out = catalog_instants(read("justinmetadata"), read("libraries"))
    return out.groupBy("field_name", "status").agg(F.count(F.lit(1)).alias("n"))
