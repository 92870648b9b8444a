"""Analysis results kept beside the catalog: only rows without a result, or whose analysis failed, are analysed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESULT = "rowid bigint, value string, at timestamp"


def latest(cache: DataFrame) -> DataFrame:
    """The newest result of each row."""
    return cache.groupBy("rowid").agg(F.max(F.struct("at", "value")).alias("r")).select("rowid", F.col("r.value").alias("value"))


def pending(catalog: DataFrame, cache: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Rows whose file exists and that have no result, or FAILED."""
    done = latest(cache).filter("value is not null and value <> 'FAILED'")
    rows = catalog.join(done, "rowid", "left_anti")
    return rows if existing is None else rows.join(existing.select(F.col("file_path").alias("filepath")), "filepath", "left_semi")


def analyse(catalog: DataFrame, cache_path: str, producer: Callable[[DataFrame], DataFrame], existing: DataFrame | None = None) -> DataFrame:
    """Analyses pending rows and appends the results; producer: rows to (rowid, value), null for failures."""
    spark = catalog.sparkSession
    todo = pending(catalog, read_cache(spark, cache_path), existing)
    out = producer(todo).select("rowid", F.coalesce("value", F.lit("FAILED")).alias("value"), F.current_timestamp().alias("at"))
    out.write.mode("append").parquet(cache_path)
    return latest(read_cache(spark, cache_path))


def read_cache(spark, cache_path: str) -> DataFrame:
    p = spark._jvm.org.apache.hadoop.fs.Path(cache_path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], RESULT)
    return spark.read.schema(RESULT).parquet(cache_path)


def follow(spark, folder: str, schema, cache_path: str, checkpoint: str, producer: Callable[[DataFrame], DataFrame], files_per_batch: int = 1000):
    """A stream of new catalog rows (Parquet files in ``folder``) into the cache, by micro-batches; an extension, as catalogs
    that grow have no counterpart in a desktop search. A batch that is run again after a failure analyses only what is
    still pending."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)

    def batch(df: DataFrame, _: int) -> None:
        analyse(df, cache_path, producer)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
