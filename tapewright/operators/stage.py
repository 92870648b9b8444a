"""Cutting lineage with tables in the cluster's shared folder, and joins that survive hot keys."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where the session names none, a temporary folder if all runs in this one
    process (tests), and an error on any cluster: there each machine would write to a disk of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"spark.checkpoint.dir must name a folder that all executors share (master {master or 'unknown'})")
    own = os.path.join(tempfile.gettempdir(), "tapewright-stage")
    os.makedirs(own, exist_ok=True)
    return f"file://{own}"


class Stage:
    """Tables written for one run; ``put`` returns the table read back, ``drop`` removes one that is no longer needed.

    A table is complete or absent, and lies where every executor can read it, so losing an executor costs only the
    tasks it ran. Column statistics and pruning work on it as on any Parquet table. The stage owns its tables: ``finish``
    leaves the result alone, ``clear`` (or the end of a ``with`` block) nothing, and what is left goes with the driver.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        self._kept: set[str] = set()

    def __enter__(self) -> Stage:
        return self

    def __exit__(self, *_) -> None:
        self.clear()

    def put(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self.n}"
        self.n += 1
        df.write.mode("overwrite").parquet(path)
        return self._table(path, df)

    def append(self, df: DataFrame, to: str) -> DataFrame:
        """Adds rows to the table ``to`` of this run; returns all of it as it now is."""
        path = f"{self.root}/{to}"
        df.write.mode("append").parquet(path)
        return self._table(path, df)

    def _table(self, path: str, df: DataFrame) -> DataFrame:
        if not self._kept:
            self._on(self.root, "deleteOnExit")
        self._kept.add(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._stage_path = path
        return back

    def finish(self, df: DataFrame) -> DataFrame:
        """Stores the run's result and drops all other tables."""
        out = self.put(df)
        self.keep(out)
        return out

    def keep(self, *tables: DataFrame) -> None:
        """Drops all tables but these."""
        for path in self._kept - {df._stage_path for df in tables}:
            self._delete(path)

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            path = getattr(df, "_stage_path", None)
            if path:
                self._delete(path)

    def clear(self) -> None:
        """Drop every table put so far."""
        self._on(self.root, "delete", True)
        self._kept.clear()

    def _delete(self, path: str) -> None:
        self._on(path, "delete", True)
        self._kept.discard(path)

    def _on(self, path: str, what: str, *args) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        getattr(p.getFileSystem(self.spark._jsc.hadoopConfiguration()), what)(p, *args)


HOT_KEYS = 256


def hot_keys(df: DataFrame, key: str, most: int = HOT_KEYS) -> DataFrame:
    """The ``most`` most frequent values of ``key``. Any other value holds less than 1/most of the rows."""
    return (
        df.groupBy(key)
        .agg(F.count(F.lit(1)).alias("_n"))
        .orderBy(F.col("_n").desc(), F.col(key))
        .limit(most)
        .select(key)
    )


def skew_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", most: int = HOT_KEYS) -> DataFrame:
    """Join a skewed ``left`` with a ``right`` that has one row a key.

    The rows of the ``most`` hottest keys stay where they are and meet a broadcast of at most ``most`` rows; all other
    rows are shuffled, and none of their keys holds more than 1/most of ``left``. Null keys match nothing: they are
    dropped for ``inner`` and kept with nulls for ``left``. ``left`` is read three times: pass a stored table.
    """
    hot = F.broadcast(hot_keys(left, key, most).filter(F.col(key).isNotNull()))
    warm = left.join(hot, key, "left_anti")
    near = left.join(hot, key, "left_semi").join(F.broadcast(right.join(hot, key, "left_semi").limit(most)), key, how)
    return near.unionByName(warm.join(right, key, how))
