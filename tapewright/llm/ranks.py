"""Ranks and running totals within keys of any size, without a key in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a key that one task ranks.
RUN = 50_000


def running(df: DataFrame, keys: list[str], order: list[str], run: Column, weight: Column, name: str) -> DataFrame:
    """Adds ``name``: sum of ``weight`` over the earlier rows of the same ``keys``, in order of ``run``, then ``order``.

    ``run`` cuts each key into consecutive runs of about ``RUN`` rows. Runs are summed first (partial aggregates), their
    totals are accumulated a key at a time (one row for each run), and rows only within their run. ``df`` is read twice:
    pass a stored table.
    """
    d = df.withColumns({"_run": run, "_w": weight})
    before = Window.partitionBy(*keys).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    starts = d.groupBy(*keys, "_run").agg(F.sum("_w").alias("_t")).withColumn("_start", F.coalesce(F.sum("_t").over(before), F.lit(0))).drop("_t")
    inside = Window.partitionBy(*keys, "_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_in", F.coalesce(F.sum("_w").over(inside), F.lit(0))).join(starts, [*keys, "_run"])
    return d.withColumn(name, F.col("_start") + F.col("_in")).drop("_run", "_w", "_start", "_in")
