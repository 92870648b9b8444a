"""Columns that are computed once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bind(df: DataFrame, **exprs: Column) -> DataFrame:
    """``df`` with further columns, each computed once a row. Through a plain projection the optimizer would copy the
    expressions into every use and every pushed filter, level by level; it does not do so through a generator."""
    row = F.explode(F.array(F.struct(*(e.alias(k) for k, e in exprs.items())))).alias("_row")
    return df.select(*df.columns, row).select(*df.columns, "_row.*")
