"""The search: row rules, compare, duplicates, dual mono, waveforms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.operators import match
from tapewright.operators.catalog_rows import working_rows
from tapewright.operators.dedupe import mark_compared, mark_duplicates, mark_exact_content
from tapewright.operators.model import Enabled, Preferences, add, has
from tapewright.operators.stage import Stage


def search(catalog: DataFrame, enabled: Enabled, prefs: Preferences, compare: DataFrame | None = None, existing: DataFrame | None = None, stage: Stage | None = None) -> DataFrame:
    """Working rows with all flags. Parts run in this order, each on the flags of the one before.

    A marking reads its rows twice, once for the groups and once for the rows themselves, so the rows are stored before
    each one; the catalog is scanned once, and the plan of the result reads one stored table. The stored tables belong to
    ``stage``."""
    stage = stage or Stage(catalog.sparkSession, "search")
    rows = working_rows(catalog, prefs, enabled, existing)
    if enabled.dbcompare and compare is not None:
        rows = mark_compared(rows, compare)
    if enabled.basic:
        rows = mark_duplicates(stored := stage.put(rows), prefs, enabled)
    if enabled.dual_mono:
        f = F.col("flags")
        rows = rows.withColumn("flags", F.when(F.col("dual_mono") & ~has(f, "InvalidPath"), add(f, "DualMono")).otherwise(f))
    if enabled.waveform:
        kind = prefs.waveform_search_type
        if kind == "Exact":
            rows = stage.put(rows)
            if enabled.basic:
                stage.drop(stored)
            rows = mark_exact_content(rows, prefs)
        elif kind == "Similar":
            rows = match.mark_similar(mark_exact_content(stage.put(rows), prefs, only_hashes=True), prefs, stage)
        else:
            rows = match.mark_subsets(rows, prefs, stage)
    return rows
