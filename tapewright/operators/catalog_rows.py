"""From a raw catalog to working rows, and the rules that look at one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.functions import paths
from tapewright.functions.durations import split_seconds
from tapewright.functions.values import as_text
from tapewright.operators.model import BIT, Enabled, Preferences, add, drop

OWNED = ("_fingerprint", "_dualmono")


def ensure_columns(df: DataFrame, names: tuple[str, ...] = OWNED) -> DataFrame:
    """Adds the text columns that are missing."""
    have = {c.lower() for c in df.columns}
    return df.withColumns({n: F.lit(None).cast("string") for n in names if n.lower() not in have})


def visible_columns(df: DataFrame) -> list[str]:
    """Column names, sorted, without those that begin with an underscore."""
    return sorted(c for c in df.columns if not c.startswith("_"))


def working_rows(catalog: DataFrame, prefs: Preferences, enabled: Enabled, existing: DataFrame | None = None) -> DataFrame:
    """Working rows with their flags after the row rules. Only needed columns are read.

    id, file_path, duration, description (null reads as empty), channels, bitdepth, samplerate, root, file_name, stem,
    fingerprint (empty reads as null; all null unless waveforms are fetched), dual_mono, flags (bits of ``FLAGS``), and a
    text column ``c_<name>`` for each column that criteria and rules name (all null if the catalog lacks it). A file
    exists if its path is among the ``file_path`` of ``existing``; without a listing every file counts as present.
    """
    catalog = ensure_columns(catalog)
    kinds = {f.name.lower(): f.dataType for f in catalog.schema}
    text = lambda n: (as_text(F.col(n), kinds[n]) if n in kinds else F.lit(None).cast("string")).alias(f"c_{n}")
    path = F.coalesce(F.col("filepath"), F.lit(""))
    mono = F.col("_dualmono")
    fp = F.when(F.col("_fingerprint") != "", F.col("_fingerprint")) if prefs.fetch_waveforms else F.lit(None).cast("string")
    rows = catalog.select(
        F.col("rowid").cast("bigint").alias("id"), path.alias("file_path"), F.coalesce("duration", F.lit("")).alias("duration"),
        F.coalesce("description", F.lit("")).alias("description"), "channels", "bitdepth", "samplerate",
        fp.alias("fingerprint"), F.when(mono == "1", True).when(mono == "0", False).alias("dual_mono"), *map(text, prefs.columns()),
    )
    rows = paths.with_names(rows, "file_path", prefs.tags, prefs.ignore_filetype)
    flags = F.lit(BIT["Keep"])
    if existing is not None and (enabled.invalidpath or enabled.dual_mono):
        there = existing.select("file_path").dropna().distinct().withColumn("_there", F.lit(True))
        rows = rows.join(there, "file_path", "left")
        missing = F.col("_there").isNull()
        flags = F.when(missing, add(drop(flags, "Keep") if enabled.invalidpath else flags, "InvalidPath")).otherwise(flags)
    if enabled.duration:
        flags = _withheld(flags, too_short(F.col("duration"), enabled.min_dur), "Duration")
    if enabled.filetags:
        flags = _withheld(flags, paths.contains_any(F.col("file_path"), prefs.autoselects), "FileTags")
    return rows.withColumn("flags", flags).drop("_there")


def _withheld(flags: Column, rule: Column, name: str) -> Column:
    return F.when(rule, add(drop(flags, "Keep"), name)).otherwise(flags)


def too_short(duration: Column, least: float) -> Column:
    """The duration reads as ``M:SS.fff`` and is below ``least`` seconds."""
    return F.coalesce(split_seconds(duration) < F.lit(float(least)), F.lit(False))


def like_fold(column: Column, text: str) -> Column:
    """``LIKE '%text%'`` with ASCII letters folded; ``%`` and ``_`` in the text are wildcards."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    folded = text.translate(str.maketrans(upper, lower)).replace("\\", "\\\\")
    return F.coalesce(F.translate(column, upper, lower).like(f"%{folded}%"), F.lit(False))


def glob(column: Column, text: str) -> Column:
    """``GLOB '*text*'``: case counts; ``*``, ``?`` and ``[...]`` in the text are wildcards."""
    out, i = "", 0
    while i < len(text):
        ch = text[i]
        end = text.find("]", i + 2 + (text[i + 1 : i + 2] == "^")) if ch == "[" else -1
        if ch == "*":
            out += ".*"
        elif ch == "?":
            out += "."
        elif end > 0:
            inner = text[i + 1 : end]
            no, inner = ("^", inner[1:]) if inner.startswith("^") else ("", inner)
            out += "[" + no + "".join(c if c == "-" else "\\" + c if not c.isalnum() else c for c in inner) + "]"
            i = end
        elif ch == "[":
            out += r"(?!)"  # an open class matches nothing
        else:
            out += ch if ch.isalnum() else "\\" + ch if ch.isascii() and not ch.isspace() else ch
        i += 1
    return F.coalesce(column.rlike(r"(?s)\A.*" + out + r".*\z"), F.lit(False))
