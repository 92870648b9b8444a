"""Text expressions shared by the operators; all run inside the JVM unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that only say there is no value, in lower case without outer punctuation.
PLACEHOLDERS = (
    "blank", "empty", "missing", "n a", "na", "n/a", "nan", "nil", "no comment", "no data", "no date", "no description",
    "no name", "no path", "no title", "no value", "none", "none given", "not applicable", "not available", "not known",
    "not set", "not specified", "null", "placeholder", "see notes", "tba", "tbc", "tbd", "to be announced", "to be confirmed",
    "to be defined", "to be determined", "to do", "todo", "undefined", "unknown", "unspecified", "untitled", "void", "x", "xx", "xxx",
    "xxxx",
)

SPACES = r"[\s\u0085   -​    ⁠　﻿]"


def trimmed(c: Column) -> Column:
    """Without outer white space, no-break and zero-width spaces included. Null stays null."""
    return F.regexp_replace(c, f"^{SPACES}+|{SPACES}+$", "")


def is_placeholder(c: Column) -> Column:
    """True for null, blank, punctuation only, and texts of ``PLACEHOLDERS`` whatever their case or outer punctuation."""
    core = F.regexp_replace(F.lower(c), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    core = F.regexp_replace(core, r"[\s_]+", " ")
    return F.coalesce((core == "") | core.isin(*PLACEHOLDERS), F.lit(True))
