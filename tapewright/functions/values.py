"""Texts as values that rank, and any value as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INT = r"^[+-]?\d+\z"


def as_text(c: Column, kind: T.DataType) -> Column:
    """Catalog value as text; whole doubles without a fraction."""
    if isinstance(kind, T.DoubleType | T.FloatType):
        whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
        return F.when(whole, F.floor(c).cast("string")).otherwise(c.cast("string"))
    return c.cast("string")


def _long(c: Column) -> Column:
    return F.when(c.rlike(INT), c.try_cast("bigint"))


def rank_value(c: Column, scaled_ms: bool = False) -> tuple[Column, Column]:
    """(kind, value) by which texts rank: 0 whole numbers, 1 durations in ms, 2 ``YYYY-MM-DD HH:MM:SS`` in seconds.
    Anything else ranks as the number 0. Durations are ``M:S.f`` or ``H:M:S.f``; any of ``:`` and ``.`` separates, and the
    last part counts as milliseconds as it stands unless ``scaled_ms``."""
    def span_of(p: Column) -> Column:
        n = F.size(p)
        at = lambda i: _long(F.get(p, F.lit(i)))
        last = lambda i: _long(F.rpad(F.substring(F.get(p, F.lit(i)), 1, 3), 3, "0")) if scaled_ms else at(i)
        short, long = at(0) * 60_000 + at(1) * 1000 + last(2), at(0) * 3_600_000 + at(1) * 60_000 + at(2) * 1000 + last(3)
        return F.when(n == 3, short).when(n == 4, long)

    # the parts are bound by a lambda: each text is split once
    span = F.when(c.rlike(r"^[+-]?\d+(?:[:.][+-]?\d+){2,3}\z"), F.get(F.transform(F.array(F.split(c, "[:.]", -1)), span_of), F.lit(0)))
    day = F.when(c.rlike(r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}\z"), c.try_cast("timestamp_ntz"))
    stamp = F.unix_date(day.cast("date")).cast("bigint") * 86400 + F.hour(day) * 3600 + F.minute(day) * 60 + F.second(day)
    whole = _long(c)
    kind = F.when(whole.isNotNull(), 0).when(span.isNotNull(), 1).when(stamp.isNotNull(), 2).otherwise(0)
    return kind, F.coalesce(whole, span, stamp, F.lit(0)).cast("bigint")


def compare_versions(a: Column, b: Column) -> Column:
    """1, 0 or -1: whether version ``a`` is newer than, equal to or older than ``b``. Parts between points count as numbers, the
    first difference decides, and what is missing or no number is 0. Null if one is null."""
    parts = lambda c: F.transform(F.split(c, r"\."), lambda x: F.coalesce(x.try_cast("double"), F.lit(0.0)))
    differences = F.filter(F.zip_with(parts(a), parts(b), lambda x, y: F.signum(F.coalesce(x, F.lit(0.0)) - F.coalesce(y, F.lit(0.0)))), lambda d: d != 0)
    return F.when(a.isNotNull() & b.isNotNull(), F.coalesce(F.get(differences, F.lit(0)), F.lit(0.0)).cast("int"))
