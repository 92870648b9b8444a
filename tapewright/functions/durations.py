"""Durations: readable ones in any notation, and the two strict notations of the catalog rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapewright.functions.text import trimmed

_CLOCK = r"^(?:(\d{1,9}):)?(\d{1,9}):([0-5]\d)(?:[.,](\d+))?$"
_COUNT = r"(?i)^(\d{1,12})?(?:[.,](\d+))?\s*(ms|msecs?|milliseconds?|s|secs?|seconds?|m|mins?|minutes?|h|hrs?|hours?)?\.?$"


def _num(c: Column) -> Column:
    return F.when(c != "", c).cast("decimal(38,9)")


def readable_seconds(c: Column) -> Column:
    """Seconds as decimal(20,9) of ``M:SS``, ``H:MM:SS``, a number, or a number with a unit; a fraction may follow a point
    or a comma, of which nine digits count. Null for anything else, for minutes over 59 beside hours, for values that are not
    above zero, and for whole numbers of more than nine digits in a clock or twelve without (over 30,000 years)."""
    fraction = lambda x: F.when(x != "", F.concat(F.lit("0."), F.substring(x, 1, 9))).cast("decimal(20,9)")
    whole = F.lit(0).cast("decimal(20,9)")

    def clock_s(p: Column) -> Column:
        part = lambda i: F.coalesce(_num(p[i]), F.lit(0).cast("decimal(38,9)"))
        s = (part(0) * 3600 + part(1) * 60 + part(2)).cast("decimal(20,9)") + F.coalesce(fraction(p[3]), whole)
        return F.when((p[0] == "") | (part(1) < 60), s).cast("decimal(24,9)")

    def count_s(p: Column) -> Column:
        n = F.coalesce(_num(p[0]).cast("decimal(22,9)"), whole) + F.coalesce(fraction(p[1]), whole)
        unit = F.lower(p[2])
        scaled = (
            F.when(unit.startswith("ms") | unit.startswith("milli"), n / 1000)
            .when(unit.startswith("m"), n * 60)
            .when(unit.startswith("h"), n * 3600)
            .otherwise(n)
        )
        return scaled.cast("decimal(24,9)")

    parts = lambda t, pattern, to, f: _let(F.split(F.regexp_replace(t, pattern, to), r"\|"), f)
    read = lambda t: F.when(t.rlike(_CLOCK), parts(t, _CLOCK, "$1|$2|$3|$4", clock_s)).when(t.rlike(_COUNT) & t.rlike(r"\d"), parts(t, _COUNT, "$1|$2|$3", count_s))
    return _let(_let(trimmed(c), read), lambda s: F.when(s > 0, s))


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def split_seconds(c: Column) -> Column:
    """Seconds as double of ``M:SS.fff`` split at the first colon; null when a half is no plain decimal number."""
    number = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
    head, at = F.substring_index(c, ":", 1), F.instr(c, ":")
    rest = c.substr(at + F.lit(1), F.length(c))
    ok = (at > 0) & head.rlike(number) & rest.rlike(number)
    return F.when(ok, head.try_cast("double") * 60 + rest.try_cast("double"))
