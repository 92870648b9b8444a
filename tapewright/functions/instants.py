"""Instants in mixed notations, precisions and zones, read by an ordered cascade of anchored patterns.

Each pattern rewrites a value into fixed fields in one regex pass; the first pattern that matches decides. Everything
runs inside the JVM, and no expression depends on the session's time zone.
"""

from __future__ import annotations

import zoneinfo
from datetime import UTC, datetime
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.functions.bind import bind
from tapewright.functions.text import trimmed

DAY_US = 86_400_000_000

_MONTH = r"(Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sept?(?:ember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\.?"
_DOW = r"(?:(Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]{0,6}\.?,?\s+)?"
_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?"
_HALF = r"(?:\s*([AaPp])\.?[Mm]\.?)?"
_ZONE = r"(?:\s*(Z|z|(?:UTC|GMT)?[+-]\d{2}(?::?\d{2})?|[A-Z]{2,5}|[A-Za-z]+/[A-Za-z0-9_+/-]+))?(?:\s*\[([A-Za-z0-9_+/-]+)\])?"
_NAME = r"(?i:%s)"

#: (name, pattern, fields). Fields: kind|year|month|day|hour|minute|second|fraction|half|zone|bracket|weekday.
PATTERNS: list[tuple[str, str, str]] = [
    ("count_s", r"^(\d{9,10})(?:\.(\d+))?$", "s|$1|||||$2|||||"),
    ("count_ms", r"^(\d{12,13})(?:\.(\d+))?$", "ms|$1|||||$2|||||"),
    ("count_us", r"^(\d{15,16})(?:\.\d+)?$", "us|$1||||||||||"),
    ("year_first", rf"^(\d{{4}})([-/._: ])(\d{{1,2}})\2(\d{{1,2}})(?:[Tt]|[\s,_]+){_TIME}{_HALF}{_ZONE}$", "ymd|$1|$3|$4|$5|$6|$7|$8|$9|$10|$11|"),
    ("year_first_dashed", rf"^(\d{{4}})([-/._: ])(\d{{1,2}})\2(\d{{1,2}})(?:[Tt]|[\s,_]+)(\d{{1,2}})([-.])(\d{{2}})\6(\d{{2}})(?:[.,](\d+))?{_HALF}{_ZONE}$", "ymd|$1|$3|$4|$5|$7|$8|$9|$10|$11|$12|"),
    ("compact", rf"^(\d{{4}})(\d{{2}})(\d{{2}})[Tt_ -]?(\d{{2}})(\d{{2}})(\d{{2}})(?:[.,](\d+))?{_ZONE}$", "ymd|$1|$2|$3|$4|$5|$6|$7||$8|$9|"),
    ("compact_minutes", rf"^(\d{{4}})(\d{{2}})(\d{{2}})[Tt_ -](\d{{2}})(\d{{2}}){_ZONE}$", "ymd|$1|$2|$3|$4|$5||||$6|$7|"),
    ("compact_date", rf"^(\d{{4}})(\d{{2}})(\d{{2}})(?:[Tt_]|\s+){_TIME}{_HALF}{_ZONE}$", "ymd|$1|$2|$3|$4|$5|$6|$7|$8|$9|$10|"),
    ("numeric", rf"^(\d{{1,2}})([-/._: ])(\d{{1,2}})\2(\d{{4}}|\d{{2}})(?:[Tt]|[\s,]+){_TIME}{_HALF}{_ZONE}$", "abc|$1|$3|$4|$5|$6|$7|$8|$9|$10|$11|"),
    ("day_month_name", rf"^{_NAME % _DOW}(\d{{1,2}})[-\s./_]?\s*{_NAME % _MONTH}[-\s,./_]*(\d{{4}}|\d{{2}})(?:,?\s+(?:at\s+)?|[Tt]){_TIME}{_HALF}{_ZONE}$", "ymd|$4|$3|$2|$5|$6|$7|$8|$9|$10|$11|$1"),
    ("month_name_day", rf"^{_NAME % _DOW}{_NAME % _MONTH}[-\s._]*(\d{{1,2}})(?:st|nd|rd|th)?(?:,\s*|[-\s/_]+)(\d{{4}}|\d{{2}})(?:,?\s+(?:at\s+)?|[Tt]){_TIME}{_HALF}{_ZONE}$", "ymd|$4|$2|$3|$5|$6|$7|$8|$9|$10|$11|$1"),
    ("year_month_name", rf"^(\d{{4}})[-\s./_]{_NAME % _MONTH}[-\s./_](\d{{1,2}})(?:,?\s+|[Tt]){_TIME}{_HALF}{_ZONE}$", "ymd|$1|$2|$3|$4|$5|$6|$7|$8|$9|$10|"),
    ("year_last", rf"^{_NAME % _DOW}{_NAME % _MONTH}\s+(\d{{1,2}})\s+(\d{{1,2}}):(\d{{2}}):(\d{{2}})(?:\.(\d+))?{_ZONE}\s+(\d{{4}})$", "ymd|$10|$2|$3|$4|$5|$6|$7||$8|$9|$1"),
]


@lru_cache(maxsize=1)
def _zones() -> dict[str, dict[str, list[int]]]:
    """Of every IANA zone, what its people's abbreviations have meant from 1970 to 2037, in seconds east of UTC; some have
    stood for several offsets."""
    out = {}
    months = [datetime(y, m, 15, tzinfo=UTC) for y in range(1970, 2038) for m in (1, 4, 7, 10)]
    for name in sorted(zoneinfo.available_timezones()):
        if name.startswith(("posix", "right/", "Factory", "local")):
            continue
        z, seen = zoneinfo.ZoneInfo(name), {}
        for t in months:
            local = t.astimezone(z)
            seen.setdefault(local.tzname(), set()).add(int(local.utcoffset().total_seconds()))
        out[name] = {a: sorted(o) for a, o in seen.items() if a.isalpha()}
    return out


@lru_cache(maxsize=1)
def _known() -> tuple[str, ...]:
    names = set(_zones())
    try:
        names &= set(SparkSession.active()._jvm.java.time.ZoneId.getAvailableZoneIds())
    except Exception:  # noqa: BLE001 - no JVM gateway (Connect): the zones Python knows
        pass
    return tuple(sorted(names))


def zone_abbreviations(spark: SparkSession) -> DataFrame:
    """tz_name, abbreviations: a row for each IANA zone, about 600 whatever the data."""
    known = set(_known())
    rows = [(k, v) for k, v in _zones().items() if k in known]
    return spark.createDataFrame(rows, "tz_name string, abbreviations map<string,array<int>>")


def _int(c: Column) -> Column:
    return F.when(c != "", c).cast("bigint")


def _micros(fraction: Column) -> Column:
    return F.coalesce(_int(F.substring(F.rpad(fraction, 6, "0"), 1, 6)), F.lit(0).cast("bigint"))


def _at(us: Column, zone: Column) -> Column:
    """Local wall clock, in microseconds, of an instant."""
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(us), zone))


def parse_instants(df: DataFrame, value: str, tz: str, order: str, abbreviations: str) -> DataFrame:
    """Add ``utc_us`` bigint and ``status`` string for the text column ``value``.

    ``tz``, ``order`` and ``abbreviations`` name columns with the source's IANA zone, its order of all-numeric dates (DMY,
    MDY or YMD) and its abbreviations (map to seconds east, of several the one the zone has at that local time, see ``zone_abbreviations``; null if the zone is not a known one). A zone in the value rules: an offset, an
    IANA name, or an abbreviation as the source's zone uses it (Z, UTC and GMT everywhere). An offset beside a zone name
    must be one that the zone has at that local time. ``status``: ``ok``; ``empty`` (null or blank); ``unreadable`` (no
    pattern matches, also dates without a time of day); ``impossible`` (no such date or time, or a weekday that isn't
    the date's); ``no_source`` (the order or zone is needed and the source has none); ``unknown_zone``; ``skipped`` and
    ``twice`` (local times that the zone skips or has twice); ``conflict`` (offset and zone disagree). ``utc_us`` is null
    unless ``ok``. Fractions of any length are read; what lies beyond microseconds is cut off. Bare counts are seconds of
    9 or 10 digits, milliseconds of 12 or 13, microseconds of 15 or 16, each from 1973 to 2286: a count of 8, 11 or 14
    digits may be of two units or a written date, names no one instant, and is ``unreadable``.
    """
    own = df.columns
    df = bind(df, _v=trimmed(F.col(value)))
    v = F.col("_v")
    fields = F.lit(None).cast("string")
    for _, pattern, to in reversed(PATTERNS):
        fields = F.when(v.rlike(pattern), F.regexp_replace(v, pattern, to)).otherwise(fields)
    df = bind(df, _f=F.split(fields, r"\|"))
    f = lambda i: F.col("_f")[i]

    # dates
    order_c, kind = F.col(order), f(0)
    a, b, c = f(1), f(2), f(3)
    year_s = F.when(kind == "ymd", a).when(order_c == "YMD", a).otherwise(c)
    month_s = F.when(kind == "ymd", b).when(order_c == "MDY", a).otherwise(b)
    day_s = F.when(kind == "ymd", c).when(order_c == "DMY", a).when(order_c == "MDY", b).otherwise(c)
    named = (F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), F.lower(F.substring(month_s, 1, 3))) + 2) / 3
    df = bind(
        df,
        _y=F.when(F.length(year_s) == 2, 2000 + _int(year_s)).when(F.length(year_s) == 4, _int(year_s)),
        _m=F.when(month_s.rlike("^[0-9]+$"), _int(month_s)).otherwise(named.cast("bigint")),
        _d=F.when(F.length(day_s) <= 2, _int(day_s)),
    )
    y, m, d = F.col("_y"), F.col("_m"), F.col("_d")
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    last = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    date_ok = y.between(1, 9999) & m.between(1, 12) & (d >= 1) & (d <= last)
    df = bind(df, _date=F.when(date_ok, F.make_date(y.cast("int"), m.cast("int"), d.cast("int"))))
    date = F.col("_date")

    # time of day
    hour, minute, second, half = _int(f(4)), _int(f(5)), F.coalesce(_int(f(6)), F.lit(0)), F.lower(f(8))
    hour24 = F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "p", 12).otherwise(0))
    time_ok = (hour24 <= 23) & (minute <= 59) & (second <= 59)
    weekday_ok = (f(11) == "") | (F.lower(f(11)) == F.lower(F.substring(F.date_format(date, "EEE"), 1, 3)))
    real = F.coalesce(date.isNotNull() & time_ok & weekday_ok, F.lit(False))
    local = F.when(real, F.unix_date(date).cast("bigint") * DAY_US + (hour24 * 3600 + minute * 60 + second) * 1_000_000 + _micros(f(7)))

    # zone
    z, br = f(9), f(10)
    digits = F.regexp_replace(z, "^(UTC|GMT)|:", "")
    signed = z.rlike(r"^(?:UTC|GMT)?[+-]\d{2}(?::?\d{2})?$")
    off_h, off_m = F.substring(digits, 2, 2), F.substring(digits, 4, 2)
    offset = F.when(
        signed & (_int(off_h) <= 18) & (F.coalesce(_int(off_m), F.lit(0)) <= 59),
        (_int(off_h) * 3600 + F.coalesce(_int(off_m), F.lit(0)) * 60) * F.when(digits.startswith("-"), -1).otherwise(1),
    )
    words = F.upper(z).isin("Z", "UTC", "GMT")
    meant = F.when((z != "") & ~signed & ~words, F.try_element_at(F.col(abbreviations), z))
    df = bind(df, _named=F.when(br != "", br).when(z.contains("/"), z), _meant=meant)
    several = F.size("_meant") > 1
    listed = F.expr("_named in (" + ", ".join(f"'{x}'" for x in _known()) + ")")
    df = bind(
        df,
        _local=local,
        _off=F.coalesce(offset, F.when(words, F.lit(0)), F.when(~several, F.get("_meant", F.lit(0)))).cast("bigint"),
        _zone=F.when(F.col("_named").isNotNull(), F.when(listed, F.col("_named"))).when(several | ((z == "") & F.col(abbreviations).isNotNull()), F.col(tz)),
    )
    local, off, zone = F.col("_local"), F.col("_off") * 1_000_000, F.col("_zone")

    # offsets that the zone has a day before and after: the only candidates, whatever change lies between
    ask = local.isNotNull() & zone.isNotNull() & ((F.col("_off").isNull()) | (br != ""))
    early, late = local - DAY_US, local + DAY_US
    df = bind(df, _c1=F.when(ask, local - (_at(early, zone) - early)), _c2=F.when(ask, local - (_at(late, zone) - late)))
    fits = lambda c: c.isNotNull() & (_at(c, zone) == local) & (~several | F.array_contains("_meant", F.floor((local - c) / 1_000_000).cast("int")))
    several = F.coalesce(several, F.lit(False))
    df = bind(df, **{f"_g{i}": F.when(fits(F.col(f"_c{i}")), F.col(f"_c{i}")) for i in (1, 2)})
    g1, g2 = F.col("_g1"), F.col("_g2")

    count = _int(f(1))
    from_zone = F.when(g1.isNotNull() & g2.isNotNull() & (g1 != g2), None).otherwise(F.coalesce(g1, g2))
    by_offset = local - off
    utc = (
        F.when(kind == "s", count * 1_000_000 + _micros(f(6)))
        .when(kind == "ms", count * 1000 + F.coalesce(_int(F.substring(F.rpad(f(6), 3, "0"), 1, 3)), F.lit(0)))
        .when(kind == "us", count)
        .when((kind == "abc") & order_c.isNull(), None)
        .when(br != "", F.when(off.isNull() & ((z == "") | several), from_zone).when((by_offset == g1) | (by_offset == g2), by_offset))
        .when(off.isNotNull(), by_offset)
        .otherwise(from_zone)
    )
    needs = (z == "") & (br == "")
    status_of = lambda utc: (
        F.when(F.coalesce(v == "", F.lit(True)), "empty")
        .when(kind.isNull(), "unreadable")
        .when(utc.isNotNull(), "ok")
        .when((kind == "abc") & order_c.isNull(), "no_source")
        .when(local.isNull(), "impossible")
        .when(needs & zone.isNull(), "no_source")
        .when(zone.isNull() & off.isNull(), "unknown_zone")
        .when((br != "") & zone.isNull(), "unknown_zone")
        .when((br != "") & off.isNotNull(), "conflict")
        .when(several & g1.isNull() & g2.isNull(), "conflict")
        .when(g1.isNotNull() & g2.isNotNull(), "twice")
        .otherwise("skipped")
    )
    df = bind(df, utc_us=utc)
    utc = F.col("utc_us")
    return bind(df, status=status_of(utc)).select(*own, "utc_us", "status")
