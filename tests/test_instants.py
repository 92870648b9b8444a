"""Instants against a plain reading with Python's own zone rules."""

from datetime import UTC, datetime
from zoneinfo import ZoneInfo

import pytest

from tapewright.operators.normalise_instants import catalog_instants

LIBRARIES = [("London", "Europe/London", "DMY", 1), ("New York", "America/New_York", "MDY", 2), ("Tokyo", "Asia/Tokyo", "YMD", 3), ("Nowhere", "Mars/Base", "DMY", 4), ("Bare", None, None, 5), ("Moscow", "Europe/Moscow", "DMY", 6)]


def us(*a, tz=UTC):
    return int(datetime(*a, tzinfo=tz).timestamp()) * 1_000_000


CASES = [
    ("2018-02-03 04:05:06", "London", "ok", us(2018, 2, 3, 4, 5, 6)),
    ("2018-07-03T04:05:06.5", "London", "ok", us(2018, 7, 3, 3, 5, 6) + 500_000),
    ("03/02/2018 04:05", "London", "ok", us(2018, 2, 3, 4, 5)),
    ("03/02/2018 04:05", "New York", "ok", us(2018, 3, 2, 4, 5, tz=ZoneInfo("America/New_York"))),
    ("18/02/03 04:05", "Tokyo", "ok", us(2018, 2, 3, 4, 5, tz=ZoneInfo("Asia/Tokyo"))),
    ("03/02/2018 04:05", "Tokyo", "impossible", None),
    ("03/02/2018 04:05Z", None, "no_source", None),
    ("2018-02-03 04:05:06Z", None, "ok", us(2018, 2, 3, 4, 5, 6)),
    ("2018-02-03 04:05:06 +0530", None, "ok", us(2018, 2, 2, 22, 35, 6)),
    ("2018-02-03 04:05:06.123456789-05", None, "ok", us(2018, 2, 3, 9, 5, 6) + 123_456),
    ("2018-02-03 04:05:06", None, "no_source", None),
    ("2018-02-03 04:05:06", "Nowhere", "no_source", None),
    ("2018-02-03 04:05:06", "Unlisted", "no_source", None),
    ("2018-02-03 04:05:06", "Bare", "no_source", None),
    ("2018-03-25 01:30:00", "London", "skipped", None),
    ("2018-10-28 01:30:00", "London", "twice", None),
    ("2018-10-28 01:30:00 BST", "London", "ok", us(2018, 10, 28, 0, 30)),
    ("2018-10-28 01:30:00 GMT", "London", "ok", us(2018, 10, 28, 1, 30)),
    ("2018-10-28T01:30:00+01:00[Europe/London]", "Tokyo", "ok", us(2018, 10, 28, 0, 30)),
    ("2018-10-28T01:30:00+05:00[Europe/London]", "Tokyo", "conflict", None),
    ("2018-10-28T12:30:00[Europe/London]", None, "ok", us(2018, 10, 28, 12, 30)),
    ("2018-10-28 12:30:00 Europe/London", None, "ok", us(2018, 10, 28, 12, 30)),
    ("2018-10-28 12:30:00 Europe/Atlantis", "London", "unknown_zone", None),
    ("2018-02-03 04:05:06 EST", "New York", "ok", us(2018, 2, 3, 9, 5, 6)),
    ("2018-02-03 04:05:06 EST", "London", "unknown_zone", None),
    ("1517632506", None, "ok", 1_517_632_506_000_000),
    ("1517632506123", None, "ok", 1_517_632_506_123_000),
    ("1517632506123456", None, "ok", 1_517_632_506_123_456),
    ("1517632506.250", None, "ok", 1_517_632_506_250_000),
    ("20180203040506", "London", "ok", us(2018, 2, 3, 4, 5, 6)),
    ("20180203T040506Z", None, "ok", us(2018, 2, 3, 4, 5, 6)),
    ("2018.02.03 04.05.06", "London", "ok", us(2018, 2, 3, 4, 5, 6)),
    ("2018_02_03 04-05-06", "London", "ok", us(2018, 2, 3, 4, 5, 6)),
    ("Sat, 03 Feb 2018 04:05:06 +0100", None, "ok", us(2018, 2, 3, 3, 5, 6)),
    ("Sun, 03 Feb 2018 04:05:06 +0100", None, "impossible", None),
    ("Feb 3, 2018 12:05:06 AM", "London", "ok", us(2018, 2, 3, 0, 5, 6)),
    ("February 3, 2018 12:05:06 pm", "London", "ok", us(2018, 2, 3, 12, 5, 6)),
    ("Feb 3, 2018 13:05:06 pm", "London", "impossible", None),
    ("03-Feb-18 04:05:06", "London", "ok", us(2018, 2, 3, 4, 5, 6)),
    ("2018-02-30 04:05:06", "London", "impossible", None),
    ("2016-02-29 23:59:59", "London", "ok", us(2016, 2, 29, 23, 59, 59)),
    ("2018-02-03 24:00:00", "London", "impossible", None),
    ("2018-02-03 04:05:60", "London", "impossible", None),
    ("  2018-02-03 04:05:06\t", "London", "ok", us(2018, 2, 3, 4, 5, 6)),
    ("2018-02-03", "London", "unreadable", None),
    ("2018-02-03 04:05:06 MSK", "Moscow", "ok", us(2018, 2, 3, 1, 5, 6)),
    ("2012-02-03 04:05:06 MSK", "Moscow", "ok", us(2012, 2, 3, 0, 5, 6)),
    ("2018-02-03 04:05:06 MSD", "Moscow", "ok", us(2018, 2, 3, 0, 5, 6)),
    ("2018-02-03 04:05:06.1234567891234567", "London", "ok", us(2018, 2, 3, 4, 5, 6) + 123456),
    ("15000000000", "London", "unreadable", None),
    ("15009900000000", "London", "impossible", None),
    ("150000000", "London", "ok", 150_000_000_000_000),
    ("1500000000.123456789123", "London", "ok", 1_500_000_000_123_456),
    ("unknown", "London", "unreadable", None),
    ("x" * 100_000, "London", "unreadable", None),
    ("", "London", "empty", None),
    ("  ", "London", "empty", None),
    (None, "London", "empty", None),
]


@pytest.fixture(scope="module")
def read(spark):
    rows = [(i, v, None, lib, "clash") for i, (v, lib, _, _) in enumerate(CASES)]
    cat = spark.createDataFrame(rows, "rowid bigint, bwdate string, scanneddate string, library string, tz_name string")
    libs = spark.createDataFrame([*LIBRARIES, LIBRARIES[0], (None, "UTC", "DMY", 9)], "library string, tz_name string, date_order string, trust_rank int")
    return {r["rowid"]: (r["status"], r["utc_us"]) for r in catalog_instants(cat, libs).filter("field_name = 'bwdate'").collect()}


@pytest.mark.parametrize("i", range(len(CASES)), ids=[repr(c[0])[:40] for c in CASES])
def test_case(read, i):
    assert read[i] == CASES[i][2:]


def test_session_zone_and_empty(spark):
    cat = spark.createDataFrame([], "rowid bigint, bwdate string, scanneddate string, library string")
    libs = spark.createDataFrame([], "library string, tz_name string, date_order string, trust_rank int")
    assert catalog_instants(cat, libs).collect() == []
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        one = spark.createDataFrame([(1, "2018-07-03 04:05:06", None, "London")], "rowid bigint, bwdate string, scanneddate string, library string")
        libs = spark.createDataFrame(LIBRARIES[:1], "library string, tz_name string, date_order string, trust_rank int")
        assert catalog_instants(one, libs).filter("status = 'ok'").first()["utc_us"] == us(2018, 7, 3, 3, 5, 6)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
