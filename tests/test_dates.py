"""C1 fix: date header parsing to a UTC wall-clock TIMESTAMP_NTZ."""
import datetime as dt

from tidemark.functions.dates import check_day, parse_sent_at

import pytest

CASES = [
    ("Sun, 05 Apr 2026 10:00:00 +0000", dt.datetime(2026, 4, 5, 10, 0, 0)),
    ("Sun, 05 Apr 2026 10:00:00 -0700 (PDT)", dt.datetime(2026, 4, 5, 17, 0, 0)),
    ("5 Apr 2026 10:00 GMT", dt.datetime(2026, 4, 5, 10, 0, 0)),
    ("Sun, 5 Apr 2026 23:30:15 UT", dt.datetime(2026, 4, 5, 23, 30, 15)),
    ("Mon, 06 Apr 2026 01:00:00 +0530", dt.datetime(2026, 4, 5, 19, 30, 0)),
    ("2026-03-31", dt.datetime(2026, 3, 31)),
    ("2026-03-31T08:15:00", dt.datetime(2026, 3, 31, 8, 15)),
    ("2026-03-31 08:15", dt.datetime(2026, 3, 31, 8, 15)),
    ("bad", None),
    ("", None),
    (None, None),
    ("31 Feb 2026 10:00:00 +0000", None),
    ("2026-02-31", None),
]


def test_parse_cases(spark):
    df = spark.createDataFrame([(c,) for c, _ in CASES], "date string")
    got = [r[0] for r in df.select(parse_sent_at("date")).collect()]
    assert got == [e for _, e in CASES]


def test_session_time_zone_does_not_matter(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        df = spark.createDataFrame([("Sun, 05 Apr 2026 10:00:00 +0000",)], "date string")
        assert df.select(parse_sent_at("date")).first()[0] == dt.datetime(2026, 4, 5, 10, 0)
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_bad_init_date_fails_early():
    with pytest.raises(ValueError):
        check_day("2024-13-01")
    assert check_day(None) is None and check_day("") is None


def test_two_digit_years(spark):
    df = spark.createDataFrame([("Fri, 21 Nov 97 09:55:06 -0600",), ("1 Jan 05 00:00 GMT",)], "date string")
    got = [r[0] for r in df.select(parse_sent_at("date")).collect()]
    assert got == [dt.datetime(1997, 11, 21, 15, 55, 6), dt.datetime(2005, 1, 1, 0, 0)]
