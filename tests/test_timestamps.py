"""Written dates against hand-computed instants and against the standard library's zone rules."""

from datetime import datetime, timezone
from zoneinfo import ZoneInfo

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from threadloom.operators import timestamps as ts


def micros(*args, zone="UTC"):
    return int(datetime(*args, tzinfo=ZoneInfo(zone)).timestamp() * 1_000_000)


@pytest.mark.parametrize(
    "written, dmy, local, offset",
    [
        ("2024-07-14T14:56:25.058Z", False, micros(2024, 7, 14, 14, 56, 25) + 58_000, 0),
        ("Wed, 26 Apr 2023 01:41:19 -0400", False, micros(2023, 4, 26, 1, 41, 19), -14400),
        ("Fri, 27 Mar 2026 10:57:02 -0700 (PDT)", False, micros(2026, 3, 27, 10, 57, 2), -25200),
        ("8/9/25 8:48 AM", False, micros(2025, 8, 9, 8, 48), None),
        ("8/9/25 8:48 PM", True, micros(2025, 9, 8, 20, 48), None),
        ("12/12/23 12:05 AM", False, micros(2023, 12, 12, 0, 5), None),
        ("20250902T030956Z", False, micros(2025, 9, 2, 3, 9, 56), 0),
        ("1682710659.042", False, 1682710659_042000, 0),
        ("1672951651869", False, 1672951651869_000, 0),
        (" 2024/10/06 00:40 ", False, micros(2024, 10, 6, 0, 40), None),
        ("miércoles, 18 de junio de 2025, 21:04", True, micros(2025, 6, 18, 21, 4), None),
        ("Mon Sep  8 02:06:36 2025", False, micros(2025, 9, 8, 2, 6, 36), None),
        ("Fri Aug 29 06:56:51 EDT 2025", False, micros(2025, 8, 29, 6, 56, 51), -14400),
        ("Jun 19, 2025 at 8:15 PM PDT", False, micros(2025, 6, 19, 20, 15), -25200),
        ("2024-11-21 00:43:10 UTC-08:00", False, micros(2024, 11, 21, 0, 43, 10), -28800),
        ("2023-02-19T14:06:30-08:00[America/Los_Angeles]", False, micros(2023, 2, 19, 14, 6, 30), -28800),
        ("2023-06-03T06:53:49,477Z", False, micros(2023, 6, 3, 6, 53, 49) + 477_000, 0),
        ("2024-10-04", False, micros(2024, 10, 4), None),
        ("31 Dec 2016 23:59:60 GMT", False, micros(2017, 1, 1), 0),
    ],
)
def test_forms(written, dmy, local, offset):
    assert ts.read_written(written, dmy) == (local, offset)


@pytest.mark.parametrize("written", ["", "TBD", "pending", "2025-02-30", "2024-13-05 11:00", "0000-00-00 00:00:00", "Thu, 31 Jun 2024 09:15:00 -0700", "yesterday", "1/2/24 13:00 PM", "2024-01-01T25:00", "5 May 2024 10:00 XYZ", "x" * 100_000])
def test_unreadable(written):
    assert ts.read_written(written, False) is None


@settings(max_examples=60, deadline=None)
@given(st.datetimes(min_value=datetime(1971, 1, 1), max_value=datetime(2090, 1, 1)))
def test_iso_round_trip(at):
    assert ts.read_written(at.isoformat(), False) == ((at - datetime(1970, 1, 1)) // __import__("datetime").timedelta(microseconds=1), None)


ROWS = [
    ("a", "exports/w/2024/a.md", "2024-11-03 01:30:00", None),  # occurs twice: first occurrence, still daylight time
    ("b", "exports/w/2024/b.md", "2024-03-10 02:30:00", "2024-03-10 02:30"),  # skipped: offset before the skip
    ("c", "exports/m/2024/c.md", "01/02/2024 10:00", None),
    ("d", "exports/nowhere/2024/d.md", "2024-01-01 10:00", "2024-01-01T10:00Z"),
    ("e", None, None, ""),
    ("e", None, None, ""),
    (None, "exports/w/2024/f.md", "2024-06-01T00:00", None),
    ("g", "exports/x/2024/g.md", "2024-06-01T00:00", None),
]
BOXES = [("w", "America/Los_Angeles", "MDY", 1), ("m", "Europe/Madrid", "DMY", 2), ("x", "Not/AZone", "MDY", 3), (None, None, None, 4), ("w", "America/Los_Angeles", "MDY", 5)]


def tables(spark, rows=ROWS, boxes=BOXES):
    # further columns that clash with names used inside
    inquiries = spark.createDataFrame(rows, "inquiry_id string, source_path string, date_range_start string, date_range_end string").selectExpr("*", "1 as zone_name", "2 as local_us", "3 as _mailbox", "4 as held")
    return inquiries, spark.createDataFrame(boxes, "mailbox string, zone_name string, day_order string, year int")


def test_resolution(spark):
    got = {(r[0], r[1]): (r[3], r[4]) for r in ts.normalise_dates(*tables(spark)).collect()}
    assert got["a", "start"] == (micros(2024, 11, 3, 8, 30), "ambiguous")
    assert got["b", "start"] == (micros(2024, 3, 10, 10, 30), "nonexistent") and got["b", "end"] == got["b", "start"]
    assert got["c", "start"] == (micros(2024, 2, 1, 10, zone="Europe/Madrid"), "direct")
    assert got["d", "start"] == (None, "unreadable") and got["d", "end"] == (micros(2024, 1, 1, 10), "given")
    assert got["e", "end"] == (None, "unreadable") and ("e", "start") not in got
    assert got[None, "start"][1] == "direct" and got["g", "start"] == (None, "unreadable")


def test_repeated_and_empty(spark):
    assert sum(r[0] == "e" for r in ts.normalise_dates(*tables(spark)).collect()) == 2
    inquiries, boxes = tables(spark)
    assert ts.normalise_dates(inquiries.limit(0), boxes).count() == 0
    assert {r[4] for r in ts.normalise_dates(inquiries, boxes.limit(0)).collect()} == {"unreadable", "given"}


def test_against_zone_rules(spark):
    """Every half hour around the transitions of a few zones and years, against the standard library."""
    rows, want = [], {}
    for name in ("America/New_York", "Europe/Madrid", "America/Phoenix", "Asia/Kolkata", "Australia/Lord_Howe"):
        zone = ZoneInfo(name)
        for month in range(1, 13):
            for day in (1, 3, 10, 11, 27, 28):
                for minute in range(0, 300, 30):
                    at = datetime(2024, month, day, minute // 60, minute % 60, tzinfo=zone)
                    rows.append((f"{name}{len(rows)}", f"exports/{name.replace('/', '-')}/x.md", at.strftime("%Y-%m-%d %H:%M"), None))
                    # fold 0 is the first occurrence and, in a skip, the offset before it
                    want[rows[-1][0]] = int(at.astimezone(timezone.utc).timestamp()) * 1_000_000
    boxes = [(n.replace("/", "-"), n, "MDY", 0) for n in ("America/New_York", "Europe/Madrid", "America/Phoenix", "Asia/Kolkata", "Australia/Lord_Howe")]
    got = {r[0]: r[3] for r in ts.normalise_dates(*tables(spark, rows, boxes)).collect()}
    assert got == want
