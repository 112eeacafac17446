"""Written dates of many forms and zones as one instant in UTC.

A value is parsed to wall-clock fields by one rule per written form, batch by batch. Values that
carry an offset are shifted by it; the rest are wall time of a named zone and are resolved by an as-of join with that
zone's offset intervals, which are exploded by year so that the join is an equi-join on (zone, year):

* two intervals hold the local time  -> it occurs twice; the first occurrence counts,
* none holds it                      -> it was skipped; the offset valid just before the skip counts,
* one holds it                       -> its offset counts.

Null, empty and unreadable values give a null instant with resolution ``unreadable``; repeated rows stay repeated; a zone
name that the time-zone database does not know leaves zoneless values unreadable.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.session import small_side

#: Years whose transitions are tabled; local times outside them use the first or last offset.
FIRST_YEAR, LAST_YEAR = 1900, 2100

# Offsets in seconds of the zone abbreviations used in mail headers.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0,
    "EST": -18000, "EDT": -14400, "CST": -21600, "CDT": -18000, "MST": -25200, "MDT": -21600, "PST": -28800, "PDT": -25200,
    "WET": 0, "WEST": 3600, "CET": 3600, "CEST": 7200, "EET": 7200, "EEST": 10800, "BST": 3600, "MSK": 10800,
}

# Month names of mail clients in English, Spanish, French and Portuguese, by their first letters.
MONTHS = {
    1: ["jan", "ene", "janv"], 2: ["feb", "fev", "fév"], 3: ["mar"], 4: ["apr", "abr", "avr"], 5: ["may", "mai"], 6: ["jun", "juin"],
    7: ["jul", "juil"], 8: ["aug", "ago", "aoû"], 9: ["sep", "set"], 10: ["oct", "out"], 11: ["nov"], 12: ["dec", "dic", "dez", "déc"],
}

_ZONE = r"(?P<zone>Z|(?:UTC|GMT|UT)?[+-]\d{2}:?\d{2}|[A-Z]{2,5})"
_TIME = r"(?P<hour>\d{1,2}):(?P<minute>\d{2})(?::(?P<second>\d{2})(?:[.,](?P<frac>\d{1,9}))?)?"
_HALF = r" ?(?P<half>AM|PM)?"
_WEEKDAY = r"(?:[^\W\d]{2,}\.?,? )?"
_TAIL = r"(?: ?\[[^\]]*\])?(?: ?\([^)]*\))?"
_MONTH = r"(?P<word>[^\W\d]{3,})"
_NUM = r"(?P<year>\d{4})(?P<month>\d{2})(?P<day>\d{2})"
_FORMS = [
    rf"(?P<year>\d{{4}})[-/.](?P<month>\d{{1,2}})[-/.](?P<day>\d{{1,2}})(?:[T ]{_TIME} ?{_ZONE}?{_TAIL})?",
    rf"{_NUM}(?:T(?P<hour>\d{{2}})(?P<minute>\d{{2}})(?:(?P<second>\d{{2}})(?:[.,](?P<frac>\d{{1,9}}))?)? ?{_ZONE}?{_TAIL})?",
    rf"{_WEEKDAY}(?P<day>\d{{1,2}})[ -]{_MONTH}\.?[ -](?P<year>\d{{4}})(?:,? {_TIME}{_HALF} ?{_ZONE}?{_TAIL})?",
    rf"{_WEEKDAY}{_MONTH} (?P<day>\d{{1,2}}) {_TIME} (?:{_ZONE} )?(?P<year>\d{{4}})",
    rf"{_WEEKDAY}{_MONTH}\.? (?P<day>\d{{1,2}}),? (?P<year>\d{{4}})(?:,?(?: at)? {_TIME}{_HALF} ?{_ZONE}?{_TAIL})?",
    rf"{_WEEKDAY}(?P<day>\d{{1,2}}) de {_MONTH} del? (?P<year>\d{{4}})(?:,?(?: a las| às)? {_TIME}{_HALF} ?{_ZONE}?)?",
    rf"(?P<first>\d{{1,2}})[/.-](?P<other>\d{{1,2}})[/.-](?P<year>\d{{4}}|\d{{2}})(?:,? {_TIME}{_HALF} ?{_ZONE}?{_TAIL})?",
]
#: Seconds since 1970, or milli-, micro- or nanoseconds by the number of digits.
_EPOCH = r"(-?)(\d{9,19})(?:\.(\d{1,9}))?"


def read_written(value: str, dmy: bool) -> tuple[int, int | None] | None:
    """(local micros, offset in seconds or None) of a written date, or None if it names no possible instant."""
    v = " ".join(value.split())
    if m := re.fullmatch(_EPOCH, v):
        n, digits = int(m[2]), len(m[2])
        us = n * 1_000_000 + int((m[3] or "").ljust(6, "0")[:6]) if digits <= 11 else n * 1000 if digits <= 14 else n if digits <= 17 else n // 1000
        return (-us if m[1] else us), 0
    m = next((m for form in _FORMS if (m := re.fullmatch(form, v, re.I))), None)
    if m is None:
        return None
    part = {k: x for k, x in m.groupdict().items() if x is not None}
    if "first" in part:
        part["day"], part["month"] = (part["first"], part["other"]) if dmy else (part["other"], part["first"])
    if "word" in part:
        word = part["word"].lower()
        part["month"] = next((n for n, starts in MONTHS.items() if word.startswith(tuple(starts))), 0)
    year, hour, second = int(part["year"]), int(part.get("hour", 0)), int(part.get("second", 0))
    year += 0 if len(part["year"]) > 2 else 2000 if year < 70 else 1900
    if "half" in part:
        if not 1 <= hour <= 12:
            return None
        hour = hour % 12 + 12 * (part["half"].upper() == "PM")
    offset = None
    if "zone" in part:
        zone = part["zone"].upper()
        if zone[-1].isdigit():
            sign, hh, mm = re.search(r"([+-])(\d{2}):?(\d{2})$", zone).groups()
            if int(hh) > 18 or int(mm) > 59:
                return None
            offset = (int(hh) * 3600 + int(mm) * 60) * (-1 if sign == "-" else 1)
        elif (offset := ABBREVIATIONS.get(zone)) is None:
            return None
    try:
        at = datetime(year, int(part["month"]), int(part["day"]), hour, int(part.get("minute", 0)), min(second, 59), tzinfo=timezone.utc)
    except ValueError:
        return None
    if second > 60:
        return None
    whole = (at - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(seconds=1) + max(0, second - 59)
    return whole * 1_000_000 + int(part.get("frac", "0").ljust(6, "0")[:6]), offset


@F.pandas_udf(T.StructType().add("local_us", "long").add("offset_s", "integer"))
def parse_written(value: pd.Series, day_order: pd.Series) -> pd.DataFrame:
    """Struct (local_us, offset_s) of a written date; both null if it can't be read, offset null if it names no zone.

    ``day_order`` (MDY or DMY) is used when day and month are both numbers; anything else reads as MDY. A regular
    expression per written form in one Arrow batch function: as JVM expressions the same rules took a hundred times as long.
    """
    read = [None if v is None else read_written(v, isinstance(o, str) and o.upper() == "DMY") for v, o in zip(value, day_order)]
    return pd.DataFrame({"local_us": pd.array([x and x[0] for x in read], dtype="Int64"), "offset_s": pd.array([x and x[1] for x in read], dtype="Int32")})


def _intervals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from zoneinfo import ZoneInfo

    first, last = datetime(FIRST_YEAR, 1, 1, tzinfo=timezone.utc), datetime(LAST_YEAR, 12, 31, tzinfo=timezone.utc)
    far = 1 << 60

    def offset(zone: ZoneInfo, at: datetime) -> int:
        return int(at.astimezone(zone).utcoffset().total_seconds())

    for batch in batches:  # looked up week by week, then narrowed to the second
        rows = []
        for name in batch["zone_name"]:
            try:
                zone = ZoneInfo(name)
            except Exception:  # not in the time-zone database
                continue
            steps, at, now = [(None, offset(zone, first))], first, offset(zone, first)
            while at < last:
                ahead = at + timedelta(days=7)
                if (then := offset(zone, ahead)) != now:
                    lo, hi = at, ahead
                    while hi - lo > timedelta(seconds=1):
                        mid = lo + timedelta(seconds=int((hi - lo).total_seconds()) // 2)
                        lo, hi = (mid, hi) if offset(zone, mid) == now else (lo, mid)
                    now = offset(zone, hi)
                    steps.append((int(hi.timestamp()), now))
                    ahead = max(hi, ahead) if now == then else hi
                at = ahead
            for i, (began, off) in enumerate(steps):
                ends = steps[i + 1] if i + 1 < len(steps) else None
                low = -far if began is None else (began + off) * 1_000_000
                high = far if ends is None else (ends[0] + off) * 1_000_000
                cover = high if ends is None else max(high, (ends[0] + ends[1]) * 1_000_000)
                y0 = FIRST_YEAR if began is None else datetime.fromtimestamp(began + off, timezone.utc).year
                y1 = LAST_YEAR if ends is None else datetime.fromtimestamp(cover / 1e6, timezone.utc).year
                rows += [(name, y, low, high, cover, off) for y in range(max(y0, FIRST_YEAR), min(y1, LAST_YEAR) + 1)]
        yield pd.DataFrame(rows, columns=["zone_name", "year", "local_from", "local_to", "cover_to", "offset_s"])


def zone_intervals(zones: DataFrame) -> DataFrame:
    """Offset intervals of each zone in local micros, one row for each year an interval touches.

    ``cover_to`` reaches over a skip to the start of the next interval. Null and unknown names give no rows. The result is
    bounded by the time-zone database: its zones times (LAST_YEAR - FIRST_YEAR + 1 + transitions).
    """
    names = zones.select("zone_name").where("zone_name is not null").distinct()
    return names.mapInPandas(_intervals, "zone_name string, year int, local_from long, local_to long, cover_to long, offset_s int")


def resolve_local(df: DataFrame, zones: DataFrame) -> DataFrame:
    """Add ``utc_micros`` and ``resolution`` to rows with parsed (local_us, offset_s) and zone_name.

    resolution: given, direct, ambiguous, nonexistent or unreadable.
    """
    held = zone_intervals(zones).groupBy("zone_name", "year").agg(F.collect_list(F.struct("local_from", "local_to", "cover_to", "offset_s")).alias("held"))
    year = F.least(F.greatest(F.year(F.timestamp_micros(F.col("local_us"))), F.lit(FIRST_YEAR)), F.lit(LAST_YEAR))
    keyed = df.withColumn("_year", F.when(F.col("offset_s").isNull(), year))
    # bounded by the time-zone database, so a broadcast needs no count
    held = F.broadcast(held).select(F.col("zone_name").alias("_zone"), F.col("year").alias("_y"), "held")
    joined = keyed.join(held, (keyed["zone_name"] == held["_zone"]) & (keyed["_year"] == held["_y"]), "left")
    at = F.col("local_us")
    exact = F.filter("held", lambda i: (at >= i["local_from"]) & (at < i["local_to"]))
    skipped = F.filter("held", lambda i: (at >= i["local_to"]) & (at < i["cover_to"]))
    joined = joined.withColumns({"_in": F.transform(exact, lambda i: i["offset_s"]), "_skip": F.transform(skipped, lambda i: i["offset_s"])})
    n = F.size("_in")
    # the first of two occurrences is the one with the larger offset
    joined = joined.withColumn("_off", F.coalesce("offset_s", F.when(n > 0, F.array_max("_in")).when(F.size("_skip") > 0, F.array_max("_skip"))))
    utc = at - F.col("_off").cast("long") * 1_000_000
    how = F.when(utc.isNull(), "unreadable").when(F.col("offset_s").isNotNull(), "given").when(n >= 2, "ambiguous").when(n == 1, "direct").otherwise("nonexistent")
    return joined.withColumns({"utc_micros": utc, "resolution": how}).drop("_year", "_zone", "_y", "held", "_in", "_skip", "_off")


def normalise_dates(inquiries: DataFrame, mailboxes: DataFrame) -> DataFrame:
    """(inquiry_id, field_name, written, utc_micros, resolution): one row for each non-null date_range_start and _end.

    The zone and day order are those of the mailbox in source_path; a mailbox that isn't listed leaves zoneless values
    unreadable and reads numeric dates as MDY.
    """
    long = inquiries.select(
        "inquiry_id",
        F.regexp_extract("source_path", r"^exports/([^/]+)/", 1).alias("_mailbox"),
        F.inline(F.array(F.struct(F.lit("start").alias("field_name"), F.col("date_range_start").alias("written")), F.struct(F.lit("end").alias("field_name"), F.col("date_range_end").alias("written")))),
    ).where("written is not null")
    boxes = mailboxes.select(F.col("mailbox").alias("_mailbox"), "zone_name", "day_order").where("mailbox is not null").dropDuplicates(["_mailbox"])
    parsed = long.join(small_side(boxes), "_mailbox", "left").withColumn("_p", parse_written("written", "day_order"))
    parsed = parsed.select("inquiry_id", "field_name", "written", "zone_name", "_p.local_us", "_p.offset_s")
    return resolve_local(parsed, mailboxes).select("inquiry_id", "field_name", "written", "utc_micros", "resolution")
