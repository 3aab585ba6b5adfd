"""Opening hours, ages and calendars. Nothing reads the clock: every function takes the time to judge by."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_HOURS = r"^(\d{1,2})(?::(\d{2}))?(am|pm)-(\d{1,2})(?::(\d{2}))?(am|pm)$"
_ANYWHERE = r"(\d+)(?::(\d+))?(am|pm)\s*[-–]\s*(\d+)(?::(\d+))?(am|pm)"
_LOOSE = r"^\s*(\d{1,2})(?::(\d{2}))?\s*(am|pm)\s*[-–]\s*(\d{1,2})(?::(\d{2}))?\s*(am|pm)\s*$"


def weekday(ts: Column) -> Column:
    return F.date_format(ts, "EEE")


def _hour(text: Column, pattern: str, hour: int, half: int) -> Column:
    h = F.regexp_extract(text, pattern, hour).try_cast("int") % 12
    return h + F.when(F.regexp_extract(text, pattern, half) == "pm", 12).otherwise(0)


def is_open_hourly(day: Column, ts: Column) -> Column:
    """By whole hours: open from its first hour until before its last; null where the text says nothing.

    Minutes are ignored, and a shop that closes at 12am is never open.
    """
    hour = F.hour(ts)
    opens, closes = _hour(day, _HOURS, 1, 3), _hour(day, _HOURS, 4, 6)
    return F.when(F.lower(day) == "closed", F.lit(False)).when(day.rlike(_HOURS), (hour >= opens) & (hour < closes))


def opening_minutes(day: Column) -> Column:
    """(opens, closes) in minutes of the day; blanks and en dashes are allowed, null where the text says nothing."""
    low = F.lower(day)
    minute = lambda g: F.coalesce(F.regexp_extract(low, _LOOSE, g).try_cast("int"), F.lit(0))
    opens = _hour(low, _LOOSE, 1, 3) * 60 + minute(2)
    closes = _hour(low, _LOOSE, 4, 6) * 60 + minute(5)
    return F.when(low.rlike(_LOOSE), F.struct(opens.alias("opens"), F.when(closes <= opens, closes + 1440).otherwise(closes).alias("closes")))


def is_open_minutes(day: Column, ts: Column) -> Column:
    """By minutes, and over midnight."""
    now, m = F.hour(ts) * 60 + F.minute(ts), opening_minutes(day)
    return F.when(m.isNotNull(), (now >= m["opens"]) & (now < m["closes"])).when(F.lower(day) == "closed", F.lit(False))


def clock(minutes: Column) -> Column:
    """Minutes of the day on a 12-hour clock: '9:30am'."""
    h, m = (F.floor(minutes / 60) % 24).cast("int"), (minutes % 60).cast("int")
    return F.concat(
        F.when(h % 12 == 0, 12).otherwise(h % 12).cast("string"),
        F.when(m > 0, F.concat(F.lit(":"), F.lpad(m.cast("string"), 2, "0"))).otherwise(""),
        F.when(h < 12, "am").otherwise("pm"),
    )


def shop_status(hours: Column, ts: Column) -> Column:
    """What a shop's door says, from a map of weekday to text; null without a map.

    A day without hours gives the next open day of a week ('tomorrow' for the first), or 'Closed today'; text that isn't hours is
    shown itself. On an open day it says when the shop opens, closes (within 90 minutes, in half hours beyond 30 minutes) or until when it is open.
    """
    day = lambda k: F.try_element_at(hours, F.date_format(F.date_add(ts.cast("date"), k), "EEE"))
    none = lambda d: F.coalesce(d, F.lit("")).isin("", "Closed")

    def minutes(d: Column) -> tuple[Column, Column, Column]:
        low = F.lower(d)
        ends = [_hour(low, _ANYWHERE, g, g + 2) * 60 + F.coalesce(F.regexp_extract(low, _ANYWHERE, g + 1).try_cast("int"), F.lit(0)) for g in (1, 4)]
        return low.rlike(_ANYWHERE), ends[0], ends[1]

    later: Column = F.lit("Closed today")
    for k in range(7, 0, -1):
        said, opens, _ = minutes(day(k))
        name = F.lit("tomorrow") if k == 1 else F.date_format(F.date_add(ts.cast("date"), k), "EEE")
        later = F.when(~none(day(k)) & said, F.concat(F.lit("Opens "), name, F.lit(" at "), clock(opens))).otherwise(later)
    now = F.hour(ts) * 60 + F.minute(ts)
    said, opens, closes = minutes(day(0))
    before, left = opens - now, closes - now
    short = lambda what, n: F.concat(F.lit(what), n.cast("string"), F.lit("m"))
    return (
        F.when(hours.isNull(), F.lit(None).cast("string")).when(none(day(0)), later).when(~said, day(0))
        .when(before > 0, F.when(before < 60, short("Opens in ", before)).otherwise(F.concat(F.lit("Opens at "), clock(opens))))
        .when(left > 0, F.when(left <= 30, short("Closes in ", left)).when(left <= 90, short("Closes in ", (F.floor(left / 30 + 0.5) * 30).cast("int"))).otherwise(F.concat(F.lit("Open until "), clock(closes))))
        .otherwise("Closed now")
    )


def seconds_between(earlier: Column, later: Column) -> Column:
    """Whole seconds between two times without a zone."""
    return F.timestamp_diff("SECOND", earlier, later)


def age_label(seconds: Column, just: bool = True) -> Column:
    """'just now' (or without it '0m ago'), '5m ago', '3h ago', '2d ago'."""
    unit = lambda n, mark: F.concat(F.floor(seconds / n).cast("string"), F.lit(mark))
    return (
        F.when(F.lit(just) & (seconds < 60), "just now").when(seconds < 3600, unit(60, "m ago")).when(seconds < 86_400, unit(3600, "h ago")).otherwise(unit(86_400, "d ago"))
    )


def day_key(text: Column) -> Column:
    """The day of a time kept as text, its first ten characters; null for an empty one."""
    return F.substring(F.nullif(text, F.lit("")), 1, 10)


def whole_minutes(seconds: Column) -> Column:
    return F.floor(seconds / 60 + 0.5).cast("long")


def stopwatch(seconds: Column) -> Column:
    """Minutes and seconds as 'm:ss'."""
    return F.concat(F.floor(seconds / 60).cast("string"), F.lit(":"), F.lpad((seconds % 60).cast("string"), 2, "0"))


def month_cells(first: Column) -> Column:
    """The 35 days of a month's sheet from the Monday on or before its first day; a sixth week is cut."""
    monday = F.date_sub(first, F.weekday(first))
    return F.transform(F.sequence(F.lit(0), F.lit(34)), lambda k: F.date_add(monday, k))
